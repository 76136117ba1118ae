"""Queries over the test tables and their SQL twins."""

from __future__ import annotations

from . import detection, features, records

QUERIES: dict = dict(sorted((detection.QUERIES | features.QUERIES | records.QUERIES).items()))
ORACLE: dict[str, str] = detection.ORACLE | features.ORACLE | records.ORACLE
