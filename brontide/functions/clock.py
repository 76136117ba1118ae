"""Clock texts, wrapped differences, candidate lists and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86_400
_CLOCK = r"^(\d{1,2})[.:](\d{1,2})[.:](\d{1,2})$"


def clock_seconds(raw: Column, strict: bool = True) -> Column:
    """h.m.s, each of one or two digits and parted by . or :, to seconds of the day. Anything else
    stops the job, or gives null if not ``strict``."""
    text = F.trim(raw)
    h, m, s = (F.try_to_number(F.nullif(F.regexp_extract(text, _CLOCK, i), F.lit("")), F.lit("99")).cast("int") for i in (1, 2, 3))
    fits = F.rlike(text, F.lit(_CLOCK)) & (h < 24) & (m < 60) & (s < 60)
    bad = F.raise_error(F.concat(F.lit("not a clock time: "), F.coalesce(raw, F.lit("null")))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(F.coalesce(fits, F.lit(False)), h * 3600 + m * 60 + s).otherwise(bad)


def relative_seconds(clock: Column, start: Column) -> Column:
    """Seconds from start to clock, over midnight if need be."""
    return F.pmod(clock - start, F.lit(DAY_S))


def signed_difference(a: Column, b: Column) -> Column:
    """a - b within half a day either way."""
    return F.pmod(a - b + DAY_S // 2, F.lit(DAY_S)) - DAY_S // 2


def lenient_relative(clock: Column, start: Column) -> Column:
    """The older rule: a day is added only to differences below minus half a day."""
    d = clock - start
    return F.when(d < -DAY_S // 2, d + DAY_S).otherwise(d)


#: The notes that a candidate may carry, and the kinds they stand for.
NOTES = {"clinical onset": "clinical", "electric onset": "electrographic", "electrographic onset": "electrographic", "": "unspecified"}


def candidates(raw: Column) -> Column:
    """Several clock times in one field, parted by ; or the word opure: array of (raw_clock,
    clock_s, kind). Entries that are no clock time, alone or with a known note, stop the job."""
    shape = r"^\s*(\d{1,2}[.:]\d{1,2}[.:]\d{1,2})\s*(?:\(([^()]*)\))?\s*$"
    kinds = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])

    def one(part: Column) -> Column:
        raw_clock, note = F.regexp_extract(part, shape, 1), F.lower(F.regexp_extract(part, shape, 2))
        kind = F.when(~F.contains(part, F.lit("()")), F.try_element_at(kinds, note))
        known = F.when(kind.isNotNull(), raw_clock).otherwise(F.concat(F.lit("candidate "), part))
        return F.struct(raw_clock.alias("raw_clock"), clock_seconds(known).alias("clock_s"), kind.alias("kind"))

    return F.transform(F.split(raw, r"(?i);|\bopure\b", -1), one)


def primary_candidate(c: Column) -> Column:
    """The first clinical candidate, or else the first."""
    return F.coalesce(F.get(F.filter(c, lambda x: x["kind"] == "clinical"), F.lit(0)), F.get(c, F.lit(0)))


def lenient_clock(text: Column) -> Column:
    """The older reading: the first three numbers parted by . or : anywhere in the text, with blanks
    inside numbers left out; null without them or if they are no time of the day."""
    closed = F.regexp_replace(text, r"(?<=\d)\s+(?=\d)", "")
    found = F.nullif(F.regexp_extract(closed, r"(\d{1,2}\s*[.:]\s*\d{1,2}\s*[.:]\s*\d{1,2})", 1), F.lit(""))
    return clock_seconds(F.regexp_replace(found, r"\s+", ""), strict=False)


def check_interval(onset: Column, offset: Column, duration: Column) -> Column:
    """True, or the job stops: 0 <= onset < offset <= duration."""
    ok = F.coalesce((onset >= 0) & (onset < offset) & (offset <= duration), F.lit(False))
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("invalid interval")).cast("boolean"))


def block_field(block: Column, name: str) -> Column:
    """The text after ``name:`` at the start of a line, or null."""
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?im)^\s*{name}:[ \t]*([^\r\n]+)", 1)), F.lit(""))


def channel_label(raw: Column) -> Column:
    """Channel names compare without blanks, case and the EEG prefix."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(raw)), "^EEG ", ""), r"\s+", "")
