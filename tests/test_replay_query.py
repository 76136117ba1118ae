"""The replay query makes its matches once."""

import duckdb

from brontide.plans import catalog
from brontide.plans import detection as D

SF = "/root/testdata/sf0.001"


def test_matches_are_made_once_and_equal_to_sql(spark, monkeypatch):
    seen, differences = [], D.Y.differences
    monkeypatch.setattr(D.Y, "differences", lambda made, kept, *a: seen.extend([made, kept]) or differences(made, kept, *a))
    df = catalog.QUERIES["q67_replay"](spark, SF)
    assert len(seen) == 2 and all("Window" not in d._jdf.queryExecution().optimizedPlan().toString() for d in seen)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    rel = con.sql(catalog.ORACLE["q67_replay"])
    want = sorted((tuple(r[rel.columns.index(n)] for n in df.columns) for r in rel.fetchall()), key=repr)
    assert want and sorted(map(tuple, df.collect()), key=repr) == want
