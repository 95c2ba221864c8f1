"""Guards on the physical plans of all queries, without running them."""

import glob
import os
import re

import pytest

import __spark_entry__ as entry
from tracefold.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if not n.startswith("stream_")))
def test_no_cross_joins_and_pruned_scans(spark, name):
    text = plan(catalogue.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for table in ("documents", "frame_scan"):
        whole = set(spark.read.parquet(f"{DATA}/{table}.parquet").columns)
        for scan in re.findall(rf"FileScan parquet \[([^\]]*)\][^\n]*{table}\.parquet", text):
            read = {c.split("#")[0] for c in scan.split(",")}
            assert read < whole, f"{table} is read whole"


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["replay_id", "root", "n_events", "start_time", "end_time", "confidence", "kinds", "status"]
    assert df.count() > 0


def test_sql_agrees_on_small_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")

    def rows(records):
        return sorted(repr([None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in records)

    for name in ("p4_found", "p4_periods", "threshold_intervals", "resample_nearest", "asof_latest_hp", "group_rollup", "centred_median", "gap_distribution", "quality_report"):
        df = catalogue.QUERIES[name](spark, DATA)
        cols = sorted(df.columns)
        got = rows(df.select(*cols).collect())
        want = rows(con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalogue.SQL[name]})").fetchall())
        assert got == want, name
