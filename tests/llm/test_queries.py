import os
import sys

import pytest
from pyspark.sql import functions as F

from tracefold.llm import queries, tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.exists(tokens.VOCABULARY), reason="no test tables or vocabulary")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_query_runs_on_empty_tables(spark, tmp_path):
    from empty_tables import write_empty

    where = write_empty(spark, DATA, str(tmp_path))
    for name, query in queries.QUERIES.items():
        assert query(spark, where).count() == 0, name


def test_every_query_runs_with_nulls_in_every_column(spark, tmp_path):
    """A fifth of the cells of every column are null, and a third of the rows come twice."""
    tables = ["frame_scan", "sample_plan", "ocr_observations", "documents", "eval_items", "match_reference", "parser_regression"]
    for table in tables:
        df = spark.read.parquet(f"{DATA}/{table}.parquet")
        df = df.select(*[F.when(F.pmod(F.xxhash64(F.to_json(F.struct("*")), F.lit(c)), F.lit(5)) > 0, F.col(c)).alias(c) for c in df.columns])
        df = df.union(df.where(F.pmod(F.xxhash64(df.columns[0]), F.lit(3)) == 0))
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    spark.read.parquet(f"{DATA}/size_limits.parquet").write.parquet(f"{tmp_path}/size_limits.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() >= 0, name
    for name in ("p2_found", "p3_found", "p6_found", "p8_found", "p9_pieces"):
        rows = queries.QUERIES[name](spark, str(tmp_path))
        assert 0 < rows.count(), name
