import glob
import os

import pytest
from empty_tables import write_empty
from pyspark.sql import functions as F

from tracefold.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: These report on keys that are fixed, so they have rows on empty tables.
FIXED = {"set_operations": 4, "rule_coverage": 6, "fixed_key_counts": 4, "quality_report": 6, "fact_gates": 7, "derived_boxes": 12}


def test_every_query_runs_on_empty_tables(spark, tmp_path):
    where = write_empty(spark, DATA, str(tmp_path))
    for name, query in catalogue.QUERIES.items():
        assert query(spark, where).count() == FIXED.get(name, 0), name


def test_every_query_runs_with_nulls_in_every_column(spark, tmp_path):
    """A fifth of the cells of every column are null, and a third of the rows come twice."""
    for path in glob.glob(f"{DATA}/*.parquet"):
        df = spark.read.parquet(path)
        df = df.select(*[F.when(F.pmod(F.xxhash64(F.to_json(F.struct("*")), F.lit(c)), F.lit(5)) > 0, F.col(c)).alias(c) for c in df.columns])
        df = df.union(df.where(F.pmod(F.xxhash64(df.columns[0]), F.lit(3)) == 0))
        df.write.parquet(f"{tmp_path}/{os.path.basename(path)}")
    for name, query in catalogue.QUERIES.items():
        assert query(spark, str(tmp_path)).count() >= 0, name
