"""Empty copies of all test tables, for tests of queries on nothing."""

import glob
import os


def write_empty(spark, source: str, target: str) -> str:
    for path in glob.glob(f"{source}/*.parquet"):
        spark.read.parquet(path).limit(0).write.parquet(f"{target}/{os.path.basename(path)}")
    return target
