"""Readers: typed JSON, JSONL and CSV, pages and object literals by pattern, images by magic bytes, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# First bytes of the image formats told apart.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "webp": "52494646"}


def json_object(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object a file, under a given schema; malformed files fail."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def artifact(spark: SparkSession, path: str, rows: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """An envelope file: its scalar fields as one row, and the array ``rows`` as a table (array position in ``_pos``)."""
    whole = json_object(spark, path, schema)
    table = whole.select(F.posexplode(rows).alias("_pos", "_row")).select("_pos", "_row.*")
    return whole.drop(rows), table


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines under a given schema; without ``strict`` bad lines are kept in ``_corrupt``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return spark.read.schema(T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def jsonl_if_present(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``jsonl``; an empty table where there is no file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return jsonl(spark, path, schema) if exists else spark.createDataFrame([], schema)


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, all columns as strings, a byte-order mark allowed."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")
    return df.select(*columns)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``path, value``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def scrape(df: DataFrame, text: str, pattern: str, names: list[str]) -> DataFrame:
    """One row per match of ``pattern`` with a column for each group, in order (``_pos``), entities decoded."""
    decode = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    kept = [c for c in df.columns if c != text]
    hits = df.select(*kept, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).alias("_pos", "_hit"))
    return hits.select(*kept, "_pos", *[decode(F.regexp_extract("_hit", pattern, i)).alias(n) for i, n in enumerate(names, 1)])


def literal_fields(df: DataFrame, text: str, block: str, fields: dict[str, str]) -> DataFrame:
    """Object literals ``key: {...}`` by pattern: ``key`` and one column per field pattern; the first block of a key counts."""
    rows = scrape(df, text, block, ["key", "body"])
    first = rows.groupBy("key").agg(F.min_by("body", "_pos").alias("body"))
    return first.select("key", *[F.nullif(F.regexp_extract("body", p, 1), F.lit("")).alias(n) for n, p in fields.items()])


def image_kind(content: Column) -> Column:
    """The format that the first bytes tell, null if unknown."""
    head = F.hex(F.substring(content, 1, 8))
    out = None
    for kind, magic in MAGIC.items():
        out = F.when(head.startswith(magic), kind) if out is None else out.when(head.startswith(magic), kind)
    return out


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with the format told by content and by name, and whether they agree."""
    df = spark.read.format("binaryFile").load(path)
    by_name = F.regexp_replace(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)), "^jpg$", "jpeg")
    return df.select("path", "length", image_kind(F.col("content")).alias("kind"), by_name.alias("named")).withColumn("agrees", F.col("kind").eqNullSafe(F.col("named")))


def catalogue(spark: SparkSession, root: str, pattern: str, names: list[str]) -> DataFrame:
    """Files under ``root`` (listed, not read) with the groups of ``pattern`` in their paths."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return df.where(F.col("path").rlike(pattern)).select("path", "length", *[F.regexp_extract("path", pattern, i).alias(n) for i, n in enumerate(names, 1)])


def recognise(jobs: DataFrame, engine, schema: str) -> DataFrame:
    """Jobs sent in batches to a recognition engine: ``engine(pandas) -> pandas``; errors are the engine's to report per row."""
    return jobs.mapInPandas(lambda batches: (engine(b) for b in batches), schema)


def index_gates(df: DataFrame, keys: list[str], ordinal: str, time: str) -> DataFrame:
    """Violations of an index of frames, ``keys, ordinal, gate``: ordinals must follow each other (``missing_before``) from 0,
    and times must grow strictly (``not_after``)."""
    from tracefold.operators.sequence import lagged

    rows = lagged(df.select(*keys, ordinal, time), keys, [ordinal], F.floor(F.col(ordinal) / 4096), {"_o": F.col(ordinal), "_t": F.col(time)})
    gates = F.array_compact(F.array(F.when(F.col(ordinal) != F.coalesce("_o", F.lit(-1)) + 1, "missing_before"), F.when(F.col("_t").isNotNull() & ~F.coalesce(F.col(time) > F.col("_t"), F.lit(False)), "not_after")))
    return rows.select(*keys, ordinal, F.explode(gates).alias("gate"))


def tree_files(df: DataFrame, text: str) -> DataFrame:
    """``path`` of every file in tree listings (JSON with ``tree: [{path, type}]``), each once; malformed listings have none."""
    tree = F.from_json(F.col(text), "tree array<struct<path: string, type: string>>")["tree"]
    return df.select(F.explode(tree).alias("x")).where("x.type = 'blob'").select("x.path").distinct()
