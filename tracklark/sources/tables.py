"""Readers of the driver tables and of raw recordings' files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, t (microseconds), cents (value as an integer), value."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", "event_type", micros("ts").alias("t"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"), "value")


def tolerant_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON files with status ok or malformed; a malformed row keeps its text in _corrupt and never fails the read."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("status", F.when(F.col("_corrupt").isNull(), "ok").otherwise("malformed"))


def file_identities(spark: SparkSession, path: str) -> DataFrame:
    """name, size and SHA-256 of files, without parsing them; files are read by the executors one by one."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def presence(rows: DataFrame) -> DataFrame:
    """field, n_rows, n_present: how often each column holds a value."""
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in rows.columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_present")) for c in rows.columns))).alias("x")
    return counts.select(pairs, F.col("_n").alias("n_rows")).select("x.field", "n_rows", "x.n_present")
