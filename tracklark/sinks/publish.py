"""GeoJSON documents and versioned publication of tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINTER = "run_id string, manifest string"


def line_features(points: DataFrame, keys: list[str], order: str, lon: str, lat: str) -> DataFrame:
    """keys, feature: a GeoJSON LineString of each key's points in order; keys with fewer than two valid points are left out."""
    valid = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), F.col(lon).alias("x"), F.col(lat).alias("y"))))
    lines = valid.groupBy(*keys).agg(ordered.alias("p")).filter(F.size("p") >= 2)
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda q: F.array(q["x"], q["y"])).alias("coordinates"))
    properties = F.struct(*keys) if keys else F.create_map()
    return lines.select(*keys, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class StaleToken(RuntimeError):
    """Another publisher has taken a later token."""


def newest_token(spark: SparkSession, root: str) -> int:
    """The largest token that has been taken below root, 0 before the first."""
    fs, folder = _fs(spark, f"{root}/tokens")
    return max((int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()), default=0) if fs.exists(folder) else 0


def fencing_token(spark: SparkSession, root: str) -> int:
    """Takes the next token: a file that did not exist before. Creating it is one step of the file system, so of several publishers that
    want the same number one gets it and the others go on to the next. Needs a file system whose createNewFile is atomic."""
    token = newest_token(spark, root) + 1
    while True:
        fs, path = _fs(spark, f"{root}/tokens/{token:012d}")
        fs.mkdirs(path.getParent())
        if fs.createNewFile(path):
            return token
        token += 1


def publish(tables: dict[str, DataFrame], root: str, run_id: str | None = None, token: int | None = None) -> str:
    """Writes the tables to a staging folder, checks their rows against what was written, renames it to runs/<id>, and then adds the pointer
    file pointers/<time>-<id>, which one rename brings in: readers take the last one, so they see a whole run or the one before at any
    moment. The run's folder must be new. Works on any file system that Spark writes to.

    With a token (of fencing_token), StaleToken is raised in place of the pointer if a later one has been taken meanwhile: a publisher
    that stalled can't put its run over that of its successor. Its run stays in runs/, which no pointer names."""
    spark = next(iter(tables.values())).sparkSession
    run_id = run_id or uuid.uuid4().hex
    staging, final = f"{root}/staging/{run_id}", f"{root}/runs/{run_id}"
    fs, target = _fs(spark, final)
    if fs.exists(target):
        raise ValueError(f"run {run_id} is published already")
    manifest = []
    for name, df in sorted(tables.items()):
        seen = Observation(uuid.uuid4().hex)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{staging}/{name}")
        rows = spark.read.parquet(f"{staging}/{name}").count()
        if rows != seen.get["n"]:
            raise OSError(f"{name}: {seen.get['n']} rows were written and {rows} read")
        manifest.append({"table": name, "rows": rows})
    fs.mkdirs(target.getParent())
    if not fs.rename(_fs(spark, staging)[1], target):
        raise OSError(f"could not move {staging}")
    row = spark.createDataFrame([(run_id, json.dumps(manifest, sort_keys=True))], POINTER)
    row.coalesce(1).write.json(f"{root}/staging/pointer-{run_id}")
    fs.mkdirs(_fs(spark, f"{root}/pointers")[1])
    if token is not None and newest_token(spark, root) > token:
        raise StaleToken(f"run {run_id} holds token {token}, and token {newest_token(spark, root)} has been taken")
    if not fs.rename(_fs(spark, f"{root}/staging/pointer-{run_id}")[1], _fs(spark, f"{root}/pointers/{time.time_ns():020d}-{run_id}")[1]):
        raise OSError(f"could not point to {run_id}")
    return run_id


def pointers(spark: SparkSession, root: str) -> list[str]:
    """The names of the pointers, oldest first; the last one counts."""
    fs, folder = _fs(spark, f"{root}/pointers")
    return sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table of the run that the last pointer names."""
    run_id = spark.read.schema(POINTER).json(f"{root}/pointers/{pointers(spark, root)[-1]}").first()["run_id"]
    return spark.read.parquet(f"{root}/runs/{run_id}/{table}")


def quarantine(spark: SparkSession, root: str, run_id: str) -> None:
    """Moves a published run out of the way; its pointers go first, so that readers fall back to the run before."""
    for name in pointers(spark, root):
        if name.partition("-")[2] == run_id:
            fs, path = _fs(spark, f"{root}/pointers/{name}")
            fs.delete(path, True)
    fs, source = _fs(spark, f"{root}/runs/{run_id}")
    target = _fs(spark, f"{root}/quarantine/{run_id}")[1]
    fs.mkdirs(target.getParent())
    fs.rename(source, target)


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str], valid) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (existing ones and valid new ones with new keys) and rejected rows with a code. Never updates."""
    known = existing.select(*keys).distinct().withColumn("_has", F.lit(True))
    # Of several valid new rows with one key the first by its content is taken, the others are duplicates too.
    place = F.row_number().over(W.partitionBy(*keys, F.coalesce(valid, F.lit(False))).orderBy(F.to_json(F.struct(*sorted(new.columns)))))
    marked = new.withColumn("_place", place).join(known, keys, "left")
    code = F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.col("_has") | (F.col("_place") > 1), "duplicate")
    marked = marked.withColumn("code", code).drop("_has", "_place")
    return existing.unionByName(marked.filter("code is null").drop("code")), marked.filter("code is not null")
