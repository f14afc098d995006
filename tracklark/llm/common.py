"""What the operators of this subpackage share: shared tables, Arrow batches balanced by bytes, unit caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes that one step of a numpy or tokenizer loop takes at once.
STEP_BYTES = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one (tests,
    benchmarks); on a cluster that is an error, as a machine's own folder is none that others see."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


#: For each running written(): the tables that cut has made in it.
_made: list[list[DataFrame]] = []


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tracklark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _made:
        _made[-1].append(out)
    return out


def written(make: Callable[[], DataFrame]) -> DataFrame:
    """cut(make()), without the tables that make has cut on the way."""
    _made.append([])
    try:
        out = cut(make())
    finally:
        used = _made.pop()
    discard(*(df for df in used if df is not out))
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables made by cut, once everything that is read from them has been written elsewhere. This and the publication go
    through the JVM's file system, so they need a classic session, not Spark Connect."""
    for df in tables:
        if df is not None:
            for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
                if "/tracklark-" in folder:
                    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and the text, null as empty; other columns of docs do not matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The whole row as _row beside the named columns, so that columns added on the way can't clash with those of docs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *names)


def unpacked(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs, in order, of rows made by packed(docs); those in new are replaced."""
    return df.select(*(new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def pieces_by_bytes(sizes: Iterable[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of rows whose sizes sum to at most limit; a larger row stands alone."""
    a, total, b = 0, 0, 0
    for b, n in enumerate(sizes):
        if b > a and total + n > limit:
            yield a, b
            a, total = b, 0
        total += n
    if sizes:
        yield a, b + 1


def per_batch(df: DataFrame, schema: str, f: Callable[[list, list], dict[str, list]]) -> DataFrame:
    """Maps rows (doc_id, text) by f(ids, texts) -> columns, over Arrow batches cut at STEP_BYTES."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pa.compute.binary_length(texts).to_pylist()
            for a, b in pieces_by_bytes(sizes):
                out = f(ids.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist())
                kinds = kinds or arrow_types(schema)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=k) for n, k in zip(names, kinds, strict=True)], names=names)

    import pyarrow.compute  # noqa: F401

    return df.mapInArrow(run, schema)


def arrow_types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return [kinds[x.split()[1]] for x in schema.split(", ")]


class Cache(dict):
    """unit -> value, emptied when it holds most entries, so that a worker's memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def room(self, n: int) -> None:
        if len(self) + n > self.most:
            self.clear()
