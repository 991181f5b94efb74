"""Small helpers shared by the text and vector operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: A word is a run of anything but ASCII white space, as the contracts state it.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one where it is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("framewell.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("framewell.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """stored(), and what was shuffled for it is deleted as soon as the table is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


def released(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs whose ids are among the wanted ones, and some others: marks of bounded size, no shuffle of docs."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << 26))
    place, drawer = (slot % 32768).cast("long"), F.floor(slot / 32768)
    marks = wanted.select(drawer.alias("drawer"), place.alias("place")).groupBy("drawer").agg(F.bitmap_construct_agg("place").alias("bits"))
    # 2048 rows of 4 kB at most
    both = docs.withColumns({"drawer": drawer, "place": place}).join(F.broadcast(marks), "drawer")
    byte = F.conv(F.hex(F.substring("bits", (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return both.where(F.call_function("shiftright", byte, (F.col("place") % 8).cast("int")).bitwiseAND(1) == 1).select(*docs.columns)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between numbers, (root, member) of each member but the root of every group that they connect."""
    if not len(a):
        return a[:0], b[:0]
    used, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(used))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(len(used)))
    return used[root[member]], used[member]


def carried(cols: list[str]) -> Column:
    """The columns as one struct called row, so that no name of theirs can clash with an operator's own."""
    return F.struct(F.lit(True).alias("0"), *(F.col(f"`{c}`").alias(str(i + 1)) for i, c in enumerate(cols))).alias("row")


def restored(cols: list[str]) -> list[Column]:
    """The columns out of that struct again."""
    return [F.col(f"row.`{i + 1}`").alias(c) for i, c in enumerate(cols)]


def with_fields(*fields: StructField | tuple[str, str]) -> StructType:
    """A schema of fields, or of names and types in words."""
    return StructType([f if isinstance(f, StructField) else StructField(f[0], DataType.fromDDL(f[1])) for f in fields])


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; fold 2 is held out from learning. A null doc_id has no fold and is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the fold that no learning sees; false for a null id."""
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))


def tasks(df: DataFrame) -> int:
    """Shuffle partitions the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task, which in the end gives freed memory back to the system, as its Python process waits for the next one."""

    def tidy(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return tidy


def field(batch, column: str | int):
    """A column of a batch by its name, or by its number in the struct that `carried` makes."""
    return batch.column(column) if isinstance(column, str) else batch.column("row").field(column)


def slices(batches: Iterator, column: str | int, most: int = 4 << 20) -> Iterator:
    """Cut Arrow batches into slices that hold about `most` bytes of text, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(field(batch, column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
