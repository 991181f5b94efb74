"""Tables and files in the folder that all executors share, and what Hadoop's file systems do to them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for the writes within is deleted when each has ended, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet and read back."""
    at = shared(df.sparkSession, name)
    with unshuffled(df.sparkSession):
        df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def released(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        removed(df.sparkSession, df._written_at)


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def removed(spark: SparkSession, path: str) -> None:
    fs, at = hadoop(spark, path)
    fs.delete(at, True)


def listed(spark: SparkSession, folder: str) -> list:
    """The visible files of a folder, in the order of their names."""
    fs, at = hadoop(spark, folder)
    found = [s.getPath() for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))] if fs.exists(at) else []
    return sorted(found, key=lambda p: p.getName())


def joined(spark: SparkSession, folder: str, target: str) -> None:
    """One file of the files of a folder, in the order of their names: complete under its name, or not there at all.

    Where the file system can chain files (HDFS) no byte is moved. Elsewhere they stream, a buffer at a time, and each goes
    as soon as it is in the new file, so that no more than one of them is there twice.
    """
    parts = listed(spark, folder)
    fs, to = hadoop(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(to.getParent())
    whole = path(to.getParent(), f".{to.getName()}-{uuid.uuid4().hex}")
    try:
        chain = spark.sparkContext._gateway.new_array(path, len(parts) - 1)
        for k, p in enumerate(parts[1:]):
            chain[k] = p
        fs.concat(parts[0], chain)
        fs.rename(parts[0], whole)
    except Exception as e:
        if "UnsupportedOperationException" not in str(e) and "not support" not in str(e):
            raise
        out = fs.create(whole, True)
        for p in parts:
            source = fs.open(p)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
            fs.delete(p, False)
        out.close()
    fs.delete(to, False)
    if not fs.rename(whole, to):
        raise OSError(f"{target} could not be renamed to its name")


def filesystem(uri: str):
    """pyarrow's file system for a path or address, for use within tasks, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if uri.startswith("file:") or "://" in uri else f"file://{uri}")
