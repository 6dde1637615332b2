"""Intermediate tables in the folder that all executors share.

A stage cuts the lineage and survives the loss of an executor, since its files live in the directory named by
``spark.checkpoint.dir``. Only where that setting is absent (tests, a laptop) a temporary directory is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="ledgerleaf-"))
    return _local[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a new stage that no other query uses."""
    path = f"{shared_dir(spark)}/ledgerleaf/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete all stages of this process, for jobs that have written their results; gives their number."""
    n = len(_made)
    while _made:
        drop(spark, _made.pop())
    return n


def stage(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet, with further write options, into the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stage that no later step reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _file(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the shared folder, written whole: under another name first, then renamed, which replaces the old one."""
    at, fs = _file(spark, path)
    new = _file(spark, f"{path}.{uuid.uuid4().hex}")[0]
    stream = fs.create(new)
    stream.write(text.encode())
    stream.close()
    fs.delete(at, False)
    fs.rename(new, at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if it is not there."""
    at, fs = _file(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
