"""Folders and small files of any file system that Spark reads, by Hadoop's own interface."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in order."""
    fs, at = _fs(spark, pattern)
    return sorted(str(s.getPath()) for s in fs.globStatus(at) or [])


def stamped(spark: SparkSession, pattern: str) -> list[str]:
    """Path, length and time of the files that match a pattern, and of those directly in folders that do."""
    fs, at = _fs(spark, pattern)
    found = list(fs.globStatus(at) or [])
    inner = [s for f in found if f.isDirectory() for s in fs.listStatus(f.getPath())]
    return sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in [*found, *inner])


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a path."""
    fs, at = _fs(spark, path)
    return fs.getContentSummary(at).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file that appears whole or not at all; FileExistsError if there is one of that name."""
    fs, at = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{spark._jvm.java.util.UUID.randomUUID()}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(at) or not fs.rename(aside, at):
        fs.delete(aside, True)
        raise FileExistsError(path)


@dataclass(frozen=True)
class Staged:
    """A frame that was written aside."""

    frame: DataFrame
    path: str

    def discard(self) -> None:
        delete(self.frame.sparkSession, self.path)


def staged(spark: SparkSession, df: DataFrame, folder: str) -> Staged:
    """``df`` written below a folder and read back: what is used several times is made once."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Staged(spark.read.schema(df.schema).parquet(path), path)
