"""Session, table and text helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.session import cut, shared_dir

__all__ = ["byte_view", "cut", "discard", "known", "numbered", "odd_ids", "per_batch", "release", "releasing", "reported", "scratch", "shared_dir", "single_threaded", "sliced", "table", "texts_of", "tokenizer_path", "tokenizer_pattern", "utf8", "written"]

#: Tables that ``written`` has left in the shared folder and nothing has deleted yet.
_LEFT: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as a table in the shared folder and read back from it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _LEFT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that ``written`` left; what still reads them must have been written itself."""
    fs = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = fs(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _LEFT.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope for intermediate tables: at its end all that were written inside go, but those kept by the given function."""
    first, kept = len(_LEFT), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        kept.append(_LEFT[-1])
        return out

    yield keep
    discard(spark, [p for p in _LEFT[first:] if p not in kept])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256, mb: int = 4) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so few rows and megabytes that what a function makes of long texts stays small.

    Spark's own batches are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``; operators
    slice these and leave the session's settings alone.
    """
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(rows, n * (mb << 20) // max(1, batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


#: Rows of one partition that ``numbered`` can number.
ROWS = 1 << 40


def odd_ids(rows: DataFrame) -> bool:
    """Whether a doc_id is null or repeated."""
    return not rows.groupBy("doc_id").count().filter(F.col("doc_id").isNull() | (F.col("count") > 1)).isEmpty()


def known(doc_id: Column) -> Column:
    """An id that is never null, in a form that shows it: joins then add no filter, and can share a shuffle."""
    return F.coalesce(doc_id, F.lit(0))


def numbered(rows: DataFrame, each: bool = False) -> DataFrame:
    """(doc, data, others) of rows (doc_id, data, others): a number of each document, in their order.

    Distinct ids are numbers already. Otherwise all rows are dealt by ranges of doc_id (null first),
    the text's hash and a tie, then numbered within their partition and written, so that every
    reader sees the same numbers. Rows that repeat doc_id and text share a number, those without a
    doc_id never do; with ``each``, every row has its own.
    """
    others = [c for c in rows.columns if c not in ("doc_id", "data")]
    if not odd_ids(rows):
        return rows.select(known(F.col("doc_id")).alias("doc"), "data", *others)
    spark = rows.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("tie")]
    tie = F.monotonically_increasing_id() if each else F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    keyed = rows.select("doc_id", "data", *others, F.sha2("data", 256).alias("hash"), tie.alias("tie"))
    dealt = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        at, last = TaskContext.get().partitionId() * ROWS - 1, None
        for batch in batches:
            numbers = []
            for key in zip(*(c.to_pylist() for c in batch.columns[-2:]), batch.column(0).to_pylist()):
                at += key != last
                last = key
                numbers.append(at)
            columns = [pa.array(numbers, pa.int64()), *batch.columns[1:-2]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "data", *others])

    schema = StructType([StructField("doc", LongType()), *(rows.schema[c] for c in ("data", *others))])
    return written(dealt.mapInArrow(releasing(run), schema), "numbered")


def reported(found: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """What was ``found`` by numbers (column, component_id, kept, others) by the ids (column, id) that the numbers stand for.

    A component is named by its least id. One without any has none, and keeps its first number.
    """
    order = found.columns
    known = found.join(ids.distinct(), column)
    named = known.groupBy("component_id").agg(F.min("id").alias("named"))
    kept = F.when(F.col("named").isNull(), F.col("kept")).otherwise(F.col("id").eqNullSafe(F.col("named")))
    stated = {column: F.col("id"), "component_id": F.col("named"), "kept": kept}
    return known.join(named, "component_id").select(*[stated.get(c, F.col(c)).alias(c) for c in order])


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text, none for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def release() -> None:
    """Gives a worker's free memory back to the system: workers are kept, and others on the machine need it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def releasing(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, with the worker's free memory given back when a task ends."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return held


def per_batch(fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 256, mb: int = 4) -> Callable:
    """A ``mapInArrow`` function from one that returns columns for a slice of a record batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows, mb):
            got = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return releasing(run)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, '' for null."""
    return [t or "" for t in column.to_pylist()]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column in one array, and the n + 1 offsets."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokenizer_path(name: str) -> str:
    """The default place of a vocabulary file; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def single_threaded() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
