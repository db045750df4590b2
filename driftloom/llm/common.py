"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

#: What separates words: ASCII white space and nothing else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Paths made in the open ``scratch`` blocks, the innermost last.
_scopes: list[list[str]] = []


def work_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path below the shared folder; ``keep``: it belongs to the scope around the innermost."""
    path = f"{shared.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(path)
    return path


def stored(df: DataFrame, name: str, few: bool = False, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, read again.

    Shuffle files stay until the driver collects the plan that made them, and a large input
    gives the driver no more garbage than a small one, hence the collection here.
    """
    spark = df.sparkSession
    path = work_path(spark, name, keep)
    out = shared.stored(df, name, few, path)
    out.stored_at = path
    spark.sparkContext._jvm.System.gc()
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    _delete(table.sparkSession, table.stored_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within it is deleted at its end, but for what was stored with ``keep``: only that may be read later."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def file_system(uri: str):
    """What ``pyarrow.fs`` opens a URI with, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, Python gets at most ``rows`` rows at a time, so that Arrow's buffers on both sides stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(batches: Iterator) -> Iterator:
    """A task's batches, after which its worker, which lives on, gives freed memory back to the system."""
    yield from batches
    give_back()


def give_back() -> None:
    """This process's freed memory goes back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trim(spark: SparkSession) -> None:
    """Executors give heap that earlier steps filled back to the system, for the Python workers beside them."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc")).write.format("noop").mode("overwrite").save()


def refresh(spark: SparkSession) -> None:
    """The driver lets go of finished jobs; both its processes give freed memory back."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator, most: int = 1000) -> Iterator:
    """Batches of at most ``most`` rows, so that what is made of them stays small."""
    for pdf in batches:
        for a in range(0, len(pdf), most):
            yield pdf.iloc[a : a + most]


def as_row(columns: list[str]) -> Column:
    """Columns as one, ``row``, so that none of their names can clash with those that an operator makes."""
    return F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row")


def of_row(columns: list[str], **new: Column) -> list[Column]:
    """The columns of ``as_row`` again, those in ``new`` replaced."""
    return [new.get(c, F.col("row").getField(f"c{i}")).alias(c) for i, c in enumerate(columns)]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of ``text``; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of ``text`` as long, without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
