"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from contextlib import suppress
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgrid.tables import new_path

#: One word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


_worker_caches: list = []


def worker_cache(make):
    """What make returns, once for each worker process and argument, until another stage frees it."""
    kept = lru_cache(maxsize=1)(make)
    _worker_caches.append(kept)
    return kept


def free_worker_caches() -> None:
    """Called where a stage's tasks begin that don't need what a worker process has kept of another stage."""
    for kept in _worker_caches:
        kept.cache_clear()
    give_back()


def give_back() -> None:
    """Returns to the system the memory that a worker process has freed, which allocators keep: workers of many stages live side by side."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of an Arrow batch at most: texts are long, and both sides of the pipe hold a batch whole.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, if there are more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it again.

    The plan's lineage ends there, the table outlives any executor, and what is joined with it
    starts at a scan of its own, so adaptive execution can split a skewed side.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value), where value is computed once a row."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """A text's words with one space between; empty if the text is null. Plain byte searches do most of it."""
    t = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    return let(t, lambda x: F.trim(F.when(x.contains("  "), F.regexp_replace(x, " {2,}", " ")).otherwise(x)))


def words(spaced_text: Column) -> Column:
    """The words of a spaced() text as an array."""
    return F.when(spaced_text == "", F.array().cast("array<string>")).otherwise(F.split(spaced_text, " "))


def count_words(text: Column) -> Column:
    """How many words a text has; 0 if it is null."""
    gaps = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return let(spaced(text), lambda x: F.when(x == "", F.lit(0)).otherwise(gaps(x))).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
