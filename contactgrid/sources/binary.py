"""Binary read pairs, little-endian records of fixed length."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgrid.sources.container import _file

#: The records of the two formats.
LONG = np.dtype([("strand1", "?"), ("chr1", "<i4"), ("pos1", "<i4"), ("frag1", "<i4"), ("strand2", "?"), ("chr2", "<i4"), ("pos2", "<i4"), ("frag2", "<i4")])
SHORT = np.dtype([("chr1", "<i4"), ("pos1", "<i4"), ("chr2", "<i4"), ("pos2", "<i4"), ("score", "<f4")])
#: The records of a dump of cells.
CELL = np.dtype([("x", "<i4"), ("y", "<i4"), ("value", "<f4")])
#: Records of a piece of a longer row of them.
PIECE_RECORDS = 100
#: Bytes of short ranges that make a batch together.
BATCH_BYTES = 1 << 20
_SQL = {"b": "boolean", "i": "int", "f": "float"}


def _schema(kind: np.dtype) -> str:
    return ", ".join(f"{n} {_SQL[kind[n].kind]}" for n in kind.names)


def decode_records(blobs: DataFrame, kind: np.dtype) -> DataFrame:
    """Pairs from rows with whole records in ``content``, which are cut into pieces first, so that a batch of rows is bounded whatever their length."""
    width = PIECE_RECORDS * kind.itemsize
    numbers = F.sequence(F.lit(0), F.floor((F.length("content") - 1) / width).cast("int"))
    pieces = blobs.where(F.length("content") > 0).select(F.explode(F.transform(numbers, lambda k: F.substring(F.col("content"), k * width + 1, F.lit(width)))).alias("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(np.frombuffer(b"".join(f["content"]), kind))

    return pieces.mapInPandas(run, _schema(kind))


def encode_records(pairs: DataFrame, kind: np.dtype) -> DataFrame:
    """Rows with whole records in ``content``, one for each batch of pairs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.zeros(len(f), kind)
            for n in kind.names:
                out[n] = f[n]
            yield pd.DataFrame({"content": [out.tobytes()]})

    return pairs.select(*kind.names).mapInPandas(run, "content binary")


#: Records of a range of a file; a task is dealt about as many, in one range or several. Up to so many ranges a core are tasks of their own.
SPLIT_RECORDS, CORE_RANGES = 1 << 20, 4


def record_splits(spark: SparkSession, path: str, width: int, records: int = SPLIT_RECORDS) -> DataFrame:
    """The byte ranges of files of fixed-length records, at multiples of their length: path, at, size. A rest that isn't a whole record goes."""
    files = spark.read.format("binaryFile").load(path).select("path", F.floor(F.col("length") / width).alias("n")).where("n > 0")  # contents aren't read
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(records).cast("long"))).alias("first")
    ranges = files.select("path", "n", first)
    return ranges.select("path", (F.col("first") * width).alias("at"), (F.least(F.lit(records), F.col("n") - F.col("first")) * width).alias("size"))


def read_records(spark: SparkSession, path: str, kind: np.dtype, records: int = SPLIT_RECORDS) -> DataFrame:
    """Records of one file or many, dealt to tasks by ranges: a file of any size is many tasks'. Paths are of file systems that pyarrow knows.

    Many short ranges share tasks: there are as many as the records ask for, not one a range.
    """
    splits = record_splits(spark, path, kind.itemsize, records)
    count, size = splits.agg(F.count(F.lit(1)), F.sum("size")).first()
    cores = spark.sparkContext.defaultParallelism
    n = max(1, count if count <= CORE_RANGES * cores else min(count, max(cores, -(-(size or 0) // (SPLIT_RECORDS * kind.itemsize)))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, ranges in f.groupby("path", sort=False):
                # Spark shows local files with one slash
                with _file(re.sub("^file:/+", "file:///", name)) as source:
                    held: list[bytes] = []
                    for r in ranges.itertuples(index=False):
                        held.append(source.read_at(int(r.size), int(r.at)))
                        if sum(map(len, held)) >= BATCH_BYTES:
                            yield pd.DataFrame(np.frombuffer(b"".join(held), kind))
                            held = []
                    if held:
                        yield pd.DataFrame(np.frombuffer(b"".join(held), kind))

    return splits.repartition(n, "path", "at").mapInPandas(run, _schema(kind))


def read_binary_pairs(spark: SparkSession, path: str, records: int = SPLIT_RECORDS) -> DataFrame:
    """Files of .bin or .bn records."""
    return read_records(spark, path, SHORT if path.rstrip("*/").endswith(".bn") else LONG, records)


def write_records(pairs: DataFrame, path: str, kind: np.dtype, ending: str) -> None:
    """A folder of files of records, one a task, on a file system that driver and executors share; a task that is run again writes its file anew."""
    os.makedirs(path, exist_ok=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"{path}/part-{TaskContext.get().partitionId():06d}"
        n = 0
        with open(f"{name}.making", "wb") as f:
            for frame in frames:
                out = np.zeros(len(frame), kind)
                for c in kind.names:
                    out[c] = frame[c]
                f.write(out.tobytes())
                n += len(frame)
        os.replace(f"{name}.making", name + ending)
        yield pd.DataFrame({"n": [n]})

    pairs.select(*kind.names).mapInPandas(run, "n long").agg(F.sum("n")).collect()
