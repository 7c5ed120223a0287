"""Tables written between the steps of composite operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="contactgrid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which driver and executors share.

    Only where all run in one process, as in local tests, may it be unset: then a folder of this process takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not folder and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (folder or _own_folder()).rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once in the shared folder and read again: it isn't computed anew, and outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables have been written: for discard()."""
    return len(_made)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables that have been written since a mark(), but for the last ``keep``; their readers have to be done."""
    gone = _made[since : len(_made) - keep]
    del _made[since : len(_made) - keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def counted(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has at most ``most`` rows, which are counted first; otherwise as it is, for a join by shuffle."""
    return df.hint("broadcast") if df.limit(most + 1).count() <= most else df
