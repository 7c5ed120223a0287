"""Binning of a stream of read pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_contacts(pairs: DataFrame, bin_size: int) -> DataFrame:
    """A01 over a stream: running sums of cells, for update or complete mode; the state has one row for each occupied cell."""
    a, b = F.floor(F.col("pos1") / bin_size).cast("int"), F.floor(F.col("pos2") / bin_size).cast("int")
    turn = (F.col("chr1") > F.col("chr2")) | ((F.col("chr1") == F.col("chr2")) & (a > b))
    ends = (F.least("chr1", "chr2").alias("chr1"), F.greatest("chr1", "chr2").alias("chr2"), F.when(turn, b).otherwise(a).alias("bin_x"), F.when(turn, a).otherwise(b).alias("bin_y"))
    return pairs.groupBy(*ends).agg(F.sum("score").alias("counts"))
