"""Expected values by distance (A14-A17) and observed over expected."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A smoothing window holds so many counts, if there are as many.
LEAST_COUNTS = 400.0
#: One function of distance has a row for each distance of the longest chromosome: so many at most.
MOST_DISTANCES = 4_000_000


def observed_by_distance(cells: DataFrame) -> DataFrame:
    """Sums of intra cells by distance, over all chromosomes."""
    return cells.where("chr1 = chr2").groupBy((F.col("bin_y") - F.col("bin_x")).alias("dist")).agg(F.sum("counts").alias("observed"))


def observed_by_chromosome(cells: DataFrame) -> DataFrame:
    """Sums of intra cells by chromosome."""
    return cells.where("chr1 = chr2").groupBy(F.col("chr1").alias("chr")).agg(F.sum("counts").alias("observed"))


def _distances(chrom_sizes: DataFrame, bin_size: int) -> DataFrame:
    """chr, dist, possible: the pairs of bins of each chromosome at each distance."""
    n = chrom_sizes.withColumn("n", F.floor(F.col("length") / bin_size).cast("int")).where("n > 0")
    return n.select("chr", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("dist")).select("chr", "dist", (F.col("n") - F.col("dist")).cast("double").alias("possible"))


def possible_by_distance(chrom_sizes: DataFrame, bin_size: int) -> DataFrame:
    """Pairs of bins at each distance."""
    return _distances(chrom_sizes, bin_size).groupBy("dist").agg(F.sum("possible").alias("possible"))


def raw_density(cells: DataFrame | None, chrom_sizes: DataFrame, bin_size: int, observed: DataFrame | None = None) -> DataFrame:
    """The mean count at each distance, without smoothing; from the cells, or what observed_by_distance() has of them."""
    both = possible_by_distance(chrom_sizes, bin_size).join(observed_by_distance(cells) if observed is None else observed, "dist", "left")
    return both.select("dist", (F.coalesce("observed", F.lit(0.0)) / F.col("possible")).alias("value"))


def smooth_density(observed: np.ndarray, possible: np.ndarray, least: float = LEAST_COUNTS) -> np.ndarray:
    """The mean over a window around each distance that holds ``least`` counts, or ends with the data.

    Running sums of both give any window's mean by two subtractions, and where a window has to end by a search in
    them. From one distance to the next a window's middle moves by one and its ends by two at most.
    """
    n = len(possible)
    seen, there = (np.concatenate([[0.0], np.cumsum(v, dtype=float)]) for v in (observed, possible))
    out = np.zeros(n)
    first, end = 0, 1  # the window, its end not included
    for d in range(n):
        short = seen[first] + least
        if seen[end] < short:
            end = min(n, max(end, int(np.searchsorted(seen, short))))
        else:  # as narrow as it can be about its middle
            k, most = 0, (end - first) // 2
            while k < most:
                half = (k + most + 1) // 2
                k, most = (half, most) if seen[end - half] - seen[min(first + half, end - half)] >= least else (k, half - 1)
            first, end = first + k, end - k
        out[d] = (seen[end] - seen[first]) / (there[end] - there[first])
        end = min(n, end + 2)
    return out


def expected(cells: DataFrame | None, chrom_sizes: DataFrame, bin_size: int, observed: DataFrame | None = None) -> DataFrame:
    """Dist, value; from the cells, or what observed_by_distance() has of them. What is smoothed is one row a distance, whatever the number of cells: MOST_DISTANCES at most, in one task."""
    both = possible_by_distance(chrom_sizes, bin_size).join(observed_by_distance(cells) if observed is None else observed, "dist", "left").fillna(0.0, ["observed"])

    def smooth(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > MOST_DISTANCES:
            raise ValueError(f"{len(f)} distances: take wider bins")
        f = f.sort_values("dist")
        return pd.DataFrame({"dist": f["dist"].to_numpy(), "value": smooth_density(f["observed"].to_numpy(float), f["possible"].to_numpy(float))})

    return both.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(smooth, "dist int, value double")


def scale_factors(density: DataFrame, cells: DataFrame, chrom_sizes: DataFrame, bin_size: int) -> DataFrame:
    """Each chromosome's expected sum by its observed one."""
    sums = _distances(chrom_sizes, bin_size).join(density, "dist").groupBy("chr").agg(F.sum(F.col("possible") * F.col("value")).alias("sum"))
    return sums.join(observed_by_chromosome(cells), "chr").select("chr", (F.col("sum") / F.col("observed")).alias("factor"))


def observed_over_expected(cells: DataFrame, density: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Intra cells by the expected value at their distance, or, beyond it, at the last one; of their chromosome, given its factor."""
    last = density.agg(F.max("dist").alias("last"))
    intra = cells.where("chr1 = chr2").join(F.broadcast(last)).withColumn("dist", F.least(F.col("bin_y") - F.col("bin_x"), F.col("last")))
    both, value = intra.join(density, "dist"), F.try_divide("counts", "value")
    if factors is not None:
        both, value = both.join(factors.withColumnRenamed("chr", "chr1"), "chr1"), value * F.col("factor")
    return both.withColumn("oe", value).where("oe is not null").select("chr1", "chr2", "bin_x", "bin_y", "oe")


def combine(*parts: DataFrame) -> DataFrame:
    """The sum of several expected functions, distance by distance."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("dist").agg(F.sum("value").alias("value"))
