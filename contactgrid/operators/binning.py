"""From pairs to sparse matrices at many resolutions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactgrid.tables import written

CELL = ["chr1", "chr2", "bin_x", "bin_y"]
#: Counts of a cell that are drawn one by one; counts that are dealt at a time.
SINGLE, DEALT = 64, 100_000


def _draws(cell: np.ndarray, number: np.ndarray, seed: int) -> np.ndarray:
    """64 random bits for each count of a cell, by the cell's hash, the count's number and the seed."""
    mixed = lambda z: (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    start = mixed(np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)) ^ cell.astype("int64").view("uint64"))
    z = start + (number.astype("uint64") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = mixed(z ^ (z >> np.uint64(27)))
    return z ^ (z >> np.uint64(29))


def bin_contacts(pairs: DataFrame, bin_sizes: Sequence[int], unit: str = "BP") -> DataFrame:
    """Cells of each matrix, by sum of scores; unit FRAG bins fragments instead of positions.

    The finest resolution is summed from the pairs; a coarser one that it divides is summed from the finest cells that
    do; those that others are summed from are written, so the pairs are read and shuffled once, whatever the number of resolutions.
    """
    at = "pos" if unit == "BP" else "frag"
    pairs = pairs.where((F.col(f"{at}1") >= 0) & (F.col(f"{at}2") >= 0))
    swap = F.col("chr1") > F.col("chr2")
    chr1, chr2 = F.least("chr1", "chr2").alias("chr1"), F.greatest("chr1", "chr2").alias("chr2")
    x, y = F.when(swap, F.col(f"{at}2")).otherwise(F.col(f"{at}1")), F.when(swap, F.col(f"{at}1")).otherwise(F.col(f"{at}2"))
    ends = pairs.select(chr1, chr2, x.alias("x"), y.alias("y"), "score")
    done: dict[int, DataFrame] = {}
    for size in sorted(set(bin_sizes)):
        finer = max((s for s in done if size % s == 0), default=None)
        source, step, value = (ends, size, "score") if finer is None else (done[finer].withColumnsRenamed({"bin_x": "x", "bin_y": "y"}), size // finer, "counts")
        a, b = F.floor(F.col("x") / step).cast("int"), F.floor(F.col("y") / step).cast("int")
        same = F.col("chr1") == F.col("chr2")
        cells = source.select(
            "chr1", "chr2", F.when(same, F.least(a, b)).otherwise(a).alias("bin_x"), F.when(same, F.greatest(a, b)).otherwise(b).alias("bin_y"), F.col(value).alias("value")
        )
        done[size] = cells.groupBy(*CELL).agg(F.sum("value").alias("counts"))
        if any(s > size and s % size == 0 for s in bin_sizes):
            done[size] = written(done[size], f"cells-{size}")
    out = [done[s].select("chr1", "chr2", F.lit(unit).alias("unit"), F.lit(s).alias("bin_size"), "bin_x", "bin_y", "counts") for s in done]
    result = out[0]
    for other in out[1:]:
        result = result.unionByName(other)
    return result


def coarsen(cells: DataFrame, factor: int) -> DataFrame:
    """Cells of a resolution that is ``factor`` times as coarse."""
    by = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return cells.groupBy("chr1", "chr2", by("bin_x"), by("bin_y")).agg(F.sum("counts").alias("counts"))


def served(levels: dict[int, DataFrame], bin_size: int) -> DataFrame:
    """Cells of a resolution from stored ones by bin size: those of that size, or the coarsest ones whose bins divide its, summed. Only the chosen level is read."""
    fit = [s for s in levels if bin_size % s == 0]
    if not fit:
        raise ValueError(f"no stored bins of {sorted(levels)} divide {bin_size}")
    return levels[max(fit)] if max(fit) == bin_size else coarsen(levels[max(fit)], bin_size // max(fit))


def genome_offsets(chrom_sizes: DataFrame) -> DataFrame:
    """Where each chromosome begins in thousands of bases, and its bins of each size."""
    before = Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)
    return chrom_sizes.withColumn("kb_offset", F.coalesce(F.sum(F.floor(F.col("length") / 1000)).over(before), F.lit(0)))


def whole_genome(pairs: DataFrame, chrom_sizes: DataFrame) -> DataFrame:
    """One matrix of all chromosomes, in about 500 bins of whole thousands of bases."""
    offsets = genome_offsets(chrom_sizes)
    size = F.greatest(F.floor(F.sum(F.floor(F.col("length") / 1000)).over(Window.partitionBy()) / 500), F.lit(1))
    offsets = offsets.withColumn("size", size).select("chr", "kb_offset", "size")
    for end in ("1", "2"):
        mine = offsets.select(F.col("chr").alias(f"chr{end}"), F.col("kb_offset").alias(f"off{end}"), F.col("size").alias(f"size{end}"))
        pairs = pairs.join(mine, f"chr{end}")
    a, b = (F.floor((F.col(f"off{e}") + F.floor(F.col(f"pos{e}") / 1000)) / F.col(f"size{e}")).cast("int") for e in "12")
    return pairs.groupBy(F.least(a, b).alias("bin_x"), F.greatest(a, b).alias("bin_y")).agg(F.sum("score").alias("counts"))


def merge_maps(*maps: DataFrame) -> DataFrame:
    """The sum of maps, cell by cell."""
    both = maps[0]
    for m in maps[1:]:
        both = both.unionByName(m)
    return both.groupBy(*CELL).agg(F.sum("counts").alias("counts"))


def matrix_sums(cells: DataFrame) -> DataFrame:
    """Each matrix's sum, with off-diagonal cells within a chromosome twice, and its cells."""
    mirrored = (F.col("chr1") == F.col("chr2")) & (F.col("bin_x") != F.col("bin_y"))
    return cells.groupBy("chr1", "chr2").agg(F.sum(F.when(mirrored, 2 * F.col("counts")).otherwise(F.col("counts"))).alias("sum_counts"), F.count(F.lit(1)).alias("n_cells"))


def average_counts(cells: DataFrame, chrom_sizes: DataFrame, bin_size: int) -> DataFrame:
    """Sum by number of bins, a chromosome shorter than a bin counting one."""
    bins = F.greatest(F.floor(F.col("length") / bin_size), F.lit(1))
    one, two = (chrom_sizes.select(F.col("chr").alias(f"chr{e}"), bins.alias(f"n{e}")) for e in "12")
    return matrix_sums(cells).join(one, "chr1").join(two, "chr2").select("chr1", "chr2", (F.col("sum_counts") / F.col("n1") / F.col("n2")).alias("average"))


def occupancy(cells: DataFrame) -> DataFrame:
    """Occupied cells, and the 5th and 95th percentile of their counts."""
    return cells.groupBy("chr1", "chr2").agg(
        F.count(F.lit(1)).alias("n_cells"), F.percentile("counts", F.lit(0.05)).alias("p05"), F.percentile("counts", F.lit(0.95)).alias("p95")
    )


def place(cells: DataFrame, first: str, then: str, name: str) -> DataFrame:
    """The place of each cell of a matrix by two of its bins: cells of smaller first bins, counted by bin and summed, and the place among those of its own."""
    row = ["chr1", "chr2", first]
    by = Window.partitionBy("chr1", "chr2").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    before = cells.groupBy(*row).agg(F.count(F.lit(1)).alias("_n")).select(*row, F.coalesce(F.sum("_n").over(by), F.lit(0)).alias("_before"))
    here = cells.withColumn("_here", F.row_number().over(Window.partitionBy(*row).orderBy(then)))
    return here.join(before, row).select(*cells.columns, (F.col("_before") + F.col("_here")).cast("int").alias(name))


def thin(cells: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """of each cell's counts as many as a binomial draw keeps; the draw follows from the cell's place and the seed, so reruns agree.

    Up to ``SINGLE`` counts of a cell are drawn one by one, of all cells of a batch together; more by a generator of the cell's own.
    """

    @F.pandas_udf("double")
    def kept(n: pd.Series, draw: pd.Series) -> pd.Series:
        counts, h = n.to_numpy("int64"), draw.to_numpy("int64")
        few = np.where(counts <= SINGLE, counts, 0)
        at = np.repeat(np.arange(len(few)), few)
        bits = _draws(h[at], np.arange(len(at)) - np.repeat(few.cumsum() - few, few), seed)
        out = np.bincount(at, (bits >> np.uint64(11)) * 2.0**-53 < fraction, len(few))
        for k in np.flatnonzero(counts > SINGLE):
            out[k] = np.random.default_rng([seed, int(h[k]) & (2**63 - 1)]).binomial(int(counts[k]), fraction)
        return pd.Series(out)

    return cells.withColumn("counts", kept(F.floor("counts"), F.xxhash64(*CELL))).where("counts > 0")


def rebin(cells: DataFrame, bin_size: int, new_size: int, seed: int = 0) -> DataFrame:
    """Cells in bins of any other size, also one that isn't a multiple: each count goes to a place of its cell at random, by the cell and the seed.

    Whole counts are dealt one by one, so sums stay; where the new size is a multiple there is nothing to deal.
    """
    if new_size % bin_size == 0:
        return coarsen(cells, new_size // bin_size)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["counts"].to_numpy(float).astype("int64")
            last = n.cumsum()
            first = last - n
            c = {k: f[k].to_numpy("int64") for k in (*CELL, "draw")}
            for begin in range(0, int(n.sum()), DEALT):  # the counts of all cells in a line, cut into pieces
                of = np.arange(begin, min(begin + DEALT, int(n.sum())))
                at = np.searchsorted(last, of, side="right")
                x, y = ((c[b][at] * bin_size + (_draws(c["draw"][at], of - first[at], 2 * seed + k) % np.uint64(bin_size)).astype("int64")) // new_size for k, b in enumerate(("bin_x", "bin_y")))
                same = c["chr1"][at] == c["chr2"][at]
                low, high = np.where(same, np.minimum(x, y), x), np.where(same, np.maximum(x, y), y)
                out = {"chr1": c["chr1"][at], "chr2": c["chr2"][at], "bin_x": low, "bin_y": high}
                yield pd.DataFrame({k: v.astype("int32") for k, v in out.items()}).assign(counts=1.0)

    dealt = cells.select(*CELL, "counts", F.xxhash64(*CELL).alias("draw")).mapInPandas(deal, "chr1 int, chr2 int, bin_x int, bin_y int, counts double")
    return dealt.groupBy(*CELL).agg(F.sum("counts").alias("counts"))
