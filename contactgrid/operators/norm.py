"""Normalization vectors (A08, A10, M01-M03) and normalized cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactgrid.tables import written

#: Types of norm vectors, and those that are built where none is asked for (M03e). Any other name is a custom type.
KNOWN_TYPES = ("NONE", "VC", "VC_SQRT", "KR", "SCALE", "GW_KR", "GW_SCALE", "GW_VC", "INTER_KR", "INTER_SCALE", "INTER_VC")
DEFAULT_TYPES = ("VC", "VC_SQRT", "SCALE", "INTER_SCALE", "GW_SCALE")
#: The finest bins that genome-wide vectors are built for.
GENOME_WIDE_FROM = 25_000
#: Cells of a chromosome up to which its vector is solved in one task; larger ones take a join a round.
LOCAL_CELLS = 4_000_000


def both_sides(cells: DataFrame) -> DataFrame:
    """Intra cells once from each of their bins; a diagonal cell once."""
    side = lambda a, b: F.struct(F.col(a).alias("bin"), F.col(b).alias("other"))
    sides = F.when(F.col("bin_x") == F.col("bin_y"), F.array(side("bin_x", "bin_y"))).otherwise(F.array(side("bin_x", "bin_y"), side("bin_y", "bin_x")))
    return cells.where("chr1 = chr2").select(F.col("chr1").alias("chr"), "counts", F.inline(sides)).select("chr", "bin", "other", "counts")


def coverage(cells: DataFrame) -> DataFrame:
    """Row sums of the symmetric matrix: chr, bin, value."""
    return both_sides(cells).groupBy("chr", "bin").agg(F.sum("counts").alias("value"))


def _with_values(cells: DataFrame, vector: DataFrame, how: str = "inner") -> DataFrame:
    """The cells with the vector's values of both bins, vx and vy."""
    x = vector.select(F.col("chr").alias("chr1"), F.col("bin").alias("bin_x"), F.col("value").alias("vx"))
    y = vector.select(F.col("chr").alias("chr2"), F.col("bin").alias("bin_y"), F.col("value").alias("vy"))
    return cells.join(x, ["chr1", "bin_x"], how).join(y, ["chr2", "bin_y"], how)


def finish(vector: DataFrame, cells: DataFrame) -> DataFrame:
    """A10: scales a vector so that the normalized matrix keeps the sum of the raw one."""
    twice = F.when(F.col("bin_x") == F.col("bin_y"), F.lit(1)).otherwise(F.lit(2))
    both = _with_values(cells.where("chr1 = chr2"), vector.where("value > 0"))
    factor = F.sqrt(F.sum(twice * F.col("counts") / (F.col("vx") * F.col("vy"))) / F.sum(twice * F.col("counts"))).alias("factor")
    sums = both.groupBy(F.col("chr1").alias("chr")).agg(factor)
    return vector.join(sums, "chr").select("chr", "bin", (F.col("value") * F.col("factor")).alias("value"))


def vc(cells: DataFrame) -> DataFrame:
    """Coverage, finished."""
    return finish(coverage(cells), cells)


def vc_sqrt(cells: DataFrame) -> DataFrame:
    """The square root of coverage, finished."""
    return finish(coverage(cells).withColumn("value", F.sqrt("value")), cells)


def normalize(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """Counts by both bins' values; cells with a missing value go."""
    value = F.try_divide("counts", F.col("vx") * F.col("vy"))
    return _with_values(cells, vector).withColumn("counts", value).where("counts is not null and not isnan(counts)").select(*cells.columns)


def matvec(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """The symmetric matrix of each chromosome times a vector."""
    v = vector.select("chr", F.col("bin").alias("other"), "value")
    return both_sides(cells).join(v, ["chr", "other"]).groupBy("chr", "bin").agg(F.sum(F.col("counts") * F.col("value")).alias("value"))


def genome_wide(cells: DataFrame, chrom_sizes: DataFrame, bin_size: int, inter_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """M03d: all chromosomes' bins in one row: cells as of one chromosome 0, and the offsets to part them again."""
    n = (F.floor(F.col("length") / bin_size) + 1).cast("long")
    offsets = chrom_sizes.select("chr", F.coalesce(F.sum(n).over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("offset"))
    one, two = (offsets.select(F.col("chr").alias(f"chr{e}"), F.col("offset").alias(f"o{e}")) for e in "12")
    c = cells.where("chr1 <> chr2") if inter_only else cells
    c = c.join(one, "chr1").join(two, "chr2").select(F.lit(0).alias("chr1"), F.lit(0).alias("chr2"), (F.col("bin_x") + F.col("o1")).alias("bin_x"), (F.col("bin_y") + F.col("o2")).alias("bin_y"), "counts")
    return c, offsets


def split_back(vector: DataFrame, offsets: DataFrame, chrom_sizes: DataFrame, bin_size: int) -> DataFrame:
    """M03d: the genome-wide vector by chromosome and bin."""
    spans = offsets.join(chrom_sizes, "chr").withColumn("n", (F.floor(F.col("length") / bin_size) + 1).cast("int"))
    bins = spans.select("chr", "offset", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))
    return bins.join(vector.select(F.col("bin").alias("wide"), "value"), F.col("wide") == F.col("bin") + F.col("offset")).select("chr", "bin", "value")


def occupied(cells: DataFrame, low: float = 0.0) -> DataFrame:
    """Chr, bin of the rows whose number of cells is at or above the quantile ``low`` of their chromosome's."""
    filled = both_sides(cells).where("counts > 0").groupBy("chr", "bin").agg(F.count(F.lit(1)).alias("n"))
    if not low:
        return filled.select("chr", "bin")
    cut = filled.groupBy("chr").agg(F.percentile("n", F.lit(low)).alias("cut"))
    return filled.join(cut, "chr").where("n >= cut").select("chr", "bin")


def _solve(x: np.ndarray, y: np.ndarray, c: np.ndarray, n: int, tolerance: float, rounds: int, target: np.ndarray) -> tuple[np.ndarray, bool]:
    """The scaling b under which all rows b_i * sum_j c_ij b_j of a matrix, given from both sides, have the target's sums; and whether it came so near."""
    b = np.ones(n)
    for _ in range(rounds):
        sums = b * np.bincount(x, weights=c * b[y], minlength=n)
        live = (sums > 0) & (target > 0)
        if not live.any() or np.abs(sums[live] / target[live] - 1).max() < tolerance:
            return b, bool(live.any())
        b[live] *= np.sqrt(target[live] / sums[live])
    return b, False


_SOLVED = "chr int, bin int, value double, settled boolean"


def _attempt(intra: DataFrame, wanted: DataFrame, tolerance: float, rounds: int, local_cells: int) -> DataFrame:
    """One attempt on all chromosomes of the cells: chr, bin, value, and whether the chromosome settled within the rounds.

    A chromosome of up to ``local_cells`` cells is solved in its task. Larger ones take a join and a sum by row for each round, with the vector written
    between rounds; neither a chromosome nor a vector is then in one task, and those that have settled take no part in the next round.
    """
    sizes = intra.groupBy("chr1").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > local_cells).select("chr1"), "large-chromosomes")
    wanted = wanted.select("chr", "bin", F.col("value").cast("double").alias("want"))
    sides = both_sides(intra).join(wanted, ["chr", "bin"], "left")

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        x, y, c = f["bin"].to_numpy(), f["other"].to_numpy(), f["counts"].to_numpy()
        n = int(max(x.max(), y.max())) + 1
        want = np.zeros(n)
        want[x] = np.nan_to_num(f["want"].to_numpy(float))
        with np.errstate(all="ignore"):  # what doesn't settle may leave all bounds
            b, settled = _solve(x, y, c, n, tolerance, rounds, want)
            at = np.flatnonzero(want > 0)
            return pd.DataFrame({"chr": f["chr"].iloc[0], "bin": at, "value": 1 / b[at], "settled": settled})

    few = sides.join(large, sides["chr"] == large["chr1"], "left_anti")
    vector = few.groupBy("chr").applyInPandas(solve, _SOLVED)
    if large.limit(1).count():
        vector = vector.unionByName(_by_rounds(intra.join(large, "chr1", "left_semi"), wanted, tolerance, rounds))
    return vector


def _by_rounds(cells: DataFrame, wanted: DataFrame, tolerance: float, rounds: int) -> DataFrame:
    cells = written(cells, "round-cells")
    vector = written(both_sides(cells).select("chr", "bin").distinct().join(wanted.where("want > 0"), ["chr", "bin"]).withColumn("value", F.lit(1.0)), "round-vector")
    done = None
    for _ in range(rounds):
        sums = matvec(cells, vector).withColumnRenamed("value", "product")
        step = written(vector.join(sums, ["chr", "bin"]).withColumn("part", F.col("value") * F.col("product") / F.col("want")), "round-vector")
        off = step.groupBy("chr").agg(F.max(F.abs(F.col("part") - 1)).alias("off"))
        near = written(off.where(F.col("off") < tolerance).select("chr"), "settled-chromosomes")
        settled = step.join(F.broadcast(near), "chr", "left_semi").select("chr", "bin", "value", F.lit(True).alias("settled"))
        done = settled if done is None else done.unionByName(settled)
        vector = step.join(F.broadcast(near), "chr", "left_anti").select("chr", "bin", "want", (F.col("value") / F.sqrt("part")).alias("value"))
        if not vector.limit(1).count():
            break
        if near.limit(1).count():  # those that have settled leave the matrix
            cells = written(cells.join(F.broadcast(near), cells["chr1"] == near["chr"], "left_anti"), "round-cells")
    left = vector.select("chr", "bin", "value", F.lit(False).alias("settled"))
    return (left if done is None else done.unionByName(left)).withColumn("value", 1 / F.col("value"))


#: Of each attempt of either kind, the share of rows with the smallest sums that are left out, and the value below which a row is left out of the next one.
KR_ATTEMPTS, KR_LEAST = (0.0, 0.01, 0.02, 0.03, 0.04, 0.10), 0.01
SCALE_ATTEMPTS = (0.0, *(5e-5 * 2**k for k in range(12)), 0.2)


def balance_by_attempts(
    cells: DataFrame, attempts: Sequence[float], tolerance: float = 5e-4, rounds: int = 300, least: float = 0.0, target: DataFrame | None = None, local_cells: int = LOCAL_CELLS
) -> DataFrame:
    """Balancing that leaves out more rows where it doesn't come to an end: chr, bin, value, attempt.

    attempts: the share of each one's rows, those with the smallest sums of their chromosome, that it leaves out. Only chromosomes that haven't settled take
    the next attempt; rows whose finished value is below ``least`` have theirs to take, without these rows. A chromosome that no attempt settles has null for each of its rows, and a null attempt.
    """
    intra = cells.where("chr1 = chr2 and counts > 0").select("chr1", "chr2", "bin_x", "bin_y", F.col("counts").cast("double").alias("counts"))
    left = written(intra, "balanced-cells")
    sums = written(coverage(left), "row-sums")
    out, tossed = None, None
    for turn, share in enumerate(attempts):
        keep = sums
        if tossed is not None:
            keep = keep.join(tossed, ["chr", "bin"], "left_anti")
        if share:
            cut = keep.groupBy("chr").agg(F.percentile("value", F.lit(share)).alias("cut"))
            keep = keep.join(F.broadcast(cut), "chr").where("value > cut")
        keep = written(keep.select("chr", "bin"), "kept-rows")
        side = lambda e, keep=keep: keep.select(F.col("chr").alias(f"chr{e}"), F.col("bin").alias(f"bin_{'xy'[e - 1]}"))
        some = written(left.join(side(1), ["chr1", "bin_x"], "left_semi").join(side(2), ["chr2", "bin_y"], "left_semi").select(*left.columns), "attempted-cells")
        wanted = keep.withColumn("value", F.lit(1.0)) if target is None else target.join(keep, ["chr", "bin"], "left_semi")
        found = written(_attempt(some, wanted, tolerance, rounds, local_cells), "attempt")
        ended = written(finish(found.where("settled").drop("settled"), some), "finished")
        small = ended.where(F.col("value") < least).select("chr", "bin")
        again = small.select("chr").distinct()
        done = ended.join(F.broadcast(again), "chr", "left_anti").withColumn("attempt", F.lit(turn))
        out = done if out is None else out.unionByName(done)
        over = written(done.select("chr").distinct(), "settled-chromosomes")
        left = written(left.join(F.broadcast(over), left["chr1"] == over["chr"], "left_anti"), "balanced-cells")
        sums = written(sums.join(F.broadcast(over), "chr", "left_anti"), "row-sums")
        if not left.limit(1).count():
            break
        if least:
            tossed = written(small if tossed is None else small.unionByName(tossed), "tossed-rows")
    failed = sums.select("chr", "bin", F.lit(None).cast("double").alias("value"), F.lit(None).cast("int").alias("attempt"))
    return failed if out is None else out.unionByName(failed)


def balance(cells: DataFrame, tolerance: float = 5e-4, rounds: int = 200, low: float = 0.0, target: DataFrame | None = None, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """The vector under which the rows of each chromosome's matrix have equal sums, or the sums of ``target``, finished.

    The scaling of a symmetric matrix to given row sums is one and the same whichever method finds it; this one multiplies
    each row by the root of what it lacks, round by round: see _attempt(). Rows whose number of cells is below the quantile ``low`` are left out.
    A chromosome that doesn't settle within the rounds has null for each of its rows; balance_by_attempts() goes on with fewer rows. target: chr, bin, value.
    """
    rows = occupied(cells, low)
    keep = lambda e: rows.select(F.col("chr").alias(f"chr{e}"), F.col("bin").alias(f"bin_{'xy'[e - 1]}"))
    intra = cells.where("chr1 = chr2 and counts > 0")
    if low:
        intra = intra.join(keep(1), ["chr1", "bin_x"], "left_semi").join(keep(2), ["chr2", "bin_y"], "left_semi")
    intra = written(intra.select("chr1", "chr2", "bin_x", "bin_y", F.col("counts").cast("double").alias("counts")), "balanced-cells")
    found = written(_attempt(intra, rows.withColumn("value", F.lit(1.0)) if target is None else target, tolerance, rounds, local_cells), "attempt")
    settled = finish(found.where("settled").drop("settled"), intra)
    return settled.unionByName(found.where("not settled").select("chr", "bin", F.lit(None).cast("double").alias("value")))


def rescale(vector: DataFrame, cells: DataFrame, tolerance: float = 5e-4, rounds: int = 200) -> DataFrame:
    """M03h: a custom vector rescaled: the vector that gives the normalized matrix the custom one's values as row sums."""
    return balance(cells, tolerance, rounds, target=vector.where("value > 0"))


def _kinds(low: float) -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {
        "VC": vc, "VC_SQRT": vc_sqrt, "KR": lambda c: balance_by_attempts(c, KR_ATTEMPTS if not low else (low,), 1e-6, 1000, KR_LEAST).drop("attempt"),
        "SCALE": lambda c: balance_by_attempts(c, SCALE_ATTEMPTS if not low else (low,)).drop("attempt"),
    }


def add_norms(cells: DataFrame, chrom_sizes: DataFrame, bin_size: int, types: Sequence[str] = DEFAULT_TYPES, low: float = 0.0, skip: dict[str, DataFrame] | None = None) -> DataFrame:
    """M03d-M03f: the vectors of one resolution: norm, chr, bin, value. Genome-wide ones are left out below GENOME_WIDE_FROM.

    skip: of a type the chromosomes (chr) that aren't tried.
    """
    cells = written(cells, "norm-cells")
    out = None
    for name in types:
        wide, kind = name.split("_", 1) if name.startswith(("GW_", "INTER_")) else ("", name)
        if wide and bin_size < GENOME_WIDE_FROM or kind == "NONE":
            continue
        make = _kinds(low)[kind]
        if wide:
            all_, offsets = genome_wide(cells, chrom_sizes, bin_size, wide == "INTER")
            vector = split_back(make(all_), offsets, chrom_sizes, bin_size)
        else:
            gone = (skip or {}).get(name)
            vector = make(cells if gone is None else cells.join(F.broadcast(gone), cells["chr1"] == gone["chr"], "left_anti"))  # a row a chromosome at most
        vector = vector.select(F.lit(name).alias("norm"), "chr", "bin", "value")
        out = vector if out is None else out.unionByName(vector)
    if out is None:
        return cells.sparkSession.createDataFrame([], "norm string, chr int, bin int, value double")
    return out


def add_norms_at(contacts: DataFrame, chrom_sizes: DataFrame, types: Sequence[str] = DEFAULT_TYPES) -> DataFrame:
    """M03f: the vectors of all resolutions of a map, from the coarsest on: bin_size, norm, chr, bin, value. contacts: cells with their bin_size.

    A chromosome for which a balanced type came to no end is remembered, and not tried at finer bins; it has no rows there.
    """
    contacts = written(contacts, "norm-contacts")
    failed: dict[str, DataFrame] = {}
    out = None
    for size in sorted((r[0] for r in contacts.select("bin_size").distinct().collect()), reverse=True):
        cells = contacts.where(F.col("bin_size") == size).drop("bin_size", "unit")
        vectors = written(add_norms(cells, chrom_sizes, size, types, skip=failed), "vectors")
        for name in set(types) & {"KR", "SCALE"}:
            none = vectors.where(F.col("norm") == name).groupBy("chr").agg(F.count("value").alias("n")).where("n = 0").select("chr")
            none = none.unionByName(failed[name]) if name in failed else none
            failed[name] = written(none.distinct(), "failed-chromosomes")
        sized = vectors.select(F.lit(size).alias("bin_size"), *vectors.columns)
        out = sized if out is None else out.unionByName(sized)
    return out


def balance_text(lines: DataFrame, chr_: str | None = None) -> DataFrame:
    """M03g: the vector of a matrix in text, a line (value) each cell: bin_x, bin_y, count; those of several at once, if ``chr_`` names a column that tells them apart."""
    t = F.split(F.trim("value"), r"\s+")
    number = lambda k: t[k].cast("int")
    key = F.col(chr_) if chr_ else F.lit(1)
    cells = lines.where(F.size(t) == 3).select(key.alias("chr1"), key.alias("chr2"), F.least(number(0), number(1)).alias("bin_x"), F.greatest(number(0), number(1)).alias("bin_y"), t[2].cast("double").alias("counts"))
    return balance(cells, 1e-6, 1000)
