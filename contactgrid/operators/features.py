"""Lists of loops and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactgrid.tables import written

ENDS = ["start1", "end1", "start2", "end2"]


def by_size(loops: DataFrame, low: float, high: float, resolution: int) -> DataFrame:
    """the distance of the middles, in bins, within [low, high]."""
    mid = lambda e: F.floor((F.col(f"start{e}") + F.col(f"end{e}")) / 2)
    return loops.where(F.round(F.abs(mid(1) - mid(2)) / resolution).between(low, high))


def near_diagonal(loops: DataFrame, distance: int) -> DataFrame:
    """F19."""
    return loops.where(F.abs(F.col("start1") - F.col("start2")) < distance)


def strong(loops: DataFrame, limit: float) -> DataFrame:
    """F20."""
    return loops.where(F.col("observed") > limit)


def mapq_clear(loops: DataFrame, missing: DataFrame, resolution: int, radius: int = 5) -> DataFrame:
    """loops without a missing norm value within ``radius`` bins of either anchor; missing: chr, bin."""
    spread = missing.select("chr", F.explode(F.sequence(F.col("bin") - radius, F.col("bin") + radius)).alias("_bin")).distinct()
    for end in ("1", "2"):
        bad = spread.withColumnRenamed("_bin", "_bad").withColumnRenamed("chr", "_chr")
        loops = loops.join(bad, (loops["chr"] == bad["_chr"]) & (F.floor(loops[f"start{end}"] / resolution) == bad["_bad"]), "left_anti")
    return loops


def fdr_accepts(least: float = 1.5, usual: float = 1.75, strong_: float = 2.0, fdr_sum: float = 0.02) -> Column:
    """loops that stand out from what each mask expects, as often as it: the arms ``least``, donut and corner ``usual``, one of
    these two ``strong_`` times; and that were collapsed from several pixels, or have a sum of rates of at most ``fdr_sum``."""
    over = lambda times, *masks: [F.col("observed") > times * F.col(f"expected{m}") for m in masks]
    arms, sides, one = over(least, "H", "V"), over(usual, "BL", "Donut"), over(strong_, "BL", "Donut")
    rates = F.aggregate(F.array(*(F.col(f"fdr{m}") for m in ("BL", "Donut", "H", "V"))), F.lit(0.0), lambda total, rate: total + rate)
    return arms[0] & arms[1] & sides[0] & sides[1] & (one[0] | one[1]) & ((F.col("numCollapsed") > 1) | (rates <= fdr_sum))


def _cells(df: DataFrame, x: str, y: str, size: int, spread: bool) -> DataFrame:
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size) + 1)) if spread else F.floor(F.col(c) / size)
    return df.withColumn("_cx", around(x)).withColumn("_cy", around(y))


def near_points(a: DataFrame, b: DataFrame, radius: int) -> DataFrame:
    """Pairs of loops of a chromosome whose starts are within ``radius`` of each other, by grid cells of that width: b's columns with b_."""
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    left, right = _cells(a, "start1", "start2", radius, False), _cells(b, "b_start1", "b_start2", radius, True).withColumnsRenamed({"_cx": "_bx", "_cy": "_by"})
    on = (F.col("chr") == F.col("b_chr")) & (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by"))
    far = F.sqrt(F.pow(F.col("start1") - F.col("b_start1"), F.lit(2.0)) + F.pow(F.col("start2") - F.col("b_start2"), F.lit(2.0)))
    return left.join(right.hint("merge"), on).withColumn("far", far).where(F.col("far") <= radius).drop("_cx", "_cy", "_bx", "_by")


def reproducible(a: DataFrame, b: DataFrame, radius: int) -> DataFrame:
    """Loops of b with one of a within the radius."""
    return b.join(near_points(a, b, radius).select(F.col("b_id").alias("id")).distinct(), "id", "left_semi")


def reproducible_nearest(a: DataFrame, b: DataFrame, radius: int, fraction: float) -> DataFrame:
    """Loops of b whose nearest one of a is within the radius and the fraction of its span."""
    near = near_points(a, b, radius).groupBy("b_id").agg(F.min("far").alias("far"), F.first("b_start1").alias("s1"), F.first("b_start2").alias("s2"))
    near = near.where(F.try_divide("far", F.abs(F.col("s2") - F.col("s1"))) <= fraction)
    return b.join(near.select(F.col("b_id").alias("id")), "id", "left_semi")


def at_locations(loops: DataFrame, places: DataFrame, keep: bool = True) -> DataFrame:
    """Loops that start where one of the places does, or those that don't."""
    key = ["chr", "start1", "start2"]
    return loops.join(places.select(*key).distinct(), key, "left_semi" if keep else "left_anti")


def _within(tolerance: int) -> Column:
    near = [F.abs(F.col(c) - F.col(f"b_{c}")) <= tolerance for c in ENDS]
    return near[0] & near[1] & near[2] & near[3]


def tolerant(a: DataFrame, b: DataFrame, tolerance: int, keep: bool = True) -> DataFrame:
    """a's loops with (without) one of b within the tolerance at all four coordinates.

    b stands in nine cells each, which the size of its file doesn't tell: so it isn't left to be broadcast.
    """
    width = max(1, tolerance)
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    left, right = _cells(a, "start1", "start2", width, False), _cells(b, "b_start1", "b_start2", width, True).withColumnsRenamed({"_cx": "_bx", "_cy": "_by"})
    on = (F.col("chr") == F.col("b_chr")) & (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by")) & _within(tolerance)
    return left.join(right.hint("merge"), on, "left_semi" if keep else "left_anti").drop("_cx", "_cy")


def differences(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """Loops of one list alone, labelled with it."""
    return tolerant(a, b, tolerance, False).withColumn("only", F.lit("A")).unionByName(tolerant(b, a, tolerance, False).withColumn("only", F.lit("B")))


def compare_lists(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """Common (equal in both), A* or B* (within the tolerance), A or B (in one alone)."""
    key = ["chr", *ENDS]
    out = [a.join(b.select(*key).distinct().hint("merge"), key, "left_semi").withColumn("label", F.lit("Common"))]
    for mine, other, name in ((a, b, "A"), (b, a, "B")):
        rest = mine.join(other.select(*key).distinct().hint("merge"), key, "left_anti")
        out += [tolerant(rest, other, tolerance).withColumn("label", F.lit(f"{name}*")), tolerant(rest, other, tolerance, False).withColumn("label", F.lit(name))]
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def overlapping_rectangles(a: DataFrame, b: DataFrame, width: int = 50_000) -> DataFrame:
    """Pairs of features whose rectangles overlap, in the cell where the overlap begins."""
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    cover = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    left = a.withColumn("_cx", cover("start1", "end1")).withColumn("_cy", cover("start2", "end2"))
    right = b.withColumn("_bx", cover("b_start1", "b_end1")).withColumn("_by", cover("b_start2", "b_end2"))
    on = (F.col("chr") == F.col("b_chr")) & (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by"))
    for s, e in (("start1", "end1"), ("start2", "end2")):
        on &= (F.col(s) <= F.col(f"b_{e}")) & (F.col(f"b_{s}") <= F.col(e))
    first = (F.floor(F.greatest("start1", "b_start1") / width) == F.col("_cx")) & (F.floor(F.greatest("start2", "b_start2") / width) == F.col("_cy"))
    return left.join(right, on & first).drop("_cx", "_cy", "_bx", "_by")


def nearest(points: DataFrame, loops: DataFrame, n: int, first_radius: int = 10_000) -> DataFrame:
    """The n loops of the chromosome that are nearest to each point, however far.

    Points look within a radius, by grid cells of that width; those that find fewer than n there, and fewer than their
    chromosome has, look again within twice the radius, so that each round has fewer points.
    """
    most = loops.groupBy("chr").agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("_most"))
    left = written(points.join(most, "chr"), "nearest-points")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("far", "b_id"))
    out, radius = None, first_radius
    while True:
        found = near_points(left, loops, radius).withColumn("rank", rank).where(F.col("rank") <= n)
        found = written(found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id"))), "nearest-found")
        done = found.where("_n = _most")
        out = done if out is None else out.unionByName(done)
        left = written(left.join(done.select("id").distinct(), "id", "left_anti"), "nearest-points")
        if not left.limit(1).count():
            return out.drop("_n", "_most")
        radius *= 4


def loop_domains(loops: DataFrame, domains: DataFrame, threshold: int) -> DataFrame:
    """Domains whose corner (start, end) is within the threshold of a loop's."""
    corner = domains.select("id", "chr", "start1", F.col("end1").alias("start2"))
    places = loops.select("id", "chr", "start1", "start2")
    near = near_points(places, corner, 2 * threshold).where(
        (F.abs(F.col("start1") - F.col("b_start1")) <= threshold) & (F.abs(F.col("start2") - F.col("b_start2")) <= threshold)
    )
    return domains.join(near.select(F.col("b_id").alias("id")).distinct(), "id", "left_semi")


def _middles(loops: DataFrame, resolution: int) -> DataFrame:
    """The loops with the bins of their middles: mx, my."""
    mid = lambda e: F.floor((F.floor((F.col(f"start{e}") + F.col(f"end{e}")) / 2)) / resolution)
    return loops.withColumns({"mx": mid(1), "my": mid(2)})


def _around(places: DataFrame, window: int) -> DataFrame:
    """The rows, each with all cells of the window around its middle: bin_x, bin_y, dx, dy."""
    spread = F.sequence(F.lit(-window), F.lit(window))
    at = places.withColumn("dx", F.explode(spread)).withColumn("dy", F.explode(spread))
    return at.withColumns({"bin_x": (F.col("mx") + F.col("dx")).cast("int"), "bin_y": (F.col("my") + F.col("dy")).cast("int")})


def _intra(cells: DataFrame) -> DataFrame:
    return cells.where("chr1 = chr2").select(F.col("chr1").alias("chr"), "bin_x", "bin_y", "counts")


def pile_up(loops: DataFrame, cells: DataFrame, resolution: int, window: int = 10) -> DataFrame:
    """The sum of the (2w+1)^2 windows around the loops: dx, dy, value.

    Loops of one place are counted first; each place is spread over its window's cells, an equi-join with the matrix; only sums by place are left.
    """
    places = _middles(loops, resolution).groupBy("chr", "mx", "my").agg(F.count(F.lit(1)).alias("n"))
    at = _around(places, window).join(_intra(cells), ["chr", "bin_x", "bin_y"])
    return at.groupBy("dx", "dy").agg(F.sum(F.col("n") * F.col("counts")).alias("value"))


def corner_scores(pile: DataFrame, window: int = 10, corner: int = 3) -> DataFrame:
    """The centre against the mean of each corner and of all, and its Z-score in the lower left."""
    size = 2 * window + 1
    spark = pile.sparkSession
    grid = spark.range(size * size).select((F.floor(F.col("id") / size) - window).cast("int").alias("dx"), (F.col("id") % size - window).cast("int").alias("dy"))
    g = grid.join(pile, ["dx", "dy"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    low, high = lambda c: F.col(c) < -window + corner, lambda c: F.col(c) > window - corner
    corners = {"ul": low("dx") & low("dy"), "ur": low("dx") & high("dy"), "ll": high("dx") & low("dy"), "lr": high("dx") & high("dy")}
    centre = F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("value")))
    out = {f"p2{k}": F.try_divide(centre, F.avg(F.when(c, F.col("value")))) for k, c in corners.items()}
    out["p2m"] = F.try_divide(centre, F.avg(F.when((F.col("dx") != 0) | (F.col("dy") != 0), F.col("value"))))
    ll = F.when(corners["ll"], F.col("value"))
    out["zscore_ll"] = F.try_divide(centre - F.avg(ll), F.stddev_samp(ll))
    return g.agg(*(v.alias(k) for k, v in out.items()))


def centre_normed(pile: DataFrame) -> DataFrame:
    """A pile-up by its centre; where that is 0, by the least positive value, or 1."""
    centre = F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("value")))
    by = pile.agg(F.coalesce(F.nullif(centre, F.lit(0.0)), F.min(F.when(F.col("value") > 0, F.col("value"))), F.lit(1.0)).alias("by"))
    return pile.join(F.broadcast(by)).select("dx", "dy", (F.col("value") / F.col("by")).alias("value"))


def mean_normed(pile: DataFrame, window: int = 10) -> DataFrame:
    """A pile-up by the mean of its whole square, at least 1."""
    by = pile.agg(F.greatest(F.sum("value") / (2 * window + 1) ** 2, F.lit(1.0)).alias("by"))
    return pile.join(F.broadcast(by)).select("dx", "dy", (F.col("value") / F.col("by")).alias("value"))


def enhancement(loops: DataFrame, cells: DataFrame, resolution: int, window: int = 10) -> DataFrame:
    """Of each loop with counts in its window, its own cell by the mean of the others: id, enhancement. Loops of one place share its window."""
    centre = F.sum(F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("counts")).otherwise(0.0))
    rest = (F.sum("counts") - centre) / ((2 * window + 1) ** 2 - 1)
    place, middles = ["chr", "mx", "my"], _middles(loops, resolution)
    at = _around(middles.select(*place).distinct(), window).join(_intra(cells), ["chr", "bin_x", "bin_y"])
    found = at.groupBy(*place).agg(F.try_divide(centre, rest).alias("enhancement"))
    return middles.select("id", *place).join(found, place).select("id", "enhancement")


def pile_up_by_distance(loops: DataFrame, cells: DataFrame, resolution: int, window: int = 10, corner: int = 3, first: int = 20_000, bands: int = 8) -> DataFrame:
    """The loops by doubling bands of distance, of each band the centre of its pile-up, and that by the mean of the lower left corner: band, n_loops, centre, p2ll."""
    far = F.floor(F.abs(F.col("start2") - F.col("start1")) / first)
    banded = loops.where(far >= 1).withColumn("band", F.floor(F.log2(far.cast("double"))).cast("int")).where(F.col("band") < bands)
    places = _middles(banded, resolution).groupBy("band", "chr", "mx", "my").agg(F.count(F.lit(1)).alias("n"))
    here = (F.col("dx") == 0) & (F.col("dy") == 0)
    low = (F.col("dx") > window - corner) & (F.col("dy") < -window + corner)
    total = lambda c: F.sum(F.when(c, F.col("n") * F.col("counts")).otherwise(0.0))
    sums = _around(places, window).join(_intra(cells), ["chr", "bin_x", "bin_y"]).groupBy("band").agg(total(here).alias("centre"), F.try_divide(total(here), total(low) / corner**2).alias("p2ll"))
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("n_loops")).join(sums, "band", "left").select("band", "n_loops", "centre", "p2ll")
