"""Interval joins and merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a bucket of a range join; of one of starts with ends.
BUCKET, PART_BUCKET = 5_000, 256
#: Base intervals that begin in so many bases are one row beside the hits that they can overlap; so many lists are one batch.
LIST_BUCKET, LISTS = 1_000, 32


def _buckets(df: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", width: int = BUCKET) -> DataFrame:
    """Rows of a and b, both (id, chr, x1, x2, ...), whose closed intervals overlap; b's columns get the prefix b_.

    Both sides are dealt to buckets along the chromosome, an equi-key, so the join is by shuffle at any size. A pair is
    kept in the bucket where the overlap begins, so it comes once, without a second shuffle.
    """
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    left = _buckets(a, "x1", "x2", width)
    right = _buckets(b, "b_x1", "b_x2", width).withColumnRenamed("_bucket", "b__bucket")
    on = (F.col("chr") == F.col("b_chr")) & (F.col("_bucket") == F.col("b__bucket")) & (F.col("x1") <= F.col("b_x2")) & (F.col("b_x1") <= F.col("x2"))
    if how in ("left_semi", "left_anti"):
        found = left.join(right, on, "left_semi").select("id").distinct()
        return a.join(found, "id", how)
    first = F.floor(F.greatest("x1", "b_x1") / width) == F.col("_bucket")
    return left.join(right, on & first).drop("_bucket", "b__bucket")


def overlap_pairs(a: DataFrame, b: DataFrame, width: int = BUCKET) -> DataFrame:
    """overlap_join(), for lists of which most rows near each other overlap, so that there are far more pairs than rows.

    Each stretch is met in order along the chromosome, row of a by row of a, so that pairs of one row stand together beside those of its neighbours: written in columns, they
    take a fraction of the room. Windows give that order, which the join keeps; a sort alone would be left out of the plan. The number of tasks goes by the pairs', not by the rows' size.
    """
    tasks = 4 * a.sparkSession.sparkContext.defaultParallelism

    def placed(df: DataFrame) -> DataFrame:
        by = Window.partitionBy("chr", "_bucket").orderBy("x1", "x2", "id")
        return _buckets(df, "x1", "x2", width).repartition(tasks, "chr", "_bucket").withColumn("_number", F.row_number().over(by)).where("_number > 0").drop("_number")

    right = placed(b).withColumnsRenamed({c: f"b_{c}" for c in [*b.columns, "_bucket"]})
    on = (F.col("chr") == F.col("b_chr")) & (F.col("_bucket") == F.col("b__bucket")) & (F.col("x1") <= F.col("b_x2")) & (F.col("b_x1") <= F.col("x2"))
    start = F.col("_bucket") * width
    first = F.greatest("x1", "b_x1").between(start, start + (width - 1))
    return placed(a).hint("merge").join(right, on & first).drop("_bucket", "b__bucket")


def _blocks(lo: Column, hi: Column) -> Column:
    """The aligned blocks, of 2**level bases each, that [lo, hi] is made of: at most two a level."""
    size = hi - lo + 1
    first = lambda k: F.ceil(lo / F.pow(F.lit(2.0), k))
    last = lambda k: F.floor((hi + 1) / F.pow(F.lit(2.0), k)) - 1

    def ends(k: Column) -> Column:
        alone = lambda block: (first(k) <= last(k)) & ~F.floor(block / 2).between(first(k + 1), last(k + 1))
        left, right = F.when(alone(first(k)), first(k)), F.when(alone(last(k)) & (first(k) < last(k)), last(k))
        return F.transform(F.array_compact(F.array(left, right)), lambda block: F.struct(k.cast("int").alias("_level"), block.cast("long").alias("_block")))

    # a range of n bases holds no block of more than n
    return F.when(size > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2(size.cast("double"))).cast("int")), ends)))


def _above(at: str, longest: int) -> Column:
    """All aligned blocks around a base that a range of up to ``longest`` bases can be made of."""
    levels = F.sequence(F.lit(0), F.lit(max(longest, 1).bit_length() - 1))
    return F.transform(levels, lambda k: F.struct(k.alias("_level"), F.floor(F.col(at) / F.pow(F.lit(2.0), k)).cast("long").alias("_block")))


def over_hits(base: DataFrame, hits: DataFrame, of: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """Of each base interval with hits, aggregates over the hits that overlap it: id and a column for each of ``of``, an aggregate of hits and what joins several of it.

    A hit overlaps if it starts within the base interval, or if it holds the base's start behind its own. Either is a range that holds
    a point: the range is made of aligned blocks, which are aggregated once, so no pair of a base interval and a hit is ever a row.
    """
    block, names = ["chr", "_level", "_block"], list(of)
    long_base, long_hit = (int(df.agg(F.max(F.col("x2") - F.col("x1") + 1)).first()[0] or 1) for df in (base, hits))
    aggregated = [of[n][0].alias(n) for n in names]
    starts = hits.select("*", F.inline(_above("x1", long_base))).groupBy(*block).agg(*aggregated)
    holders = hits.select("*", F.inline(_blocks(F.col("x1") + 1, F.col("x2")))).groupBy(*block).agg(*aggregated)
    ranges = base.select("id", "chr", F.inline(_blocks(F.col("x1"), F.col("x2"))))
    points = base.select("id", "chr", F.inline(_above("x1", long_hit)))
    both = ranges.join(starts.hint("merge"), block).unionByName(points.join(holders.hint("merge"), block))
    return both.groupBy("id").agg(*(of[n][1](n).alias(n) for n in names))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct common parts.

    A part starts where an interval of a or of b does, and ends where one does. Where start and end are of one interval, the part is that interval. Otherwise it is
    told by the start and the end alone: of a start the farthest end counts, of an end the nearest start. So each part is made once, and neither pairs nor parts are shuffled.
    """
    def starts(df: DataFrame) -> DataFrame:
        return df.groupBy("chr", "x1").agg(F.max("x2").alias("far"))

    def ends(df: DataFrame) -> DataFrame:
        return df.groupBy("chr", "x2").agg(F.min("x1").alias("near"))

    def within(own: DataFrame, other: DataFrame) -> DataFrame:
        """Distinct intervals that lie in one of the other list: whose end is no farther than any of those that start before them. Running maxima of stretches are carried."""
        at = starts(other).unionByName(own.select("chr", "x1"), allowMissingColumns=True).groupBy("chr", "x1").agg(F.max("far").alias("far"))
        at = at.withColumn("_stretch", F.floor(F.col("x1") / (1 << 16)))
        over = Window.partitionBy("chr").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = at.groupBy("chr", "_stretch").agg(F.max("far").alias("_far")).select("chr", "_stretch", F.max("_far").over(over).alias("_carried"))
        by = Window.partitionBy("chr", "_stretch").orderBy("x1").rowsBetween(Window.unboundedPreceding, 0)
        reach = at.withColumn("_here", F.max("far").over(by)).join(carried, ["chr", "_stretch"])
        return own.distinct().join(reach.select("chr", "x1", F.greatest("_here", "_carried").alias("_reach")), ["chr", "x1"]).where("x2 <= _reach").select("chr", "x1", "x2")

    def told(firsts: DataFrame, lasts: DataFrame) -> DataFrame:
        """All starts and ends of which each lies in the other's longest interval."""
        first = firsts.withColumn("_bucket", F.floor(F.col("x1") / PART_BUCKET))
        last = _buckets(lasts.withColumnRenamed("chr", "b_chr"), "near", "x2", PART_BUCKET).withColumnRenamed("_bucket", "b__bucket")
        on = (F.col("chr") == F.col("b_chr")) & (F.col("_bucket") == F.col("b__bucket")) & (F.col("near") <= F.col("x1")) & (F.col("x1") <= F.col("x2")) & (F.col("x2") <= F.col("far"))
        return first.hint("merge").join(last, on)

    def also(df: DataFrame, more: DataFrame, on: str, name: str) -> DataFrame:
        """With what the other list has at that start or end."""
        value = next(c for c in more.columns if c in ("far", "near"))
        return df.join(more.select("chr", on, F.col(value).alias(name)), ["chr", on], "left")

    a, b = a.select("chr", "x1", "x2"), b.select("chr", "x1", "x2")
    of_a = told(starts(a), ends(b)).select("chr", "x1", "x2")
    # a start of b and an end of a, but for those that are a start of a and an end of b too
    twice = F.coalesce((F.col("a_far") >= F.col("x2")) & (F.col("b_near") <= F.col("x1")), F.lit(False))
    of_b = told(also(starts(b), starts(a), "x1", "a_far"), also(ends(a), ends(b), "x2", "b_near")).where(~twice).select("chr", "x1", "x2")

    def whole(own: DataFrame, other: DataFrame) -> DataFrame:
        """Intervals in one of the other list that are not told by a start and an end of different lists."""
        mine = also(also(within(own, other), starts(other), "x1", "o_far"), ends(other), "x2", "o_near")
        return mine.where(~F.coalesce(F.col("o_far") >= F.col("x2"), F.lit(False)) & ~F.coalesce(F.col("o_near") <= F.col("x1"), F.lit(False))).select("chr", "x1", "x2")

    return of_a.unionByName(of_b).unionByName(whole(a, b)).unionByName(whole(b, a))


def preserving_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's intervals that overlap any of b, with their number and the smallest id."""
    found = over_hits(a, b, {"n_hits": (F.count(F.lit(1)), F.sum), "first_hit": (F.min("id"), F.min)})
    return a.select("id", "chr", "x1", "x2").join(found, "id")


def all_references(base: DataFrame, hits: DataFrame, width: int = LIST_BUCKET) -> DataFrame:
    """Base intervals that overlap any of hits, both (id, chr, x1, x2), with the number of these and their ids, ascending and joined by commas: id, chr, x1, x2, n_hits, hits.

    A stretch of a chromosome is one row: the base intervals that begin there, and the hits that start before the longest of them can end. Lists are made inside
    that row, so no pair is shuffled, sorted or grouped; a row is in proportion to the longest list of its stretch.
    """
    longest = int(base.agg(F.max(F.col("x2") - F.col("x1") + 1)).first()[0] or 1)
    mine = base.groupBy("chr", F.floor(F.col("x1") / width).alias("_bucket")).agg(F.collect_list(F.struct("id", "x1", "x2")).alias("base"))
    first, last = F.ceil((F.col("x1") - (width + longest - 2)) / width), F.floor(F.col("x2") / width)
    near = hits.select("chr", "id", "x1", "x2", F.explode(F.sequence(first, last)).alias("_bucket")).groupBy("chr", "_bucket").agg(F.collect_list(F.struct("id", "x1", "x2")).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(column: pa.ListArray, k: int) -> list[np.ndarray]:
            own = column.slice(k, 1).flatten()
            return [own.field(c).to_numpy(zero_copy_only=False) for c in ("id", "x1", "x2")]

        for batch in batches:
            for k, chr_ in enumerate(batch.column("chr").to_pylist()):
                ids, x1, x2 = of(batch.column("near"), k)
                order = np.argsort(ids, kind="stable")
                x1, x2, names = x1[order], x2[order], np.array([str(i) for i in ids[order].tolist()], object)
                own = list(zip(*(c.tolist() for c in of(batch.column("base"), k)), strict=True))
                for at in range(0, len(own), LISTS):
                    rows = [(i, a, b, names[(x1 <= b) & (a <= x2)]) for i, a, b in own[at : at + LISTS]]
                    rows = [(i, chr_, a, b, len(found), ",".join(found)) for i, a, b, found in rows if len(found)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["id", "chr", "x1", "x2", "n_hits", "hits"])

    return mine.join(near.hint("merge"), ["chr", "_bucket"]).mapInArrow(run, "id bigint, chr int, x1 bigint, x2 bigint, n_hits bigint, hits string")


def in_locus(base: DataFrame, hits: DataFrame, unique: bool) -> DataFrame:
    """Hits that are the only one (unique), or one of several, to overlap a base interval."""
    both = overlap_join(base, hits)
    counts = both.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 1" if unique else "n > 1")
    return both.join(counts, "id").select(*(F.col(f"b_{c}").alias(c) for c in hits.columns)).distinct()


def best_in_locus(base: DataFrame, hits: DataFrame) -> DataFrame:
    """Of the hits that overlap a base interval the one of the highest score, then the smallest id."""
    found = over_hits(base, hits, {"best": (F.max(F.struct("score", (-F.col("id")).alias("neg"))), F.max)})
    return found.select("id", (-F.col("best.neg")).alias("hit"), F.col("best.score").alias("score"))


def merge(a: DataFrame, gap: int = 0) -> DataFrame:
    """Unions of overlapping intervals of a chromosome, with their number.

    Islands begin where an interval starts beyond all ends so far. The running end is taken within stretches of the
    chromosome, and carried over the few stretches, so that no chromosome is in one task.
    """
    span = 1 << 22
    a = a.withColumn("stretch", F.floor(F.col("x1") / span))
    ends = a.groupBy("chr", "stretch").agg(F.max("x2").alias("far"))
    over = Window.partitionBy("chr").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("chr", "stretch", F.max("far").over(over).alias("carried"))
    by = Window.partitionBy("chr", "stretch").orderBy("x1", "x2")
    a = a.join(ends, ["chr", "stretch"]).withColumn("reach", F.greatest(F.max("x2").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried")))
    a = a.withColumn("new", F.coalesce(F.col("x1") > F.col("reach") + gap, F.lit(True)).cast("int"))
    heads = a.groupBy("chr", "stretch").agg(F.sum("new").alias("n_new"))
    heads = heads.select("chr", "stretch", F.coalesce(F.sum("n_new").over(over), F.lit(0)).alias("before"))
    a = a.withColumn("island_here", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).join(heads, ["chr", "stretch"])
    return a.groupBy("chr", (F.col("island_here") + F.col("before")).alias("island")).agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.count(F.lit(1)).alias("n")).drop("island")


def widen(a: DataFrame, least: int) -> DataFrame:
    """Intervals shorter than ``least`` grow on both sides of their middle."""
    mid = F.floor((F.col("x1") + F.col("x2")) / 2)
    short = F.col("x2") - F.col("x1") < least
    return a.withColumns({"x1": F.when(short, F.greatest(mid - least // 2, F.lit(0))).otherwise(F.col("x1")), "x2": F.when(short, mid + least - least // 2).otherwise(F.col("x2"))})


def anchors(loops: DataFrame, least: int = 0) -> DataFrame:
    """Both ends of the loops of a chromosome, merged, then widened."""
    ends = loops.select("chr", F.col("start1").alias("x1"), F.col("end1").alias("x2")).unionByName(loops.select("chr", F.col("start2").alias("x1"), F.col("end2").alias("x2")))
    return widen(merge(ends), least) if least else merge(ends)


def unique_per_cell(motifs: DataFrame, size: int) -> DataFrame:
    """Motifs that are alone in their coarse cell."""
    cell = [F.col("chr"), F.floor(F.col("x1") / size).alias("c1"), F.floor(F.col("x2") / size).alias("c2")]
    return motifs.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("score").alias("score")).where("n = 1").select("id", "chr", "score")


def best_per_cell(motifs: DataFrame, size: int) -> DataFrame:
    """The motif of the highest score of each coarse cell."""
    cell = [F.col("chr"), F.floor(F.col("x1") / size).alias("c1"), F.floor(F.col("x2") / size).alias("c2")]
    best = F.max(F.struct("score", (-F.col("id")).alias("neg")))
    return motifs.groupBy(*cell).agg(best.alias("b")).select((-F.col("b.neg")).alias("id"), "chr", F.col("b.score").alias("score"))


def binned_track(track: DataFrame, size: int) -> DataFrame:
    """Mean and maximum of scores over all bins that an interval touches."""
    bins = track.withColumn("bin", F.explode(F.sequence(F.floor(F.col("x1") / size), F.floor(F.col("x2") / size))))
    return bins.groupBy("chr", "bin").agg(F.avg("score").alias("mean"), F.max("score").alias("high"))


def lift(rows: DataFrame, scaffolds: DataFrame, width: int = BUCKET) -> DataFrame:
    """Intervals cut to the scaffolds that they overlap, at their new places, mirrored where a scaffold is inverted.

    scaffolds: id, chr, x1, x2 (original, closed), new_start, inverted.
    """
    both = overlap_pairs(rows.select("id", "chr", "x1", "x2"), scaffolds.select("id", "chr", "x1", "x2", "new_start", "inverted"), width)
    a, b = F.greatest("x1", "b_x1"), F.least("x2", "b_x2")
    straight, turned = F.col("b_new_start") + a - F.col("b_x1"), F.col("b_new_start") + F.col("b_x2") - b
    start = F.when(F.col("b_inverted"), turned).otherwise(straight)
    return both.select("id", "chr", F.col("b_id").alias("scaffold"), start.alias("x1"), (start + b - a).alias("x2"))


def pseudo_chromosome(regions: DataFrame, buffer: int = 10) -> DataFrame:
    """Regions one after the other, with ``buffer`` bases between: id, chr, x1, x2, new_start.

    Running sums are taken within stretches of a chromosome and carried over the few stretches.
    """
    by = Window.partitionBy("chr", "stretch").orderBy("x1", "x2", "id").rowsBetween(Window.unboundedPreceding, -1)
    r = regions.select("id", "chr", "x1", "x2").withColumns({"stretch": F.floor(F.col("x1") / (1 << 22)), "width": F.col("x2") - F.col("x1") + buffer})
    over = Window.orderBy("chr", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = r.groupBy("chr", "stretch").agg(F.sum("width").alias("all"))
    sums = sums.select("chr", "stretch", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("before"))
    r = r.withColumn("here", F.coalesce(F.sum("width").over(by), F.lit(0))).join(sums, ["chr", "stretch"])
    return r.select("id", "chr", "x1", "x2", (F.col("here") + F.col("before")).alias("new_start"))


def lift_cells(cells: DataFrame, regions: DataFrame, bin_size: int) -> DataFrame:
    """Cells both of whose bins start in regions (id, chr, x1, x2, new_start), at their places in the pseudo chromosome: region_x, region_y, bin_x, bin_y, counts.

    Overlapping regions each take their copy. A bin's regions are one row, so both joins are equi-joins of cells, and the copies are made behind them, where nothing is sorted any more.
    """
    bins = regions.select("id", "chr", "x1", "new_start", F.explode(F.sequence(F.ceil(F.col("x1") / bin_size), F.floor(F.col("x2") / bin_size))).alias("bin")).where(F.col("bin") * bin_size >= F.col("x1"))
    bins = bins.select("id", "chr", F.col("bin").cast("int").alias("bin"), F.floor((F.col("new_start") + F.col("bin") * bin_size - F.col("x1")) / bin_size).alias("new"))
    there = bins.groupBy("chr", "bin").agg(F.collect_list(F.struct("id", "new")).alias("regions"))
    x = there.select(F.col("chr").alias("chr1"), F.col("bin").alias("bin_x"), F.col("regions").alias("x"))
    y = there.select(F.col("chr").alias("chr2"), F.col("bin").alias("bin_y"), F.col("regions").alias("y"))
    both = cells.join(x, ["chr1", "bin_x"]).join(y, ["chr2", "bin_y"]).select("x", "y", "counts")
    both = both.repartition(4 * cells.sparkSession.sparkContext.defaultParallelism)  # few rows make many
    one = both.select("y", "counts", F.inline("x")).withColumnsRenamed({"id": "region_x", "new": "new_x"})
    two = one.select("region_x", "new_x", "counts", F.inline("y")).withColumnsRenamed({"id": "region_y", "new": "new_y"})
    return two.select("region_x", "region_y", F.least("new_x", "new_y").alias("bin_x"), F.greatest("new_x", "new_y").alias("bin_y"), "counts")


def lift_track(track: DataFrame, regions: DataFrame) -> DataFrame:
    """The parts of a track's intervals within regions, at their places in the pseudo chromosome: id, region, x1, x2, score."""
    both = overlap_pairs(track.select("id", "chr", "x1", "x2", "score"), regions.select("id", "chr", "x1", "x2", "new_start"))
    at = lambda p: p - F.col("b_x1") + F.col("b_new_start")
    return both.select("id", F.col("b_id").alias("region"), at(F.greatest("x1", "b_x1")).alias("x1"), at(F.least("x2", "b_x2")).alias("x2"), "score")


def lift_features(rows: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """Features (id, chr, start1, end1, start2, end2, strand1, strand2) both of whose ends lie within scaffolds, at their new places; an inverted scaffold turns the strand.

    Each place of one end meets each of the other, so far more rows come out than go in: the number of tasks goes by the cores, not by the size of what is shuffled.
    """
    tasks = 8 * rows.sparkSession.sparkContext.defaultParallelism

    def end(e: str) -> DataFrame:
        ends = rows.select("id", "chr", F.col(f"start{e}").alias("x1"), F.col(f"end{e}").alias("x2"), F.col(f"strand{e}").alias("strand"))
        both = overlap_join(ends, scaffolds).where("b_x1 <= x1 and x2 <= b_x2")
        start = F.when(F.col("b_inverted"), F.col("b_new_start") + F.col("b_x2") - F.col("x2")).otherwise(F.col("b_new_start") + F.col("x1") - F.col("b_x1"))
        strand = F.col("strand") != F.col("b_inverted")
        return both.select("id", F.col("b_id").alias(f"scaffold{e}"), start.alias(f"start{e}"), (start + F.col("x2") - F.col("x1")).alias(f"end{e}"), strand.alias(f"strand{e}")).repartition(tasks, "id")

    return end("1").hint("merge").join(end("2"), "id")


def track_by_middle(track: DataFrame, size: int) -> DataFrame:
    """Mean and maximum of scores by the bin of an interval's middle."""
    middle = F.floor(F.floor((F.col("x1") + F.col("x2")) / 2) / size)
    return track.groupBy("chr", middle.alias("bin")).agg(F.avg("score").alias("mean"), F.max("score").alias("high"))


def coverage_track(vector: DataFrame, chr_: int, first: int, last: int) -> DataFrame:
    """A chromosome's values of a vector from bin to bin, and the 95th percentile of all its values, where the track's scale ends."""
    mine = vector.where(F.col("chr") == chr_)
    top = mine.agg(F.percentile("value", F.lit(0.95)).alias("top"))
    return mine.where(F.col("bin").between(first, last)).select("bin", "value").join(F.broadcast(top))


def genes_by_name(genes: DataFrame, names: DataFrame) -> DataFrame:
    """Places of genes, whatever the case of the names."""
    wanted = names.select(F.lower("name").alias("_key")).distinct()
    return genes.join(wanted, F.lower(genes["name"]) == F.col("_key")).drop("_key")
