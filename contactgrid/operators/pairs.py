"""Filters and projections of read pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intra_only(pairs: DataFrame) -> DataFrame:
    """F01."""
    return pairs.where("chr1 = chr2")


def on_chromosomes(pairs: DataFrame, names: Sequence) -> DataFrame:
    """both ends on the list."""
    return pairs.where(F.col("chr1").isin(list(names)) & F.col("chr2").isin(list(names)))


def least_mapq(pairs: DataFrame, q: int) -> DataFrame:
    """the lower of both qualities; an absent one passes."""
    return pairs.where(F.least(F.coalesce("mapq1", F.lit(1000)), F.coalesce("mapq2", F.lit(1000))) >= q)


def alignment() -> Column:
    """how the strands of a pair on one chromosome face each other, by position; null between chromosomes.

    Both forward LL or both reverse RR (each TANDEM); the first forward and the second reverse INNER, else OUTER.
    """
    first_is_low = F.col("pos1") < F.col("pos2")
    low, high = F.when(first_is_low, F.col("strand1")).otherwise(F.col("strand2")), F.when(first_is_low, F.col("strand2")).otherwise(F.col("strand1"))
    return F.when(F.col("chr1") == F.col("chr2"), F.when(low & high, "LL").when(~low & ~high, "RR").when(low, "INNER").otherwise("OUTER"))


def between_fragments(pairs: DataFrame) -> DataFrame:
    """without pairs inside one fragment."""
    return pairs.where("not (chr1 = chr2 and frag1 = frag2)")


def subsample(pairs: DataFrame, fraction: float, seed: int = 0, by: str | None = None) -> DataFrame:
    """about a share of the pairs, dealt by a hash of the column ``by``, or of all columns, and the seed.

    So a task that is run again takes the same pairs, in whatever order they come; pairs that are alike stay or go together, and a smaller share lies inside a larger one.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *([by] if by else pairs.columns)), 11) / F.lit(float(1 << 53))
    return pairs.where(draw < fraction)


def clamp(pairs: DataFrame, chrom_sizes: DataFrame) -> DataFrame:
    """Positions within [0, length]; pairs with an unknown chromosome go.

    chrom_sizes is the list of a genome's chromosomes, which is small by its nature, but its size isn't taken for
    granted: Spark broadcasts it by its measured size or else shuffles.
    """
    for end in ("1", "2"):
        size = chrom_sizes.select(F.col("chr").alias(f"chr{end}"), F.col("length").alias("_length"))
        pairs = pairs.join(size, f"chr{end}").withColumn(f"pos{end}", F.least(F.greatest(f"pos{end}", F.lit(0)), F.col("_length")).cast("int")).drop("_length")
    return pairs


def canonical(pairs: DataFrame) -> DataFrame:
    """the lower chromosome first; ends of one chromosome by position."""
    turn = (F.col("chr1") > F.col("chr2")) | ((F.col("chr1") == F.col("chr2")) & (F.col("pos1") > F.col("pos2")))
    ends = [c[:-1] for c in pairs.columns if c.endswith("1") and f"{c[:-1]}2" in pairs.columns]
    swapped = {f"{c}{a}": F.when(turn, F.col(f"{c}{b}")).otherwise(F.col(f"{c}{a}")) for c in ends for a, b in ("12", "21")}
    return pairs.select(*(swapped[c].alias(c) if c in swapped else F.col(c) for c in pairs.columns))


def site_arrays(sites: DataFrame) -> DataFrame:
    """One sorted array of cut sites a chromosome."""
    return sites.groupBy("chr").agg(F.array_sort(F.collect_set("pos")).alias("sites"))


def _as_of(rows: DataFrame, sites: DataFrame, pos: str) -> DataFrame:
    """For each row, of its chromosome's sites, how many are at or before pos (_frag), the last of these and the next.

    Sites and rows are one sorted stream a stretch of a chromosome; running counts carry the sites' numbers over
    the stretches, so that no chromosome is in one task. The next site is the last one of the falling order: a frame
    with an open end would be read anew for each row.
    """
    span = 1 << 17
    numbered = sites.distinct().withColumn("stretch", F.floor(F.col("pos") / span))
    per = numbered.groupBy("chr", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    wanted = rows.select("chr", F.floor(F.col(pos) / span).alias("stretch")).distinct()
    over, back = (Window.partitionBy("chr").orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in ("stretch", F.desc("stretch")))
    steps = per.join(wanted, ["chr", "stretch"], "full")
    steps = steps.select(
        "chr", "stretch", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"), F.last("last", True).over(over).alias("prev"), F.last("first", True).over(back).alias("next"),
    )
    both = rows.select(F.struct("*").alias("row"), "chr", F.col(pos).alias("at"), F.lit(None).cast("int").alias("site"))
    both = both.unionByName(sites.distinct().select(F.lit(None).cast(both.schema["row"].dataType).alias("row"), "chr", F.col("pos").alias("at"), F.col("pos").alias("site")))
    both = both.withColumn("stretch", F.floor(F.col("at") / span))
    by, is_row = Window.partitionBy("chr", "stretch"), F.col("row").isNotNull()
    upto = by.orderBy("at", is_row).rowsBetween(Window.unboundedPreceding, 0)
    after = by.orderBy(F.desc("at"), is_row.desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({"in_stretch": F.count("site").over(upto), "prev_here": F.last("site", True).over(upto), "next_here": F.last("site", True).over(after)})
    found = both.where("row is not null").join(steps, ["chr", "stretch"], "left")
    return found.select(
        "row.*", (F.col("in_stretch") + F.coalesce("before", F.lit(0))).cast("int").alias("_frag"), F.coalesce("prev_here", "prev").alias("_prev"), F.coalesce("next_here", "next").alias("_next")
    )


def fragment_of(rows: DataFrame, sites: DataFrame, pos: str = "pos") -> DataFrame:
    """The number of the fragment that holds pos; a position on a site belongs to the fragment after it."""
    return _as_of(rows, sites, pos).withColumnRenamed("_frag", "frag").drop("_prev", "_next")


def distance_to_site(rows: DataFrame, sites: DataFrame, pos: str = "pos") -> DataFrame:
    """The distance to the nearest cut site on either side."""
    near = _as_of(rows, sites, pos)
    return near.withColumn("site_distance", F.least(F.col(pos) - F.col("_prev"), F.col("_next") - F.col(pos))).drop("_frag", "_prev", "_next")


def bed_to_fragments(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Intervals (chr, x1, x2) with the fragments of their start and end."""
    return fragment_of(fragment_of(rows, sites, "x1").withColumnRenamed("frag", "frag1"), sites, "x2").withColumnRenamed("frag", "frag2")


def site_rows(sites: DataFrame) -> DataFrame:
    """A row of one base for each cut site: chr, x1, x2, idx (from 0). Sites are numbered along stretches of a chromosome."""
    at = sites.distinct().withColumns({"x1": F.col("pos") - 1, "x2": F.col("pos")})
    return fragment_of(at, sites, "pos").select("chr", "x1", "x2", (F.col("frag") - 1).alias("idx"))


def nearest_sites(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """Both ends of the pairs with the distance to their fragment's nearer end, and which end that is by strand: chr, pos, strand, distance, side.

    Ends beyond a chromosome's last site go. Of ends as near the first counts; a chromosome's start is an end of its first fragment.
    """
    end = lambda e: F.struct(F.col(f"strand{e}").alias("strand"), F.col(f"chr{e}").alias("chr"), F.col(f"pos{e}").alias("pos"))
    ends = pairs.select(F.inline(F.array(end(1), end(2))))
    near = _as_of(ends, sites, "pos").where("_next is not null")
    before, after = F.col("pos") - F.coalesce("_prev", F.lit(0)), F.col("_next") - F.col("pos")
    side = F.when((before <= after) == F.col("strand"), "5p").otherwise("3p")
    return near.select("chr", "pos", "strand", F.least(before, after).alias("distance"), side.alias("side"))


def randomize_in_fragments(pairs: DataFrame, sites: DataFrame, seed: int = 0) -> DataFrame:
    """each position moved to any place of its fragment, by the pair and the seed, so reruns agree; beyond a chromosome's last site it stays."""
    for e in "12":
        place = _as_of(pairs.withColumnRenamed(f"chr{e}", "chr"), sites, f"pos{e}")
        low, high = F.coalesce("_prev", F.lit(0)), F.col("_next")
        share = F.pmod(F.xxhash64("pair_id", F.lit(seed), F.lit(int(e)), f"pos{e}"), F.lit(1 << 30)) / F.lit(1 << 30)
        moved = F.when(high.isNotNull(), (low + F.floor(share * (high - low))).cast("int")).otherwise(F.col(f"pos{e}"))
        pairs = place.withColumn(f"pos{e}", moved).withColumnRenamed("chr", f"chr{e}").drop("_frag", "_prev", "_next")
    return pairs
