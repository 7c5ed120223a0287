"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactgrid.llm.common import count_words, materialize

#: A list of sources of at most this many rows may be broadcast; beyond it, Spark joins by shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Targets by source from (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating. Together they take as many words as
    there are. No target is above max_epochs times its source's size; what is above is shared anew by
    weight. Sorted by the size that one unit of weight may take at most, the sources that reach their
    limit are a prefix, so one pass of running sums finds the level of the others.
    The rows are one for each source, already counted, so that the single sort here is small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    s = s.withColumn("limit", max_epochs * F.col("source_size"))
    rising = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    from_here = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / from_here)
    s = s.withColumn("open", F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.col("level")))
    s = s.withColumn("level", F.first("open", ignorenulls=True).over(everything))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def random_key(seed: int, doc_id: Column) -> Column:
    """64 hash-random bits in hex, by which a source's documents are sorted."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 16)


def mix_sources(
    docs: DataFrame, carry: Sequence[str], weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 7
) -> DataFrame:
    """Each document with the words that the mix takes of it: row (struct of ``carry``), size, source_size, target, taken.

    Each document gets a hash-random key. The keys' leading bits deal the sorted order of each source into
    ranges; sums by range, and running sums over these few, give where the ranges begin. A source takes
    whole epochs of all its words while they fit in its target; of the rest, the documents before the cut
    once more, and of the one document at the cut just the words that are left. Only the range that holds
    a source's cut is sorted by document, so that a source of any size is never in one task.

    Null text: size 0, nothing taken. Null source: a source of its own, the last. Equal doc_ids share a key
    and are ordered by size and text. No rows: no rows. Columns not in ``carry`` play no part.
    """
    spark = docs.sparkSession
    n = docs.count()
    bits = min(20, max(4, (n // 1000).bit_length()))
    key = random_key(seed, F.col("doc_id"))
    bucket = F.shiftright(F.conv(F.substring("key", 1, 5), 16, 10).cast("long"), 20 - bits)
    sized = docs.select(F.struct(*carry).alias("row"), "source", F.struct("doc_id", F.xxhash64("text")).alias("at"), count_words(F.col("text")).alias("size"), key.alias("key"))
    sized = sized.withColumn("bucket", bucket)
    if "text" not in carry:
        sized = materialize(sized, "mix-sizes")
    ranges = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    targets = materialize(
        targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-targets"
    )
    small = targets.count() <= BROADCAST_SOURCES
    few = F.broadcast(targets) if small else targets
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    start = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("begin", start)
    cut = ranges.join(few, same(ranges, few)).where("begin < rest and begin + words >= rest")
    cut = cut.select(*(few[c] for c in ("source", "source_size", "target", "epochs", "rest")), F.col("bucket").alias("cut"), F.col("begin"))
    plan = targets.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.*", F.coalesce("c.cut", F.lit(-1)).alias("cut"), F.coalesce("c.begin", F.lit(0)).alias("begin"))
    plan = materialize(plan, "mix-plan")
    plan = F.broadcast(plan) if small else plan
    dealt = sized.join(plan, same(sized, plan)).drop(plan["source"])
    whole = dealt.where("bucket <> cut").withColumn("once", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("key", "at", "size")
    prefix = F.col("begin") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = dealt.where("bucket = cut").withColumn("once", F.greatest(F.lit(0), F.least("size", F.col("rest") - prefix)))
    result = [x.select("row", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("once")).alias("taken")) for x in (whole, part)]
    return result[0].unionByName(result[1])


def taken_copies(mixed: DataFrame) -> DataFrame:
    """The documents of a mix, as often as it takes them; a last, partial copy ends with its last word."""
    full, rest = F.floor(F.col("taken") / F.col("size")), F.pmod("taken", "size")
    copies = (full + F.when(rest > 0, 1).otherwise(0)).cast("int")
    used = mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    head = F.array_join(F.slice(pieces, F.lit(1), rest.cast("int")), "")
    return used.select("row", "copy", F.when(F.col("copy") <= full, F.col("row.text")).otherwise(head).alias("cut_text"))
