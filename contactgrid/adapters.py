"""The domain tables, as integer arithmetic over the general tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str, more: dict[str, Column] | None = None, wide: bool = False) -> DataFrame:
    """Read pairs from line items, with more columns by name; wide ones have positions of 64 bits, as chromosomes need that have more bases than 32 bits tell."""
    bits = "long" if wide else "int"
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("pair_id"),
        (F.col("l_returnflag") != "R").alias("strand1"),
        (1 + F.col("l_orderkey") % 3).cast("int").alias("chr1"),
        (F.col("l_partkey") * 500).cast(bits).alias("pos1"),
        F.floor(F.col("l_partkey") * 500 / 4000).cast("int").alias("frag1"),
        F.col("l_quantity").cast("int").alias("mapq1"),
        (F.col("l_linestatus") == "F").alias("strand2"),
        (1 + (F.col("l_orderkey") + F.col("l_linenumber")) % 3).cast("int").alias("chr2"),
        ((F.col("l_suppkey") * 20 + F.col("l_linenumber")) * 500).cast(bits).alias("pos2"),
        F.floor((F.col("l_suppkey") * 20 + F.col("l_linenumber")) * 500 / 4000).cast("int").alias("frag2"),
        (F.col("l_linenumber") * 10).cast("int").alias("mapq2"),
        F.lit(1.0).alias("score"),
        *(c.alias(name) for name, c in (more or {}).items()),
    )


def chrom_sizes(pairs_: DataFrame) -> DataFrame:
    """Three chromosomes, as long as the last position of any pair."""
    longest = pairs_.agg((F.max(F.greatest("pos1", "pos2")) + 1).alias("length"))
    return longest.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("chr"), F.col("length").cast("long").alias("length"))


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops on one chromosome each, from orders."""
    t = table(spark, sf_dir, "orders")
    start, width = F.col("o_custkey") * 1000, 1000 * (1 + F.col("o_orderkey") % 7)
    far = start + 20_000 + 1000 * (F.col("o_orderkey") % 40)
    return t.select(
        F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 3).cast("int").alias("chr"), start.alias("start1"), (start + width).alias("end1"),
        far.alias("start2"), (far + width).alias("end2"), F.floor("o_totalprice").cast("long").alias("observed"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


def loop_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read pairs with loops planted in them, from line items: each 750 orders make a site of 500 kb on one of three chromosomes.

    A site's pairs lie along it, at distances of which small ones are many; but one in twenty (of each fourth site one in eighty) stands where its loop is, from 100 to 300 kb, 7.5 kb wide.
    """
    o, n, part, sup = (F.col(f"l_{c}").cast("long") for c in ("orderkey", "linenumber", "partkey", "suppkey"))
    site = F.floor(o / 750)
    a = (o * 48_271 + n * 16_807 + part * 69_621) % 1_000_003
    b = (sup * 40_692 + o * 30_269 + n * 52_774 + part * 7) % 1_000_033
    start = F.floor(site / 3) * 500_000
    looped = (n == 1) & (o % 5 == 0) & ((site % 4 != 3) | (o % 20 == 0))
    at = F.when(looped, start + 100_000 + a % 3_750 + b % 3_750).otherwise(start + a % 500_000)
    far = F.when(looped, start + 300_000 + (a * 13 + b * 7) % 3_750 + (a * 5 + b * 11) % 3_750).otherwise(at + (b % 1_000) * (F.floor(a / 3) % 400))
    chr_ = (1 + site % 3).cast("int")
    t = table(spark, sf_dir, "lineitem")
    return t.select(chr_.alias("chr1"), at.cast("int").alias("pos1"), chr_.alias("chr2"), far.cast("int").alias("pos2"), F.lit(1.0).alias("score"))


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed intervals with a score, from events."""
    t = table(spark, sf_dir, "events")
    x1 = F.pmod(F.col("event_id") * 37_003, F.lit(1_000_000))
    return t.select(
        F.col("event_id").alias("id"), (1 + F.col("user_id") % 3).cast("int").alias("chr"), x1.alias("x1"), (x1 + 200 + F.col("event_id") % 900).alias("x2"),
        F.col("event_type").alias("name"), F.col("value").alias("score"),
    )


def spread(features: DataFrame, step: int, first: str, *others: str) -> DataFrame:
    """All rows, each moved to start at id * step: along chromosomes that grow with the table, so that anchors don't all merge."""
    at = F.col("id").cast("long") * step
    return features.withColumns({first: at, **{c: at + F.col(c) - F.col(first) for c in others}})


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named intervals from parts."""
    t = table(spark, sf_dir, "part")
    x1 = F.pmod(F.col("p_partkey") * 7919, F.lit(1_000_000))
    return t.select(
        F.col("p_partkey").alias("gene_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"),
        (1 + F.col("p_partkey") % 3).cast("int").alias("chr"), x1.alias("x1"), (x1 + 1000 + 100 * F.col("p_size")).alias("x2"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restriction sites from suppliers and parts: chr, pos, ascending and distinct."""
    t = table(spark, sf_dir, "part")
    return t.select((1 + F.col("p_partkey") % 3).cast("int").alias("chr"), (F.col("p_partkey") * 700 + 350).cast("int").alias("pos"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes from nations, two of them sex chromosomes and one mitochondrial."""
    key = F.col("n_nationkey")
    name = F.when(key == 22, "chrX").when(key == 23, "Y").when(key == 24, "chrM").otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select((key + 1).cast("int").alias("chr"), name.alias("name"), (1_000_000 + 10_000 * (key * 37 % 25)).cast("long").alias("length"))
