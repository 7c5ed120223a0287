"""The chromosomes and resolutions of maps (F26, F27, F30, J26, J27, U09, X03, X14, S12, O08): dimension tables of chr, name, length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names, cleaned, of chromosomes that aren't autosomes.
NOT_AUTOSOMES = ("X", "Y", "M", "MT", "ALL")


def bare_name(name: Column) -> Column:
    """A chromosome's name in lower case without chr."""
    return F.replace(F.lower(name), F.lit("chr"), F.lit(""))


def by_names(dim: DataFrame, names: DataFrame) -> DataFrame:
    """the chromosomes that names (name) stand for, whatever their case and prefix; of two that a name fits, the first."""
    wanted = names.select(bare_name(F.col("name")).alias("_bare")).distinct()
    first = F.row_number().over(Window.partitionBy("_bare").orderBy("chr"))
    return dim.withColumn("_bare", bare_name(F.col("name"))).join(wanted, "_bare").withColumn("_first", first).where("_first = 1").drop("_bare", "_first")


def snapped(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """for each wanted bin size the nearest available one; of two as near, the smaller. Both: bin_size."""
    best = F.min_by(F.col("there"), F.struct(F.abs(F.col("there") - F.col("bin_size")), F.col("there")))
    there = available.agg(F.collect_set("bin_size").alias("all"))
    both = wanted.select("bin_size").distinct().join(F.broadcast(there)).withColumn("there", F.explode("all"))
    return both.groupBy("bin_size").agg(best.alias("snapped"))


def autosomes(dim: DataFrame) -> DataFrame:
    """all but sex chromosomes, mitochondria and the whole genome."""
    return dim.where(~F.upper(bare_name(F.col("name"))).isin(list(NOT_AUTOSOMES)))


def autosome_parts(dim: DataFrame) -> DataFrame:
    """autosomes with their parts: odd or even by number (is_odd), halves of about equal length, in order (half: 1 or 2), and two
    parts that take turns by twos after the first chromosome (turn: 1 or 2). A dimension table is small: its order is one window."""
    order = Window.orderBy("chr")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a = autosomes(dim).withColumn("_upto", F.sum("length").over(upto)).withColumn("_all", F.sum("length").over(whole))
    off = F.abs(2 * F.col("_upto") - F.col("_all"))
    a = a.withColumn("_cut", F.min_by("chr", F.struct(off, "chr")).over(whole))
    place = F.row_number().over(order)
    return a.select(
        "chr", "name", "length", (F.col("chr") % 2 == 1).alias("is_odd"), F.when(F.col("chr") <= F.col("_cut"), 1).otherwise(2).alias("half"),
        F.when(F.floor(place / 2) % 2 == 0, 1).otherwise(2).alias("turn"),
    )


def pairs_of(dim: DataFrame, intra: bool = True, inter: bool = True) -> DataFrame:
    """chr1, chr2 with chr1 <= chr2: each two chromosomes of a dimension table."""
    a, b = dim.select(F.col("chr").alias("chr1")), dim.select(F.col("chr").alias("chr2"))
    same = F.col("chr1") < F.col("chr2") if not intra else F.col("chr1") == F.col("chr2") if not inter else F.col("chr1") <= F.col("chr2")
    return a.join(b, same)


def common(dims: Sequence[DataFrame], key: Sequence[str] = ("name", "length")) -> DataFrame:
    """Chromosomes, bin sizes or norm types that all have, by the key."""
    out = dims[0].select(*key).distinct()
    for d in dims[1:]:
        out = out.join(d.select(*key).distinct(), list(key), "left_semi")
    return out


def combined_zooms(zooms: Sequence[DataFrame]) -> DataFrame:
    """Unit, bin_size of maps that are shown as one: those of positions that any has, those of fragments that all have."""
    kind = ["unit", "bin_size"]
    any_ = zooms[0].select(*kind)
    for z in zooms[1:]:
        any_ = any_.unionByName(z.select(*kind))
    return any_.where("unit = 'BP'").distinct().unionByName(common(zooms, kind).where("unit = 'FRAG'"))


def zoom_order(zooms: DataFrame) -> DataFrame:
    """Bin sizes from coarse to fine, with the next finer (finer) and coarser (coarser) one of the unit."""
    order = Window.partitionBy("unit").orderBy(F.col("bin_size").desc())
    return zooms.select("unit", "bin_size", F.row_number().over(order).alias("place"), F.lead("bin_size").over(order).alias("finer"), F.lag("bin_size").over(order).alias("coarser"))


def grid_sizes(sizes: DataFrame, bin_size: int, cutoff: int, least: int = 500) -> DataFrame:
    """How many columns of blocks a chromosome's matrix has, and how many bins a block: chr, n_bins, columns, block_bins."""
    n = (F.floor(F.col("length") / bin_size) + 1).cast("long")
    columns = F.greatest(F.floor(n / least) + 1, F.lit(1)) if bin_size < cutoff else F.greatest(F.floor(n * bin_size / cutoff / least) + 1, F.lit(1))
    return sizes.select("chr", n.alias("n_bins"), columns.cast("long").alias("columns")).withColumn("block_bins", F.floor(F.col("n_bins") / F.col("columns")) + 1)


def infer_genome(dim: DataFrame, genomes: DataFrame) -> DataFrame:
    """The first genome, in order of rank, with a chromosome of a name and length that dim has: genomes: rank, genome, name, length."""
    hits = dim.select("name", "length").distinct().join(genomes, ["name", "length"])
    return hits.agg(F.min_by("genome", F.struct("rank", "genome")).alias("genome"))


def infer_enzyme(dim: DataFrame, sites: DataFrame, genomes: DataFrame, enzymes: DataFrame) -> DataFrame:
    """Genome and enzyme, of the genome that infer_genome() finds: the first, in order of rank, that cuts its first chromosome (the smallest chr of dim) as often as sites (chr, pos) do.

    enzymes: genome, n_sites, rank, enzyme. Where none does, enzyme is null.
    """
    first = dim.agg(F.min("chr").alias("chr"))
    cuts = first.join(sites.groupBy("chr").agg(F.count(F.lit(1)).alias("n_sites")), "chr", "left").select(F.coalesce("n_sites", F.lit(0)).alias("n_sites"))
    found = infer_genome(dim, genomes).join(F.broadcast(cuts))  # both are one row
    return found.join(enzymes, ["genome", "n_sites"], "left").groupBy("genome").agg(F.min_by("enzyme", F.struct("rank", "enzyme")).alias("enzyme"))


def ordinals_by_arrival(pairs: DataFrame, at: str) -> DataFrame:
    """Name, ordinal (from 1) of chromosomes as they first come, by the column ``at``; of one row the first end first."""
    ends = pairs.select(at, F.posexplode(F.array("chr1", "chr2")).alias("end", "name"))
    first = ends.groupBy("name").agg(F.min(F.struct(at, "end")).alias("first"))
    return first.select("name", F.row_number().over(Window.orderBy("first", "name")).alias("ordinal"))
