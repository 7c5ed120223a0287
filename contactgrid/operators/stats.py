"""Statistics of read pairs (A18-A20, A25, A26) and of ordered values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactgrid.functions.scalars import poisson_upper

from contactgrid.operators.pairs import alignment
from contactgrid.tables import counted, written


def pair_statistics(pairs: DataFrame, mapq: int, short: int = 20_000) -> DataFrame:
    """All counters of a set of pairs in one pass: one row."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    intra, good = F.col("chr1") == F.col("chr2"), F.least("mapq1", "mapq2") >= mapq
    far, way = F.abs(F.col("pos1") - F.col("pos2")), alignment()
    same = intra & (F.col("frag1") == F.col("frag2"))
    return pairs.agg(
        F.count(F.lit(1)).alias("total"), n(~good).alias("below_mapq"), n(good & same).alias("intra_fragment"), n(good & ~same).alias("hic_contacts"),
        n(good & ~same & ~intra).alias("inter"), n(good & ~same & intra).alias("intra"), n(good & ~same & intra & (far < short)).alias("short_range"),
        n(good & ~same & intra & (far >= short)).alias("long_range"), *(n(good & ~same & (way == w)).alias(w.lower()) for w in ("INNER", "OUTER", "LL", "RR")),
    )


def log_bins(n: int = 100, low: float = 10.0, high: float = 2e9) -> list[int]:
    """Edges of distance bins, evenly spaced by logarithm."""
    return sorted({round(low * (high / low) ** (k / (n - 1))) for k in range(n)})


def distance_histogram(pairs: DataFrame, edges: list[int]) -> DataFrame:
    """Intra pairs by orientation and by the last edge at or below their distance."""
    far = F.abs(F.col("pos1") - F.col("pos2"))
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= far))
    return pairs.where("chr1 = chr2").groupBy(alignment().alias("orientation"), at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mapq_histogram(pairs: DataFrame, most: int = 200) -> DataFrame:
    """Pairs by the lower quality, in all, within and between chromosomes."""
    q = F.least("mapq1", "mapq2", F.lit(most)).alias("mapq")
    intra = F.sum((F.col("chr1") == F.col("chr2")).cast("long"))
    return pairs.groupBy(q).agg(F.count(F.lit(1)).alias("n"), intra.alias("n_intra")).withColumn("n_inter", F.col("n") - F.col("n_intra"))


def merge_statistics(lines: DataFrame) -> DataFrame:
    """Over statistics lines (value) like 'Label: 1,234 (5% / 6%)', the sum of the numbers of each label, or of one about convergence the largest."""
    label, number = F.trim(F.regexp_extract("value", r"^([^:]+):", 1)), F.regexp_extract("value", r":\s*([\d,]+)", 1)
    rows = lines.select(label.alias("label"), number.alias("number")).where("number <> ''").withColumn("number", F.replace(F.col("number"), F.lit(","), F.lit("")).cast("long"))
    return rows.groupBy("label").agg(F.when(F.lower("label").contains("convergence"), F.max("number")).otherwise(F.sum("number")).alias("total"))


def merge_arrays(graphs: DataFrame) -> DataFrame:
    """Element by element sums of arrays with equal names: name, idx, value."""
    return graphs.select("name", F.posexplode("arr").alias("idx", "value")).groupBy("name", "idx").agg(F.sum("value").alias("value"))


def sliding_mean(vector: DataFrame, radius: int) -> DataFrame:
    """The mean over bins within the radius that have a value; rows: chr, bin, value."""
    by = Window.partitionBy("chr").orderBy("bin").rangeBetween(-radius, radius)
    return vector.select("chr", "bin", F.avg("value").over(by).alias("mean"))


def reverse_cumulative(histogram: DataFrame) -> DataFrame:
    """Sums from each value up: series, k, n."""
    by = Window.partitionBy("series").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return histogram.select("series", "k", F.sum("n").over(by).alias("at_least"))


def column_sums(cells: DataFrame) -> DataFrame:
    """Of each bin, the sum of all its cells, of both kinds, and its diagonal cell."""
    x = cells.select(F.col("chr1").alias("chr"), F.col("bin_x").alias("bin"), "counts", ((F.col("chr1") == F.col("chr2")) & (F.col("bin_x") == F.col("bin_y"))).alias("diagonal"))
    y = cells.where("chr1 <> chr2 or bin_x <> bin_y").select(F.col("chr2").alias("chr"), F.col("bin_y").alias("bin"), "counts", F.lit(False).alias("diagonal"))
    return x.unionByName(y).groupBy("chr", "bin").agg(F.sum("counts").alias("total"), F.sum(F.when(F.col("diagonal"), F.col("counts")).otherwise(0.0)).alias("diagonal"))


def top_neighbours(cells: DataFrame, k: int) -> DataFrame:
    """The k strongest partners of each bin within its chromosome, with all that tie."""
    from contactgrid.operators.norm import both_sides

    rank = F.rank().over(Window.partitionBy("chr", "bin").orderBy(F.col("counts").desc()))
    return both_sides(cells).where("bin <> other").withColumn("rank", rank).where(F.col("rank") <= k)


def poisson_peaks(cells: DataFrame, k: int) -> DataFrame:
    """The k cells of each chromosome that stand out most from the expected value: rows with counts and value."""
    from contactgrid.functions.scalars import poisson_z

    z = poisson_z(F.col("counts"), F.col("value"))
    rank = F.row_number().over(Window.partitionBy("chr1").orderBy(F.col("z").desc(), "bin_x", "bin_y"))
    return cells.withColumn("z", z).withColumn("rank", rank).where(F.col("rank") <= k)


def significant_peaks(cells: DataFrame, k: int, most_p: float = 0.1) -> DataFrame:
    """The k cells of each chromosome that stand out most from the expected value, of those whose Poisson p-value, times the chromosome's cells (its window), is at most ``most_p``."""
    n = cells.groupBy("chr1").agg(F.count(F.lit(1)).alias("n"))
    p = F.least(poisson_upper(F.round("counts"), F.col("value")) * F.col("n"), F.lit(1.0))
    found = cells.where("value > 0").join(F.broadcast(n), "chr1").withColumn("p_value", p).where(F.col("p_value") <= most_p).drop("n")  # a row a chromosome
    return poisson_peaks(found, k)


def pair_counters(pairs: DataFrame, thresholds: list[int], ligation: str, dangling: str) -> DataFrame:
    """All counters of read pairs with their sequences (seq1, seq2), a row for each quality threshold, in one pass over the pairs.

    Pairs within a fragment count first, then those below the threshold; the rest are contacts. LEFT and RIGHT are pairs of
    equal strands, as of alignment(); the four ways count long-range pairs alone. A pair dangles if a sequence starts with the
    unligated junction.
    """
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    p = pairs.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    intra, far, way = F.col("chr1") == F.col("chr2"), F.abs(F.col("pos1") - F.col("pos2")), alignment()
    same = intra & (F.col("frag1") == F.col("frag2"))
    low = ~same & (F.least("mapq1", "mapq2") < F.col("threshold"))
    good = ~same & ~low
    hangs = F.coalesce(F.col("seq1").startswith(dangling) | F.col("seq2").startswith(dangling), F.lit(False))
    joined = F.coalesce(F.col("seq1").contains(ligation) | F.col("seq2").contains(ligation), F.lit(False))
    ranges = {"lt_500": far < 500, "lt_5k": (far >= 500) & (far < 5_000), "lt_20k": (far >= 5_000) & (far < 20_000), "long": far >= 20_000}
    counters = {"intra_fragment": same, "below_mapq": low, "contacts": good, "dangling": good & hangs, "ligation": good & joined, "intra": good & intra, "inter": good & ~intra, "inter_dangling": good & ~intra & hangs}
    for name, c in ranges.items():
        counters |= {name: good & intra & c, f"{name}_dangling": good & intra & c & hangs}
    counters |= {name: good & (way == w) & (far >= 20_000) for name, w in (("inner", "INNER"), ("outer", "OUTER"), ("right", "LL"), ("left", "RR"))}
    return p.groupBy("threshold").agg(F.count(F.lit(1)).alias("total"), *(n(c).alias(k) for k, c in counters.items()))


#: The labels of a statistics text, in order, and the counters they show.
LABELS = (
    ("Intra-fragment Reads", "intra_fragment"), ("Below MAPQ Threshold", "below_mapq"), ("Hi-C Contacts", "contacts"), ("Inter-chromosomal", "inter"), ("Intra-chromosomal", "intra"),
    ("  <500BP", "lt_500"), ("  500BP-5kB", "lt_5k"), ("  5kB-20kB", "lt_20k"), ("Long Range (>20Kb)", "long"),
)


def statistics_lines(counters: DataFrame) -> DataFrame:
    """Threshold, line, value: each counter as text, with its share of all pairs."""
    shown = lambda label, c: F.concat(F.lit(f"{label}: "), F.format_number(c, 0), F.lit(" ("), F.format_number(100 * F.col(c) / F.greatest("total", F.lit(1)), 2), F.lit("%)"))
    lines = F.array(*(F.struct(F.lit(k).alias("line"), shown(label, c).alias("value")) for k, (label, c) in enumerate(LABELS)))
    return counters.select("threshold", F.inline(lines))


def convergence_bin(histogram: DataFrame, n_bins: int, limit: float = 0.01, hold: int = 3) -> DataFrame:
    """The first bin of distances where the four ways' counts are within ``limit`` of their mean, by logarithms, and stay so for ``hold`` more; else the last bin.

    histogram: orientation, bin, n, as of distance_histogram(): some hundred rows.
    """
    ways = ("INNER", "OUTER", "LL", "RR")
    by_bin = histogram.groupBy("bin").agg(*(F.sum(F.when(F.col("orientation") == w, F.col("n")).otherwise(0)).alias(w) for w in ways))
    grid = histogram.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin")).join(by_bin, "bin", "left").fillna(0, list(ways))
    mean = F.log(sum((F.col(w) for w in ways[1:]), F.col(ways[0])) / 4)
    off = F.greatest(*(F.when(F.col(w) > 0, F.abs(F.try_divide(mean - F.log(w), mean))).otherwise(F.lit(1e3)) for w in ways))
    near = grid.withColumn("near", F.coalesce(off < limit, F.lit(False)))
    ahead = F.min("near").over(Window.orderBy("bin").rowsBetween(0, hold))
    found = near.withColumn("stays", ahead).agg(F.min(F.when(F.col("stays"), F.col("bin"))).alias("bin"))
    return found.select(F.coalesce("bin", F.lit(n_bins - 1)).cast("int").alias("bin"))


def find_duplicates(reads: DataFrame, radius: int = 50) -> DataFrame:
    """Reads with their kind: unique, the first by name of all with the same strands, chromosomes and positions of both ends; opt, a later one within ``radius`` of an earlier one
    of its place on the same tile (tile, x, y); pcr, the other later ones.

    Which ones are near each other is an equi-join of places, tiles and cells of the radius, so a place that a third of the reads share is spread over its cells.
    """
    place = ["strand1", "chr1", "pos1", "strand2", "chr2", "pos2"]
    first = reads.groupBy(*place).agg(F.min("name").alias("_first"))
    cell = lambda c: F.floor(F.col(c) / radius)
    near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    a = reads.select(*place, "tile", F.col("name"), F.col("x").alias("_ax"), F.col("y").alias("_ay"), near("x").alias("_cx")).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_ay") / radius) - 1, F.floor(F.col("_ay") / radius) + 1)))
    b = reads.select(*place, "tile", F.col("name").alias("_before"), F.col("x").alias("_bx"), F.col("y").alias("_by"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    close = (F.col("_before") < F.col("name")) & (F.hypot(F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by")) <= radius)
    optical = a.join(b, [*place, "tile", "_cx", "_cy"]).where(close).select("name").distinct().withColumn("_opt", F.lit(True))
    both = reads.join(first, place).join(optical, "name", "left")
    kind = F.when(F.col("name") == F.col("_first"), "unique").when(F.col("_opt"), "opt").otherwise("pcr")
    return both.select(*reads.columns, kind.alias("kind"))


def duplicate_counts(reads: DataFrame) -> DataFrame:
    """Reads (kind) that are optical duplicates (opt), copies (pcr) or neither (unique), in one row."""
    n = lambda k: F.sum((F.col("kind") == k).cast("long"))
    return reads.agg(*(F.coalesce(n(k), F.lit(0)).alias(k) for k in ("opt", "pcr", "unique")))


def compare_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of each chromosome the bins that both vectors have a value for, their correlation, and the mean of the quotients."""
    both = a.select("chr", "bin", F.col("value").alias("a")).join(b.select("chr", "bin", F.col("value").alias("b")), ["chr", "bin"]).where("a is not null and b is not null")
    return both.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("r"), F.avg(F.try_divide("a", "b")).alias("quotient"))


def validate(cells: DataFrame, chrom_sizes: DataFrame, bin_size: int) -> DataFrame:
    """Of each matrix its cells, and how many are negative or no number, in the wrong order, beyond a chromosome's end, or there twice."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(True)).cast("long"))
    cells = cells.groupBy("chr1", "chr2", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("times"), F.min("counts").alias("counts"))
    chrom_sizes = counted(written(chrom_sizes, "sizes"))  # a join by shuffle would leave all cells of a chromosome to one task
    for e, b in (("1", "bin_x"), ("2", "bin_y")):
        last = chrom_sizes.select(F.col("chr").alias(f"chr{e}"), F.floor(F.col("length") / bin_size).alias(f"last{e}"))
        cells = cells.join(last, f"chr{e}", "left").withColumn(f"beyond{e}", (F.col(b) < 0) | (F.col(b) > F.col(f"last{e}")))
    disorder = (F.col("chr1") > F.col("chr2")) | ((F.col("chr1") == F.col("chr2")) & (F.col("bin_x") > F.col("bin_y")))
    return cells.groupBy("chr1", "chr2").agg(
        F.count(F.lit(1)).alias("n_cells"), n(F.isnan("counts") | (F.col("counts") < 0)).alias("n_bad"), n(disorder).alias("n_disordered"),
        n(F.col("beyond1") | F.col("beyond2")).alias("n_beyond"), n(F.col("times") > 1).alias("n_repeated"),
    )
