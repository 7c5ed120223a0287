"""The registered queries of the contact-matrix engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgrid import adapters
from contactgrid.functions import scalars, transforms
from contactgrid.operators import binning, domains, expected, features, intervals, linalg, lists, loops, motifs, norm, pairs, query, stats
from contactgrid.sources import binary, text
from contactgrid.tables import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "q_region_dump"
SIZE = 25_000

# The adapters again, as SQL.
PAIRS = """pairs AS (SELECT l_orderkey AS pair_id, l_returnflag <> 'R' AS strand1, CAST(1 + l_orderkey % 3 AS INTEGER) AS chr1, CAST(l_partkey * 500 AS INTEGER) AS pos1,
 CAST(l_partkey * 500 // 4000 AS INTEGER) AS frag1, CAST(l_quantity AS INTEGER) AS mapq1, l_linestatus = 'F' AS strand2, CAST(1 + (l_orderkey + l_linenumber) % 3 AS INTEGER) AS chr2,
 CAST((l_suppkey * 20 + l_linenumber) * 500 AS INTEGER) AS pos2, CAST((l_suppkey * 20 + l_linenumber) * 500 // 4000 AS INTEGER) AS frag2, CAST(l_linenumber * 10 AS INTEGER) AS mapq2,
 CAST(1.0 AS DOUBLE) AS score FROM lineitem)"""
SIZES = "sizes AS (SELECT unnest([1, 2, 3]) AS chr, length FROM (SELECT CAST(max(greatest(pos1, pos2)) + 1 AS BIGINT) AS length FROM pairs))"


def cells_sql(size: int = SIZE, name: str = "cells", source: str = "pairs", at: str = "pos") -> str:
    return f"""{name} AS (SELECT least(chr1, chr2) AS chr1, greatest(chr1, chr2) AS chr2,
 CASE WHEN chr1 = chr2 THEN least({at}1 // {size}, {at}2 // {size}) WHEN chr1 < chr2 THEN {at}1 // {size} ELSE {at}2 // {size} END AS bin_x,
 CASE WHEN chr1 = chr2 THEN greatest({at}1 // {size}, {at}2 // {size}) WHEN chr1 < chr2 THEN {at}2 // {size} ELSE {at}1 // {size} END AS bin_y,
 CAST(sum(score) AS DOUBLE) AS counts FROM {source} GROUP BY 1, 2, 3, 4)"""


BASE = f"WITH {PAIRS}, {SIZES}, {cells_sql()}"
SIDES = """sides AS (SELECT chr1 AS chr, bin_x AS bin, bin_y AS other, counts FROM cells WHERE chr1 = chr2
 UNION ALL SELECT chr1, bin_y, bin_x, counts FROM cells WHERE chr1 = chr2 AND bin_x <> bin_y)"""
COVERAGE = f"{SIDES}, coverage AS (SELECT chr, bin, sum(counts) AS value FROM sides GROUP BY chr, bin)"


def finish_sql(value: str) -> str:
    return f"""raw AS (SELECT chr, bin, {value} AS value FROM coverage),
 factors AS (SELECT s.chr, sqrt(sum(s.counts / (a.value * b.value)) / sum(s.counts)) AS factor FROM sides s JOIN raw a ON s.chr = a.chr AND s.bin = a.bin
  JOIN raw b ON s.chr = b.chr AND s.other = b.bin GROUP BY s.chr),
 vec AS (SELECT raw.chr, bin, value * factor AS value FROM raw JOIN factors ON raw.chr = factors.chr)"""


VC = f"{BASE}, {COVERAGE}, {finish_sql('value')}"
NORMED = """normed AS (SELECT c.chr1, c.chr2, c.bin_x, c.bin_y, c.counts / (a.value * b.value) AS counts FROM cells c
 JOIN vec a ON c.chr1 = a.chr AND c.bin_x = a.bin JOIN vec b ON c.chr2 = b.chr AND c.bin_y = b.bin)"""
DENSITY = f"""possible AS (SELECT dist, sum(n - dist) AS possible FROM (SELECT n, unnest(range(n)) AS dist FROM (SELECT length // {SIZE} AS n FROM sizes)) GROUP BY dist),
 seen AS (SELECT bin_y - bin_x AS dist, sum(counts) AS observed FROM cells WHERE chr1 = chr2 GROUP BY 1),
 density AS (SELECT p.dist, coalesce(observed, 0) / possible AS value FROM possible p LEFT JOIN seen s ON p.dist = s.dist)"""
OE = f"""scales AS (SELECT s.chr, sum((length // {SIZE} - dist) * value) / any_value(observed) AS factor FROM sizes s JOIN density ON dist < length // {SIZE}
 JOIN (SELECT chr1 AS chr, sum(counts) AS observed FROM cells WHERE chr1 = chr2 GROUP BY 1) o ON o.chr = s.chr GROUP BY s.chr),
 oe AS (SELECT chr1, chr2, bin_x, bin_y, counts / nullif(value, 0) * factor AS oe FROM cells JOIN density ON dist = least(bin_y - bin_x, (SELECT max(dist) FROM density)) JOIN scales ON scales.chr = chr1 WHERE chr1 = chr2)"""
LOOPS = """loops AS (SELECT o_orderkey AS id, CAST(1 + o_orderkey % 3 AS INTEGER) AS chr, o_custkey * 1000 AS start1, o_custkey * 1000 + 1000 * (1 + o_orderkey % 7) AS end1,
 o_custkey * 1000 + 20000 + 1000 * (o_orderkey % 40) AS start2, o_custkey * 1000 + 20000 + 1000 * (o_orderkey % 40) + 1000 * (1 + o_orderkey % 7) AS end2,
 CAST(floor(o_totalprice) AS BIGINT) AS observed, o_orderpriority AS priority, o_orderstatus AS status FROM orders)"""
HALVES = f"{LOOPS}, la AS (SELECT * FROM loops WHERE id % 2 = 0), lb AS (SELECT * FROM loops WHERE id % 2 = 1)"
LOCI = """loci AS (SELECT event_id AS id, CAST(1 + user_id % 3 AS INTEGER) AS chr, (event_id * 37003) % 1000000 AS x1, (event_id * 37003) % 1000000 + 200 + event_id % 900 AS x2,
 event_type AS name, value AS score FROM events)"""
GENES = """genes AS (SELECT p_partkey AS gene_id, p_partkey AS id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name, CAST(1 + p_partkey % 3 AS INTEGER) AS chr, (p_partkey * 7919) % 1000000 AS x1,
 (p_partkey * 7919) % 1000000 + 1000 + 100 * p_size AS x2 FROM part)"""
INTERVALS = f"WITH {LOCI}, {GENES}, hits AS (SELECT g.id AS g_id, g.chr, g.x1 AS gx1, g.x2 AS gx2, l.id AS l_id, l.x1 AS lx1, l.x2 AS lx2, l.score FROM genes g JOIN loci l ON g.chr = l.chr AND g.x1 <= l.x2 AND l.x1 <= g.x2)"
CLASS = """CASE WHEN chr1 = chr2 THEN CASE WHEN lo AND hi THEN 'LL' WHEN NOT lo AND NOT hi THEN 'RR' WHEN lo THEN 'INNER' ELSE 'OUTER' END END"""
FACED = f"""faced AS (SELECT *, {CLASS} AS way FROM (SELECT *, CASE WHEN pos1 < pos2 THEN strand1 ELSE strand2 END AS lo, CASE WHEN pos1 < pos2 THEN strand2 ELSE strand1 END AS hi FROM pairs))"""


def registered(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _pairs(spark: SparkSession, d: str, wide: bool = False) -> DataFrame:
    return adapters.pairs(spark, d, wide=wide)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return adapters.chrom_sizes(_pairs(spark, d, wide=True))


def _cells(spark: SparkSession, d: str, size: int = SIZE) -> DataFrame:
    return binning.bin_contacts(_pairs(spark, d, wide=True), [size]).drop("unit", "bin_size")


def _stored(spark: SparkSession, d: str, size: int = SIZE) -> DataFrame:
    """The cells, written once, for queries that use them more than once."""
    return written(_cells(spark, d, size), "cells")


def _control(spark: SparkSession, d: str) -> DataFrame:
    return binning.bin_contacts(_pairs(spark, d, wide=True).where("pair_id % 2 = 0"), [SIZE]).drop("unit", "bin_size")


def _oe(spark: SparkSession, d: str, size: int = SIZE) -> DataFrame:
    """Observed over expected, with each chromosome's scale."""
    cells, sizes = _stored(spark, d, size), written(_sizes(spark, d), "sizes")
    density = written(expected.raw_density(cells, sizes, size), "density")
    return expected.observed_over_expected(cells, density, expected.scale_factors(density, cells, sizes, size))


def _genes(spark: SparkSession, d: str) -> DataFrame:
    return adapters.genes(spark, d).withColumn("id", F.col("gene_id"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    both = adapters.loops(spark, d)
    return both.where("id % 2 = 0"), both.where("id % 2 = 1")


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


LOOP_COLS = ["id", "chr", "start1", "end1", "start2", "end2"]
PICK = ", ".join(LOOP_COLS)


@registered("q_region_dump", f"""{VC}, {NORMED} SELECT bin_x * {SIZE} AS x, bin_y * {SIZE} AS y, round(counts, 6) AS value FROM normed WHERE chr1 = 1 AND chr2 = 1
 AND ((bin_x * {SIZE} BETWEEN 0 AND 500000 AND bin_y * {SIZE} BETWEEN 25000 AND 900000) OR (bin_y * {SIZE} BETWEEN 0 AND 500000 AND bin_x * {SIZE} BETWEEN 25000 AND 900000))""")  # fmt: skip
def q_region_dump(s, d):
    cells = written(binning.bin_contacts(_pairs(s, d).where("chr1 = 1 and chr2 = 1"), [SIZE]).drop("unit", "bin_size"), "cells")
    here = cells.where(query.in_region(1, (0, 500_000), 1, (25_000, 900_000), SIZE))
    return _round(query.dump(norm.normalize(here, norm.vc(cells)), 1, (0, 500_000), 1, (25_000, 900_000), SIZE), "value")


# Sources: lines that Spark makes of the pairs, parsed again.
def _lines(s, d, *parts) -> DataFrame:
    return _pairs(s, d).select(F.concat_ws(" ", *parts).alias("value"))


def _strand(c: str, forward: str = "0", reverse: str = "16"):
    return F.when(F.col(c), forward).otherwise(reverse)


PARSED = "SELECT strand1, CAST(chr1 AS VARCHAR) AS chr1, pos1, {f1} AS frag1, {q1} AS mapq1, strand2, CAST(chr2 AS VARCHAR) AS chr2, pos2, {f2} AS frag2, {q2} AS mapq2 FROM pairs"
_PAIR_COLS = ["strand1", "chr1", "pos1", "frag1", "mapq1", "strand2", "chr2", "pos2", "frag2", "mapq2"]


@registered("s05_parse_short", f"WITH {PAIRS} " + PARSED.format(f1="frag1", q1="1000", f2="frag2", q2="1000"))
def s05(s, d):
    return text.parse_pairs(_lines(s, d, _strand("strand1"), "chr1", "pos1", "frag1", _strand("strand2"), "chr2", "pos2", "frag2"), "short").select(*_PAIR_COLS)


@registered("s06_parse_super_short", f"WITH {PAIRS} SELECT CAST(chr1 AS VARCHAR) AS chr1, pos1, CAST(chr2 AS VARCHAR) AS chr2, pos2, score FROM pairs")
def s06(s, d):
    return text.parse_pairs(_lines(s, d, "chr1", "pos1", "chr2", "pos2", "score"), "super_short_score").select("chr1", "pos1", "chr2", "pos2", F.col("score").cast("double").alias("score"))


@registered("s07_parse_dcic", f"WITH {PAIRS} " + PARSED.format(f1="0", q1="mapq1", f2="1", q2="mapq2"))
def s07(s, d):
    at = text.dcic_columns(["## pairs format v1.0", "#columns: readID chr1 pos1 chr2 pos2 strand1 strand2 mapq1 mapq2"])
    lines = _lines(s, d, "pair_id", "chr1", "pos1", "chr2", "pos2", _strand("strand1", "+", "-"), _strand("strand2", "+", "-"), "mapq1", "mapq2")
    return text.parse_pairs(lines, "dcic", at).select(*_PAIR_COLS)


@registered("s08_parse_long", f"WITH {PAIRS} " + PARSED.format(f1="frag1", q1="mapq1", f2="frag2", q2="mapq2"))
def s08(s, d):
    x = F.lit("x")
    lines = _lines(s, d, _strand("strand1"), "chr1", "pos1", "frag1", _strand("strand2"), "chr2", "pos2", "frag2", "mapq1", x, x, "mapq2", x, x, x, x)
    return text.parse_pairs(lines, "long").select(*_PAIR_COLS)


@registered("s09_parse_medium", f"WITH {PAIRS} " + PARSED.format(f1="frag1", q1="mapq1", f2="frag2", q2="mapq2"))
def s09(s, d):
    lines = _lines(s, d, "pair_id", _strand("strand1"), "chr1", "pos1", "frag1", _strand("strand2"), "chr2", "pos2", "frag2", "mapq1", "mapq2")
    return text.parse_pairs(lines, "medium").select(*_PAIR_COLS)


@registered("s11_chromosome_ordinals", f"WITH {PAIRS} SELECT chr1, pos1, chr2, pos2 FROM pairs WHERE chr1 < 3 AND chr2 < 3")
def s11(s, d):
    named = _pairs(s, d).select(*(F.concat(F.lit("chr"), F.col(f"chr{e}").cast("string")).alias(f"chr{e}") for e in "12"), "pos1", "pos2")
    dim = s.createDataFrame([(1, "1", 1), (2, "2", 1)], "chr int, name string, length long")
    return text.with_ordinals(named, dim, clean=True).select("chr1", "pos1", "chr2", "pos2")


@registered("s13_binary_records", f"WITH {PAIRS} SELECT strand1, chr1, pos1, frag1, strand2, chr2, pos2, frag2 FROM pairs")
def s13(s, d):
    return binary.decode_records(binary.encode_records(_pairs(s, d), binary.LONG), binary.LONG)


@registered("s14_short_binary_records", f"WITH {PAIRS} SELECT chr1, pos1, chr2, pos2, score FROM pairs")
def s14(s, d):
    return binary.decode_records(binary.encode_records(_pairs(s, d), binary.SHORT), binary.SHORT).withColumn("score", F.col("score").cast("double"))


@registered("s26_parse_bed", f"WITH {LOCI} SELECT DISTINCT 'chr' || CAST(chr AS VARCHAR) AS chr, x1, x2 FROM loci WHERE chr < 3")
def s26(s, d):
    name = F.when(F.col("chr") < 3, F.concat(F.lit("chr"), F.col("chr").cast("string"))).otherwise("scaffold")
    return text.parse_bed(adapters.loci(s, d).select(F.concat_ws("\t", name, "x1", "x2", "name").alias("value")))


@registered("s27_parse_fimo", f"WITH {LOCI} SELECT CAST(chr AS VARCHAR) AS chr, x1, x2, id % 2 = 0 AS forward, round(score, 6) AS score FROM loci")
def s27(s, d):
    strand = F.when(F.col("id") % 2 == 0, "+").otherwise("-")
    lines = adapters.loci(s, d).select(F.concat_ws("\t", "name", "chr", "x1", "x2", strand, "score", F.lit("0.1"), F.lit("0.2"), F.lit("ACGT")).alias("value"))
    return _round(text.parse_fimo(lines).select("chr", "x1", "x2", "forward", "score"), "score")


@registered("s29_parse_genes", f"WITH {GENES} SELECT replace(name, ' ', '_') AS name, CAST(chr AS VARCHAR) AS chr, x1, x2 FROM genes")
def s29(s, d):
    return text.parse_genes(adapters.genes(s, d).select(F.concat_ws(" ", F.replace("name", F.lit(" "), F.lit("_")), "chr", "x1", "x2").alias("value")))


@registered("s31_parse_bedgraph", f"WITH {LOCI} SELECT CAST(chr AS VARCHAR) AS chr, x1, x2, round(score, 6) AS score FROM loci")
def s31(s, d):
    return _round(text.parse_bedgraph(adapters.loci(s, d).select(F.concat_ws("\t", "chr", "x1", "x2", "score").alias("value"))), "score")


@registered("s32_parse_norm_vectors", f"{BASE}, {COVERAGE} SELECT CAST(chr AS VARCHAR) AS chr, CAST(row_number() OVER (PARTITION BY chr ORDER BY bin) - 1 AS INTEGER) AS bin, round(value, 6) AS value FROM coverage")
def s32(s, d):
    v = norm.coverage(_cells(s, d))
    head = v.select("chr").distinct().select(F.col("chr").cast("string").alias("file"), F.lit(-1).alias("line"), F.concat(F.lit("vector VC "), "chr", F.lit(" 25000 BP")).alias("value"))
    body = v.select(F.col("chr").cast("string").alias("file"), F.col("bin").alias("line"), F.col("value").cast("string").alias("value"))
    from pyspark.sql import Window

    lines = head.unionByName(body).withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("line")))
    return _round(text.parse_norm_vectors(lines).select("chr", "bin", "value"), "value")


# Filters.
FILTERS = {
    "f01_intra": (pairs.intra_only, "chr1 = chr2"),
    "f02_chromosomes": (lambda p: pairs.on_chromosomes(p, [1, 2]), "chr1 IN (1, 2) AND chr2 IN (1, 2)"),
    "f03_mapq": (lambda p: pairs.least_mapq(p, 25), "least(mapq1, mapq2) >= 25"),
    "f05_between_fragments": (pairs.between_fragments, "NOT (chr1 = chr2 AND frag1 = frag2)"),
}
for _name, (_filter, _where) in FILTERS.items():
    registered(_name, f"WITH {PAIRS} SELECT pair_id, chr1, pos1, chr2, pos2 FROM pairs WHERE {_where}")(
        lambda s, d, f=_filter: f(_pairs(s, d)).select("pair_id", "chr1", "pos1", "chr2", "pos2")
    )


@registered("f04_alignment", f"WITH {PAIRS}, {FACED} SELECT way, count(*) AS n FROM faced GROUP BY way")
def f04(s, d):
    return _pairs(s, d).groupBy(pairs.alignment().alias("way")).agg(F.count(F.lit(1)).alias("n"))


@registered("f08_clamp", f"WITH {PAIRS} SELECT pair_id, least(pos1, 400000) AS pos1, least(pos2, 400000) AS pos2 FROM pairs WHERE chr1 < 3 AND chr2 < 3")
def f08(s, d):
    dim = s.createDataFrame([(1, 400_000), (2, 400_000)], "chr int, length long")
    return pairs.clamp(_pairs(s, d), dim).select("pair_id", "pos1", "pos2")


@registered("f09_canonical", f"""WITH {PAIRS}, t AS (SELECT *, chr1 > chr2 OR (chr1 = chr2 AND pos1 > pos2) AS turn FROM pairs) SELECT pair_id, least(chr1, chr2) AS chr1, greatest(chr1, chr2) AS chr2,
 CASE WHEN turn THEN pos2 ELSE pos1 END AS pos1, CASE WHEN turn THEN pos1 ELSE pos2 END AS pos2, CASE WHEN turn THEN mapq2 ELSE mapq1 END AS mapq1 FROM t""")  # fmt: skip
def f09(s, d):
    return pairs.canonical(_pairs(s, d)).select("pair_id", "chr1", "chr2", "pos1", "pos2", "mapq1")


@registered("f12_min_count", f"{BASE} SELECT chr1, chr2, bin_x, bin_y, counts FROM cells WHERE counts >= 5")
def f12(s, d):
    return query.min_count(_cells(s, d), 5)


@registered("f15_point_lookup", f"""{BASE}, {LOOPS}, p AS (SELECT id, chr, least(start1 // {SIZE}, start2 // {SIZE}) AS bin_x, greatest(start1 // {SIZE}, start2 // {SIZE}) AS bin_y FROM loops)
 SELECT id, p.chr, p.bin_x, p.bin_y, coalesce(counts, 0) AS counts FROM p LEFT JOIN cells c ON c.chr1 = p.chr AND c.chr2 = p.chr AND c.bin_x = p.bin_x AND c.bin_y = p.bin_y""")  # fmt: skip
def f15(s, d):
    points = adapters.loops(s, d).select("id", "chr", *(F.floor(F.col(f"start{e}") / SIZE).cast("int").alias(f"bin_{a}") for e, a in (("2", "x"), ("1", "y"))))
    return query.lookup(_cells(s, d), points).select("id", "chr", "bin_x", "bin_y", "counts")


@registered("f16_window", f"""{BASE}, sym AS (SELECT bin_x, bin_y, counts FROM cells WHERE chr1 = 1 AND chr2 = 1 UNION ALL SELECT bin_y, bin_x, counts FROM cells WHERE chr1 = 1 AND chr2 = 1 AND bin_x <> bin_y),
 grid AS (SELECT i, j FROM range(12) a(i), range(9) b(j)) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, coalesce(counts, 0) AS value FROM grid LEFT JOIN sym ON bin_x = i + 3 AND bin_y = j + 5""")  # fmt: skip
def f16(s, d):
    return query.window(_cells(s, d), 1, 3, 5, 12, 9)


@registered("f18_loop_size", f"WITH {LOOPS} SELECT {PICK} FROM loops WHERE round(abs((start1 + end1) // 2 - (start2 + end2) // 2) / 10000.0) BETWEEN 3 AND 5")
def f18(s, d):
    return features.by_size(adapters.loops(s, d), 3, 5, 10_000).select(*LOOP_COLS)


@registered("f19_near_diagonal", f"WITH {LOOPS} SELECT {PICK} FROM loops WHERE abs(start1 - start2) < 30000")
def f19(s, d):
    return features.near_diagonal(adapters.loops(s, d), 30_000).select(*LOOP_COLS)


@registered("f20_strong", f"WITH {LOOPS} SELECT {PICK}, observed FROM loops WHERE observed > 100000")
def f20(s, d):
    return features.strong(adapters.loops(s, d), 100_000).select(*LOOP_COLS, "observed")


@registered("f21_mapq_clear", f"""WITH {LOOPS}, bad AS (SELECT DISTINCT CAST(1 + p_partkey % 3 AS INTEGER) AS chr, p_partkey * 97 % 4000 AS bin FROM part WHERE p_size < 3)
 SELECT {PICK} FROM loops l WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.chr = l.chr AND (abs(l.start1 // 5000 - b.bin) <= 5 OR abs(l.start2 // 5000 - b.bin) <= 5))""")  # fmt: skip
def f21(s, d):
    bad = adapters.table(s, d, "part").where("p_size < 3").select((1 + F.col("p_partkey") % 3).cast("int").alias("chr"), (F.col("p_partkey") * 97 % 4000).alias("bin")).distinct()
    return features.mapq_clear(adapters.loops(s, d), bad, 5000).select(*LOOP_COLS)


# Aggregations.
@registered("a01_bin_contacts", f"{BASE} SELECT chr1, chr2, bin_x, bin_y, counts FROM cells")
def a01(s, d):
    return _cells(s, d)


@registered("a02_multi_resolution", f"WITH {PAIRS}, " + ", ".join(cells_sql(z, f"c{z}") for z in (5000, 25000, 100000)) + " " + " UNION ALL ".join(
    f"SELECT chr1, chr2, 'BP' AS unit, {z} AS bin_size, bin_x, bin_y, counts FROM c{z}" for z in (5000, 25000, 100000)))
def a02(s, d):
    return binning.bin_contacts(_pairs(s, d), [5000, 25_000, 100_000])


@registered("a03_fragment_bins", f"WITH {PAIRS}, {cells_sql(5, 'cells', at='frag')} SELECT chr1, chr2, bin_x, bin_y, counts FROM cells")
def a03(s, d):
    return binning.bin_contacts(_pairs(s, d), [5], "FRAG").drop("unit", "bin_size")


@registered("a04_whole_genome", f"""WITH {PAIRS}, {SIZES}, o AS (SELECT chr, CAST(coalesce(sum(length // 1000) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off,
 CAST(greatest(sum(length // 1000) OVER () // 500, 1) AS BIGINT) AS size FROM sizes), b AS (SELECT (a.off + pos1 // 1000) // a.size AS x, (c.off + pos2 // 1000) // c.size AS y, score FROM pairs JOIN o a ON a.chr = chr1
 JOIN o c ON c.chr = chr2) SELECT least(x, y) AS bin_x, greatest(x, y) AS bin_y, sum(score) AS counts FROM b GROUP BY 1, 2""")  # fmt: skip
def a04(s, d):
    return binning.whole_genome(_pairs(s, d), _sizes(s, d))


@registered("a05_coarsen", f"WITH {PAIRS}, {cells_sql(100_000)} SELECT chr1, chr2, bin_x, bin_y, counts FROM cells")
def a05(s, d):
    return binning.coarsen(_cells(s, d), 4)


@registered("a07_merge_maps", f"WITH {PAIRS}, even AS (SELECT * FROM pairs WHERE pair_id % 2 = 0), every AS (SELECT * FROM pairs UNION ALL SELECT * FROM even), {cells_sql(source='every')} SELECT chr1, chr2, bin_x, bin_y, counts FROM cells")
def a07(s, d):
    return binning.merge_maps(_cells(s, d), _control(s, d))


@registered("a08_coverage", f"{BASE}, {COVERAGE} SELECT chr, bin, value FROM coverage")
def a08(s, d):
    return norm.coverage(_cells(s, d))


@registered("a09_occupancy", f"{BASE} SELECT chr1, chr2, count(*) AS n_cells, round(quantile_cont(counts, 0.05), 6) AS p05, round(quantile_cont(counts, 0.95), 6) AS p95 FROM cells GROUP BY chr1, chr2")
def a09(s, d):
    return _round(binning.occupancy(_cells(s, d)), "p05", "p95")


@registered("a11_matrix_sums", f"{BASE} SELECT chr1, chr2, sum(CASE WHEN chr1 = chr2 AND bin_x <> bin_y THEN 2 * counts ELSE counts END) AS sum_counts, count(*) AS n_cells FROM cells GROUP BY chr1, chr2")
def a11(s, d):
    return binning.matrix_sums(_cells(s, d))


@registered("a12_average_counts", f"""{BASE}, m AS (SELECT chr1, chr2, sum(CASE WHEN chr1 = chr2 AND bin_x <> bin_y THEN 2 * counts ELSE counts END) AS s FROM cells GROUP BY chr1, chr2)
 SELECT chr1, chr2, round(s / greatest(a.length // {SIZE}, 1) / greatest(b.length // {SIZE}, 1), 6) AS average FROM m JOIN sizes a ON a.chr = chr1 JOIN sizes b ON b.chr = chr2""")  # fmt: skip
def a12(s, d):
    return _round(binning.average_counts(_cells(s, d), _sizes(s, d), SIZE), "average")


@registered("a14_distance_sums", f"{BASE} SELECT bin_y - bin_x AS dist, sum(counts) AS observed FROM cells WHERE chr1 = chr2 GROUP BY 1")
def a14(s, d):
    return expected.observed_by_distance(_cells(s, d))


@registered("a15_raw_density", f"{BASE}, {DENSITY} SELECT dist, round(value, 6) AS value FROM density")
def a15(s, d):
    return _round(expected.raw_density(_cells(s, d), _sizes(s, d), SIZE), "value")


@registered("a16_smoothed_expected", f"""{BASE.replace("WITH", "WITH RECURSIVE", 1)}, {DENSITY}, v AS (SELECT p.dist, coalesce(observed, 0) AS o, possible AS p FROM possible p LEFT JOIN seen s ON p.dist = s.dist),
 cum AS (SELECT dist, sum(o) OVER (ORDER BY dist) - o AS so, sum(p) OVER (ORDER BY dist) - p AS sp FROM v UNION ALL SELECT count(*), sum(o), sum(p) FROM v), n AS (SELECT count(*) AS n FROM v),
 win AS (SELECT a.dist AS lo, b.dist AS hi, b.so - a.so AS s, b.sp - a.sp AS p FROM cum a JOIN cum b ON b.dist > a.dist),
 st(d, lo, hi, s, p) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
  SELECT d + 1, w.lo, w.hi, w.s, w.p FROM (SELECT st.d, st.lo, CASE WHEN st.d < 0 THEN 1 ELSE least(st.hi + 2, n) END AS hi, n FROM st, n WHERE st.d + 1 < n) t, LATERAL (SELECT win.* FROM win JOIN win here ON here.lo = t.lo AND here.hi = t.hi
   WHERE CASE WHEN here.s < 400 THEN win.lo = t.lo AND win.hi >= t.hi AND (win.s >= 400 OR win.hi = t.n) ELSE win.lo - t.lo = t.hi - win.hi AND win.lo >= t.lo AND win.hi > win.lo AND win.s >= 400 END ORDER BY win.hi LIMIT 1) w)
 SELECT d AS dist, round(s / p, 6) AS value FROM st WHERE d >= 0""")  # fmt: skip
def a16(s, d):
    return _round(expected.expected(_cells(s, d), _sizes(s, d), SIZE), "value")


@registered("a18_pair_statistics", f"""WITH {PAIRS}, {FACED}, g AS (SELECT *, least(mapq1, mapq2) >= 20 AS good, chr1 = chr2 AS intra, abs(pos1 - pos2) AS far, chr1 = chr2 AND frag1 = frag2 AS same FROM faced)
 SELECT count(*) AS total, count(*) FILTER (NOT good) AS below_mapq, count(*) FILTER (good AND same) AS intra_fragment, count(*) FILTER (good AND NOT same) AS hic_contacts,
 count(*) FILTER (good AND NOT same AND NOT intra) AS inter, count(*) FILTER (good AND NOT same AND intra) AS intra, count(*) FILTER (good AND NOT same AND intra AND far < 20000) AS short_range,
 count(*) FILTER (good AND NOT same AND intra AND far >= 20000) AS long_range, count(*) FILTER (good AND NOT same AND way = 'INNER') AS inner, count(*) FILTER (good AND NOT same AND way = 'OUTER') AS outer,
 count(*) FILTER (good AND NOT same AND way = 'LL') AS ll, count(*) FILTER (good AND NOT same AND way = 'RR') AS rr FROM g""")  # fmt: skip
def a18(s, d):
    return stats.pair_statistics(_pairs(s, d), 20)


@registered("a19_distance_histogram", f"""WITH {PAIRS}, {FACED} SELECT way AS orientation, CAST(len(list_filter({stats.log_bins()}, lambda e: e <= abs(pos1 - pos2))) AS INTEGER) AS bin, count(*) AS n FROM faced WHERE chr1 = chr2 GROUP BY 1, 2""")
def a19(s, d):
    return stats.distance_histogram(_pairs(s, d), stats.log_bins())


@registered("a20_mapq_histogram", f"""WITH {PAIRS} SELECT least(mapq1, mapq2, 200) AS mapq, count(*) AS n, CAST(sum(CAST(chr1 = chr2 AS INTEGER)) AS BIGINT) AS n_intra,
 CAST(count(*) - sum(CAST(chr1 = chr2 AS INTEGER)) AS BIGINT) AS n_inter FROM pairs GROUP BY 1""")  # fmt: skip
def a20(s, d):
    return stats.mapq_histogram(_pairs(s, d))


@registered("a25_merge_statistics", f"WITH {LOOPS} SELECT 'Orders ' || status AS label, CAST(sum(observed) AS BIGINT) AS total FROM loops GROUP BY 1")
def a25(s, d):
    lines = adapters.loops(s, d).select(F.concat(F.lit("Orders "), "status", F.lit(": "), F.format_number("observed", 0), F.lit(" (1.0% / 2.0%)")).alias("value"))
    return stats.merge_statistics(lines)


@registered("a31_binned_track", f"WITH {LOCI}, b AS (SELECT chr, unnest(range(x1 // 1000, x2 // 1000 + 1)) AS bin, score FROM loci) SELECT chr, bin, round(avg(score), 6) AS mean, round(max(score), 6) AS high FROM b GROUP BY chr, bin")
def a31(s, d):
    return _round(intervals.binned_track(adapters.loci(s, d), 1000), "mean", "high")


@registered("a33_merge_intervals", f"""WITH {LOCI}, m AS (SELECT *, max(x2) OVER (PARTITION BY chr ORDER BY x1, x2, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM loci),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR x1 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY x1, x2, id) AS island FROM m) SELECT chr, min(x1) AS x1, max(x2) AS x2, count(*) AS n FROM g GROUP BY chr, island""")  # fmt: skip
def a33(s, d):
    return intervals.merge(adapters.loci(s, d))


@registered("a35_best_per_cell", f"""WITH {LOCI}, r AS (SELECT *, row_number() OVER (PARTITION BY chr, x1 // 5000, x2 // 5000 ORDER BY score DESC, id) AS k FROM loci) SELECT id, chr, round(score, 6) AS score FROM r WHERE k = 1""")
def a35(s, d):
    return _round(intervals.best_per_cell(adapters.loci(s, d), 5000), "score")


@registered("a35_unique_per_cell", f"WITH {LOCI} SELECT min(id) AS id, chr, round(min(score), 6) AS score FROM loci GROUP BY chr, x1 // 100, x2 // 100 HAVING count(*) = 1")
def a35u(s, d):
    return _round(intervals.unique_per_cell(adapters.loci(s, d), 100), "score")


@registered("a36_convergence", f"WITH {LOOPS} SELECT CASE WHEN observed % 7 = 0 THEN 'incomplete' WHEN observed % 5 = 0 THEN 'non-unique' ELSE (CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END) || (CASE WHEN observed % 3 = 0 THEN '+' ELSE '-' END) END AS status, count(*) AS n FROM loops GROUP BY 1")
def a36(s, d):
    unique = F.lit(True)
    ends = adapters.loops(s, d).select((F.col("id") % 2 == 0).alias("strand1"), F.when(F.col("observed") % 7 != 0, F.col("observed") % 3 == 0).alias("strand2"), unique.alias("unique1"), (F.col("observed") % 5 != 0).alias("unique2"))
    return lists.convergence(ends)


@registered("a37_column_sums", f"""{BASE}, x AS (SELECT chr1 AS chr, bin_x AS bin, counts, chr1 = chr2 AND bin_x = bin_y AS diag FROM cells UNION ALL SELECT chr2, bin_y, counts, FALSE FROM cells WHERE chr1 <> chr2 OR bin_x <> bin_y)
 SELECT chr, bin, sum(counts) AS total, sum(CASE WHEN diag THEN counts ELSE 0 END) AS diagonal FROM x GROUP BY chr, bin""")  # fmt: skip
def a37(s, d):
    return stats.column_sums(_cells(s, d))


@registered("a27_pile_up", f"""{BASE}, {LOOPS}, a AS (SELECT chr, (start1 + end1) // 2 // {SIZE} AS mx, (start2 + end2) // 2 // {SIZE} AS my FROM loops), w AS (SELECT chr, mx + dx AS bx, my + dy AS y2, dx, dy FROM a, range(-4, 5) p(dx), range(-4, 5) q(dy))
 SELECT CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, sum(counts) AS value FROM w JOIN cells ON chr1 = w.chr AND chr2 = w.chr AND bin_x = bx AND bin_y = y2 GROUP BY dx, dy""")  # fmt: skip
def a27(s, d):
    return features.pile_up(adapters.loops(s, d), _cells(s, d), SIZE, 4)


@registered("a28_corner_scores", f"""{BASE}, {LOOPS}, a AS (SELECT chr, (start1 + end1) // 2 // {SIZE} AS mx, (start2 + end2) // 2 // {SIZE} AS my FROM loops), w AS (SELECT chr, mx + dx AS bx, my + dy AS y2, dx, dy FROM a, range(-4, 5) p(dx), range(-4, 5) q(dy)),
 s AS (SELECT dx, dy, sum(counts) AS value FROM w JOIN cells ON chr1 = w.chr AND chr2 = w.chr AND bin_x = bx AND bin_y = y2 GROUP BY dx, dy),
 g AS (SELECT p.dx, q.dy, coalesce(value, 0) AS value FROM range(-4, 5) p(dx) CROSS JOIN range(-4, 5) q(dy) LEFT JOIN s ON s.dx = p.dx AND s.dy = q.dy), c AS (SELECT value AS c FROM g WHERE dx = 0 AND dy = 0)
 SELECT round(any_value(c) / nullif(avg(value) FILTER (dx < -2 AND dy < -2), 0), 6) AS p2ul, round(any_value(c) / nullif(avg(value) FILTER (dx < -2 AND dy > 2), 0), 6) AS p2ur, round(any_value(c) / nullif(avg(value) FILTER (dx > 2 AND dy < -2), 0), 6) AS p2ll,
 round(any_value(c) / nullif(avg(value) FILTER (dx > 2 AND dy > 2), 0), 6) AS p2lr, round(any_value(c) / nullif(avg(value) FILTER (dx <> 0 OR dy <> 0), 0), 6) AS p2m,
 round((any_value(c) - avg(value) FILTER (dx > 2 AND dy < -2)) / nullif(stddev_samp(value) FILTER (dx > 2 AND dy < -2), 0), 6) AS zscore_ll FROM g, c""")  # fmt: skip
def a28(s, d):
    scores = features.corner_scores(features.pile_up(adapters.loops(s, d), _cells(s, d), SIZE, 4), 4, 2)
    return _round(scores, *scores.columns)


# Joins.
@registered("j01_normalize", f"{VC}, {NORMED} SELECT chr1, chr2, bin_x, bin_y, round(counts, 6) AS counts FROM normed")
def j01(s, d):
    cells = _stored(s, d)
    return _round(norm.normalize(cells, norm.vc(cells)), "counts")


@registered("j02_observed_over_expected", f"{BASE}, {DENSITY}, {OE} SELECT chr1, chr2, bin_x, bin_y, round(oe, 6) AS oe FROM oe WHERE oe IS NOT NULL")
def j02(s, d):
    return _round(_oe(s, d), "oe")


@registered("j05_intersect", f"{INTERVALS} SELECT DISTINCT chr, greatest(gx1, lx1) AS x1, least(gx2, lx2) AS x2 FROM hits")
def j05(s, d):
    return intervals.intersect(_genes(s, d).select("id", "chr", "x1", "x2"), adapters.loci(s, d))


@registered("j06_preserving_intersect", f"{INTERVALS} SELECT g_id AS id, chr, gx1 AS x1, gx2 AS x2, count(*) AS n_hits, min(l_id) AS first_hit FROM hits GROUP BY 1, 2, 3, 4")
def j06(s, d):
    return intervals.preserving_intersect(_genes(s, d).select("id", "chr", "x1", "x2"), adapters.loci(s, d))


@registered("j09_best_in_locus", f"{INTERVALS}, r AS (SELECT *, row_number() OVER (PARTITION BY g_id ORDER BY score DESC, l_id) AS k FROM hits) SELECT g_id AS id, l_id AS hit, round(score, 6) AS score FROM r WHERE k = 1")
def j09(s, d):
    return _round(intervals.best_in_locus(_genes(s, d).select("id", "chr", "x1", "x2"), adapters.loci(s, d)), "score")


FAR = "sqrt(power(a.start1 - b.start1, 2) + power(a.start2 - b.start2, 2))"


@registered("j10_reproducible", f"WITH {HALVES} SELECT {PICK} FROM lb b WHERE EXISTS (SELECT 1 FROM la a WHERE a.chr = b.chr AND {FAR} <= 2500)")
def j10(s, d):
    return features.reproducible(*_halves(s, d), 2500).select(*LOOP_COLS)


@registered("j11_reproducible_nearest", f"""WITH {HALVES}, n AS (SELECT b.id, min({FAR}) AS far, any_value(b.start2 - b.start1) AS span FROM la a JOIN lb b ON a.chr = b.chr AND {FAR} <= 5000 GROUP BY b.id)
 SELECT {', '.join('lb.' + c for c in LOOP_COLS)} FROM lb JOIN n ON lb.id = n.id WHERE n.far / n.span <= 0.05""")  # fmt: skip
def j11(s, d):
    return features.reproducible_nearest(*_halves(s, d), 5000, 0.05).select(*LOOP_COLS)


@registered("j14_loop_domains", f"WITH {HALVES} SELECT {PICK} FROM lb b WHERE EXISTS (SELECT 1 FROM la a WHERE a.chr = b.chr AND abs(a.start1 - b.start1) <= 20000 AND abs(a.start2 - b.end1) <= 20000)")
def j14(s, d):
    return features.loop_domains(*_halves(s, d), 20_000).select(*LOOP_COLS)


@registered("j15_rectangle_overlaps", f"WITH {HALVES} SELECT a.id, b.id AS b_id FROM la a JOIN lb b ON a.chr = b.chr AND a.start1 <= b.end1 AND b.start1 <= a.end1 AND a.start2 <= b.end2 AND b.start2 <= a.end2")
def j15(s, d):
    return features.overlapping_rectangles(*_halves(s, d)).select("id", "b_id")


@registered("j15_nearest", f"""WITH {HALVES}, r AS (SELECT a.id, b.id AS b_id, {FAR} AS far FROM la a JOIN lb b ON a.chr = b.chr), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, b_id) AS rank FROM r)
 SELECT id, b_id, round(far, 6) AS far, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")  # fmt: skip
def j15n(s, d):
    return _round(features.nearest(*_halves(s, d), 3).select("id", "b_id", "far", "rank"), "far")


@registered("j17_fragment_lookup", f"""WITH {LOCI}, sites AS (SELECT DISTINCT CAST(1 + p_partkey % 3 AS INTEGER) AS chr, p_partkey * 700 + 350 AS pos FROM part), l AS (SELECT id, chr, x1 FROM loci)
 SELECT l.id, l.chr, l.x1, CAST(count(s.pos) AS INTEGER) AS frag FROM l LEFT JOIN sites s ON s.chr = l.chr AND s.pos <= l.x1 GROUP BY l.id, l.chr, l.x1""")  # fmt: skip
def j17(s, d):
    return pairs.fragment_of(adapters.loci(s, d).select("id", "chr", "x1"), adapters.sites(s, d), "x1")


@registered("j19_site_distance", f"""WITH {LOCI}, sites AS (SELECT DISTINCT CAST(1 + p_partkey % 3 AS INTEGER) AS chr, p_partkey * 700 + 350 AS pos FROM part)
 SELECT l.id, l.chr, l.x1, least(l.x1 - max(s.pos) FILTER (s.pos <= l.x1), min(s.pos) FILTER (s.pos > l.x1) - l.x1) AS site_distance FROM loci l LEFT JOIN sites s ON s.chr = l.chr GROUP BY l.id, l.chr, l.x1""")  # fmt: skip
def j19(s, d):
    return pairs.distance_to_site(adapters.loci(s, d).select("id", "chr", "x1"), adapters.sites(s, d), "x1")


@registered("j22_lift_over", f"""WITH {LOCI}, {GENES}, s AS (SELECT id, chr, x1, x2, x1 * 2 AS new_start, id % 2 = 0 AS inverted FROM genes), h AS (SELECT l.id, l.chr, s.id AS scaffold, greatest(l.x1, s.x1) AS a, least(l.x2, s.x2) AS b, s.*
 FROM loci l JOIN s ON l.chr = s.chr AND l.x1 <= s.x2 AND s.x1 <= l.x2) SELECT id, chr, scaffold, CASE WHEN inverted THEN new_start + x2 - b ELSE new_start + a - x1 END AS x1,
 CASE WHEN inverted THEN new_start + x2 - b ELSE new_start + a - x1 END + b - a AS x2 FROM h""")  # fmt: skip
def j22(s, d):
    scaffolds = _genes(s, d).select("id", "chr", "x1", "x2", (F.col("x1") * 2).alias("new_start"), (F.col("id") % 2 == 0).alias("inverted"))
    return intervals.lift(adapters.loci(s, d).select("id", "chr", "x1", "x2"), scaffolds)


@registered("j25_gene_lookup", f"WITH {GENES} SELECT gene_id, name, chr, x1, x2 FROM genes WHERE gene_id % 5 = 0")
def j25(s, d):
    genes = adapters.genes(s, d)
    return intervals.genes_by_name(genes, genes.where("gene_id % 5 = 0").select(F.upper("name").alias("name"))).select("gene_id", "name", "chr", "x1", "x2")


# Set operations on lists.
NEAR = " AND ".join(f"abs(a.{c} - b.{c}) <= 3000" for c in ("start1", "end1", "start2", "end2"))
for _keep, _name, _not in ((True, "u02_intersect_tolerant", ""), (False, "u03_subtract_tolerant", "NOT ")):
    registered(_name, f"WITH {HALVES} SELECT {PICK} FROM la a WHERE {_not}EXISTS (SELECT 1 FROM lb b WHERE a.chr = b.chr AND {NEAR})")(
        lambda s, d, k=_keep: features.tolerant(*_halves(s, d), 3000, k).select(*LOOP_COLS)
    )


@registered("u04_differences", f"""WITH {HALVES} SELECT {PICK}, 'A' AS only_in FROM la a WHERE NOT EXISTS (SELECT 1 FROM lb b WHERE a.chr = b.chr AND {NEAR})
 UNION ALL SELECT {PICK}, 'B' FROM lb b WHERE NOT EXISTS (SELECT 1 FROM la a WHERE a.chr = b.chr AND {NEAR})""")  # fmt: skip
def u04(s, d):
    return features.differences(*_halves(s, d), 3000).select(*LOOP_COLS, F.col("only").alias("only_in"))


SAME = " AND ".join(f"a.{c} = b.{c}" for c in ("chr", "start1", "end1", "start2", "end2"))


@registered("c08_compare_lists", f"""WITH {HALVES}, ra AS (SELECT * FROM la a WHERE NOT EXISTS (SELECT 1 FROM lb b WHERE {SAME})), rb AS (SELECT * FROM lb b WHERE NOT EXISTS (SELECT 1 FROM la a WHERE {SAME}))
 SELECT id, 'Common' AS label FROM la a WHERE EXISTS (SELECT 1 FROM lb b WHERE {SAME})
 UNION ALL SELECT id, CASE WHEN EXISTS (SELECT 1 FROM lb b WHERE a.chr = b.chr AND {NEAR}) THEN 'A*' ELSE 'A' END FROM ra a
 UNION ALL SELECT id, CASE WHEN EXISTS (SELECT 1 FROM la a WHERE a.chr = b.chr AND {NEAR}) THEN 'B*' ELSE 'B' END FROM rb b""")  # fmt: skip
def c08(s, d):
    return features.compare_lists(*_halves(s, d), 3000).select("id", "label")


# Windows and orders.
@registered("w01_sliding_mean", f"{BASE}, {COVERAGE} SELECT chr, bin, round(avg(value) OVER (PARTITION BY chr ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM coverage")
def w01(s, d):
    return _round(stats.sliding_mean(norm.coverage(_cells(s, d)), 2), "mean")


@registered("w02_reverse_cumulative", f"{BASE}, h AS (SELECT chr1 AS series, CAST(counts AS BIGINT) AS k, count(*) AS n FROM cells GROUP BY 1, 2) SELECT series, k, CAST(sum(n) OVER (PARTITION BY series ORDER BY k DESC) AS BIGINT) AS at_least FROM h")
def w02(s, d):
    return stats.reverse_cumulative(_cells(s, d).groupBy(F.col("chr1").alias("series"), F.col("counts").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n")))


@registered("o06_top_neighbours", f"{BASE}, {SIDES}, r AS (SELECT *, rank() OVER (PARTITION BY chr, bin ORDER BY counts DESC) AS rank FROM sides WHERE bin <> other) SELECT chr, bin, other, counts, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def o06(s, d):
    return stats.top_neighbours(_cells(s, d), 3).select("chr", "bin", "other", "counts", "rank")


@registered("o05_poisson_peaks", f"""{BASE}, {DENSITY}, z AS (SELECT chr1, bin_x, bin_y, 2 * (sqrt(counts) - sqrt(value)) AS z FROM cells JOIN density ON dist = bin_y - bin_x WHERE chr1 = chr2),
 r AS (SELECT *, row_number() OVER (PARTITION BY chr1 ORDER BY z DESC, bin_x, bin_y) AS rank FROM z) SELECT chr1, bin_x, bin_y, round(z, 6) AS z, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")  # fmt: skip
def o05(s, d):
    cells = _stored(s, d).where("chr1 = chr2")
    both = cells.withColumn("dist", F.col("bin_y") - F.col("bin_x")).join(expected.raw_density(cells, _sizes(s, d), SIZE), "dist")
    return _round(stats.poisson_peaks(both, 20).select("chr1", "bin_x", "bin_y", "z", "rank"), "z")


# Two maps: all transforms at once.
_T = {
    "log": "ln(1 + o)", "oe": "o / e", "oectrl": "c / ec", "oep1": "(o + 1) / (e + 1)", "ome": "o - e", "logeo": "ln(o + 1) / ln(e + 1)", "explogeo": "exp(ln(o + 1) / ln(e + 1))",
    "ratio": "(o / a) / (c / ac)", "ratiop1": "((o + 1) / (a + 1)) / ((c + 1) / (ac + 1))", "ratio0": "(o / e0) / (c / ec0)", "logratio": "ln(o / a + 1) / ln(c / ac + 1)",
    "logeoratio": "(ln(o + 1) / ln(e + 1)) / (ln(c + 1) / ln(ec + 1))", "oeratio": "(o / e) / (c / ec)", "oeratiominus": "o / e - c / ec", "diff": "(o / a - c / ac) * (a + ac) / 2",
}
_EVEN = f"even AS (SELECT * FROM pairs WHERE pair_id % 2 = 0), {cells_sql(name='ctrl', source='even')}"
_TWO = f"""{BASE}, {_EVEN}, {DENSITY}, cseen AS (SELECT bin_y - bin_x AS dist, sum(counts) AS observed FROM ctrl WHERE chr1 = chr2 GROUP BY 1),
 cdensity AS (SELECT p.dist, coalesce(observed, 0) / possible AS value FROM possible p LEFT JOIN cseen s ON p.dist = s.dist),
 av AS (SELECT chr1, sum(CASE WHEN bin_x <> bin_y THEN 2 * counts ELSE counts END) / greatest(any_value(length) // {SIZE}, 1) / greatest(any_value(length) // {SIZE}, 1) AS a FROM cells JOIN sizes ON chr = chr1 WHERE chr1 = chr2 GROUP BY chr1),
 cav AS (SELECT chr1, sum(CASE WHEN bin_x <> bin_y THEN 2 * counts ELSE counts END) / greatest(any_value(length) // {SIZE}, 1) / greatest(any_value(length) // {SIZE}, 1) AS a FROM ctrl JOIN sizes ON chr = chr1 WHERE chr1 = chr2 GROUP BY chr1),
 two AS (SELECT x.chr1, x.bin_x, x.bin_y, x.counts AS o, y.counts AS c, d.value AS e, cd.value AS ec, av.a, cav.a AS ac, (SELECT value FROM density WHERE dist = 0) AS e0, (SELECT value FROM cdensity WHERE dist = 0) AS ec0
 FROM cells x JOIN ctrl y ON x.chr1 = y.chr1 AND x.chr2 = y.chr2 AND x.bin_x = y.bin_x AND x.bin_y = y.bin_y JOIN density d ON d.dist = x.bin_y - x.bin_x JOIN cdensity cd ON cd.dist = x.bin_y - x.bin_x
 JOIN av ON av.chr1 = x.chr1 JOIN cav ON cav.chr1 = x.chr1 WHERE x.chr1 = x.chr2)"""  # fmt: skip


def _two_maps(s, d) -> DataFrame:
    """The cells that both maps have within chromosomes, with all that transforms need: o, c, e, ec, a, ac, e0, ec0, dist."""
    sizes = written(_sizes(s, d), "sizes")
    cells, control = (written(m.where("chr1 = chr2"), "cells") for m in (_cells(s, d), _control(s, d)))
    density, cdensity = (written(expected.raw_density(m, sizes, SIZE), "density").select("dist", F.col("value").alias(v)) for m, v in ((cells, "e"), (control, "ec")))
    averages = [binning.average_counts(m, sizes, SIZE).select("chr1", F.col("average").alias(v)) for m, v in ((cells, "a"), (control, "ac"))]
    both = cells.withColumnRenamed("counts", "o").join(control.withColumnRenamed("counts", "c"), binning.CELL).withColumn("dist", F.col("bin_y") - F.col("bin_x"))
    both = both.join(density, "dist").join(cdensity, "dist").join(averages[0], "chr1").join(averages[1], "chr1")
    zero = density.where("dist = 0").select(F.col("e").alias("e0")).join(cdensity.where("dist = 0").select(F.col("ec").alias("ec0")))
    return both.join(F.broadcast(zero))


@registered("j03_two_map_transforms", f"{_TWO} SELECT chr1, bin_x, bin_y, " + ", ".join(f"round({v}, 5) AS {k}" for k, v in _T.items()) + " FROM two")
def j03(s, d):
    both = written(_two_maps(s, d), "two-maps")
    known = transforms.transforms()
    return both.select("chr1", "bin_x", "bin_y", *(F.round(known[k], 5).alias(k) for k in _T))


# Vectors.
@registered("m02_vc_sqrt", f"{BASE}, {COVERAGE}, {finish_sql('sqrt(value)')} SELECT chr, bin, round(value, 6) AS value FROM vec")
def m02(s, d):
    return _round(norm.vc_sqrt(_stored(s, d)), "value")


@registered("m01_matvec", f"{BASE}, {COVERAGE} SELECT s.chr, s.bin, sum(counts * value) AS value FROM sides s JOIN coverage v ON s.chr = v.chr AND s.other = v.bin GROUP BY s.chr, s.bin")
def m01(s, d):
    cells = _stored(s, d)
    return norm.matvec(cells, norm.coverage(cells))


@registered("m03_balanced", None)
def m03(s, d):
    return _round(norm.balance(_cells(s, d)), "value")


@registered("m03d_genome_wide_coverage", f"""{BASE}, o AS (SELECT chr, CAST(coalesce(sum(length // {SIZE} + 1) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS off FROM sizes),
 g AS (SELECT bin_x + a.off AS x, bin_y + b.off AS y, counts FROM cells JOIN o a ON a.chr = chr1 JOIN o b ON b.chr = chr2), v AS (SELECT x AS bin, counts FROM g UNION ALL SELECT y, counts FROM g WHERE x <> y)
 SELECT bin, sum(counts) AS value FROM v GROUP BY bin""")  # fmt: skip
def m03d(s, d):
    wide, _ = norm.genome_wide(_cells(s, d), _sizes(s, d), SIZE)
    return norm.coverage(wide).select("bin", "value")


_OE100 = f"{BASE}, {DENSITY}, {OE}".replace(f"// {SIZE}", "// 100000")


_CORRELATED = f"""{_OE100}, v AS (SELECT chr1 AS chr, bin_x AS row, bin_y AS col, oe AS value FROM oe WHERE oe IS NOT NULL UNION ALL SELECT chr1, bin_y, bin_x, oe FROM oe WHERE oe IS NOT NULL AND bin_x <> bin_y),
 r AS (SELECT DISTINCT chr, row FROM v), dims AS (SELECT chr, unnest(range(length // 100000 + 1)) AS col FROM sizes), full_rows AS (SELECT r.chr, r.row, dims.col, coalesce(v.value, 0) AS value FROM r JOIN dims ON r.chr = dims.chr
  LEFT JOIN v ON v.chr = r.chr AND v.row = r.row AND v.col = dims.col), centred AS (SELECT chr, row, col, value - avg(value) OVER (PARTITION BY chr, col) AS value FROM full_rows),
 correlated AS MATERIALIZED (SELECT a.chr, a.row, b.row AS row2, CASE WHEN a.row = b.row THEN 1 ELSE corr(a.value, b.value) END AS r FROM centred a JOIN centred b ON a.chr = b.chr AND a.col = b.col GROUP BY a.chr, a.row, b.row)"""


def _top_vector(name: str, matrix: str, squarings: int = 14) -> str:
    """The eigenvector of the largest eigenvalue: a matrix squared so often has columns along it alone. Tables {name}_0, ..., and {name}: chr, row, v of length 1."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT chr, row, row2, r AS v FROM {matrix})"]
    for k in range(squarings):
        steps.append(f"""{name}_{k + 1} AS MATERIALIZED (SELECT chr, row, row2, v / max(abs(v)) OVER (PARTITION BY chr) AS v FROM (SELECT a.chr, a.row, b.row2, sum(a.v * b.v) AS v FROM {name}_{k} a JOIN {name}_{k} b
 ON a.chr = b.chr AND a.row2 = b.row GROUP BY a.chr, a.row, b.row2))""")
    last = f"{name}_{squarings}"
    return ", ".join(steps) + f""", {name} AS MATERIALIZED (SELECT m.chr, m.row, v / sqrt(sum(v * v) OVER (PARTITION BY m.chr)) AS v FROM {last} m JOIN (SELECT chr, arg_max(row, v) AS best FROM {last} WHERE row = row2 GROUP BY chr) b
 ON b.chr = m.chr AND m.row2 = b.best)"""


def _signed(name: str) -> str:
    return f"""SELECT x.chr, CAST(row AS INTEGER) AS bin, round((v - avg(v) OVER (PARTITION BY x.chr)) * s, 6) AS value FROM {name} x JOIN (SELECT chr, sign(arg_min(v, row)) AS s FROM (SELECT *, max(abs(v)) OVER (PARTITION BY chr) AS top FROM {name})
 WHERE abs(v) >= top * (1 - 1e-9) GROUP BY chr) t ON t.chr = x.chr"""


_FIRST = f"{_CORRELATED}, {_top_vector('first_', 'correlated')}"
_DEFLATED = f"""{_FIRST}, length1 AS (SELECT c.chr, sum(a.v * c.r * b.v) AS size FROM correlated c JOIN first_ a ON a.chr = c.chr AND a.row = c.row JOIN first_ b ON b.chr = c.chr AND b.row = c.row2 GROUP BY c.chr),
 deflated AS (SELECT c.chr, c.row, c.row2, c.r - size * a.v * b.v AS r FROM correlated c JOIN first_ a ON a.chr = c.chr AND a.row = c.row JOIN first_ b ON b.chr = c.chr AND b.row = c.row2 JOIN length1 l ON l.chr = c.chr), {_top_vector('second_', 'deflated')}"""


@registered("m04_pearson", f"{_CORRELATED} SELECT chr, row, row2, round(r, 5) AS r FROM correlated")
def m04(s, d):
    return _round(linalg.pearson(_oe(s, d, 100_000), _sizes(s, d), 100_000), "r", places=5)


@registered("m05_eigenvector", f"{_FIRST} {_signed('first_')}")
def m05(s, d):
    return _round(linalg.eigenvector(_oe(s, d, 100_000), 0, _sizes(s, d), 100_000), "value")


@registered("o07_second_eigenvector_by_rounds", f"{_DEFLATED} {_signed('second_')}")
def o07(s, d):
    """By block Lanczos, which larger chromosomes take."""
    return _round(linalg.eigenvector(_oe(s, d, 100_000), 1, _sizes(s, d), 100_000, local_bins=0), "value")


@registered("m06_compartment_difference", f"""{BASE}, {COVERAGE}, a AS (SELECT chr, bin, value - avg(value) OVER (PARTITION BY chr) AS v FROM coverage), {_EVEN},
 cs AS (SELECT chr1 AS chr, bin_x AS bin, counts FROM ctrl WHERE chr1 = chr2 UNION ALL SELECT chr1, bin_y, counts FROM ctrl WHERE chr1 = chr2 AND bin_x <> bin_y), cc AS (SELECT chr, bin, sum(counts) AS value FROM cs GROUP BY chr, bin),
 b AS (SELECT chr, bin, avg(value) OVER (PARTITION BY chr) - value AS v FROM cc), j AS (SELECT a.chr, a.bin, a.v AS a, b.v AS b FROM a JOIN b ON a.chr = b.chr AND a.bin = b.bin),
 t AS (SELECT chr, CASE WHEN sum(sign(a) * sign(b)) < 0 THEN -1 ELSE 1 END AS turn FROM j GROUP BY chr)
 SELECT j.chr, bin, round(CASE WHEN a < 0 THEN -abs(a - b * turn) ELSE abs(a - b * turn) END, 6) AS difference, sign(a) = sign(b * turn) AS similar_sign FROM j JOIN t ON j.chr = t.chr""")  # fmt: skip
def m06(s, d):
    from pyspark.sql import Window

    mean = F.avg("value").over(Window.partitionBy("chr"))
    a = norm.coverage(_cells(s, d)).select("chr", "bin", (F.col("value") - mean).alias("value"))
    b = norm.coverage(_control(s, d)).select("chr", "bin", (mean - F.col("value")).alias("value"))
    return _round(linalg.compartment_difference(a, b).withColumnRenamed("similar", "similar_sign"), "difference")


@registered("x08_lambda_bins", f"{BASE}, {DENSITY} SELECT dist, CAST(CASE WHEN value * 100 <= 1 THEN 0 ELSE least(floor(ln(value * 100) / ln(power(2, 0.33))), 39) END AS INTEGER) AS bin FROM density")
def x08(s, d):
    return expected.raw_density(_cells(s, d), _sizes(s, d), SIZE).select("dist", scalars.lambda_bin(F.col("value") * 100).alias("bin"))


@registered("k11_cross_hair", f"""{BASE}, m AS (SELECT CASE WHEN bin_x = 7 THEN bin_y ELSE bin_x END AS bin, counts FROM cells WHERE chr1 = 1 AND chr2 = 1 AND (bin_x = 7 OR bin_y = 7))
 SELECT CAST(b.i AS INTEGER) AS bin, coalesce(counts, 0) AS value FROM range(40) b(i) LEFT JOIN m ON m.bin = b.i""")  # fmt: skip
def k11(s, d):
    return query.cross_hair(_cells(s, d), 1, 7, 40)


@registered("c05_domains", None)
def c05(s, d):
    return domains.call_domains(_cells(s, d))


C04_FAR = "sqrt(power(a.start1 - b.start1, 2) + power(a.start2 - b.start2, 2))"


@registered("c04_loop_differences", f"""WITH {HALVES}, n AS (SELECT a.id AS a_id, b.id AS b_id, {C04_FAR} AS far, a.start2 - a.start1 AS span_a, b.start2 - b.start1 AS span_b FROM la a JOIN lb b ON a.chr = b.chr AND {C04_FAR} <= 4000)
 SELECT {PICK}, 'A' AS only_in FROM la WHERE id NOT IN (SELECT a_id FROM n GROUP BY a_id HAVING min(far) / any_value(span_a) <= 0.1)
 UNION ALL SELECT {PICK}, 'B' FROM lb WHERE id NOT IN (SELECT b_id FROM n GROUP BY b_id HAVING min(far) / any_value(span_b) <= 0.1)""")  # fmt: skip
def c04(s, d):
    return loops.loop_differences(*_halves(s, d), 4000, 0.1).select(*LOOP_COLS, "only_in")


ENDS_SQL = "ends AS (SELECT chr, start1 AS x1, end1 AS x2 FROM loops UNION ALL SELECT chr, start2, end2 FROM loops)"


@registered("c11_genes_at_loops", f"WITH {LOOPS}, {GENES}, {ENDS_SQL} SELECT DISTINCT name FROM genes g WHERE EXISTS (SELECT 1 FROM ends e WHERE e.chr = g.chr AND e.x1 <= g.x2 AND g.x1 <= e.x2)")
def c11(s, d):
    return motifs.genes_at_loops(adapters.loops(s, d), _genes(s, d).select("id", "name", "chr", "x1", "x2"))


@registered("a34_anchors", f"""WITH {LOOPS}, {ENDS_SQL}, m AS (SELECT *, max(x2) OVER (PARTITION BY chr ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER (PARTITION BY chr ORDER BY x1, x2) AS k FROM ends),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR x1 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY k) AS island FROM m), i AS (SELECT chr, min(x1) AS x1, max(x2) AS x2, count(*) AS n FROM g GROUP BY chr, island)
 SELECT chr, n, CASE WHEN x2 - x1 < 15000 THEN greatest((x1 + x2) // 2 - 7500, 0) ELSE x1 END AS x1, CASE WHEN x2 - x1 < 15000 THEN (x1 + x2) // 2 + 7500 ELSE x2 END AS x2 FROM i""")  # fmt: skip
def a34(s, d):
    return intervals.anchors(adapters.loops(s, d), 15_000)


@registered("c07_unique_motifs", f"""WITH {LOOPS}, {LOCI}, {GENES}, lp AS (SELECT chr, id * 40000 AS start1, id * 40000 + end1 - start1 AS end1, id * 40000 + start2 - start1 AS start2, id * 40000 + end2 - start1 AS end2 FROM loops),
 l AS (SELECT id, chr, id * 60000 AS x1, id * 60000 + x2 - x1 AS x2, score FROM loci), gn AS (SELECT id, chr, id * 300000 AS x1, id * 300000 + x2 - x1 AS x2 FROM genes), {ENDS_SQL.replace("loops", "lp")},
 m AS (SELECT *, max(x2) OVER (PARTITION BY chr ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER (PARTITION BY chr ORDER BY x1, x2) AS k FROM ends),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR x1 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY k) AS island FROM m), i AS (SELECT chr, min(x1) AS x1, max(x2) AS x2 FROM g GROUP BY chr, island),
 a AS (SELECT chr, CASE WHEN x2 - x1 < 15000 THEN greatest((x1 + x2) // 2 - 7500, 0) ELSE x1 END AS x1, CASE WHEN x2 - x1 < 15000 THEN (x1 + x2) // 2 + 7500 ELSE x2 END AS x2 FROM i),
 h AS (SELECT a.chr AS c, a.x1 AS a1, a.x2 AS a2, l.* FROM a JOIN l ON a.chr = l.chr AND a.x1 <= l.x2 AND l.x1 <= a.x2), alone AS (SELECT DISTINCT id, chr, x1, x2 FROM (SELECT *, count(*) OVER (PARTITION BY c, a1, a2) AS n FROM h) WHERE n = 1),
 p AS (SELECT * FROM alone WHERE EXISTS (SELECT 1 FROM gn WHERE gn.chr = alone.chr AND gn.x1 <= alone.x2 AND alone.x1 <= gn.x2)), r AS (SELECT p.id, l.id AS hit, l.score, row_number() OVER (PARTITION BY p.id ORDER BY l.score DESC, l.id) AS k FROM p JOIN l ON p.chr = l.chr AND p.x1 <= l.x2 AND l.x1 <= p.x2)
 SELECT id, hit, round(score, 6) AS score FROM r WHERE k = 1""")  # fmt: skip
def c07(s, d):
    sparse = adapters.spread(adapters.loops(s, d), 40_000, "start1", "end1", "start2", "end2")
    loci = adapters.spread(adapters.loci(s, d), 60_000, "x1", "x2")
    genes = adapters.spread(_genes(s, d).select("id", "chr", "x1", "x2"), 300_000, "x1", "x2")
    return _round(motifs.unique_motifs(sparse, [loci, genes], loci), "score")


# Its steps are those of the joins above; the tests hold it against brute force.
@registered("c07_directed_motifs", None)
def c07d(s, d):
    sparse = adapters.spread(adapters.loops(s, d), 40_000, "start1", "end1", "start2", "end2")
    loci = adapters.spread(adapters.loci(s, d), 60_000, "x1", "x2")
    peaks = adapters.spread(_genes(s, d).select("id", "chr", "x1", "x2"), 300_000, "x1", "x2")
    peaks = peaks.unionByName(peaks.select((-F.col("id") - 1).alias("id"), "chr", (F.col("x1") + 500).alias("x1"), "x2"))
    found = motifs.directed_motifs(sparse, peaks, loci.withColumn("forward", F.col("id") % 2 == 0))
    return _round(found.select("id", "hit", "forward", "score"), "score")


@registered("f29_catalog_filter", f"WITH {GENES} SELECT gene_id, name FROM genes WHERE regexp_matches(lower(name), '(re|or).*[02468]$')")
def f29(s, d):
    return lists.catalog_filter(adapters.genes(s, d).select("gene_id", "name"), "(re|or).*[02468]$", ["name", "gene_id"])


OVERLAP = "a.chr = b.chr AND a.start1 <= b.end1 AND b.start1 <= a.end1 AND a.start2 <= b.end2 AND b.start2 <= a.end2"


@registered("u01_union_without_overlaps", f"""WITH RECURSIVE {HALVES}, free AS (SELECT * FROM lb b WHERE NOT EXISTS (SELECT 1 FROM la a WHERE {OVERLAP})),
 e AS (SELECT b.id, a.id AS earlier FROM free a JOIN free b ON {OVERLAP} AND a.id < b.id),
 st AS (SELECT 0 AS round, id, 0 AS status FROM free UNION ALL SELECT any_value(s.round) + 1, s.id, CASE WHEN any_value(s.status) <> 0 THEN any_value(s.status) WHEN count(*) FILTER (t.status = 1) > 0 THEN 2
  WHEN count(*) FILTER (e.earlier IS NOT NULL AND t.status <> 2) = 0 THEN 1 ELSE 0 END FROM st s LEFT JOIN e ON e.id = s.id LEFT JOIN st t ON t.id = e.earlier WHERE s.round < 40 GROUP BY s.id)
 SELECT id FROM la UNION ALL SELECT id FROM st WHERE round = 40 AND status = 1""")  # fmt: skip
def u01(s, d):
    return lists.union_without_overlaps(*_halves(s, d)).select("id")


@registered("a41_distinct_features", f"WITH {LOOPS} SELECT chr, start1, end1, start2, end2, min(id) AS id FROM loops GROUP BY ALL")
def a41(s, d):
    return lists.distinct_features(adapters.loops(s, d))


@registered("a29_pile_up_by_distance", f"""{BASE}, {LOOPS}, a AS (SELECT chr, CAST(floor(log2(abs(start2 - start1) // 10000)) AS INTEGER) AS band, (start1 + end1) // 2 // {SIZE} AS mx, (start2 + end2) // 2 // {SIZE} AS my FROM loops WHERE abs(start2 - start1) >= 10000),
 n AS (SELECT band, count(*) AS n_loops FROM a WHERE band < 8 GROUP BY band), w AS (SELECT band, chr, mx + dx AS bx, my + dy AS y2, dx, dy FROM a, range(-4, 5) p(dx), range(-4, 5) q(dy)),
 v AS (SELECT band, sum(CASE WHEN dx = 0 AND dy = 0 THEN counts ELSE 0 END) AS centre, sum(CASE WHEN dx > 2 AND dy < -2 THEN counts ELSE 0 END) / 4 AS ll FROM w JOIN cells ON chr1 = w.chr AND chr2 = w.chr AND bin_x = bx AND bin_y = y2 GROUP BY band)
 SELECT n.band, n_loops, centre, round(centre / nullif(ll, 0), 6) AS p2ll FROM n LEFT JOIN v ON n.band = v.band""")  # fmt: skip
def a29(s, d):
    return _round(features.pile_up_by_distance(adapters.loops(s, d), _stored(s, d), SIZE, 4, 2, 10_000), "p2ll")
