"""Registered queries on statistics, vectors, images and lifted maps, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contactgrid import adapters
from contactgrid.functions import transforms
from contactgrid.operators import assembly, binning, domains, expected, features, images, intervals, loops, norm, pairs, query, stats
from contactgrid.plans.registry import (
    _T, _TWO, BASE, COVERAGE, DENSITY, FACED, GENES, LOCI, LOOPS, PAIRS, SIDES, SIZE, SIZES, VC, _cells, _control, _genes, _pairs, _round, _sizes, _stored, _two_maps, cells_sql, finish_sql, registered,
)
from contactgrid.sources import bigwig, binary, container, container_format, sinks, text
from contactgrid.tables import new_path, shared_folder, written

# Statistics of pairs.
_LONG = PAIRS.replace("CAST(1.0 AS DOUBLE) AS score", "CAST(1.0 AS DOUBLE) AS score, l_returnflag || l_linestatus || 'AT' AS seq1, l_linestatus || l_returnflag AS seq2")
_COUNTED = f"""WITH {_LONG}, {FACED}, t AS (SELECT *, unnest([20, 35]) AS threshold, chr1 = chr2 AS intra, abs(pos1 - pos2) AS far, chr1 = chr2 AND frag1 = frag2 AS same, least(mapq1, mapq2) AS q,
 starts_with(seq1, 'AF') OR starts_with(seq2, 'AF') AS hangs, contains(seq1, 'FAT') OR contains(seq2, 'FAT') AS joined FROM faced), g AS (SELECT *, NOT same AND q >= threshold AS good FROM t),
 counted AS (SELECT threshold, count(*) AS total, count(*) FILTER (same) AS intra_fragment, count(*) FILTER (NOT same AND q < threshold) AS below_mapq, count(*) FILTER (good) AS contacts, count(*) FILTER (good AND hangs) AS dangling,
 count(*) FILTER (good AND joined) AS ligation, count(*) FILTER (good AND intra) AS intra, count(*) FILTER (good AND NOT intra) AS inter, count(*) FILTER (good AND NOT intra AND hangs) AS inter_dangling,
 count(*) FILTER (good AND intra AND far < 500) AS lt_500, count(*) FILTER (good AND intra AND far < 500 AND hangs) AS lt_500_dangling, count(*) FILTER (good AND intra AND far >= 500 AND far < 5000) AS lt_5k,
 count(*) FILTER (good AND intra AND far >= 500 AND far < 5000 AND hangs) AS lt_5k_dangling, count(*) FILTER (good AND intra AND far >= 5000 AND far < 20000) AS lt_20k, count(*) FILTER (good AND intra AND far >= 5000 AND far < 20000 AND hangs) AS lt_20k_dangling,
 count(*) FILTER (good AND intra AND far >= 20000) AS long, count(*) FILTER (good AND intra AND far >= 20000 AND hangs) AS long_dangling, count(*) FILTER (good AND way = 'INNER' AND far >= 20000) AS inner,
 count(*) FILTER (good AND way = 'OUTER' AND far >= 20000) AS outer, count(*) FILTER (good AND way = 'LL' AND far >= 20000) AS right, count(*) FILTER (good AND way = 'RR' AND far >= 20000) AS left FROM g GROUP BY threshold)"""


def _counters(s, d):
    seq = {"seq1": F.concat("l_returnflag", "l_linestatus", F.lit("AT")), "seq2": F.concat("l_linestatus", "l_returnflag")}
    return stats.pair_counters(adapters.pairs(s, d, seq), [20, 35], "FAT", "AF")


@registered("a18_pair_counters", f"{_COUNTED} SELECT * FROM counted")
def a18c(s, d):
    return _counters(s, d)


_SHOWN = ", ".join(f"({k}, '{label}: ' || format('{{:,}}', {c}) || ' (' || printf('%.2f', 100.0 * {c} / total) || '%)')" for k, (label, c) in enumerate(stats.LABELS))


@registered("k12_statistics_text", f"{_COUNTED} SELECT threshold, v.line AS line, v.value AS value FROM counted, LATERAL (VALUES {_SHOWN}) v(line, value)")
def k12(s, d):
    return stats.statistics_lines(_counters(s, d))


_CONVERGED = f"""WITH {PAIRS}, {FACED}, h AS (SELECT way, CAST(len(list_filter({stats.log_bins()}, lambda e: e <= abs(pos1 - pos2))) AS INTEGER) AS bin, count(*) AS n FROM faced WHERE chr1 = chr2 GROUP BY 1, 2),
 g AS (SELECT b.bin, coalesce(sum(n) FILTER (way = 'INNER'), 0) AS a, coalesce(sum(n) FILTER (way = 'OUTER'), 0) AS b, coalesce(sum(n) FILTER (way = 'LL'), 0) AS c, coalesce(sum(n) FILTER (way = 'RR'), 0) AS d FROM range(100) b(bin) LEFT JOIN h ON h.bin = b.bin GROUP BY b.bin),
 e AS (SELECT bin, CASE WHEN least(a, b, c, d) = 0 THEN 1000 ELSE greatest(abs((ln((a + b + c + d) / 4) - ln(a)) / ln((a + b + c + d) / 4)), abs((ln((a + b + c + d) / 4) - ln(b)) / ln((a + b + c + d) / 4)),
  abs((ln((a + b + c + d) / 4) - ln(c)) / ln((a + b + c + d) / 4)), abs((ln((a + b + c + d) / 4) - ln(d)) / ln((a + b + c + d) / 4))) END AS off FROM g),
 w AS (SELECT bin, max(off) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS ahead FROM e)"""


@registered("a22_convergence_bin", f"{_CONVERGED} SELECT CAST(coalesce(min(bin) FILTER (ahead < 0.3), 99) AS INTEGER) AS bin FROM w")
def a22(s, d):
    return stats.convergence_bin(stats.distance_histogram(_pairs(s, d), stats.log_bins()), 100, 0.3)


@registered("a24_duplicate_counts", "SELECT count(*) FILTER (l_returnflag = 'A') AS opt, count(*) FILTER (l_returnflag = 'R') AS pcr, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS unique FROM lineitem")
def a24(s, d):
    kind = F.when(F.col("l_returnflag") == "A", "opt").when(F.col("l_returnflag") == "R", "pcr").otherwise("unique")
    return stats.duplicate_counts(adapters.table(s, d, "lineitem").select(kind.alias("kind")))


@registered("a25_merge_convergence", f"WITH {LOOPS} SELECT 'LIOR Convergence ' || status AS label, CAST(max(observed) AS BIGINT) AS total FROM loops GROUP BY 1")
def a25c(s, d):
    lines = adapters.loops(s, d).select(F.concat(F.lit("LIOR Convergence "), "status", F.lit(": "), F.format_number("observed", 0)).alias("value"))
    return stats.merge_statistics(lines)


@registered("c12_validate", f"{BASE}, s AS (SELECT * FROM sizes WHERE chr < 3) SELECT chr1, chr2, count(*) AS n_cells, CAST(0 AS BIGINT) AS n_bad, CAST(0 AS BIGINT) AS n_disordered, CAST(sum(CASE WHEN chr1 = 3 OR chr2 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_beyond, CAST(0 AS BIGINT) AS n_repeated FROM cells GROUP BY chr1, chr2")
def c12(s, d):
    return stats.validate(_cells(s, d), _sizes(s, d).where("chr < 3"), SIZE)


@registered("c13_compare_vectors", f"""{BASE}, {COVERAGE}, even AS (SELECT * FROM pairs WHERE pair_id % 2 = 0), {cells_sql(name='ctrl', source='even')},
 cs AS (SELECT chr1 AS chr, bin_x AS bin, counts FROM ctrl WHERE chr1 = chr2 UNION ALL SELECT chr1, bin_y, counts FROM ctrl WHERE chr1 = chr2 AND bin_x <> bin_y), cc AS (SELECT chr, bin, sum(counts) AS value FROM cs GROUP BY chr, bin)
 SELECT a.chr, count(*) AS n, round(corr(a.value, b.value), 6) AS r, round(avg(a.value / b.value), 6) AS quotient FROM coverage a JOIN cc b ON a.chr = b.chr AND a.bin = b.bin GROUP BY a.chr""")  # fmt: skip
def c13(s, d):
    return _round(stats.compare_vectors(norm.coverage(_cells(s, d)), norm.coverage(_control(s, d))), "r", "quotient")


# Vectors.
@registered("m03_balanced_row_sums", f"{BASE} SELECT DISTINCT chr1 AS chr, 1.0 AS spread FROM cells WHERE chr1 = chr2")
def m03r(s, d):
    cells = _stored(s, d)
    sums = norm.coverage(norm.normalize(cells.where("chr1 = chr2"), written(norm.balance(cells, 1e-7, 1000), "vector")))
    return _round(sums.groupBy("chr").agg((F.max("value") / F.min("value")).alias("spread")), "spread", places=4)


@registered("m03f_added_norms", f"""{BASE}, {COVERAGE}, {finish_sql('value')}, v2 AS (SELECT chr, bin, sqrt(value) AS value FROM coverage), f2 AS (SELECT s.chr, sqrt(sum(s.counts / (a.value * b.value)) / sum(s.counts)) AS factor FROM sides s
 JOIN v2 a ON s.chr = a.chr AND s.bin = a.bin JOIN v2 b ON s.chr = b.chr AND s.other = b.bin GROUP BY s.chr)
 SELECT 'VC' AS norm, chr, bin, round(value, 6) AS value FROM vec UNION ALL SELECT 'VC_SQRT', v2.chr, bin, round(value * factor, 6) FROM v2 JOIN f2 ON v2.chr = f2.chr""")  # fmt: skip
def m03f(s, d):
    return _round(norm.add_norms(_cells(s, d), _sizes(s, d), SIZE, ("VC", "VC_SQRT")), "value")


_WIDE = f"""{BASE}, o AS (SELECT chr, length // {SIZE} + 1 AS n, CAST(coalesce(sum(length // {SIZE} + 1) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS off FROM sizes),
 g AS (SELECT bin_x + a.off AS x, bin_y + b.off AS y, counts FROM cells JOIN o a ON a.chr = chr1 JOIN o b ON b.chr = chr2 WHERE chr1 <> chr2 OR {{all}}), gs AS (SELECT x AS bin, y AS other, counts FROM g UNION ALL SELECT y, x, counts FROM g WHERE x <> y),
 gv AS (SELECT bin, sum(counts) AS value FROM gs GROUP BY bin), gf AS (SELECT sqrt(sum(s.counts / (a.value * b.value)) / sum(s.counts)) AS factor FROM gs s JOIN gv a ON s.bin = a.bin JOIN gv b ON s.other = b.bin)
 SELECT '{{name}}' AS norm, o.chr, CAST(gv.bin - o.off AS INTEGER) AS bin, round(value * factor, 6) AS value FROM gv, gf, o WHERE gv.bin >= o.off AND gv.bin < o.off + o.n"""
for _name, _all in (("GW_VC", "TRUE"), ("INTER_VC", "FALSE")):
    registered(f"m03e_{_name.lower()}", _WIDE.format(all=_all, name=_name))(lambda s, d, n=_name: _round(norm.add_norms(_cells(s, d), _sizes(s, d), SIZE, (n,)), "value"))


_SETTLING = [100_000, 50_000]


@registered("m03f_attempts_over_resolutions", "WITH " + PAIRS + ", " + ", ".join(cells_sql(k, f"cells{k}") for k in _SETTLING) + f""", c AS (SELECT 100000 AS bin_size, * FROM cells100000 UNION ALL SELECT 50000, * FROM cells50000),
 r AS (SELECT bin_size, chr1 AS chr, count(DISTINCT bin) AS bins FROM (SELECT bin_size, chr1, bin_x AS bin FROM c WHERE chr1 = chr2 UNION ALL SELECT bin_size, chr1, bin_y FROM c WHERE chr1 = chr2) GROUP BY ALL),
 hub AS (SELECT s_nationkey AS n FROM supplier GROUP BY 1) SELECT bin_size, chr, bins, bins AS balanced, 1.0 AS spread FROM r UNION ALL SELECT 100000, 4, count(*) + 1, 0, NULL FROM hub""")  # fmt: skip
def m03fa(s, d):
    """Balanced rows, and how their sums spread, at two resolutions; chromosome 4, where suppliers' nations meet one bin alone, comes to no end and isn't tried again."""
    hub = adapters.table(s, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).cast("double").alias("counts"))
    four = [F.lit(4).alias("chr1"), F.lit(4).alias("chr2"), F.lit(0).alias("bin_x"), (F.col("s_nationkey") + 1).cast("int").alias("bin_y"), "counts"]
    contacts = binning.bin_contacts(_pairs(s, d), _SETTLING).drop("unit")
    for size in _SETTLING:
        contacts = contacts.unionByName(hub.select(F.lit(size).alias("bin_size"), *four))
    contacts = written(contacts, "contacts")
    vectors = written(norm.add_norms_at(contacts, _sizes(s, d), ("KR",)).drop("norm"), "vectors")
    key = ["bin_size", "chr"]
    x, y = (vectors.select("bin_size", F.col("chr").alias("chr1"), F.col("bin").alias(f"bin_{c}"), F.col("value").alias(f"v{c}")) for c in "xy")
    normed = contacts.where("chr1 = chr2").join(x, ["bin_size", "chr1", "bin_x"]).join(y, ["bin_size", "chr1", "bin_y"]).withColumn("counts", F.col("counts") / F.col("vx") / F.col("vy"))
    sides = F.when(F.col("bin_x") == F.col("bin_y"), F.array("bin_x")).otherwise(F.array("bin_x", "bin_y"))
    sums = normed.select("bin_size", F.col("chr1").alias("chr"), F.explode(sides).alias("bin"), "counts").groupBy(*key, "bin").agg(F.sum("counts").alias("sum"))
    spread = sums.groupBy(*key).agg(F.round(F.max("sum") / F.min("sum"), 3).alias("spread"))
    return vectors.groupBy(*key).agg(F.count(F.lit(1)).alias("bins"), F.count("value").alias("balanced")).join(spread, key, "left")


@registered("m03g_text_matrix", f"{BASE} SELECT DISTINCT chr1 AS chr, 1.0 AS spread FROM cells WHERE chr1 = chr2")
def m03g(s, d):
    cells = _stored(s, d).where("chr1 = chr2")
    vector = written(norm.balance_text(cells.select("chr1", F.concat_ws("\t", "bin_y", "bin_x", "counts").alias("value")), "chr1"), "vector")
    sums = norm.coverage(norm.normalize(cells, vector))
    return _round(sums.groupBy("chr").agg((F.max("value") / F.min("value")).alias("spread")), "spread", places=3)


@registered("m03h_rescaled_vector", f"{BASE} SELECT DISTINCT chr1 AS chr, 1.0 AS spread FROM cells WHERE chr1 = chr2")
def m03h(s, d):
    cells = _stored(s, d)
    custom = written(norm.coverage(cells).withColumn("value", F.sqrt("value") * (1 + F.col("bin") % 3)), "custom")
    sums = norm.coverage(norm.normalize(cells.where("chr1 = chr2"), written(norm.rescale(custom, cells, 1e-7, 2000), "vector")))
    part = sums.join(custom.withColumnRenamed("value", "want"), ["chr", "bin"]).withColumn("part", F.col("value") / F.col("want"))
    return _round(part.groupBy("chr").agg((F.max("part") / F.min("part")).alias("spread")), "spread", places=4)


@registered("s33_expected_wig", f"{BASE}, {COVERAGE} SELECT CAST(chr AS VARCHAR) AS chr, bin, round(value, 6) AS value FROM coverage")
def s33(s, d):
    lines = sinks.wig_lines(norm.coverage(_cells(s, d)), SIZE).withColumn("file", F.col("chr").cast("string"))
    return text.parse_wig(lines).select("chr", F.floor(F.col("x1") / SIZE).cast("int").alias("bin"), F.round("score", 6).alias("value"))


@registered("s31_parse_variable_wig", f"WITH {LOCI} SELECT CAST(chr AS VARCHAR) AS chr, x1 - 1 AS x1, x1 + 24 AS x2, round(score, 6) AS score FROM loci")
def s31v(s, d):
    rows = adapters.loci(s, d).withColumn("line", F.row_number().over(Window.partitionBy("chr").orderBy("x1", "id")))
    body = rows.select(F.col("chr").cast("string").alias("file"), "line", F.concat_ws(" ", "x1", "score").alias("value"))
    head = rows.select(F.col("chr").cast("string").alias("file")).distinct().select("file", F.lit(0).alias("line"), F.concat(F.lit("variableStep chrom="), "file", F.lit(" span=25")).alias("value"))
    return text.parse_wig(head.unionByName(body)).select("chr", "x1", "x2", F.round("score", 6).alias("score"))


# Sinks that are read back.
@registered("k05_binary_dump", f"{BASE} SELECT chr1, chr2, CAST(bin_x * {SIZE} AS INTEGER) AS x, CAST(bin_y * {SIZE} AS INTEGER) AS y, counts AS value FROM cells")
def k05(s, d):
    """The dumps of all pairs of chromosomes, each read back."""
    cells, found = _stored(s, d), None
    for a, b in [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]:
        rows = cells.where(f"chr1 = {a} and chr2 = {b}").select((F.col("bin_x") * SIZE).alias("x"), (F.col("bin_y") * SIZE).alias("y"), F.col("counts").alias("value"))
        back = binary.decode_records(binary.encode_records(rows, binary.CELL), binary.CELL)
        back = back.select(F.lit(a).alias("chr1"), F.lit(b).alias("chr2"), "x", "y", F.col("value").cast("double").alias("value"))
        found = back if found is None else found.unionByName(back)
    return found


@registered("k06_npy_vectors", f"{BASE}, {COVERAGE}, n AS (SELECT chr, max(bin) AS n FROM coverage GROUP BY chr), b AS (SELECT chr, unnest(range(n + 1)) AS bin FROM n) SELECT b.chr, CAST(b.bin AS INTEGER) AS bin, coalesce(value, 0) AS value FROM b LEFT JOIN coverage c ON c.chr = b.chr AND c.bin = b.bin")
def k06(s, d):
    return sinks.read_npy(sinks.npy_vectors(norm.coverage(_cells(s, d)))).fillna(0.0)


# Lifted cells, tracks and features.
_REGIONS = f"{GENES}, regions AS (SELECT id, chr, x1, x2, x1 * 3 + 1000 AS new_start FROM genes)"


def _regions(s, d):
    return _genes(s, d).select("id", "chr", "x1", "x2", (F.col("x1") * 3 + 1000).alias("new_start"))


@registered("j20_lifted_cells", f"""WITH {PAIRS}, {cells_sql(1000)}, {_REGIONS}, l AS (SELECT a.id AS region_x, b.id AS region_y, (a.new_start + bin_x * 1000 - a.x1) // 1000 AS x, (b.new_start + bin_y * 1000 - b.x1) // 1000 AS y, counts FROM cells
 JOIN regions a ON a.chr = chr1 AND bin_x * 1000 BETWEEN a.x1 AND a.x2 JOIN regions b ON b.chr = chr2 AND bin_y * 1000 BETWEEN b.x1 AND b.x2) SELECT region_x, region_y, least(x, y) AS bin_x, greatest(x, y) AS bin_y, counts FROM l""")  # fmt: skip
def j20(s, d):
    return intervals.lift_cells(_cells(s, d, 1000), _regions(s, d), 1000)


@registered("j21_lifted_track", f"WITH {LOCI}, {_REGIONS} SELECT l.id, r.id AS region, greatest(l.x1, r.x1) - r.x1 + r.new_start AS x1, least(l.x2, r.x2) - r.x1 + r.new_start AS x2, round(score, 6) AS score FROM loci l JOIN regions r ON l.chr = r.chr AND l.x1 <= r.x2 AND r.x1 <= l.x2")
def j21(s, d):
    return intervals.lift_track(_round(adapters.loci(s, d), "score"), _regions(s, d))


@registered("j23_lifted_features", f"""WITH {LOOPS}, {GENES}, r AS (SELECT id, chr, x1, x1 + 30000 AS x2, x1 * 2 AS new_start, id % 2 = 0 AS inverted FROM genes), f AS (SELECT id, chr, start1, end1, start2, end2, observed % 2 = 0 AS strand1, observed % 3 = 0 AS strand2 FROM loops),
 a AS (SELECT f.id, r.id AS scaffold1, CASE WHEN inverted THEN new_start + x2 - end1 ELSE new_start + start1 - x1 END AS start1, end1 - start1 AS w1, strand1 <> inverted AS strand1 FROM f JOIN r ON f.chr = r.chr AND r.x1 <= start1 AND end1 <= r.x2),
 b AS (SELECT f.id, r.id AS scaffold2, CASE WHEN inverted THEN new_start + x2 - end2 ELSE new_start + start2 - x1 END AS start2, end2 - start2 AS w2, strand2 <> inverted AS strand2 FROM f JOIN r ON f.chr = r.chr AND r.x1 <= start2 AND end2 <= r.x2)
 SELECT a.id, scaffold1, start1, start1 + w1 AS end1, strand1, scaffold2, start2, start2 + w2 AS end2, strand2 FROM a JOIN b ON a.id = b.id""")  # fmt: skip
def j23(s, d):
    rows = adapters.loops(s, d).withColumns({"strand1": F.col("observed") % 2 == 0, "strand2": F.col("observed") % 3 == 0})
    scaffolds = _genes(s, d).select("id", "chr", "x1", (F.col("x1") + 30_000).alias("x2"), (F.col("x1") * 2).alias("new_start"), (F.col("id") % 2 == 0).alias("inverted"))
    return intervals.lift_features(rows, scaffolds)


@registered("c16_pseudo_chromosome", f"WITH {GENES} SELECT id, chr, x1, x2, CAST(coalesce(sum(x2 - x1 + 10) OVER (ORDER BY chr, x1, x2, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_start FROM genes")
def c16(s, d):
    return intervals.pseudo_chromosome(_genes(s, d))


# Tracks.
@registered("a30_track_by_middle", f"WITH {LOCI} SELECT chr, (x1 + x2) // 2 // 1000 AS bin, round(avg(score), 6) AS mean, round(max(score), 6) AS high FROM loci GROUP BY 1, 2")
def a30(s, d):
    return _round(intervals.track_by_middle(adapters.loci(s, d), 1000), "mean", "high")


@registered("a32_coverage_track", f"{BASE}, {COVERAGE} SELECT bin, value, round((SELECT quantile_cont(value, 0.95) FROM coverage WHERE chr = 1), 6) AS top FROM coverage WHERE chr = 1 AND bin BETWEEN 1 AND 20")
def a32(s, d):
    return _round(intervals.coverage_track(norm.coverage(_cells(s, d)), 1, 1, 20), "top")


# Pile-ups and images.
_PILE = f"""{BASE}, {LOOPS}, a AS (SELECT id, chr, (start1 + end1) // 2 // {SIZE} AS mx, (start2 + end2) // 2 // {SIZE} AS my FROM loops), w AS (SELECT id, chr, mx + dx AS bx, my + dy AS y2, dx, dy FROM a, range(-4, 5) p(dx), range(-4, 5) q(dy)),
 s AS (SELECT CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, sum(counts) AS value FROM w JOIN cells ON chr1 = w.chr AND chr2 = w.chr AND bin_x = bx AND bin_y = y2 GROUP BY dx, dy)"""


@registered("a27_mean_normed", f"{_PILE} SELECT dx, dy, round(value / (SELECT greatest(sum(value) / 81, 1) FROM s), 6) AS value FROM s")
def a27m(s, d):
    return _round(features.mean_normed(features.pile_up(adapters.loops(s, d), _cells(s, d), SIZE, 4), 4), "value")


@registered("a27_centre_normed", f"{_PILE} SELECT dx, dy, round(value / (SELECT coalesce(nullif(max(value) FILTER (dx = 0 AND dy = 0), 0), min(value) FILTER (value > 0), 1) FROM s), 6) AS value FROM s")
def a27c(s, d):
    return _round(features.centre_normed(features.pile_up(adapters.loops(s, d), _cells(s, d), SIZE, 4)), "value")


@registered("a27_enhancement", f"""{_PILE}, v AS (SELECT w.id, sum(CASE WHEN dx = 0 AND dy = 0 THEN counts ELSE 0 END) AS c, sum(counts) AS t FROM w JOIN cells ON chr1 = w.chr AND chr2 = w.chr AND bin_x = bx AND bin_y = y2 GROUP BY w.id)
 SELECT id, round(c / nullif((t - c) / 80, 0), 6) AS enhancement FROM v""")  # fmt: skip
def a27e(s, d):
    return _round(features.enhancement(adapters.loops(s, d), _stored(s, d), SIZE, 4), "enhancement")


N = 16
_TILE = f"(CAST(chr1 AS BIGINT) * 1048576 + bin_x // {N}) * 1048576 + bin_y // {N}"
_IMAGE = f"""WITH {PAIRS}, {cells_sql(5000)}, c AS (SELECT CAST({_TILE} AS BIGINT) AS id, bin_x, bin_y, counts FROM cells WHERE chr1 = chr2),
 sym AS (SELECT id, bin_x % {N} AS i, bin_y % {N} AS j, counts FROM c UNION ALL SELECT id, bin_y % {N}, bin_x % {N}, counts FROM c WHERE bin_x <> bin_y AND bin_x // {N} = bin_y // {N}), ids AS (SELECT DISTINCT id FROM c),
 m AS (SELECT k.id, p.i, q.j, coalesce(counts, 0) AS value FROM ids k CROSS JOIN range({N}) p(i) CROSS JOIN range({N}) q(j) LEFT JOIN sym ON sym.id = k.id AND sym.i = p.i AND sym.j = q.j)"""


def _image(s, d):
    """All chromosomes' whole matrices as images of N x N bins."""
    return images.tiles(_cells(s, d, 5000), N)


def _on_image(name, sql, made, rounded="value"):
    registered(name, f"{_IMAGE} {sql}")(lambda s, d: _round(made(_image(s, d)), *([rounded] if rounded else [])))


def _on_stacks(name, sql, work):
    registered(name, f"{_IMAGE} {sql}")(lambda s, d: images.on_tiles(_cells(s, d, 5000), N, work))


_I = "CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, id"
_on_image("w07_rank_percentile", f"SELECT {_I}, round(CASE WHEN value = 0 THEN 0 ELSE 100.0 * (rank() OVER (PARTITION BY id ORDER BY value) - 1) / count(*) OVER (PARTITION BY id) END, 6) AS value FROM m", images.rank_percentile)
_on_image("w08_box_blur", f"""SELECT CAST(t.i AS INTEGER) AS i, CAST(t.j AS INTEGER) AS j, t.id, round(avg(s.value), 6) AS value FROM m t, range(-2, 3) a(di), range(-2, 3) b(dj), m s
 WHERE s.id = t.id AND s.i = least(greatest(t.i + di, 0), {N - 1}) AND s.j = least(greatest(t.j + dj, 0), {N - 1}) GROUP BY t.id, t.i, t.j""", lambda m: images.box_blur(m, 2))  # fmt: skip
_BOXED = f""", {{to}} AS MATERIALIZED (SELECT t.id, t.i, t.j, avg(s.value) AS value FROM {{of}} t, range(-{{r}}, {{r}} + 1) a(di), range(-{{r}}, {{r}} + 1) b(dj), {{of}} s
 WHERE s.id = t.id AND s.i = least(greatest(t.i + di, 0), {N - 1}) AND s.j = least(greatest(t.j + dj, 0), {N - 1}) GROUP BY t.id, t.i, t.j)"""
_on_stacks("w08_gaussian_blur", "".join(_BOXED.format(to=f"m{k + 1}", of=f"m{k or ''}", r=r) for k, r in enumerate((1, 1, 2))) + f" SELECT {_I}, round(value, 6) AS value FROM m3", lambda m: images.gaussian_blurred(m, 2))
_on_image("w09_peaks", f"SELECT {_I}, value FROM m t WHERE value > 0 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.id = t.id AND abs(o.i - t.i) <= 2 AND abs(o.j - t.j) <= 2 AND (o.value > t.value OR (o.value = t.value AND (o.i < t.i OR (o.i = t.i AND o.j < t.j)))))", lambda m: images.peaks(m, 2))
_on_image("w10_local_gradient", f"""SELECT {_I}, round(value, 6) AS value FROM (SELECT t.id, t.i, t.j, (any_value(t.value) - sum(o.value) / 8) / nullif(sqrt(any_value(t.value)), 0) AS value FROM m t JOIN m o ON o.id = t.id AND abs(o.i - t.i) <= 1 AND abs(o.j - t.j) <= 1 AND NOT (o.i = t.i AND o.j = t.j)
 WHERE t.i BETWEEN 1 AND {N - 2} AND t.j BETWEEN 1 AND {N - 2} GROUP BY t.id, t.i, t.j) WHERE value > 0""", images.local_gradient)  # fmt: skip
_on_image("w11_column_derivative", f"SELECT {_I}, value FROM (SELECT id, i, j, value - lead(value) OVER (PARTITION BY id, j ORDER BY i) AS value FROM m) WHERE value IS NOT NULL", images.column_derivative)
_on_image("w11_over_median", f"SELECT {_I}, round(value, 6) AS value FROM (SELECT id, i, j, least(value / nullif(median(value) OVER (PARTITION BY id, j), 0), 3) AS value FROM m) WHERE value IS NOT NULL", lambda m: images.over_median(m, 3.0))
_on_image("w12_box_max", "SELECT CAST(i // 4 AS INTEGER) AS i, CAST(j // 2 AS INTEGER) AS j, id, max(value) AS value FROM m GROUP BY 1, 2, 3", lambda m: images.box_max(m, 4, 2))
_on_stacks("w12_interpolate", f"""SELECT CAST(r.i AS INTEGER) AS i, CAST(c.j AS INTEGER) AS j, a.id, round((a.value * (1 - (c.j % 3) / 3.0) + b.value * (c.j % 3) / 3.0) * (1 - (r.i % 2) / 2.0) + (e.value * (1 - (c.j % 3) / 3.0) + f.value * (c.j % 3) / 3.0) * (r.i % 2) / 2.0, 6) AS value
 FROM range({2 * N}) r(i) CROSS JOIN range({3 * N}) c(j) JOIN m a ON a.i = r.i // 2 AND a.j = c.j // 3 JOIN m b ON b.id = a.id AND b.i = a.i AND b.j = least(a.j + 1, {N - 1}) JOIN m e ON e.id = a.id AND e.i = least(a.i + 1, {N - 1}) AND e.j = a.j
 JOIN m f ON f.id = a.id AND f.i = e.i AND f.j = b.j""", lambda m: images.interpolated(m, 2, 3))  # fmt: skip
_on_image("w12_expand_with_zeros", "SELECT CAST(p.i AS INTEGER) AS i, CAST(q.j AS INTEGER) AS j, k.id, coalesce(value, 0) AS value FROM ids k CROSS JOIN range(20) p(i) CROSS JOIN range(18) q(j) LEFT JOIN m ON m.id = k.id AND m.i = p.i AND m.j = q.j", lambda m: images.expand_with_zeros(m, 20, 18))
_on_image("a43_display_limit", "SELECT id, round(quantile_cont(value, 0.95), 6) AS top FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i, j) AS place FROM m WHERE i <> j AND value > 0) WHERE place % 10 = 0 GROUP BY id", images.display_limit, "top")


_on_image("k07_matrix_text", "SELECT id, CAST(i AS INTEGER) AS i, '[' || string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ', ' ORDER BY j) || ']' AS value FROM m GROUP BY id, i", lambda m: sinks.matrix_lines(m.withColumn("value", F.col("value").cast("long"))), None)


@registered("c10_localizer", None)
def c10(s, d):
    return images.localize(adapters.loops(s, d), _stored(s, d, 5000), 5000, radius=8)


# Domains.
@registered("c05r_resolution", f"{BASE}, {DENSITY} SELECT CAST(CASE WHEN value > 200 THEN 5000 ELSE 10000 END AS INTEGER) AS bin_size, value < 100 AS sparse FROM density WHERE dist = 0")
def c05r(s, d):
    return domains.resolution_for(expected.raw_density(_cells(s, d), _sizes(s, d), SIZE), 200, 100)


# Transforms.
_SPLIT = {"vs": ("o / a * (a + ac) / 2", "c / ac * (a + ac) / 2"), "logvs": ("ln(1 + o / a * (a + ac) / 2)", "ln(1 + c / ac * (a + ac) / 2)"), "oevs": ("o / e", "c / ec"), "oevsp1": ("(o + 1) / (e + 1)", "(c + 1) / (ec + 1)"),
          "ocmevs": ("o - e", "c - ec"), "logeovs": ("ln(o + 1) / ln(e + 1)", "ln(c + 1) / ln(ec + 1)")}
_MORE = {"observed": "o", "control": "c", "logc": "ln(1 + c)", "expected": "e", "oectrlp1": "(c + 1) / (ec + 1)", "cme": "c - ec", "logceo": "ln(c + 1) / ln(ec + 1)", "explogceo": "exp(ln(c + 1) / ln(ec + 1))",
         "ratio0p1": "((o + 1) / (e0 + 1)) / ((c + 1) / (ec0 + 1))", "oeratiop1": "((o + 1) / (e + 1)) / ((c + 1) / (ec + 1))", "oeratiominusp1": "(o + 1) / (e + 1) - (c + 1) / (ec + 1)"}


@registered("x04_split_transforms", f"{_TWO} SELECT chr1, bin_x, bin_y, " + ", ".join(f"round({up}, 5) AS {k}_upper, round({low}, 5) AS {k}_lower" for k, (up, low) in _SPLIT.items()) + " FROM two")
def x04s(s, d):
    known, both = transforms.split_transforms(), written(_two_maps(s, d), "two-maps")
    return both.select("chr1", "bin_x", "bin_y", *(F.round(known[k][n], 5).alias(f"{k}_{side}") for k in _SPLIT for n, side in enumerate(("upper", "lower"))))


# Five decimals, but of the exponential, which passes what a double can tell to five decimals, nine digits.
@registered("x04_more_transforms", f"{_TWO} SELECT chr1, bin_x, bin_y, " + ", ".join((f"CAST(format('{{:.8e}}', {v}) AS DOUBLE)" if k == "explogceo" else f"round({v}, 5)") + f" AS {k}" for k, v in _MORE.items()) + " FROM two")
def x04m(s, d):
    known, both = transforms.transforms(), written(_two_maps(s, d), "two-maps")
    digits = transforms.exp_log_digits(F.col("c"), F.col("ec"))
    return both.select("chr1", "bin_x", "bin_y", *((digits if k == "explogceo" else F.round(known[k], 5)).alias(k) for k in _MORE))


@registered("x20_norm_squared", f"{VC} SELECT c.chr1, c.bin_x, c.bin_y, round(1 / (a.value * b.value * power(greatest(bin_y - bin_x, 1), 4)), 6) AS value FROM cells c JOIN vec a ON c.chr1 = a.chr AND c.bin_x = a.bin JOIN vec b ON c.chr1 = b.chr AND c.bin_y = b.bin WHERE chr1 = chr2")
def x20(s, d):
    cells = _stored(s, d)
    both = norm._with_values(cells.where("chr1 = chr2"), written(norm.vc(cells), "vector"))
    value = transforms.norm_squared(F.col("vx"), F.col("vy"), F.col("bin_y") - F.col("bin_x"))
    return both.select("chr1", "bin_x", "bin_y", F.round(value, 6).alias("value"))


# Random draws: what they keep.
@registered("a06_uneven_rebin_sums", f"{BASE} SELECT chr1, chr2, sum(counts) AS total FROM cells GROUP BY chr1, chr2")
def a06(s, d):
    return binning.rebin(_cells(s, d), SIZE, 35_000).groupBy("chr1", "chr2").agg(F.sum("counts").alias("total"))


@registered("f07_thinned", None)
def f07(s, d):
    return binning.thin(_cells(s, d), 0.5)


_SITES = "sites AS (SELECT DISTINCT CAST(1 + p_partkey % 3 AS INTEGER) AS chr, p_partkey * 700 + 350 AS pos FROM part)"


@registered("f11_randomized_fragments", f"""WITH {PAIRS}, {_SITES}, p AS (SELECT DISTINCT chr1, pos1 FROM pairs) SELECT pair_id, q.chr1, CAST(coalesce(n, 0) AS INTEGER) AS frag FROM pairs q
 LEFT JOIN (SELECT p.chr1, p.pos1, count(*) AS n FROM p JOIN sites ON sites.chr = p.chr1 AND sites.pos <= p.pos1 GROUP BY 1, 2) c ON c.chr1 = q.chr1 AND c.pos1 = q.pos1""")  # fmt: skip
def f11(s, d):
    """A position moved within its fragment is in the same one still."""
    sites = adapters.sites(s, d)
    moved = pairs.randomize_in_fragments(_pairs(s, d), sites)
    return pairs.fragment_of(moved.withColumnRenamed("chr1", "chr"), sites, "pos1").select("pair_id", F.col("chr").alias("chr1"), "frag")


@registered("s17_container_blocks", f"{BASE} SELECT chr1, chr2, bin_x, bin_y, counts FROM cells")
def s17(s, d):
    """The cells as compressed blocks of a container, and back."""
    contacts = _cells(s, d).select("chr1", "chr2", F.lit("BP").alias("unit"), F.lit(SIZE).alias("bin_size"), "bin_x", "bin_y", "counts")
    return container.decode_blocks(container.encode_blocks(contacts, 8)).select("chr1", "chr2", "bin_x", "bin_y", "counts")


def _container(s, d) -> str:
    """A container of the cells at two resolutions, and their coverage vectors, written by tasks; its path."""
    contacts = written(binning.bin_contacts(_pairs(s, d), [SIZE, 100_000]), "contacts")
    fine = contacts.where(F.col("bin_size") == SIZE).drop("unit", "bin_size")
    vectors = norm.coverage(fine).select(F.lit("VC").alias("norm"), "chr", F.lit("BP").alias("unit"), F.lit(SIZE).alias("bin_size"), "bin", "value")
    lengths = [(str(r["chr"]), r["length"]) for r in _sizes(s, d).orderBy("chr").collect()]
    shared_folder(s)
    path = container_format.plain_path(new_path(s, "container"))
    container_format.write_container(contacts, path, lengths, vectors, block_bins=8)
    return path


_ASKED = f"chr1 = 1 AND chr2 <> 2 AND bin_size = {SIZE} AND bin_x BETWEEN 8 AND 30 AND bin_y >= 12"


@registered("s16_container_source", f"{BASE} SELECT chr1, chr2, bin_x, bin_y, counts FROM cells WHERE chr1 = 1 AND chr2 = 1 AND bin_x BETWEEN 8 AND 30 AND bin_y >= 12")
def s16(s, d):
    """A region of one resolution of a whole container that tasks have written, by the data source."""
    found = container_format.contact_map(s, _container(s, d)).where("unit = 'BP' AND chr2 = 1").where(_ASKED)
    return found.select("chr1", "chr2", "bin_x", "bin_y", "counts")


@registered("s16_blocks_read", f"""{BASE} SELECT bin_x // 8 BETWEEN 1 AND 3 AND bin_y // 8 >= 1 AS is_read, count(DISTINCT (bin_x // 8, bin_y // 8)) AS blocks FROM cells WHERE chr1 = 1 AND chr2 = 1 GROUP BY 1""")
def s16b(s, d):
    """How many blocks of the matrix the same conditions leave to be read, and how many not."""
    reader = container_format.contact_map(s, _container(s, d), blocks=True, bins={"bin_x": (8, 30), "bin_y": (12, None)})
    return reader.where(f"chr1 = 1 AND chr2 = 1 AND bin_size = {SIZE}").groupBy("is_read").agg(F.count(F.lit(1)).alias("blocks"))


@registered("k01_whole_container", f"{BASE}, {cells_sql(100_000, 'wide')} SELECT {SIZE} AS bin_size, chr1, chr2, bin_x, bin_y, counts FROM cells UNION ALL SELECT 100000, chr1, chr2, bin_x, bin_y, counts FROM wide")
def k01(s, d):
    return container_format.contact_map(s, _container(s, d)).select("bin_size", "chr1", "chr2", "bin_x", "bin_y", "counts")


@registered("s19_container_vectors", f"{BASE}, {COVERAGE} SELECT chr, bin, value FROM coverage")
def s19(s, d):
    return container.read_vectors(s, _container(s, d), "VC").where("value is not null").select("chr", "bin", "value")


def _track(s, d) -> str:
    """The coverage of bins of 5 kb as an indexed track file with two levels of summaries; its path."""
    v = norm.coverage(_stored(s, d, 5000))
    values = v.select(F.concat(F.lit("chr"), "chr").alias("chr"), (F.col("bin") * F.lit(5000).cast("long")).alias("x1"), ((F.col("bin") + 1) * F.lit(5000).cast("long")).alias("x2"), F.col("value").alias("score"))
    lengths = [(f"chr{r['chr']}", r["length"]) for r in _sizes(s, d).collect()]
    path = container_format.plain_path(new_path(s, "track"))
    bigwig.write_track(values, path, lengths, [20_000, 100_000])
    return path


_COVERED5 = f"{BASE}, {COVERAGE}, track AS (SELECT 'chr' || chr AS chr, bin * 5000 AS x1, (bin + 1) * 5000 AS x2, value FROM coverage)".replace(f"// {SIZE}", "// 5000")


@registered("s30_track_range", f"{_COVERED5} SELECT chr, x1, x2, value AS score FROM track WHERE chr = 'chr2' AND x2 > 60000 AND x1 < 400000")
def s30(s, d):
    return bigwig.track(s, _track(s, d)).where("chr = 'chr2' and x2 > 60000 and x1 < 400000")


@registered("s30_track_summaries", f"""{_COVERED5} SELECT chr, CAST(x1 // 100000 AS BIGINT) AS w, CAST(sum(x2 - x1) AS BIGINT) AS n, min(value) AS low, max(value) AS high, round(sum(value * (x2 - x1)) / sum(x2 - x1), 3) AS mean FROM track GROUP BY ALL""")
def s30s(s, d):
    found = bigwig.track(s, _track(s, d), zoom=2)
    return found.select("chr", F.floor(F.col("x1") / 100_000).alias("w"), "n", "low", "high", F.round(F.col("total") / F.col("n"), 3).alias("mean"))


@registered("a30_track_windows", f"""{_COVERED5}, w AS (SELECT chr, (x1 + x2) // 2 // 40000 AS w, avg(value) AS mean, max(value) AS high FROM track GROUP BY ALL), l AS (SELECT chr, unnest(range(max(w) + 1)) AS w FROM w GROUP BY chr)
 SELECT l.chr, l.w * 40000 AS x1, (l.w + 1) * 40000 AS x2, round(coalesce(mean, 0), 6) AS mean, coalesce(high, 0) AS high FROM l LEFT JOIN w ON w.chr = l.chr AND w.w = l.w""")
def a30w(s, d):
    return _round(bigwig.windows(bigwig.track(s, _track(s, d)), 40_000), "mean")


_READS = """reads AS (SELECT l_orderkey * 10 + l_linenumber AS name, l_returnflag <> 'R' AS strand1, 1 AS chr1, l_partkey % 40 AS pos1, l_linestatus = 'F' AS strand2, 2 AS chr2, l_suppkey % 7 AS pos2, l_linenumber AS tile,
 l_orderkey * 37 % 1000 AS x, l_partkey * 91 % 1000 AS y FROM lineitem)"""


@registered("a24_found_duplicates", f"""WITH {_READS}, f AS (SELECT *, min(name) OVER p AS first FROM reads WINDOW p AS (PARTITION BY strand1, pos1, strand2, pos2)),
 o AS (SELECT DISTINCT a.name FROM reads a JOIN reads b ON a.strand1 = b.strand1 AND a.pos1 = b.pos1 AND a.strand2 = b.strand2 AND a.pos2 = b.pos2 AND a.tile = b.tile AND b.name < a.name AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 50)
 SELECT name, CASE WHEN name = first THEN 'unique' WHEN name IN (SELECT name FROM o) THEN 'opt' ELSE 'pcr' END AS kind FROM f""")
def a24f(s, d):
    """Copies found by place, and those near an earlier one on its tile, of pairs brought to few places."""
    t = adapters.table(s, d, "lineitem")
    reads = t.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("name"), (F.col("l_returnflag") != "R").alias("strand1"), F.lit(1).alias("chr1"), (F.col("l_partkey") % 40).alias("pos1"),
        (F.col("l_linestatus") == "F").alias("strand2"), F.lit(2).alias("chr2"), (F.col("l_suppkey") % 7).alias("pos2"), F.col("l_linenumber").alias("tile"),
        (F.col("l_orderkey") * 37 % 1000).alias("x"), (F.col("l_partkey") * 91 % 1000).alias("y"),
    )
    return stats.find_duplicates(reads).select("name", "kind")


@registered("o05_significant_peaks", f"""{BASE}, {DENSITY}, v AS (SELECT chr1, bin_x, bin_y, counts, value, count(*) OVER (PARTITION BY chr1) AS n FROM cells JOIN density ON dist = bin_y - bin_x WHERE chr1 = chr2),
 p AS (SELECT *, least(1, n * (1 - coalesce(list_sum(list_transform(range(CAST(round(counts) AS BIGINT)), lambda k: exp(k * ln(value) - value - lgamma(k + 1)))), 0))) AS p_value, 2 * (sqrt(counts) - sqrt(value)) AS z FROM v WHERE value > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY chr1 ORDER BY z DESC, bin_x, bin_y) AS k FROM p WHERE p_value <= 0.9) SELECT chr1, bin_x, bin_y, counts, round(z, 6) AS z, round(p_value, 6) AS p_value FROM r WHERE k <= 20""")
def o05p(s, d):
    cells = _stored(s, d).where("chr1 = chr2")
    both = cells.withColumn("dist", F.col("bin_y") - F.col("bin_x")).join(expected.raw_density(cells, _sizes(s, d), SIZE), "dist")
    return _round(stats.significant_peaks(both, 20, 0.9).select("chr1", "bin_x", "bin_y", "counts", "z", "p_value"), "z", "p_value")


@registered("f25_wide_domains", f"""WITH {LOOPS} SELECT id, chr, start1 // 5000 AS start_bin, end2 // 5000 AS end_bin FROM loops WHERE end2 // 5000 - start1 // 5000 > 8""")
def f25(s, d):
    bins = {c: F.floor(F.col(at) / 5000).alias(c) for c, at in (("start_bin", "start1"), ("end_bin", "end2"))}
    return domains.wider_than(adapters.loops(s, d).select("id", "chr", *bins.values()), 8)


_PHASED = "SELECT p_partkey + 1 AS id, 'c' || ((p_partkey + 1) % 3) AS chr, (p_partkey + 1) * 10 AS pos, upper(substr(p_name, 1, 1)) AS ref, upper(substr(p_type, 1, 1)) AS alt FROM part"


@registered("s35_phasing_copies", f"""WITH v AS ({_PHASED}), m AS (SELECT id, id // 20 AS chain, CASE WHEN id % 3 = 0 THEN -id ELSE id END AS signed_id, row_number() OVER (PARTITION BY id // 20 ORDER BY id) - 1 AS place FROM v)
 SELECT CAST(2 * chain + k AS BIGINT) AS super_id, CAST(place AS INTEGER) AS pos, CAST(2 * abs(signed_id) - CASE WHEN (signed_id < 0) = (k = 1) THEN 1 ELSE 0 END AS INTEGER) AS signed_id FROM m, (SELECT unnest([0, 1]) AS k)""")
def s35(s, d):
    """A phasing file of parts: chains of twenty variants, both copies of each."""
    t = adapters.table(s, d, "part")
    key, first = F.col("p_partkey") + 1, lambda c: F.upper(F.substring(c, 1, 1))  # variants are numbered from 1
    heads = t.select((10**9 + key).alias("line"), F.concat(F.lit(">c"), F.concat_ws(" ", (key % 3).cast("string"), (key * 10).cast("string"), first("p_name"), first("p_type"), key.cast("string"))).alias("value"))
    signed = F.when(key % 3 == 0, -key).otherwise(key)
    row = F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), signed.alias("s")))), lambda x: x["s"].cast("string"))
    chains = t.groupBy(F.floor(key / 20).alias("line")).agg(F.array_join(row, " ").alias("value"))
    return assembly.phasing_scaffolds(*assembly.phasing_rows(heads.unionByName(chains)))[1]


@registered("k13_phasing_lines", f"""WITH v AS ({_PHASED}) SELECT 0 AS part, CAST(id AS BIGINT) AS line, '>' || chr || ' ' || pos || ' ' || ref || ' ' || alt || ' ' || id AS value FROM v
 UNION ALL SELECT 1, CAST(id // 20 AS BIGINT), string_agg(CASE WHEN id % 3 = 0 THEN -id ELSE id END, ' ' ORDER BY id) FROM v GROUP BY id // 20""")
def k13p(s, d):
    """The file again from its two copies and the forms of its variants."""
    t = adapters.table(s, d, "part")
    key, first = F.col("p_partkey") + 1, lambda c: F.upper(F.substring(c, 1, 1))  # variants are numbered from 1
    variants = t.select(key.cast("int").alias("id"), F.concat(F.lit("c"), (key % 3).cast("string")).alias("chr"), (key * 10).alias("pos"), first("p_name").alias("ref"), first("p_type").alias("alt"))
    place = F.row_number().over(Window.partitionBy("super_id").orderBy("id")) - 1
    chains = variants.withColumn("super_id", F.floor(F.col("id") / 20)).select("super_id", place.alias("pos"), F.when(F.col("id") % 3 == 0, -F.col("id")).otherwise(F.col("id")).alias("signed_id"))
    return assembly.phasing_lines(*assembly.phasing_scaffolds(variants, chains))


@registered("k08_localized_export", f"WITH {LOOPS} SELECT 'chr' || chr AS chr1, start1, end1, start2, end2, CAST(observed AS VARCHAR) AS observed, 'NA' AS localX FROM loops")
def k08l(s, d):
    """Loops in the fifth layout, read back."""
    lines = sinks.bedpe_lines(adapters.loops(s, d).withColumn("chr", F.concat(F.lit("chr"), "chr")), "LOCALIZED")
    back = text.parse_bedpe(lines, sinks.bedpe_header("LOCALIZED"))
    return back.select("chr1", "start1", "end1", "start2", "end2", F.col("attrs")["observed"].alias("observed"), F.col("attrs")["localX"].alias("localX"))


@registered("a05_served_resolution", f"WITH {PAIRS}, {cells_sql(150_000)} SELECT chr1, chr2, bin_x, bin_y, counts FROM cells")
def a05s(s, d):
    """Bins of 150 kb, which aren't stored, from the coarsest of three stored levels that divides them (50 kb); the others aren't read."""
    levels = {k: written(_cells(s, d, k), f"level-{k}") for k in (10_000, 50_000, 100_000)}
    return binning.served(levels, 150_000)


@registered("s14_record_files", f"WITH {PAIRS} SELECT chr1, pos1, chr2, pos2, score FROM pairs")
def s14f(s, d):
    """Pairs as files of records, read by ranges of 1,000 records."""
    path = container_format.plain_path(new_path(s, "records"))
    binary.write_records(_pairs(s, d), path, binary.SHORT, ".bn")
    return binary.read_binary_pairs(s, f"{path}/*.bn", 1_000).select("chr1", "pos1", "chr2", "pos2", "score")


@registered("s32_vectors_from_file", f"{BASE}, {COVERAGE} SELECT CAST(chr AS VARCHAR) AS chr, CAST(row_number() OVER (PARTITION BY chr ORDER BY bin) - 1 AS INTEGER) AS bin, round(value, 6) AS value FROM coverage")
def s32f(s, d):
    """Coverage vectors as sections of one text file, read in Spark's own splits of it."""
    v = norm.coverage(_cells(s, d))
    head = v.groupBy("chr").agg(F.lit(-1).alias("bin"), F.concat(F.lit("vector VC "), F.first("chr").cast("string"), F.lit(f" {SIZE} BP")).alias("value"))
    path = new_path(s, "vectors")
    head.unionByName(v.select("chr", "bin", F.col("value").cast("string").alias("value"))).coalesce(1).sortWithinPartitions("chr", "bin").select("value").write.text(path)
    found = text.parse_norm_vectors(text.numbered_lines(s, path))
    return _round(found.select("chr", "bin", "value"), "value")


@registered("c05s_domain_scores", None)
def c05s(s, d):
    found = adapters.loops(s, d).select("id", "chr", F.floor(F.col("start1") / 5000).cast("int").alias("start_bin"), F.floor(F.col("end2") / 5000).cast("int").alias("end_bin"))
    return _round(domains.score_domains(found, _cells(s, d, 5000)), "score", "uVarScore", "lVarScore", "upSign", "loSign")
