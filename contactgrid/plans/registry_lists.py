"""Registered queries on chromosomes, catalogs and lists of features, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contactgrid import adapters
from contactgrid.operators import binning, chromosomes, features, intervals, lists
from contactgrid.plans.registry import BASE, GENES, HALVES, INTERVALS, LOCI, LOOP_COLS, LOOPS, NEAR, OVERLAP, PAIRS, PICK, _cells, _halves, _lines, _pairs, _round, registered
from contactgrid.sources import text
from contactgrid.tables import written

GENOME = """genome AS (SELECT CAST(n_nationkey + 1 AS INTEGER) AS chr, CASE n_nationkey WHEN 22 THEN 'chrX' WHEN 23 THEN 'Y' WHEN 24 THEN 'chrM' ELSE n_name END AS name, 1000000 + 10000 * ((n_nationkey * 37) % 25) AS length FROM nation)"""
#: Scores of loops, made of what orders have.
SCORED = f"""{LOOPS}, scored AS (SELECT *, 1.0 + (observed * 7 % 1000) * 300 AS expectedBL, 1.0 + (observed * 11 % 1000) * 300 AS expectedDonut, 1.0 + (observed * 13 % 1000) * 300 AS expectedH, 1.0 + (observed * 17 % 1000) * 300 AS expectedV,
 (id % 10) / 1000000.0 AS fdrBL, (id % 7) / 1000000.0 AS fdrDonut, (id % 3) / 1000000.0 AS fdrH, 0.0 AS fdrV, CAST(1 + id % 2 AS INTEGER) AS numCollapsed FROM loops)"""


def _scored(s, d):
    expected = {f"expected{m}": 1.0 + (F.col("observed") * k % 1000) * 300 for m, k in (("BL", 7), ("Donut", 11), ("H", 13), ("V", 17))}
    rates = {"fdrBL": (F.col("id") % 10) / 1e6, "fdrDonut": (F.col("id") % 7) / 1e6, "fdrH": (F.col("id") % 3) / 1e6, "fdrV": F.lit(0.0)}
    return adapters.loops(s, d).withColumns(expected | rates | {"numCollapsed": (1 + F.col("id") % 2).cast("int")})


# Scores.
@registered("f22_fdr_acceptance", f"""WITH {SCORED} SELECT {PICK} FROM scored WHERE observed > 1.75 * expectedBL AND observed > 1.75 * expectedDonut AND observed > 1.5 * expectedH AND observed > 1.5 * expectedV
 AND (observed > 2 * expectedBL OR observed > 2 * expectedDonut) AND (numCollapsed > 1 OR fdrBL + fdrDonut + fdrH + fdrV <= 0.000008)""")  # fmt: skip
def f22(s, d):
    return _scored(s, d).where(features.fdr_accepts(fdr_sum=0.000008)).select(*LOOP_COLS)


@registered("f23_clean_up", f"""WITH {SCORED} SELECT {PICK} FROM scored WHERE observed < 40 * expectedBL AND observed < 40 * expectedDonut AND observed < 40 * expectedH AND observed < 40 * expectedV
 AND (end1 - start1 < 5000 OR numCollapsed > 1 OR fdrBL + fdrDonut + fdrH + fdrV <= 0.0000105)""")  # fmt: skip
def f23(s, d):
    return _scored(s, d).where(lists.clean(fdr_sum=0.0000105)).select(*LOOP_COLS)


@registered("f24_max_enrichment", f"WITH {SCORED} SELECT {PICK} FROM scored WHERE observed < 1.3 * expectedBL AND observed < 1.3 * expectedDonut AND observed < 1.3 * expectedH AND observed < 1.3 * expectedV")
def f24(s, d):
    return _scored(s, d).where(lists.enriched_less_than(1.3)).select(*LOOP_COLS)


@registered("f28_attribute_filter", f"WITH {LOOPS} SELECT {PICK} FROM loops WHERE priority = '1-URGENT' OR status = '1-URGENT'")
def f28(s, d):
    rows = adapters.loops(s, d).withColumn("attrs", F.create_map(F.lit("priority"), "priority", F.lit("status"), "status"))
    return lists.with_attribute(rows, "1-URGENT").select(*LOOP_COLS)


# Chromosomes and resolutions.
@registered("f26_chromosomes_by_name", f"WITH {GENOME} SELECT chr, name, length FROM genome WHERE lower(replace(lower(name), 'chr', '')) IN (SELECT replace(lower(upper(n_name)), 'chr', '') FROM nation WHERE n_regionkey < 3) OR name IN ('chrX', 'chrM')")
def f26(s, d):
    wanted = adapters.table(s, d, "nation").where("n_regionkey < 3").select(F.concat(F.lit("CHR"), F.lower("n_name")).alias("name"))
    return chromosomes.by_names(adapters.genome(s, d), wanted.unionByName(s.createDataFrame([("x",), ("chrm",)], "name string")))


@registered("f27_resolution_snap", """WITH w AS (SELECT DISTINCT p_size * 1000 AS bin_size FROM part), a AS (SELECT DISTINCT s_suppkey % 9 * 5000 + 2500 AS there FROM supplier)
 SELECT bin_size, arg_min(there, struct_pack(a := abs(there - bin_size), b := there)) AS snapped FROM w, a GROUP BY bin_size""")  # fmt: skip
def f27(s, d):
    wanted = adapters.table(s, d, "part").select((F.col("p_size") * 1000).cast("long").alias("bin_size"))
    return chromosomes.snapped(wanted, adapters.table(s, d, "supplier").select((F.col("s_suppkey") % 9 * 5000 + 2500).alias("bin_size")))


@registered("f30_autosome_parts", f"""WITH {GENOME}, a AS (SELECT *, sum(length) OVER (ORDER BY chr) AS upto, sum(length) OVER () AS whole, row_number() OVER (ORDER BY chr) AS place FROM genome WHERE name NOT IN ('chrX', 'Y', 'chrM')),
 c AS (SELECT chr AS cut FROM a ORDER BY abs(2 * upto - whole), chr LIMIT 1) SELECT chr, name, length, chr % 2 = 1 AS is_odd, CAST(CASE WHEN chr <= cut THEN 1 ELSE 2 END AS INTEGER) AS half,
 CAST(CASE WHEN (place // 2) % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS turn FROM a, c""")  # fmt: skip
def f30(s, d):
    return chromosomes.autosome_parts(adapters.genome(s, d))


@registered("j26_chromosome_pairs", f"WITH {GENOME} SELECT a.chr AS chr1, b.chr AS chr2 FROM genome a JOIN genome b ON a.chr <= b.chr")
def j26(s, d):
    return chromosomes.pairs_of(adapters.genome(s, d))


@registered("j27_common_chromosomes", f"WITH {GENOME} SELECT name, length FROM genome WHERE chr % 2 = 0 AND chr % 3 = 0")
def j27(s, d):
    g = adapters.genome(s, d)
    return chromosomes.common([g.where("chr % 2 = 0"), g.where("chr % 3 = 0").unionByName(g.where("chr = 6"))])


@registered("u09_combined_zooms", """WITH z AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'FRAG' ELSE 'BP' END AS unit, p_size * 100 AS bin_size, p_partkey % 5 AS k FROM part), a AS (SELECT * FROM z WHERE k < 4 AND bin_size < 4000), b AS (SELECT * FROM z WHERE k > 1 AND bin_size > 1000)
 SELECT DISTINCT unit, bin_size FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE unit = 'BP' UNION ALL (SELECT DISTINCT unit, bin_size FROM a WHERE unit = 'FRAG' INTERSECT SELECT unit, bin_size FROM b)""")  # fmt: skip
def u09(s, d):
    z = adapters.table(s, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, "FRAG").otherwise("BP").alias("unit"), (F.col("p_size") * 100).alias("bin_size"), (F.col("p_partkey") % 5).alias("k"))
    return chromosomes.combined_zooms([z.where("k < 4 and bin_size < 4000"), z.where("k > 1 and bin_size > 1000")])


@registered("o08_zoom_order", """WITH z AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'FRAG' ELSE 'BP' END AS unit, p_size * 100 AS bin_size FROM part)
 SELECT unit, bin_size, CAST(row_number() OVER w AS INTEGER) AS place, coalesce(lead(bin_size) OVER w, 0) AS finer, coalesce(lag(bin_size) OVER w, 0) AS coarser FROM z WINDOW w AS (PARTITION BY unit ORDER BY bin_size DESC)""")  # fmt: skip
def o08(s, d):
    z = adapters.table(s, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, "FRAG").otherwise("BP").alias("unit"), (F.col("p_size") * 100).alias("bin_size")).distinct()
    return chromosomes.zoom_order(z).fillna(0, ["finer", "coarser"])


@registered("x03_grid_sizes", f"WITH {GENOME}, n AS (SELECT chr, length // 500 + 1 AS n FROM genome) SELECT chr, n AS n_bins, greatest(n // 500 + 1, 1) AS columns, n // greatest(n // 500 + 1, 1) + 1 AS block_bins FROM n")
def x03(s, d):
    return chromosomes.grid_sizes(adapters.genome(s, d), 500, 1000)


@registered("x14_infer_genome", f"WITH {GENOME}, k AS (SELECT n_regionkey AS rank, 'genome' || n_regionkey AS genome, n_name AS name, 1000000 + 10000 * ((n_nationkey * 37) % 25) + CASE WHEN n_regionkey < 2 THEN 1 ELSE 0 END AS length FROM nation) SELECT k.genome FROM genome g JOIN k ON g.name = k.name AND g.length = k.length ORDER BY rank LIMIT 1")
def x14(s, d):
    known = adapters.table(s, d, "nation").select(
        F.col("n_regionkey").alias("rank"), F.concat(F.lit("genome"), F.col("n_regionkey").cast("string")).alias("genome"), F.col("n_name").alias("name"),
        (1_000_000 + 10_000 * (F.col("n_nationkey") * 37 % 25) + F.when(F.col("n_regionkey") < 2, 1).otherwise(0)).cast("long").alias("length"),
    )
    return chromosomes.infer_genome(adapters.genome(s, d), known)


@registered("x14_infer_enzyme", f"""WITH {GENOME}, k AS (SELECT n_regionkey AS rank, 'genome' || n_regionkey AS genome, n_name AS name, 1000000 + 10000 * ((n_nationkey * 37) % 25) + CASE WHEN n_regionkey < 2 THEN 1 ELSE 0 END AS length FROM nation),
 f AS (SELECT k.genome FROM genome g JOIN k ON g.name = k.name AND g.length = k.length ORDER BY rank LIMIT 1), c AS (SELECT count(*) AS n FROM part WHERE 1 + p_partkey % 3 = 1)
 SELECT f.genome, min(n_nationkey) AS k, 'enzyme' || min(n_nationkey) AS enzyme FROM f LEFT JOIN nation ON 'genome' || n_regionkey = f.genome AND n_nationkey % 3 = 0 GROUP BY f.genome""".replace("min(n_nationkey) AS k, ", ""))
def x14e(s, d):
    known = adapters.table(s, d, "nation").select(
        F.col("n_regionkey").alias("rank"), F.concat(F.lit("genome"), F.col("n_regionkey").cast("string")).alias("genome"), F.col("n_name").alias("name"),
        (1_000_000 + 10_000 * (F.col("n_nationkey") * 37 % 25) + F.when(F.col("n_regionkey") < 2, 1).otherwise(0)).cast("long").alias("length"),
    )
    sites = adapters.sites(s, d)
    cuts = sites.where("chr = 1").agg(F.count(F.lit(1)).alias("n"))
    key = F.col("n_nationkey")
    enzymes = adapters.table(s, d, "nation").join(F.broadcast(cuts)).select(  # one row
        F.concat(F.lit("genome"), F.col("n_regionkey").cast("string")).alias("genome"), (F.col("n") + key % 3).alias("n_sites"), key.alias("rank"), F.concat(F.lit("enzyme"), key.cast("string")).alias("enzyme"),
    )
    return chromosomes.infer_enzyme(adapters.genome(s, d), sites, known, enzymes)


@registered("s12_ordinals_by_arrival", """WITH e AS (SELECT o_orderkey AS t, 0 AS k, o_orderpriority AS name FROM orders UNION ALL SELECT o_orderkey, 1, o_orderstatus FROM orders),
 f AS (SELECT name, min(t * 2 + k) AS first FROM e GROUP BY name) SELECT name, CAST(row_number() OVER (ORDER BY first, name) AS INTEGER) AS ordinal FROM f""")  # fmt: skip
def s12(s, d):
    lines = adapters.table(s, d, "orders").select(F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("chr1"), F.col("o_orderstatus").alias("chr2"))
    return chromosomes.ordinals_by_arrival(lines, "at")


# Catalogs.
@registered("s37_catalog_table", "SELECT p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def s37(s, d):
    rows = adapters.table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return lists.parse_table(lists.table_lines(rows), "name\tbrand\tsize")


@registered("k18_catalog_lines", "SELECT p_name || chr(9) || p_brand || chr(9) || CAST(p_size AS VARCHAR) AS value FROM part")
def k18(s, d):
    return lists.table_lines(adapters.table(s, d, "part").select("p_name", "p_brand", "p_size"))


# Orders, as places within a chromosome.
def _placed(*order):
    return F.row_number().over(Window.partitionBy("chr").orderBy(*map(F.expr, order))).alias("place")


@registered("o01_cell_order", f"{BASE} SELECT chr1, chr2, bin_x, bin_y, CAST(row_number() OVER (PARTITION BY chr1, chr2 ORDER BY bin_x, bin_y) AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY chr1, chr2 ORDER BY bin_y, bin_x) AS INTEGER) AS write_place FROM cells")
def o01(s, d):
    placed = binning.place(written(_cells(s, d).drop("counts"), "cells"), "bin_x", "bin_y", "place")
    return binning.place(written(placed, "placed"), "bin_y", "bin_x", "write_place")


@registered("o02_feature_order", f"WITH {LOOPS} SELECT id, CAST(row_number() OVER (PARTITION BY chr ORDER BY start1, start2, end1, end2, id) AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY chr ORDER BY observed, id) AS INTEGER) AS by_observed FROM loops")
def o02(s, d):
    rows = adapters.loops(s, d)
    return rows.select("id", _placed(*lists.FEATURE_ORDER), _placed(*lists.OBSERVED_ORDER).alias("by_observed"))


@registered("o03_locus_order", f"WITH {LOCI} SELECT id, CAST(row_number() OVER (PARTITION BY chr ORDER BY x1, x2, id) AS INTEGER) AS place FROM loci")
def o03(s, d):
    rows = adapters.loci(s, d)
    return rows.select("id", _placed(*lists.LOCUS_ORDER))


@registered("o04_domain_order", f"WITH {LOOPS} SELECT id, CAST(row_number() OVER (PARTITION BY chr ORDER BY observed % 1000 + observed % 777 DESC, id) AS INTEGER) AS place FROM loops")
def o04(s, d):
    rows = adapters.loops(s, d).withColumns({"uVarScore": F.col("observed") % 1000, "lVarScore": F.col("observed") % 777})
    return rows.select("id", _placed(*lists.DOMAIN_ORDER))


# Set operations.
@registered("u05b_merged_layers", f"WITH {HALVES} SELECT chr, start1, end1, start2, end2, min(id) AS id FROM (SELECT * FROM la UNION ALL SELECT * FROM lb UNION ALL SELECT * FROM la WHERE id % 3 = 0) GROUP BY chr, start1, end1, start2, end2")
def u05b(s, d):
    a, b = _halves(s, d)
    return lists.merged_layers([a, b, a.where("id % 3 = 0")])


@registered("u05b_without_nearest", f"""WITH {HALVES}, r AS (SELECT a.id AS p, b.id, sqrt(power(a.start1 - b.start1, 2) + power(a.start2 - b.start2, 2)) AS far FROM la a JOIN lb b ON a.chr = b.chr WHERE sqrt(power(a.start1 - b.start1, 2) + power(a.start2 - b.start2, 2)) <= 3000),
 g AS (SELECT p, arg_min(id, struct_pack(a := far, b := id)) AS gone FROM r GROUP BY p) SELECT {PICK} FROM lb WHERE id NOT IN (SELECT gone FROM g)""")  # fmt: skip
def u05bn(s, d):
    a, b = _halves(s, d)
    return lists.without_nearest(b, a, 3000).select(*LOOP_COLS)


@registered("u06_ordered_difference", f"WITH {LOOPS} SELECT DISTINCT chr, start1, observed % 10 AS score FROM loops WHERE id % 2 = 0 EXCEPT SELECT chr, start1, observed % 10 FROM loops WHERE id % 2 = 1")
def u06(s, d):
    a, b = (x.select("chr", "start1", (F.col("observed") % 10).alias("score")) for x in _halves(s, d))
    return lists.set_difference(a, b)


_INTERVALS2 = f"{LOOPS}, w AS (SELECT id, chr, id * 700 + observed % 1500 AS x1, id * 700 + observed % 1500 + 300 + observed % 2000 AS x2 FROM loops), m AS (SELECT * FROM w WHERE id % 8 = 0), n AS (SELECT * FROM w WHERE id % 8 <> 0)"


@registered("u07_non_conflicting", f"""WITH RECURSIVE {_INTERVALS2}, open AS (SELECT * FROM n b WHERE NOT EXISTS (SELECT 1 FROM m a WHERE a.chr = b.chr AND (a.x1 BETWEEN b.x1 AND b.x2 OR a.x2 BETWEEN b.x1 AND b.x2))),
 e AS (SELECT b.id, a.id AS earlier FROM open a JOIN open b ON a.chr = b.chr AND a.id < b.id AND (a.x1 BETWEEN b.x1 AND b.x2 OR a.x2 BETWEEN b.x1 AND b.x2)),
 st AS (SELECT 0 AS round, id, 0 AS status FROM open UNION ALL SELECT any_value(s.round) + 1, s.id, CASE WHEN any_value(s.status) <> 0 THEN any_value(s.status) WHEN count(*) FILTER (t.status = 1) > 0 THEN 2
  WHEN count(*) FILTER (e.earlier IS NOT NULL AND t.status <> 2) = 0 THEN 1 ELSE 0 END FROM st s LEFT JOIN e ON e.id = s.id LEFT JOIN st t ON t.id = e.earlier WHERE s.round < 40 GROUP BY s.id)
 SELECT id FROM st WHERE round = 40 AND status = 1""")  # fmt: skip
def u07(s, d):
    x1 = F.col("id") * 700 + F.col("observed") % 1500
    w = adapters.loops(s, d).select("id", "chr", x1.alias("x1"), (x1 + 300 + F.col("observed") % 2000).alias("x2"))
    return lists.non_conflicting(w.where("id % 8 = 0"), w.where("id % 8 <> 0"))


@registered("u08_common_to_all", f"WITH {LOOPS} SELECT {PICK} FROM loops a WHERE observed % 3 = 0 AND EXISTS (SELECT 1 FROM loops b WHERE b.observed % 3 = 1 AND a.chr = b.chr AND {NEAR}) AND EXISTS (SELECT 1 FROM loops b WHERE b.observed % 3 = 2 AND a.chr = b.chr AND {NEAR})".replace("3000", "30000"))
def u08(s, d):
    rows = adapters.loops(s, d)
    return lists.common_to_all([rows.where(f"observed % 3 = {k}") for k in range(3)], 30_000).select(*LOOP_COLS)


@registered("j15_contained", f"WITH {HALVES} SELECT a.id, b.id AS b_id FROM la a JOIN lb b ON {OVERLAP} AND b.start1 <= a.start1 AND a.end1 <= b.end1 AND b.start2 <= a.start2 AND a.end2 <= b.end2")
def j15c(s, d):
    return lists.contained(*_halves(s, d)).select("id", "b_id")


_PLACES = f"{LOOPS}, p AS (SELECT chr, start1, start2, end1, end2 FROM loops WHERE observed % 3 = 0)"
for _keep, _name, _not in ((True, "j12_at_locations", ""), (False, "j13_not_at_locations", "NOT ")):
    registered(_name, f"WITH {_PLACES} SELECT {PICK} FROM loops a WHERE {_not}EXISTS (SELECT 1 FROM p b WHERE a.chr = b.chr AND a.start1 = b.start1 AND a.start2 = b.start2)")(
        lambda s, d, k=_keep: features.at_locations(adapters.loops(s, d), adapters.loops(s, d).where("observed % 3 = 0"), k).select(*LOOP_COLS)
    )

# Genes are longer than loci, so a locus is alone in a gene where genes are spread along chromosomes that grow with the table.
_SPREAD = f"{LOCI}, {GENES}, g AS (SELECT id, chr, id * 1500 AS x1, id * 1500 + 1000 AS x2 FROM genes), l AS (SELECT id, chr, id * 900 AS x1, id * 900 + x2 - x1 AS x2 FROM loci), hits AS (SELECT g.id AS g_id, l.* FROM g JOIN l ON g.chr = l.chr AND g.x1 <= l.x2 AND l.x1 <= g.x2)"
for _unique, _name, _having in ((True, "j08_alone_in_locus", "= 1"), (False, "j08_one_of_several", "> 1")):
    registered(_name, f"WITH {_SPREAD}, n AS (SELECT g_id FROM hits GROUP BY g_id HAVING count(*) {_having}) SELECT DISTINCT id, chr, x1, x2 FROM hits WHERE g_id IN (SELECT g_id FROM n)")(
        lambda s, d, u=_unique: intervals.in_locus(
            adapters.spread(adapters.genes(s, d).withColumn("id", F.col("gene_id")).withColumn("x2", F.col("x1") + 1000), 1500, "x1", "x2").select("id", "chr", "x1", "x2"),
            adapters.spread(adapters.loci(s, d), 900, "x1", "x2").select("id", "chr", "x1", "x2"), u,
        )
    )


@registered("j06_all_references", f"{INTERVALS} SELECT g_id AS id, chr, gx1 AS x1, gx2 AS x2, count(*) AS n_hits, string_agg(CAST(l_id AS VARCHAR), ',' ORDER BY l_id) AS hits FROM hits GROUP BY 1, 2, 3, 4")
def j06a(s, d):
    genes = adapters.genes(s, d).select(F.col("gene_id").alias("id"), "chr", "x1", "x2")
    return intervals.all_references(genes, adapters.loci(s, d).select("id", "chr", "x1", "x2"))


# Greedy joins.
@registered("a39_binned_scores", None)
def a39(s, d):
    at = adapters.loops(s, d).select(
        "id", "chr", F.floor(F.col("start1") / 1000).alias("i"), F.floor(F.col("start2") / 1000).alias("j"), (F.col("observed") / 1000).alias("score"),
        *((F.col("observed") % k / 1.0).alias(c) for k, c in ((7, "uVarScore"), (11, "lVarScore"), (13, "upSign"), (17, "loSign"))),
    )
    return _round(lists.binned_scores(at, 3), *lists.SCORES)


@registered("a40_triple_centroids", None)
def a40(s, d):
    t = adapters.loops(s, d).select("id", "chr", F.col("start1").alias("x1"), F.col("start2").alias("x2"), (F.col("start2") + 10_000 + F.col("observed") % 20_000).alias("x3"))
    return lists.triple_centroids(t, 1500)


# Feature lines.
@registered("s24_parse_bedpe", f"WITH {LOOPS} SELECT CAST(chr AS VARCHAR) AS chr1, start1, end1, CAST(chr AS VARCHAR) AS chr2, start2, end2, '0,0,255' AS color, CAST(observed AS VARCHAR) AS observed, status FROM loops")
def s24(s, d):
    dot = F.lit(".")
    lines = adapters.loops(s, d).select(F.concat_ws("\t", "chr", "start1", "end1", "chr", "start2", "end2", dot, dot, dot, dot, F.lit("0,0,255"), "observed", "status").alias("value"))
    f = text.parse_bedpe(lines, "#chr1\tx1\tx2\tchr2\ty1\ty2\tname\tscore\tstrand1\tstrand2\tcolor\to\tstatus")
    return f.select("chr1", "start1", "end1", "chr2", "start2", "end2", "color", F.col("attrs")["observed"].alias("observed"), F.col("attrs")["status"].alias("status"))


@registered("s24_parse_legacy_loops", f"WITH {LOOPS} SELECT CAST(chr AS VARCHAR) AS chr1, start1, end1, CAST(chr AS VARCHAR) AS chr2, start2, end2, '0,0,255' AS color, CAST(observed AS VARCHAR) AS observed FROM loops")
def s24l(s, d):
    lines = adapters.loops(s, d).select(F.concat_ws("\t", "chr", "start1", "end1", "chr", "start2", "end2", F.lit("0,0,255"), "observed").alias("value"))
    f = text.parse_bedpe(lines, "chr1\tx1\tx2\tchr2\ty1\ty2\tcolor\to")
    return f.select("chr1", "start1", "end1", "chr2", "start2", "end2", "color", F.col("attrs")["observed"].alias("observed"))


@registered("s24_parse_domains", f"WITH {LOOPS} SELECT CAST(chr AS VARCHAR) AS chr1, start1, end1, CAST(chr AS VARCHAR) AS chr2, start1 AS start2, end1 AS end2, CAST(observed AS VARCHAR) AS score FROM loops")
def s24d(s, d):
    lines = adapters.loops(s, d).select(F.concat_ws("\t", "chr", "start1", "end1", "observed").alias("value"))
    return text.parse_domains(lines, "chr\tx1\tx2\tscore").select("chr1", "start1", "end1", "chr2", "start2", "end2", F.col("attrs")["score"].alias("score"))


@registered("s02_read_text_pairs", f"WITH {PAIRS} SELECT strand1, CAST(chr1 AS VARCHAR) AS chr1, pos1, frag1, mapq1, strand2, CAST(chr2 AS VARCHAR) AS chr2, pos2, frag2, mapq2 FROM pairs")
def s02(s, d):
    from contactgrid.tables import new_path

    strand = lambda c: F.when(F.col(c), "0").otherwise("16")
    lines = _lines(s, d, "pair_id", strand("strand1"), "chr1", "pos1", "frag1", strand("strand2"), "chr2", "pos2", "frag2", "mapq1", "mapq2")
    path = new_path(s, "pairs-text")
    lines.write.option("compression", "gzip").text(path)
    return text.read_any_pairs(s, path).select("strand1", "chr1", "pos1", "frag1", "mapq1", "strand2", "chr2", "pos2", "frag2", "mapq2")


@registered("x19_site_rows", "WITH s AS (SELECT DISTINCT CAST(1 + p_partkey % 3 AS INTEGER) AS chr, p_partkey * 700 + 350 AS pos FROM part) SELECT chr, pos - 1 AS x1, pos AS x2, CAST(row_number() OVER (PARTITION BY chr ORDER BY pos) - 1 AS INTEGER) AS idx FROM s")
def x19(s, d):
    from contactgrid.operators import pairs

    return pairs.site_rows(adapters.sites(s, d))


_SITES = "sites AS (SELECT DISTINCT CAST(1 + p_partkey % 3 AS INTEGER) AS chr, p_partkey * 700 + 350 AS pos FROM part)"


@registered("j18_bed_to_fragments", f"""WITH {LOCI}, {_SITES} SELECT l.id, l.chr, l.x1, l.x2, CAST(count(s.pos) FILTER (s.pos <= l.x1) AS INTEGER) AS frag1, CAST(count(s.pos) FILTER (s.pos <= l.x2) AS INTEGER) AS frag2
 FROM loci l LEFT JOIN sites s ON s.chr = l.chr AND s.pos <= l.x2 GROUP BY l.id, l.chr, l.x1, l.x2""")  # fmt: skip
def j18(s, d):
    from contactgrid.operators import pairs

    return pairs.bed_to_fragments(adapters.loci(s, d).select("id", "chr", "x1", "x2"), adapters.sites(s, d))


_NEAREST = f"""{PAIRS}, {_SITES}, e AS (SELECT pair_id, l, e AS fin, strand, chr, pos FROM (SELECT pair_id, row_number() OVER () AS l, unnest([1, 2]) AS e, unnest([strand1, strand2]) AS strand, unnest([chr1, chr2]) AS chr, unnest([pos1, pos2]) AS pos FROM pairs)),
 b AS (SELECT e.*, p.pos AS prev FROM e ASOF LEFT JOIN sites p ON e.chr = p.chr AND e.pos >= p.pos), n AS (SELECT b.*, x.pos AS next FROM b ASOF LEFT JOIN sites x ON b.chr = x.chr AND b.pos < x.pos),
 w AS (SELECT *, pos - coalesce(prev, 0) AS d1, next - pos AS d2 FROM n WHERE next IS NOT NULL)"""


@registered("j19_site_ends", f"WITH {_NEAREST} SELECT CASE WHEN (d1 <= d2) = strand THEN '5p' ELSE '3p' END AS side, count(*) AS n FROM w GROUP BY 1")
def j19e(s, d):
    from contactgrid.operators import pairs

    return pairs.nearest_sites(_pairs(s, d), adapters.sites(s, d)).groupBy(F.col("side")).agg(F.count(F.lit(1)).alias("n"))


@registered("a20_site_histogram", f"WITH {_NEAREST} SELECT least(d1, d2) AS distance, count(*) AS n FROM w WHERE least(d1, d2) <= 2000 GROUP BY 1")
def a20s(s, d):
    from contactgrid.operators import pairs

    return pairs.nearest_sites(_pairs(s, d), adapters.sites(s, d)).where("distance <= 2000").groupBy("distance").agg(F.count(F.lit(1)).alias("n"))
