"""Registered queries on layouts of scaffolds, files that are read back, tails and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid import adapters
from contactgrid.functions import scalars
from contactgrid.operators import assembly, binning, expected, norm, pairs, query, stats
from contactgrid.plans.registry import BASE, COVERAGE, DENSITY, LOCI, LOOPS, PAIRS, SIZE, SIZES, _cells, _control, _pairs, _round, _sizes, _stored, cells_sql, registered
from contactgrid.sources import sinks, text
from contactgrid.tables import new_path

# Scaffolds of parts, twenty to a superscaffold; every other five of them turned, and in reverse order.
_SCAFFOLDS = """WITH sc AS (SELECT CAST(p_partkey + 1 AS INTEGER) AS id, 'scaffold' || p_partkey || CASE WHEN p_size % 5 = 0 THEN ':::fragment_1:::debris' ELSE '' END AS name, CAST(1000 + 37 * p_size AS BIGINT) AS length FROM part),
 signed AS (SELECT *, CASE WHEN (id // 5) % 2 = 1 THEN -id ELSE id END AS signed_id, 1000000000 + id // 20 AS super_id FROM sc),
 lay AS (SELECT id, name, length, signed_id, super_id, CAST(row_number() OVER (PARTITION BY super_id ORDER BY id // 5, signed_id) - 1 AS INTEGER) AS pos FROM signed),
 placed AS (SELECT *, coalesce(sum(length) OVER (ORDER BY super_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_start, signed_id < 0 AS inverted FROM lay)"""


def _assembly(s, d) -> tuple[DataFrame, DataFrame]:
    """The rows of an assembly file of parts."""
    id_ = (F.col("p_partkey") + 1).cast("int")
    name = F.concat(F.lit("scaffold"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 5 == 0, F.lit(":::fragment_1:::debris")).otherwise(F.lit("")))
    parts = adapters.table(s, d, "part").select(id_.alias("id"), name.alias("name"), (1000 + 37 * F.col("p_size")).alias("length"))
    heads = parts.select(F.col("id").cast("long").alias("line"), F.concat(F.lit(">"), F.concat_ws(" ", "name", "id", "length")).alias("value"))
    five = F.floor(F.col("id") / 5)
    signed = parts.select((10**9 + F.floor(F.col("id") / 20)).alias("line"), five.alias("five"), F.when(five % 2 == 1, -F.col("id")).otherwise(F.col("id")).alias("signed_id"))
    row = F.transform(F.sort_array(F.collect_list(F.struct("five", "signed_id"))), lambda x: x["signed_id"].cast("string"))
    return assembly.assembly_rows(heads.unionByName(signed.groupBy("line").agg(F.array_join(row, " ").alias("value"))))


@registered("s34_assembly_file", f"{_SCAFFOLDS} SELECT CAST(super_id AS BIGINT) AS super_id, pos, CAST(signed_id AS INTEGER) AS signed_id, name, length FROM lay")
def s34(s, d):
    scaffolds, layout = _assembly(s, d)
    return layout.withColumn("id", F.abs("signed_id")).join(scaffolds, "id").select("super_id", "pos", "signed_id", "name", "length")


@registered("k13_assembly_lines", f"""{_SCAFFOLDS} SELECT 0 AS part, CAST(id AS BIGINT) AS line, '>' || name || ' ' || id || ' ' || length AS value FROM sc
 UNION ALL SELECT 1, CAST(super_id AS BIGINT), string_agg(signed_id, ' ' ORDER BY pos) FROM lay GROUP BY super_id""")
def k13a(s, d):
    return assembly.assembly_lines(*_assembly(s, d))


@registered("c15_resolved_layout", f"{_SCAFFOLDS} SELECT id, CAST(super_id AS BIGINT) AS super_id, pos, CAST(new_start AS BIGINT) AS new_start, inverted, length FROM placed")
def c15(s, d):
    scaffolds, layout = _assembly(s, d)
    return assembly.resolve(scaffolds.select("id", "length"), layout)


@registered("c15_aggregates", f"""{_SCAFFOLDS}, l AS (SELECT *, lag(inverted) OVER w = inverted AND id - lag(id) OVER w = CASE WHEN inverted THEN -1 ELSE 1 END AS same FROM placed WINDOW w AS (PARTITION BY super_id ORDER BY pos)),
 r AS (SELECT *, sum(CASE WHEN coalesce(same, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY super_id ORDER BY pos) AS run FROM l)
 SELECT CAST(super_id AS BIGINT) AS super_id, CAST(run AS BIGINT) AS run, min(id) AS first_id, max(id) AS last_id, CAST(min(new_start) AS BIGINT) AS new_start, CAST(sum(length) AS BIGINT) AS length, any_value(inverted) AS inverted FROM r GROUP BY super_id, run""")  # fmt: skip
def c15a(s, d):
    scaffolds, layout = _assembly(s, d)
    return assembly.aggregates(assembly.resolve(scaffolds.select("id", "length"), layout))


@registered("x21_scaffold_names", f"{_SCAFFOLDS} SELECT id, contains(name, ':::debris') AS debris, split_part(name, ':::', 1) AS original FROM sc")
def x21(s, d):
    return _assembly(s, d)[0].select("id", scalars.is_debris(F.col("name")).alias("debris"), scalars.original_name(F.col("name")).alias("original"))


# Files of chromosomes, sites, intervals and vectors, read back.
@registered("s22_chromosome_file", "SELECT 'contig' || p_partkey AS name, CAST(1000 + p_size AS BIGINT) AS length, CAST(row_number() OVER (ORDER BY p_partkey DESC) AS INTEGER) AS chr FROM part")
def s22(s, d):
    """Chromosomes in the order of a file's lines."""
    t = adapters.table(s, d, "part")
    return text.parse_chrom_sizes(t.select((-F.col("p_partkey")).alias("line"), F.concat(F.lit("contig"), F.col("p_partkey").cast("string"), F.lit("\t"), (1000 + F.col("p_size")).cast("string")).alias("value")), "line")


@registered("s23_site_file", "SELECT 'chr' || (1 + p_partkey % 3) AS chr, CAST(row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) - 1 AS INTEGER) AS idx, CAST(p_partkey * 700 + 350 AS INTEGER) AS pos FROM part")
def s23(s, d):
    """A line a chromosome, with its sites."""
    sites = F.array_join(F.col("sites").cast("array<string>"), " ")
    return text.parse_sites(pairs.site_arrays(adapters.sites(s, d)).select(F.concat(F.lit("chr"), F.col("chr").cast("string"), F.lit(" "), sites).alias("value")))


@registered("s04_inferred_layouts", f"""WITH {PAIRS} SELECT v.layout AS layout, CAST(chr1 AS VARCHAR) AS chr1, pos1, CAST(chr2 AS VARCHAR) AS chr2, pos2 FROM pairs, (SELECT unnest(['short', 'super_short', 'dcic']) AS layout) v""")
def s04(s, d):
    """Pairs in three layouts, each read back by what its file's first lines show."""
    p, found = _pairs(s, d), None
    way = lambda e, yes, no: F.when(F.col(f"strand{e}"), F.lit(yes)).otherwise(F.lit(no))
    layouts = {
        "short": [way(1, "0", "16"), "chr1", "pos1", "frag1", way(2, "0", "16"), "chr2", "pos2", "frag2"],
        "super_short": ["chr1", "pos1", "chr2", "pos2"],
        "dcic": ["pair_id", "chr1", "pos1", "chr2", "pos2", way(1, "+", "-"), way(2, "+", "-")],
    }
    for name, columns in layouts.items():
        path = new_path(s, name)
        line = F.concat_ws("\t" if name == "dcic" else " ", *columns)
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of a partition, so of a file
        p.select(F.concat(F.when(first & F.lit(name == "dcic"), F.lit("## pairs format v1.0\n")).otherwise(F.lit("")), line).alias("value")).write.text(path)
        back = text.read_any_pairs(s, path).select(F.lit(name).alias("layout"), "chr1", "pos1", "chr2", "pos2")
        found = back if found is None else found.unionByName(back)
    return found


@registered("f14_region_strings", f"WITH {LOOPS} SELECT id, 'chr' || chr AS chr, start1 AS x1, end2 AS x2 FROM loops UNION ALL SELECT -1 - id, 'chr' || chr, -1, -1 FROM loops")
def f14(s, d):
    """Loops' regions, and their chromosomes alone, which have no places (-1), written as strings and read."""
    t = adapters.loops(s, d)
    name, digits = F.concat(F.lit("chr"), F.col("chr").cast("string")), lambda c: F.format_number(F.col(c), 0)
    both = t.select("id", F.concat(name, F.lit(":"), digits("start1"), F.when(F.col("id") % 2 == 0, "-").otherwise(":"), digits("end2"), F.lit(" ")).alias("value"))
    return both.unionByName(t.select(-1 - F.col("id"), name.alias("value")).toDF("id", "value")).select("id", query.regions(F.col("value")).alias("r")).select("id", "r.*").fillna(-1, ["x1", "x2"])


@registered("f07_thinned_sums", f"{BASE} SELECT chr1, chr2, sum(counts) AS total, TRUE AS in_bounds, TRUE AS near_half FROM cells GROUP BY chr1, chr2")
def f07s(s, d):
    """Of each pair of chromosomes, whether all thinned cells hold whole counts, none more than before, and their sum is within six deviations of half."""
    cells = _stored(s, d)
    key = ["chr1", "chr2", "bin_x", "bin_y"]
    both = cells.join(binning.thin(cells, 0.5).withColumnRenamed("counts", "kept"), key, "left").fillna(0.0, ["kept"])
    fine = (F.col("kept") >= 0) & (F.col("kept") <= F.col("counts")) & (F.col("kept") == F.floor("kept"))
    near = F.abs(F.sum("kept") - F.sum("counts") / 2) <= 6 * F.sqrt(F.sum("counts") / 4)
    return both.groupBy("chr1", "chr2").agg(F.sum("counts").alias("total"), F.bool_and(fine).alias("in_bounds"), near.alias("near_half"))


@registered("f06_subsample_shares", f"WITH {PAIRS} SELECT chr1, chr2, count(*) AS total, TRUE AS near_share, TRUE AS nested FROM pairs GROUP BY chr1, chr2")
def f06(s, d):
    """Of each two chromosomes, whether three tenths of the orders give about as many pairs, in whole orders, and a tenth lies inside them."""
    p = _pairs(s, d)
    small, large = (pairs.subsample(p.select("pair_id").distinct(), share, 5, "pair_id").withColumn(name, F.lit(True)) for share, name in ((0.1, "small"), (0.3, "large")))
    both = p.join(small, "pair_id", "left").join(large, "pair_id", "left").fillna(False, ["small", "large"])
    taken = F.count_if("large")
    near = F.abs(taken - 0.3 * F.count(F.lit(1))) <= 6 * F.sqrt(7 * 0.21 * F.count(F.lit(1)))  # an order has seven pairs at most
    return both.groupBy("chr1", "chr2").agg(F.count(F.lit(1)).alias("total"), near.alias("near_share"), F.bool_and(~F.col("small") | F.col("large")).alias("nested"))


@registered("k09_bed_export", f"WITH {LOCI} SELECT DISTINCT 'chr' || chr AS chr, x1, x2 FROM loci")
def k09(s, d):
    path = new_path(s, "bed")
    sinks.write_bed(adapters.loci(s, d).withColumn("chr", F.concat(F.lit("chr"), F.col("chr").cast("string"))), path)
    return text.parse_bed(s.read.text(path)).select("chr", "x1", "x2")


@registered("k14_appended_vectors", f"""{BASE}, {COVERAGE} SELECT 'SUM' AS norm, 'BP' AS unit, {SIZE} AS bin_size, chr, bin, value FROM coverage
 UNION ALL SELECT 'ROOT', 'BP', {SIZE}, chr, bin, round(sqrt(value), 6) FROM coverage""")
def k14(s, d):
    """Two vectors appended to one store, one after the other."""
    path, sums = new_path(s, "vectors"), norm.coverage(_stored(s, d))
    for name, value in (("SUM", F.col("value")), ("ROOT", F.round(F.sqrt("value"), 6))):
        sinks.append_vectors(sums.select(F.lit(name).alias("norm"), F.lit("BP").alias("unit"), F.lit(SIZE).alias("bin_size"), "chr", "bin", value.alias("value")), path)
    return s.read.parquet(path)


# Expected values, tails, libraries, blocks and numbers.
@registered("a17_combined_expected", f"""{BASE}, half AS (SELECT * FROM pairs WHERE pair_id % 2 = 0), {cells_sql(SIZE, "control", "half")}, {DENSITY},
 other AS (SELECT bin_y - bin_x AS dist, sum(counts) AS observed FROM control WHERE chr1 = chr2 GROUP BY 1)
 SELECT p.dist, round((coalesce(a.observed, 0) + coalesce(b.observed, 0)) / possible, 6) AS value FROM possible p LEFT JOIN seen a ON a.dist = p.dist LEFT JOIN other b ON b.dist = p.dist""")  # fmt: skip
def a17(s, d):
    """The expected values of a map and of its control, as one function."""
    sizes = _sizes(s, d)
    return _round(expected.combine(*(expected.raw_density(c, sizes, SIZE) for c in (_cells(s, d), _control(s, d)))), "value")


@registered("a23_library_sizes", """WITH RECURSIVE g AS (SELECT l_suppkey AS library, CAST(count(*) FILTER (l_returnflag <> 'R') AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1),
 b AS (SELECT library, c, n, c AS low, c * 1e6 AS high, 0 AS k FROM g WHERE c > 0 AND n > c
  UNION ALL SELECT library, c, n, CASE WHEN c / x - 1 + exp(-n / x) > 0 THEN x ELSE low END, CASE WHEN c / x - 1 + exp(-n / x) > 0 THEN high ELSE x END, k + 1 FROM (SELECT *, (low + high) / 2 AS x FROM b WHERE k < 90))
 SELECT g.library, round(coalesce((low + high) / 2, 0), 3) AS size FROM g LEFT JOIN b ON b.library = g.library AND b.k = 90""")
def a23(s, d):
    """Of each supplier's reads, of which those returned are duplicates, how many molecules there are."""
    again = F.col("l_returnflag") == "R"
    counts = adapters.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("library")).agg(F.count_if(~again).alias("unique"), F.count_if(again).alias("again"))
    return _round(counts.select("library", scalars.library_size_of("unique", "again").alias("size")), "size", places=3)


@registered("a26_merged_arrays", """SELECT CAST(l_suppkey AS VARCHAR) AS name, k.idx AS idx, CAST(sum(CASE k.idx WHEN 0 THEN l_linenumber WHEN 1 THEN CAST(l_quantity AS BIGINT) ELSE l_partkey END) AS BIGINT) AS value
 FROM lineitem, (SELECT unnest([0, 1, 2]) AS idx) k GROUP BY 1, 2""")
def a26(s, d):
    arr = F.array(F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long"), F.col("l_partkey").cast("long"))
    return stats.merge_arrays(adapters.table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("name"), arr.alias("arr")))


@registered("x02_block_numbers", f"""{BASE} SELECT chr1, chr2, bin_x, bin_y, CAST(CASE WHEN chr1 = chr2 THEN floor(log2(1 + abs(bin_x - bin_y) / sqrt(2) / 5)) * 10 + ((bin_x + bin_y) // 2) // 5
 ELSE (bin_y // 5) * 10 + bin_x // 5 END AS BIGINT) AS block FROM cells""")
def x02(s, d):
    return _cells(s, d).select("chr1", "chr2", "bin_x", "bin_y", scalars.block_number(F.col("bin_x"), F.col("bin_y"), F.col("chr1") == F.col("chr2"), 10, 5).alias("block"))


@registered("x06_poisson_tails", f"""{BASE}, {DENSITY} SELECT chr1, bin_x, bin_y, round(greatest(1 - list_sum(list_transform(range(CAST(counts AS BIGINT)), lambda k: exp(k * ln(value) - value - lgamma(k + 1)))), 0), 6) AS p
 FROM cells JOIN density ON dist = bin_y - bin_x WHERE chr1 = chr2""")
def x06(s, d):
    """How likely as many contacts as each cell has, or more, are at its distance."""
    cells = _stored(s, d)
    near = cells.where("chr1 = chr2").withColumn("dist", F.col("bin_y") - F.col("bin_x")).join(expected.raw_density(cells, _sizes(s, d), SIZE), "dist")
    return _round(near.select("chr1", "bin_x", "bin_y", scalars.poisson_upper("counts", "value").alias("p")), "p")


@registered("x15_grouped_digits", f"WITH {PAIRS}, {SIZES} SELECT pair_id, pos2, format('{{:,}}', CAST(pos2 AS BIGINT) * pos1) AS shown FROM pairs")
def x15(s, d):
    return adapters.pairs(s, d).select("pair_id", "pos2", scalars.commify(F.col("pos2").cast("long") * F.col("pos1")).alias("shown"))
