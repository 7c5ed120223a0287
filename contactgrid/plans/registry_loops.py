"""Registered queries on loops that are called, scored and compared over several resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid import adapters
from contactgrid.operators import binning, expected, loops
from contactgrid.plans.registry import _round, cells_sql, registered
from contactgrid.tables import written

PLANTED = """planted AS (SELECT *, CAST(1 + site % 3 AS INTEGER) AS chr, CASE WHEN looped THEN start + 100000 + a % 3750 + b % 3750 ELSE start + a % 500000 END AS spot FROM (SELECT *, (site // 3) * 500000 AS start,
 n = 1 AND o % 5 = 0 AND (site % 4 <> 3 OR o % 20 = 0) AS looped FROM (SELECT l_orderkey AS o, l_linenumber AS n, l_orderkey // 750 AS site, (l_orderkey * 48271 + l_linenumber * 16807 + l_partkey * 69621) % 1000003 AS a,
 (l_suppkey * 40692 + l_orderkey * 30269 + l_linenumber * 52774 + l_partkey * 7) % 1000033 AS b FROM lineitem))),
 pairs AS (SELECT chr AS chr1, chr AS chr2, CAST(spot AS INTEGER) AS pos1, CAST(CASE WHEN looped THEN start + 300000 + (a * 13 + b * 7) % 3750 + (a * 5 + b * 11) % 3750 ELSE spot + (b % 1000) * (a // 3 % 400) END AS INTEGER) AS pos2,
 CAST(1 AS DOUBLE) AS score FROM planted), sizes AS (SELECT unnest([1, 2, 3]) AS chr, length FROM (SELECT CAST(max(greatest(pos1, pos2)) + 1 AS BIGINT) AS length FROM pairs))"""


def _at_size(size: int) -> str:
    """Of one resolution: cells, their square root coverage vector, mean normalized counts by distance, and the expected counts of the four masks by plain sums over the windows' cells."""
    p, w, _ = loops.SETTINGS[size]
    k = size // 1000
    cells = cells_sql(size, f"cells{k}")
    return f"""{cells}, sides{k} AS (SELECT chr1 AS chr, bin_x AS bin, bin_y AS other, counts FROM cells{k} UNION ALL SELECT chr1, bin_y, bin_x, counts FROM cells{k} WHERE bin_x <> bin_y),
 raw{k} AS (SELECT chr, bin, sqrt(sum(counts)) AS value FROM sides{k} GROUP BY chr, bin), fac{k} AS (SELECT s.chr, sqrt(sum(s.counts / (x.value * y.value)) / sum(s.counts)) AS factor FROM sides{k} s JOIN raw{k} x ON s.chr = x.chr AND s.bin = x.bin
  JOIN raw{k} y ON s.chr = y.chr AND s.other = y.bin GROUP BY s.chr), vec{k} AS (SELECT r.chr, bin, value * factor AS value FROM raw{k} r JOIN fac{k} f ON r.chr = f.chr),
 c{k} AS MATERIALIZED (SELECT s.chr, s.bin AS i, s.other AS j, s.counts, x.value AS nx, y.value AS ny, s.counts / (x.value * y.value) AS c FROM sides{k} s JOIN vec{k} x ON s.chr = x.chr AND s.bin = x.bin JOIN vec{k} y ON s.chr = y.chr AND s.other = y.bin),
 dens{k} AS MATERIALIZED (SELECT q.dist, coalesce(observed, 0) / possible AS d FROM (SELECT dist, sum(n - dist) AS possible FROM (SELECT n, unnest(range(n)) AS dist FROM (SELECT length // {size} AS n FROM sizes)) GROUP BY dist) q
  LEFT JOIN (SELECT j - i AS dist, sum(c) AS observed FROM c{k} WHERE i <= j GROUP BY 1) o ON o.dist = q.dist),
 px{k} AS MATERIALIZED (SELECT *, j - i AS t, least(greatest(least({w}, (j - i - 1) // 2), {p + 1}), 20) AS win FROM c{k} WHERE j - i > {p + 2}), dist{k} AS (SELECT DISTINCT t, win FROM px{k}),
 off{k} AS (SELECT di, dj FROM range(-20, 21) x(di), range(-20, 21) y(dj)),
 kinds{k} AS MATERIALIZED (SELECT t, win, di, dj, di BETWEEN -win AND win AND dj BETWEEN -win AND win AND NOT (di BETWEEN -{p} AND {p} AND dj BETWEEN -{p} AND {p}) AND di <> 0 AND dj <> 0 AS donut,
  abs(di) > {p} AND abs(di) <= win AND abs(dj) <= 1 AS v, abs(dj) > {p} AND abs(dj) <= win AND abs(di) <= 1 AS h, di >= 1 AND dj <= -1 AND NOT (di <= {p} AND dj >= -{p}) AS bl, greatest(di, -dj) AS ring FROM dist{k}, off{k}
  WHERE (abs(di) <= win AND abs(dj) <= win) OR (di >= 1 AND dj <= -1)),
 dd{k} AS MATERIALIZED (SELECT t, sum(d) FILTER (donut) AS donut, sum(d) FILTER (v) AS v, sum(d) FILTER (h) AS h FROM kinds{k} LEFT JOIN dens{k} ON dist = abs(t + dj - di) GROUP BY t),
 dr{k} AS (SELECT t, ring, sum(coalesce(d, 0)) AS d FROM kinds{k} LEFT JOIN dens{k} ON dist = abs(t + dj - di) WHERE bl GROUP BY t, ring),
 hit{k} AS MATERIALIZED (SELECT px.chr, px.i, px.j, o.donut, o.v, o.h, o.bl, o.ring, c.c FROM px{k} px JOIN kinds{k} o ON o.t = px.t JOIN c{k} c ON c.chr = px.chr AND c.i = px.i + o.di AND c.j = px.j + o.dj),
 cc{k} AS (SELECT chr, i, j, sum(c) FILTER (donut) AS donut, sum(c) FILTER (v) AS v, sum(c) FILTER (h) AS h FROM hit{k} GROUP BY chr, i, j), cr{k} AS (SELECT chr, i, j, ring, sum(c) AS c FROM hit{k} WHERE bl GROUP BY chr, i, j, ring),
 br{k} AS (SELECT px.chr, px.i, px.j, px.t, win, dr.ring, sum(coalesce(cr.c, 0)) OVER u AS bc, sum(dr.d) OVER u AS bd FROM px{k} px JOIN dr{k} dr ON dr.t = px.t LEFT JOIN cr{k} cr ON cr.chr = px.chr AND cr.i = px.i AND cr.j = px.j AND cr.ring = dr.ring
  WINDOW u AS (PARTITION BY px.chr, px.i, px.j ORDER BY dr.ring)),
 bl{k} AS (SELECT * FROM br{k} WHERE ring >= win AND (bc >= 16 OR ring = 20 OR 2 * (ring + 1) >= t) QUALIFY row_number() OVER (PARTITION BY chr, i, j ORDER BY ring) = 1),
 m{k} AS MATERIALIZED (SELECT {size} AS bin_size, px.chr, px.i AS bin_x, px.j AS bin_y, round(px.counts) AS observed, bc / nullif(bd, 0) * e AS "expectedBL", cc.donut / nullif(dd.donut, 0) * e AS "expectedDonut", cc.h / nullif(dd.h, 0) * e AS "expectedH", cc.v / nullif(dd.v, 0) * e AS "expectedV"
  FROM (SELECT px.*, d * nx * ny AS e FROM px{k} px JOIN dens{k} ON dist = t) px JOIN bl{k} b ON b.chr = px.chr AND b.i = px.i AND b.j = px.j JOIN cc{k} cc ON cc.chr = px.chr AND cc.i = px.i AND cc.j = px.j JOIN dd{k} dd ON dd.t = px.t)"""


SIZES = sorted(loops.SETTINGS)
_EXPECTED = [f"expected{m}" for m in loops.MASKS]
_FULL = " AND ".join(f'"{e}" > 1e-9' for e in _EXPECTED)
MASKED = f"WITH {PLANTED}, " + ", ".join(map(_at_size, SIZES)) + ", masked AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM m{s // 1000}" for s in SIZES) + f"), told AS MATERIALIZED (SELECT * FROM masked WHERE {_FULL})"


def _bin_sql(e: str) -> str:
    return f"CASE WHEN {e} <= 1 THEN 0 ELSE least(floor(ln({e}) / ln(power(2, 0.33))), 39) END"


# a Poisson tail as one less the terms below, of counts up to a few hundred
_TAIL = "1 - coalesce(list_sum(list_transform(range(CAST(o AS BIGINT)), lambda k: exp(k * ln(lam) - lam - lgamma(k + 1)))), 0)"
ENRICHED = f"""{MASKED}, long AS MATERIALIZED (SELECT told.*, mask, CAST({_bin_sql('e')} AS INTEGER) AS bin FROM (SELECT told.*, unnest({list(loops.MASKS)}) AS mask, unnest([{', '.join(f'"{e}"' for e in _EXPECTED)}]) AS e FROM told) told),
 counted AS (SELECT bin_size, mask, bin, observed AS o, count(*) AS n, power(2, (bin + 1) / 3) AS lam FROM long GROUP BY ALL),
 summed AS (SELECT *, sum(n) OVER (PARTITION BY bin_size, mask, bin ORDER BY o DESC) AS seen, sum(n) OVER (PARTITION BY bin_size, mask, bin) AS total FROM counted),
 rated AS MATERIALIZED (SELECT *, total * ({_TAIL}) / seen AS rate FROM summed), least_ AS (SELECT bin_size, mask, bin, min(o) AS least FROM rated WHERE o > 0 AND rate <= 0.1 GROUP BY ALL),
 passed AS (SELECT long.*, rate FROM long JOIN least_ l ON l.bin_size = long.bin_size AND l.mask = long.mask AND l.bin = long.bin AND observed >= least
  JOIN rated r ON r.bin_size = long.bin_size AND r.mask = long.mask AND r.bin = long.bin AND r.o = observed),
 enriched AS (SELECT bin_size, chr, bin_x, bin_y, any_value(observed) AS observed, sum(rate) AS fdr_sum FROM passed GROUP BY bin_size, chr, bin_x, bin_y HAVING count(*) = 4),
 bins AS (SELECT bin_size, chr, unnest(range(length // bin_size + 1)) AS bin FROM sizes, (SELECT unnest({SIZES}) AS bin_size)),
 have AS ({" UNION ALL ".join(f"SELECT {s} AS bin_size, chr, bin FROM vec{s // 1000}" for s in SIZES)}),
 missing AS (SELECT DISTINCT b.bin_size, b.chr, b.bin + g AS bin FROM bins b LEFT JOIN have h ON h.bin_size = b.bin_size AND h.chr = b.chr AND h.bin = b.bin, range(-5, 6) r(g) WHERE h.bin IS NULL)
 SELECT e.* REPLACE (CAST(bin_size AS INTEGER) AS bin_size, round(fdr_sum, 6) AS fdr_sum) FROM enriched e WHERE NOT EXISTS (SELECT 1 FROM missing m WHERE m.bin_size = e.bin_size AND m.chr = e.chr AND (m.bin = e.bin_x OR m.bin = e.bin_y))"""


def planted_cells(s, d, sizes=tuple(SIZES)) -> DataFrame:
    return written(binning.bin_contacts(adapters.loop_pairs(s, d), sizes).drop("unit"), "planted-cells")


def _planted_map(s, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cells, the same with norms, vectors, mean counts by distance, and bins without a norm, of all resolutions of the planted map."""
    cells, sizes = planted_cells(s, d), adapters.chrom_sizes(adapters.loop_pairs(s, d))
    return cells, *loops.normed_maps(cells, sizes, SIZES, expected.raw_density)


@registered("c01k_masks", f"{MASKED} SELECT CAST(bin_size AS INTEGER) AS bin_size, chr, bin_x, bin_y, observed, {', '.join(f'round({chr(34)}{e}{chr(34)}, 5) AS {chr(34)}{e}{chr(34)}' for e in _EXPECTED)} FROM told")
def c01k(s, d):
    _, cells, vector, density, _ = _planted_map(s, d)
    return _round(loops.pixels(cells, vector, density).select("bin_size", "chr", "bin_x", "bin_y", "observed", *_EXPECTED), *_EXPECTED, places=5)


@registered("c01e_enriched_pixels", ENRICHED)
def c01e(s, d):
    """Pixels of three resolutions that pass in all masks, clear of bins without a norm, before they are joined to centroids."""
    _, cells, vector, density, missing = _planted_map(s, d)
    p = written(loops.pixels(cells, vector, density), "pixels")
    found = loops.clear_of_missing(loops.enriched(p, written(loops.thresholds(p), "rates")), missing)
    total = F.aggregate(F.array(*(F.col(f"fdr{m}") for m in loops.MASKS)), F.lit(0.0), lambda a, x: a + x)
    return found.select("bin_size", "chr", "bin_x", "bin_y", "observed", F.round(total, 6).alias("fdr_sum"))


_LOOP = ["bin_size", "chr", "start1", "end1", "start2", "end2", "observed", *_EXPECTED, "numCollapsed"]


# What joins pixels to centroids is greedy: the tests hold it against brute force.
@registered("c01_loops", None)
def c01(s, d):
    return loops.call_loops_at(planted_cells(s, d), adapters.chrom_sizes(adapters.loop_pairs(s, d))).select(*_LOOP)


@registered("c02_loops_by_p", None)
def c02(s, d):
    cells, sizes = planted_cells(s, d), adapters.chrom_sizes(adapters.loop_pairs(s, d))
    cells, vector, density, missing = loops.normed_maps(cells, sizes, SIZES)
    return loops.call_loops_by_p(cells, vector, density, settings=loops.SETTINGS, missing=missing).select(*_LOOP)


def _given(s, d) -> DataFrame:
    """Loops to be scored: those of orders, each moved to a 25 kb place of its own on the planted map."""
    place = F.floor(F.col("id") / 750) * 500_000 + (F.col("id") % 20) * 25_000
    far = (1 + F.col("id") % 12) * 25_000
    ends = {"start1": place, "end1": place + 25_000, "start2": place + far, "end2": place + far + 25_000}
    return adapters.loops(s, d).select("id", "chr", "observed").withColumns({c: F.floor(v).cast("long") for c, v in ends.items()})


_SCORED = f"""{MASKED}, given AS (SELECT o_orderkey AS id, CAST(1 + o_orderkey % 3 AS INTEGER) AS chr, (o_orderkey // 750 * 500000 + o_orderkey % 20 * 25000) // 25000 AS x,
 (o_orderkey // 750 * 500000 + o_orderkey % 20 * 25000 + (1 + o_orderkey % 12) * 25000) // 25000 AS y FROM orders)
 SELECT id, observed, {', '.join(f'round({chr(34)}{e}{chr(34)}, 5) AS {chr(34)}{e}{chr(34)}' for e in _EXPECTED)} FROM given JOIN told ON told.bin_size = 25000 AND told.chr = given.chr AND bin_x = x AND bin_y = y"""


@registered("c03_loop_scores_at_counts", _SCORED)
def c03s(s, d):
    """Given loops where the map has counts; c03_loop_scores has the others as well."""
    found = c03(s, d)
    return found.where("observed > 0").select("id", "observed", *_EXPECTED)


@registered("c03_loop_scores", None)
def c03(s, d):
    cells, _, vector, density, _ = _planted_map(s, d)
    of = lambda df: df.where("bin_size = 25000").drop("bin_size")
    found = loops.score_loops(_given(s, d), of(cells), of(vector), of(density), 25_000)
    return _round(found.select("id", "observed", *_EXPECTED), *_EXPECTED, places=5)


@registered("c04_differential_loops", None)
def c04d(s, d):
    """Loops of the planted map that a map of its other pairs doesn't have, neither near by nor enriched, and the other way round."""
    at = adapters.loop_pairs(s, d)
    sizes = adapters.chrom_sizes(at)
    # the second map lacks the loops of every other site
    lost = (F.floor(F.col("pos1") / 500_000) % 2 == 0) & (F.col("pos1") % 500_000).between(100_000, 107_500) & (F.col("pos2") % 500_000).between(300_000, 307_500)
    maps, found = [], []
    for pairs_ in (at, at.where(~lost)):
        cells = written(binning.bin_contacts(pairs_, [10_000]).drop("unit"), "map-cells")
        met, vector, density, missing = loops.normed_maps(cells, sizes, [10_000])
        settings = {10_000: loops.SETTINGS[10_000]}
        found.append(written(loops.call_loops(met, vector, density, settings=settings, missing=missing), "map-loops"))
        maps.append(tuple(m.drop("bin_size") for m in (cells, vector, density)))
    return loops.differential_loops(*found, *maps, 10_000).select("only_in", "chr", "start1", "end1", "start2", "end2")
