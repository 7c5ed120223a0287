"""Loop calling by tiles (C01), its masks, thresholds, clustering and merge of resolutions (A38, F21, C01m), and loop differences."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactgrid.functions.scalars import poisson_upper
from contactgrid.operators import expected, features
from contactgrid.tables import counted, written

MASKS = ("BL", "Donut", "H", "V")
#: Peak width, window and clustering radius by bin size.
SETTINGS = {5_000: (4, 7, 20_000), 10_000: (2, 5, 20_000), 25_000: (1, 3, 50_000)}
LAMBDA_BINS, MARGIN = 40, 20
#: Tiles that are solved at once; gaps whose expected values a task keeps; bands of expected values, of some 850 distances each, up to which they are broadcast.
TILES, EXPECTED_KEPT, MOST_BANDS = 16, 64, 2_000
#: Bases in which islands of pixels begin that are joined to centroids in one group.
ISLANDS_STRETCH = 1 << 22


def _sums(m: np.ndarray) -> np.ndarray:
    """Sums over all rows and columns before, of each square of a stack."""
    out = np.zeros((m.shape[0], m.shape[1] + 1, m.shape[2] + 1))
    np.cumsum(m, 1, out=out[:, 1:, 1:])
    np.cumsum(out[:, 1:, 1:], 2, out=out[:, 1:, 1:])
    return out


def _box(s: np.ndarray, t: np.ndarray, i0, i1, j0, j1) -> np.ndarray:
    """Sums over rows i0..i1 and columns j0..j1 of the squares t, both ends included, clipped to the square; empty boxes are 0."""
    n = s.shape[1] - 1
    i0, j0 = (np.minimum(np.maximum(v, 0), n) for v in (i0, j0))
    i1, j1 = (np.minimum(np.maximum(v + 1, 0), n) for v in (i1, j1))
    flat, first, last = s.ravel(), (t * (n + 1) + i0) * (n + 1), (t * (n + 1) + i1) * (n + 1)
    return np.where((i1 > i0) & (j1 > j0), flat[last + j1] - flat[first + j1] - flat[last + j0] + flat[first + j0], 0.0)


def mask_expected(sc: np.ndarray, sd: np.ndarray, t: np.ndarray, g: np.ndarray, i: np.ndarray, j: np.ndarray, dist: np.ndarray, p: int, w: int) -> dict[str, np.ndarray]:
    """For cells (i, j) of tiles t, at ``dist`` from the diagonal, the ratio of normalized to expected counts over each mask, from summed-area tables: of the tiles (sc), and of the expected values (sd, that of a cell is g).

    Donut: the square of radius w without that of p and the cross between; BL: the lower left quarter of both, grown until it
    holds 16 counts; H and V: arms of three. Windows shrink with the distance from the diagonal.
    """
    win = np.minimum(np.maximum(np.minimum(w, (dist - 1) // 2), p + 1), MARGIN)

    def over(boxes) -> tuple[np.ndarray, np.ndarray]:
        return sum(s * _box(sc, t, *b) for s, *b in boxes), sum(s * _box(sd, g, *b) for s, *b in boxes)

    def quarter(s, k, i, j, v):
        return _box(s, k, i + 1, i + v, j - v, j - 1) - _box(s, k, i + 1, i + p, j - p, j - 1)

    # a quarter holds more the wider it is: most never hold 16, for the others the first that does is searched
    low, grown = win.copy(), np.maximum(win, np.minimum(MARGIN, (np.maximum(dist, 1) - 1) // 2))
    at = np.flatnonzero((quarter(sc, t, i, j, grown) >= 16) & (low < grown))
    while len(at):
        middle = (low[at] + grown[at]) // 2
        holds = quarter(sc, t[at], i[at], j[at], middle) >= 16
        grown[at[holds]], low[at[~holds]] = middle[holds], middle[~holds] + 1
        at = at[low[at] < grown[at]]
    bl = quarter(sc, t, i, j, grown), quarter(sd, g, i, j, grown)
    arms_v = [(1, i - win, i - p - 1, j - 1, j + 1), (1, i + p + 1, i + win, j - 1, j + 1)]
    arms_h = [(1, i - 1, i + 1, j - win, j - p - 1), (1, i - 1, i + 1, j + p + 1, j + win)]
    thin = [(-1, i - win, i - p - 1, j, j), (-1, i + p + 1, i + win, j, j), (-1, i, i, j - win, j - p - 1), (-1, i, i, j + p + 1, j + win)]
    donut = over([(1, i - win, i + win, j - win, j + win), (-1, i - p, i + p, j - p, j + p), *thin])
    sums = {"BL": bl, "Donut": donut, "H": over(arms_h), "V": over(arms_v)}
    with np.errstate(divide="ignore", invalid="ignore"):
        return {k: np.where(b > 0, a / b, np.nan) for k, (a, b) in sums.items()}


PIXEL = "bin_size int, chr int, bin_x int, bin_y int, observed double, " + ", ".join(f"expected{m} double, bin{m} int" for m in MASKS)
PIXEL_COLUMNS = [c.split()[0] for c in PIXEL.split(", ")]
Settings = dict[int, tuple[int, int, int]]


def _sized(df: DataFrame, bin_size: int | None) -> DataFrame:
    return df if "bin_size" in df.columns else df.withColumn("bin_size", F.lit(bin_size))


def _settings(bin_size: int | None, settings: tuple[int, int, int] | Settings | None) -> Settings:
    if isinstance(settings, dict):
        return settings
    return SETTINGS if settings is None else {bin_size: settings}


def pixels(cells: DataFrame, vector: DataFrame, density: DataFrame, bin_size: int | None = None, core: int = 256, settings: tuple[int, int, int] | Settings | None = None) -> DataFrame:
    """C01k: occupied cells off the diagonal with their expected raw counts under the four masks, by tiles with margins.

    Each cell goes to the tiles whose core or margin holds it, at most four; a tile is a bounded dense square, a run of sorted rows and then one row,
    so no chromosome is in one task. Its norm values come by equi-joins, unless cells have them already (nx, ny: see normed()), its expected values with the tile. Cells, vectors and expected
    values of several resolutions, each row with its bin_size, take one plan; those without that column are of ``bin_size``. A pixel of which a mask expects nothing, or can't tell, is left out.
    """
    known = {size: (p, w) for size, (p, w, _) in _settings(bin_size, settings).items()}
    cells, vector, density = _sized(cells, bin_size), _sized(vector, bin_size), _sized(density, bin_size)
    if "nx" not in cells.columns:
        cells = normed(cells, vector)
    lower, upper = F.least("bin_x", "bin_y"), F.greatest("bin_x", "bin_y")
    turned = F.col("bin_x") > F.col("bin_y")
    c = cells.where("nx > 0 and ny > 0").select("bin_size", "chr", lower.alias("bin_x"), upper.alias("bin_y"), "counts", F.when(turned, F.col("ny")).otherwise(F.col("nx")).alias("nx"), F.when(turned, F.col("nx")).otherwise(F.col("ny")).alias("ny"))
    tiles = lambda b: F.explode(F.sequence(F.floor((F.col(b) - MARGIN) / core).cast("int"), F.floor((F.col(b) + MARGIN) / core).cast("int")))
    # a tile that holds the cell's place on the other side of the diagonal holds its own as well
    dealt = c.withColumn("tx", tiles("bin_x")).withColumn("ty", tiles("bin_y")).where("ty >= tx and tx >= 0")
    dealt = dealt.repartition("bin_size", "chr", "tx", "ty").sortWithinPartitions("tx", "ty", "chr", "bin_size").select(*_TILE_KEY, *_TILE_CELLS)
    packed = dealt.mapInArrow(_packed, _TILE).withColumn("gap", F.col("ty") - F.col("tx"))
    # a tile needs the expected values of the distances of its own band alone, and there are bands of gaps that tiles have
    gap = (F.floor(F.col("bin_y") / core) - F.floor(F.col("bin_x") / core)).cast("int")
    gaps = c.select("bin_size", gap.alias("gap")).distinct().select("bin_size", F.explode(F.sequence(F.col("gap") - 1, F.col("gap") + 1)).alias("gap")).distinct()
    spread = 2 * MARGIN + core
    bands = density.where("value is not null").withColumn("gap", F.explode(F.sequence(*(F.floor((F.col("dist") + k) / core).cast("int") for k in (-spread, spread)))))
    bands = bands.join(gaps, ["bin_size", "gap"]).groupBy("bin_size", "gap").agg(F.collect_list(F.col("dist").cast("int")).alias("dists"), F.collect_list("value").alias("values"))
    bands = counted(written(bands, "bands"), MOST_BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected_of: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("bin_size").to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for k in range(0, len(at), TILES):
                    yield _solved(batch.take(pa.array(at[k : k + TILES])), core, *known[size], expected_of)

    return packed.join(bands, ["bin_size", "gap"]).mapInArrow(run, PIXEL)


_TILE_KEY = ["bin_size", "chr", "tx", "ty"]
_TILE_CELLS = ["bin_x", "bin_y", "counts", "nx", "ny"]
_TILE = "bin_size int, chr int, tx int, ty int, bin_x array<int>, bin_y array<int>, counts array<double>, nx array<double>, ny array<double>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows of a tile; a run that a batch ends in goes on in the next."""
    def rows(keys: list[np.ndarray], cells: list[np.ndarray], starts: np.ndarray, end: int) -> pa.RecordBatch:
        offsets = pa.array(np.append(starts, end), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[:end])) for v in cells]
        return pa.RecordBatch.from_arrays([*(pa.array(v[starts]) for v in keys), *lists], [*_TILE_KEY, *_TILE_CELLS])

    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy() for c in (*_TILE_KEY, *_TILE_CELLS)]
        if left is not None:
            now = [np.concatenate(v) for v in zip(left, now, strict=True)]
        n = len(_TILE_KEY)
        starts = np.append(0, np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in now[:n]])) + 1)
        if len(starts) > 1:
            yield rows(now[:n], now[n:], starts[:-1], int(starts[-1]))
        left = [v[starts[-1] :] for v in now]
    if left is not None:
        yield rows(left[:n], left[n:], np.zeros(1, np.int64), len(left[0]))


def _solved(tiles: pa.RecordBatch, core: int, p: int, w: int, expected_of: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    """The pixels of tiles of one resolution. Expected values depend on the distance alone, so tiles as far from the diagonal share them: those of the last EXPECTED_KEPT gaps are kept."""
    n, size = core + 2 * MARGIN, tiles.column("bin_size")[0].as_py()
    tx, ty, chr_ = (tiles.column(c).to_numpy() for c in ("tx", "ty", "chr"))
    gaps = (ty - tx).tolist()
    for k, gap in enumerate(gaps):
        if (size, gap) not in expected_of:
            reach = np.abs(np.subtract.outer(np.arange(n), np.arange(n) + gap * core))
            dists, values = (tiles.column(c).slice(k, 1).flatten().to_numpy() for c in ("dists", "values"))
            table = np.zeros(max(int(reach.max()), int(dists.max())) + 1)
            table[dists] = values
            while len(expected_of) >= EXPECTED_KEPT and (old := next((x for x in expected_of if x[0] != size or x[1] not in gaps), None)):
                del expected_of[old]
            expected_of[size, gap] = table[reach]
    own = sorted(set(gaps))
    d = np.stack([expected_of[size, gap] for gap in own])
    lengths = tiles.column("bin_x").value_lengths().to_numpy()
    x, y, counts, nx, ny = (tiles.column(c).flatten().to_numpy() for c in _TILE_CELLS)
    t, g = np.repeat(np.arange(len(gaps)), lengths), np.repeat(np.searchsorted(own, gaps), lengths)
    i, j = x - tx[t] * core + MARGIN, y - ty[t] * core + MARGIN
    i2, j2 = y - tx[t] * core + MARGIN, x - ty[t] * core + MARGIN
    c, value = np.zeros((len(gaps), n, n)), counts / (nx * ny)
    for a, b in ((i, j), (i2, j2)):
        here = (a >= 0) & (a < n) & (b >= 0) & (b < n)
        c[t[here], a[here], b[here]] = value[here]
    inside = (i >= MARGIN) & (i < n - MARGIN) & (j >= MARGIN) & (j < n - MARGIN) & (y - x > p + 2)
    x, y, counts, nx, ny, t, g, i, j = (v[inside] for v in (x, y, counts, nx, ny, t, g, i, j))
    ratio = mask_expected(_sums(np.nan_to_num(c, copy=False)), _sums(d), t, g, i, j, y - x, p, w)
    scale = d[g, i, j] * nx * ny
    out = [np.full(len(x), size, np.int32), chr_[t], x, y, np.round(counts)]
    told = np.ones(len(x), bool)
    for m in MASKS:
        e = ratio[m] * scale
        told &= np.isfinite(e) & (e > 1e-9)
        with np.errstate(invalid="ignore", divide="ignore"):
            b = np.where(e > 1, np.minimum(np.floor(np.log(e) / math.log(2**0.33)), LAMBDA_BINS - 1), 0)
        out += [e, np.nan_to_num(b).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(v[told]) for v in out], PIXEL_COLUMNS)


def normed(cells: DataFrame, vector: DataFrame) -> DataFrame:
    """Intra cells with the norm values of both bins: bin_size, chr, bin_x, bin_y, counts, nx, ny."""
    vx = vector.select("bin_size", "chr", F.col("bin").alias("bin_x"), F.col("value").alias("nx"))
    vy = vector.select("bin_size", "chr", F.col("bin").alias("bin_y"), F.col("value").alias("ny"))
    intra = cells.where("chr1 = chr2").select("bin_size", F.col("chr1").alias("chr"), "bin_x", "bin_y", "counts")
    return intra.join(vx, ["bin_size", "chr", "bin_x"]).join(vy, ["bin_size", "chr", "bin_y"]).select("bin_size", "chr", "bin_x", "bin_y", "counts", "nx", "ny")


def _long(pixels_: DataFrame, value: str) -> DataFrame:
    """A row for each pixel and mask: bin_size, mask, bin, and the named value (of the mask, where it has one)."""
    of = lambda m: F.col(value if value in pixels_.columns else f"{value}{m}")
    return pixels_.select("bin_size", F.inline(F.array(*(F.struct(F.lit(m).alias("mask"), F.col(f"bin{m}").alias("bin"), of(m).alias("v")) for m in MASKS))))


def thresholds(pixels_: DataFrame, fdr: float = 0.1) -> DataFrame:
    """Of each mask and lambda bin, the false discovery rate of each count that it has, and ``least``, the smallest one that passes: bin_size, mask, bin, o, rate, least.

    A lambda bin's pixels of a count or more, against as many as its greatest mean would give by chance. Counts are a histogram that Spark sums, with no upper end;
    only counts that occur are told, as a pixel between two of them doesn't exist. Where none passes, least is null.
    """
    counts = _long(pixels_, "observed").groupBy("bin_size", "mask", "bin", F.col("v").cast("long").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("bin_size", "mask", "bin")
    seen = F.sum("n").over(group.orderBy(F.desc("o")).rowsBetween(Window.unboundedPreceding, 0))
    told = F.sum("n").over(group) * poisson_upper(F.col("o").cast("double"), F.pow(F.lit(2.0), (F.col("bin") + 1) / 3))
    rates = counts.withColumns({"seen": seen, "told": told})
    passes = (F.col("o") > 0) & (F.col("told") <= fdr * F.col("seen"))
    return rates.withColumn("least", F.min(F.when(passes, F.col("o"))).over(group)).select("bin_size", "mask", "bin", "o", (F.col("told") / F.col("seen")).alias("rate"), "least")


def enriched(pixels_: DataFrame, rates: DataFrame) -> DataFrame:
    """Pixels whose count passes in all four masks, with their rates. The least counts are LAMBDA_BINS rows a mask and resolution at most, and broadcast."""
    rates = rates.where("o >= least")
    least = rates.groupBy("bin_size", "mask", "bin").agg(F.first("least").alias("_least"))
    out = pixels_
    for m in MASKS:
        mine = least.where(F.col("mask") == m).select("bin_size", F.col("bin").alias(f"bin{m}"), "_least")
        out = out.join(F.broadcast(mine), ["bin_size", f"bin{m}"]).where(F.col("observed") >= F.col("_least")).drop("_least")
    out = written(out.withColumn("o", F.col("observed").cast("long")), "passing")
    for m in MASKS:
        mine = rates.where(F.col("mask") == m).select("bin_size", F.col("bin").alias(f"bin{m}"), "o", F.col("rate").alias(f"fdr{m}"))
        out = out.join(mine, ["bin_size", f"bin{m}", "o"])
    return out.select(*PIXEL_COLUMNS, *(f"fdr{m}" for m in MASKS))


def missing_bins(vector: DataFrame, chrom_sizes: DataFrame, bin_sizes: Sequence[int]) -> DataFrame:
    """The bins of each chromosome and resolution that have no norm value: bin_size, chr, bin."""
    sizes = chrom_sizes.withColumn("bin_size", F.explode(F.array(*map(F.lit, bin_sizes))))
    bins = sizes.select("bin_size", "chr", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / F.col("bin_size")).cast("int"))).alias("bin"))
    return bins.join(vector.where("value > 0").select("bin_size", "chr", "bin"), ["bin_size", "chr", "bin"], "left_anti")


def clear_of_missing(found: DataFrame, missing: DataFrame, radius: int = 5) -> DataFrame:
    """pixels without a missing norm value within ``radius`` bins of either end."""
    around = missing.select("bin_size", "chr", F.explode(F.sequence(F.col("bin") - radius, F.col("bin") + radius)).alias("_bin")).distinct()
    for end in ("bin_x", "bin_y"):
        found = found.join(around.withColumnRenamed("_bin", end), ["bin_size", "chr", end], "left_anti")
    return found.select(*PIXEL_COLUMNS, *(f"fdr{m}" for m in MASKS))


def _centroids(f: pd.DataFrame, base: int) -> pd.DataFrame:
    """The strongest pixel left takes, one after the other from the strongest, those within reach of the middle of what it has; the reach grows with them.

    Pixels are in grid cells as wide as the first reach; those of cells that the reach comes to are lined up when it does, so no pixel looks at all others.
    """
    f = f.sort_values(["observed", "bin_x", "bin_y"], ascending=[False, True, True], ignore_index=True)
    size = int(f["bin_size"].iloc[0])
    x, y = (f[b].to_numpy("int64") * size for b in ("bin_x", "bin_y"))
    grid = defaultdict(list)
    for k, cell in enumerate(zip((x // base).tolist(), (y // base).tolist(), strict=True)):
        grid[cell].append(k)
    left, rows = np.ones(len(f), bool), []
    for k in range(len(f)):
        if not left[k]:
            continue
        members, reach, cx, cy = [k], float(base), float(x[k]), float(y[k])
        left[k] = False
        line, lined, last = [], set(), k
        while True:
            for a in range(int((cx - reach) // base), int((cx + reach) // base) + 1):
                for b in range(int((cy - reach) // base), int((cy + reach) // base) + 1):
                    if (a, b) not in lined and (a, b) in grid:
                        lined.add((a, b))
                        for q in grid[a, b]:
                            if q > last and left[q]:
                                heappush(line, q)
            while line:
                last = heappop(line)
                if math.hypot(x[last] - cx, y[last] - cy) <= reach:
                    break
            else:
                break
            members.append(last)
            left[last] = False
            cx, cy = x[members].mean(), y[members].mean()
            reach = base + round(float(np.hypot(x[members] - cx, y[members] - cy).max()))
        rows.append((k, len(members), round(cx) + size // 2, round(cy) + size // 2, round(reach - base)))
    at, n, c1, c2, r = (np.array(v, "int64") for v in zip(*rows, strict=True))
    return f.iloc[at].assign(numCollapsed=n.astype("int32"), centroid1=c1, centroid2=c2, radius=r)


def cluster(found: DataFrame, bin_size: int | None = None, radius: int | None = None, settings: Settings | None = None) -> DataFrame:
    """Pixels joined to centroids: the strongest left takes all within its growing radius, in a total order.

    What comes here is only the enriched pixels, a small share. They are parted into islands, runs of pixels of one resolution and chromosome without a wide gap
    between along the first axis: no centroid reaches across a gap that is wider than its reach. Where one's reach is wider, its chromosome is parted anew at wider gaps.
    """
    from contactgrid.operators.lists import islands

    known = {bin_size: radius} if radius else {s: r for s, (_, _, r) in (settings or SETTINGS).items()}
    sizes = sorted(known)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_centroids(g.drop(columns=["island", "stretch"]), known[int(g["bin_size"].iloc[0])]) for _, g in f.groupby("island", sort=False)])

    schema = f"{PIXEL}, " + ", ".join(f"fdr{m} double" for m in MASKS) + ", numCollapsed int, centroid1 bigint, centroid2 bigint, radius bigint"
    columns = [*PIXEL_COLUMNS, *(f"fdr{m}" for m in MASKS)]
    of = lambda values: F.element_at(F.create_map(*(F.lit(v) for pair in zip(sizes, values, strict=True) for v in pair)), F.col("bin_size"))
    base = of([known[s] for s in sizes])
    # islands are told apart by a chromosome's number: each resolution's chromosomes get their own
    place = {"id": F.xxhash64("bin_size", "chr", "bin_x", "bin_y"), "_chr": F.col("chr"), "chr": F.col("chr") * len(sizes) + of(list(range(len(sizes))))}
    start = F.col("bin_x").cast("long") * F.col("bin_size")
    left, gap, out = written(_sized(found, bin_size).select(*columns), "enriched"), 4 * max(known.values()), None
    while True:
        parts = islands(left.withColumns({**place, "x1": start, "x2": start}), gap).withColumn("chr", F.col("_chr"))
        # islands that begin in one stretch are one group, as most are small
        parts = parts.select("island", F.floor(F.col("island") / ISLANDS_STRETCH).alias("stretch"), *columns)
        clusters = written(parts.groupBy("bin_size", "chr", "stretch").applyInPandas(run, schema), "clusters")
        wide = written(clusters.where(F.col("radius") + base > gap).select("bin_size", "chr").distinct(), "wide-chromosomes")
        done = clusters.join(wide, ["bin_size", "chr"], "left_anti").select(*(c.split()[0] for c in schema.split(", ")))
        out = done if out is None else out.unionByName(done)
        if not wide.limit(1).count():
            return out
        left = written(left.join(wide, ["bin_size", "chr"], "left_semi").select(*columns), "enriched")
        gap *= 4


def _as_loops(clusters: DataFrame) -> DataFrame:
    start = lambda b: F.col(b).cast("long") * F.col("bin_size")
    ends = {"start1": start("bin_x"), "end1": start("bin_x") + F.col("bin_size"), "start2": start("bin_y"), "end2": start("bin_y") + F.col("bin_size")}
    return clusters.withColumns({**ends, "id": F.xxhash64("bin_size", "chr", "bin_x", "bin_y")})


def call_loops(
    cells: DataFrame, vector: DataFrame, density: DataFrame, bin_size: int | None = None, settings: tuple[int, int, int] | Settings | None = None, missing: DataFrame | None = None
) -> DataFrame:
    """Loops as features with their scores, at one resolution or, given a bin_size by row, at several in one plan; pixels near ``missing`` bins go."""
    p = written(pixels(cells if "nx" in cells.columns else written(cells, "cells"), vector, density, bin_size, settings=settings), "pixels")
    found = enriched(p, written(thresholds(p), "rates"))
    if missing is not None:
        found = clear_of_missing(found, missing)
    return _as_loops(cluster(found, settings=_settings(bin_size, settings))).where(features.fdr_accepts())


def maps_by_size(cells: DataFrame, chrom_sizes: DataFrame, bin_sizes: Sequence[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a map's cells at several resolutions, each row with its bin_size: square root coverage vectors, expected values by distance, and bins without a norm."""
    return normed_maps(cells, chrom_sizes, bin_sizes)[1:]


def normed_maps(cells: DataFrame, chrom_sizes: DataFrame, bin_sizes: Sequence[int], density: Callable[..., DataFrame] = expected.expected) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The cells with both bins' norm values (as normed() gives them), and what maps_by_size() tells.

    Cells meet the coverage of their bins once; the factors of chromosomes, the sums by distance and the pixels of tiles take that one table.
    """
    sizes = sorted(bin_sizes)
    intra = cells.where((F.col("chr1") == F.col("chr2")) & F.col("bin_size").isin(sizes))
    ends = F.when(F.col("bin_x") == F.col("bin_y"), F.array("bin_x")).otherwise(F.array("bin_x", "bin_y"))
    coverage = intra.select("bin_size", F.col("chr1").alias("chr"), "counts", F.explode(ends).alias("bin")).groupBy("bin_size", "chr", "bin").agg(F.sqrt(F.sum("counts")).alias("value"))
    coverage = written(coverage, "coverage")
    met = written(normed(intra, coverage.where("value > 0")), "covered-cells")
    twice = F.when(F.col("bin_x") == F.col("bin_y"), F.lit(1)).otherwise(F.lit(2))
    factor = F.sqrt(F.sum(twice * F.col("counts") / (F.col("nx") * F.col("ny"))) / F.sum(twice * F.col("counts")))
    factors = counted(written(met.groupBy("bin_size", "chr").agg(factor.alias("factor")), "factors"))
    vector = written(coverage.join(factors, ["bin_size", "chr"]).select("bin_size", "chr", "bin", (F.col("value") * F.col("factor")).alias("value")), "vectors")
    met = met.join(factors, ["bin_size", "chr"]).select("bin_size", "chr", "bin_x", "bin_y", "counts", (F.col("nx") * F.col("factor")).alias("nx"), (F.col("ny") * F.col("factor")).alias("ny"))
    sums = written(met.groupBy("bin_size", (F.col("bin_y") - F.col("bin_x")).alias("dist")).agg(F.sum(F.col("counts") / (F.col("nx") * F.col("ny"))).alias("observed")), "sums-by-distance")
    told = None
    for size in sizes:
        one = density(None, chrom_sizes, size, observed=sums.where(F.col("bin_size") == size).drop("bin_size")).withColumn("bin_size", F.lit(size))
        told = one if told is None else told.unionByName(one)
    return met, vector, written(told, "densities"), missing_bins(vector, chrom_sizes, sizes)


def call_loops_at(cells: DataFrame, chrom_sizes: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """C01, C01m: loops of all resolutions of ``settings`` in one plan, merged: cells have a bin_size by row, as bin_contacts() gives them.

    Cells, vectors, expected values and tiles' pixels of all resolutions are each one stored table; pixels near bins without a norm go
    before they are joined to centroids; resolutions that merge_resolutions() has no rule for are kept as they are.
    """
    sizes = sorted(settings)
    cells = written(cells.where(F.col("bin_size").isin(sizes)).select("bin_size", "chr1", "chr2", "bin_x", "bin_y", "counts"), "cells")
    met, vector, density, missing = normed_maps(cells, chrom_sizes, sizes)
    loops = written(call_loops(met, vector, density, settings=settings, missing=missing), "loops-by-size")
    of = {s: loops.where(F.col("bin_size") == s) for s in sizes}
    if not {5_000, 10_000} & of.keys():
        return loops.dropDuplicates(["chr", *features.ENDS])
    first = [of[s] for s in (5_000, 10_000) if s in of]
    return merge_resolutions(*first, coarsest=of.get(25_000))


def merge_resolutions(fine: DataFrame, coarse: DataFrame | None = None, coarsest: DataFrame | None = None) -> DataFrame:
    """C01m: fine loops that the coarse ones confirm within 20 kb, coarse ones that no fine one confirms, fine ones near the diagonal or of
    over 100 counts; then coarsest ones farther than 50 kb from all these."""
    parts = [fine] if coarse is None else [
        features.reproducible(coarse, fine, 20_000), coarse.join(features.reproducible(fine, coarse, 20_000).select("id"), "id", "left_anti"),
        features.near_diagonal(fine, 110_000), features.strong(fine, 100),
    ]
    merged = parts[0]
    for x in parts[1:]:
        merged = merged.unionByName(x)
    merged = merged.dropDuplicates(["chr", *features.ENDS])
    if coarsest is not None:
        near = features.reproducible(merged, coarsest, 50_000).select("id")
        merged = merged.unionByName(coarsest.join(near, "id", "left_anti"))
    return merged


def loop_differences(a: DataFrame, b: DataFrame, radius: int = 50_000, fraction: float = 0.2) -> DataFrame:
    """C04, first half: loops that the other list doesn't have nearby, labelled with their own."""
    out = None
    for mine, other, name in ((a, b, "A"), (b, a, "B")):
        kept = features.reproducible_nearest(other, mine, radius, fraction).select("id")
        part = mine.join(kept, "id", "left_anti").withColumn("only_in", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def score_loops(loops: DataFrame, cells: DataFrame, vector: DataFrame, density: DataFrame, bin_size: int, settings: tuple[int, int, int] | None = None) -> DataFrame:
    """Given loops with what a map shows and the masks expect at their places, whatever it is: observed, expectedBL, expectedDonut, expectedH, expectedV.

    Loops' pixels that the map has no counts in are scored as zero counts. A loop without expected values, such as one near the
    diagonal or of a bin without a norm, can't be told and is left out, as in the original.
    """
    at = loops.withColumns({"bin_x": F.floor(F.col("start1") / bin_size).cast("int"), "bin_y": F.floor(F.col("start2") / bin_size).cast("int")})
    pixel = at.select(F.col("chr").alias("chr1"), F.col("chr").alias("chr2"), "bin_x", "bin_y").distinct()
    empty = pixel.join(cells, ["chr1", "chr2", "bin_x", "bin_y"], "left_anti").withColumn("counts", F.lit(0.0))
    # masks reach MARGIN bins: cells in the squares around a given pixel, on either side of the diagonal, are all that is looked at
    square = lambda b: F.floor(F.col(b) / MARGIN)
    near = lambda b: F.explode(F.sequence(square(b) - 1, square(b) + 1))
    around = pixel.select("chr1", near("bin_x").alias("a"), "bin_y").select("chr1", "a", near("bin_y").alias("b"))
    around = counted(around.select("chr1", F.least("a", "b").alias("sx"), F.greatest("a", "b").alias("sy")).distinct())
    here = cells.where("chr1 = chr2").select(*empty.columns, F.least(square("bin_x"), square("bin_y")).alias("sx"), F.greatest(square("bin_x"), square("bin_y")).alias("sy")).join(around, ["chr1", "sx", "sy"], "left_semi")
    p = pixels(here.select(*empty.columns).unionByName(empty), vector, density, bin_size, settings=settings)
    told = p.select("chr", "bin_x", "bin_y", "observed", *(f"expected{m}" for m in MASKS))
    return at.drop("observed", *(f"expected{m}" for m in MASKS)).join(told, ["chr", "bin_x", "bin_y"])


def not_enriched(loops: DataFrame, cells: DataFrame, vector: DataFrame, density: DataFrame, bin_size: int, limit: float = 1.3, settings: tuple[int, int, int] | None = None) -> DataFrame:
    """Loops whose pixel in a map is observed less than ``limit`` times what each of the four masks expects: see score_loops()."""
    low = score_loops(loops, cells, vector, density, bin_size, settings).where(F.col("observed") < limit * F.least(*(F.col(f"expected{m}") for m in MASKS)))
    return loops.join(low.select("id").distinct(), "id", "left_semi")


def significant(pixels_: DataFrame, fdr: float = 0.1) -> DataFrame:
    """Pixels whose Poisson p-value passes for all four masks, with the p-values (pBL, pDonut, pH, pV).

    Of each mask and lambda bin, pixels' p-values times their number by ``fdr`` are the rank that a pixel has to have: the last
    rank that is at most the number of pixels with it or a lower one is the limit. Ranks are counted, so that no lambda bin is sorted.
    """

    p = pixels_.select(*PIXEL_COLUMNS, *(poisson_upper("observed", f"expected{m}").alias(f"p{m}") for m in MASKS))
    p = written(p, "p-values")
    long = _long(p, "p").withColumnRenamed("v", "p")
    key = ["bin_size", "mask", "bin"]
    total = long.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    ranks = long.where(F.col("p") < fdr).join(F.broadcast(total), key).withColumn("rank", F.greatest(F.ceil(F.col("p") * F.col("m") / fdr), F.lit(1)))
    counts = ranks.groupBy(*key, "rank").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("p"))
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("rank"))
    limits = written(counts.withColumn("upto", upto).where("rank <= upto").groupBy(*key).agg(F.max("p").alias("limit")), "limits")
    for m in MASKS:
        mine = limits.where(F.col("mask") == m).select("bin_size", F.col("bin").alias(f"bin{m}"), F.col("limit").alias("_limit"))
        p = p.join(F.broadcast(mine), ["bin_size", f"bin{m}"]).where(F.col(f"p{m}") <= F.col("_limit")).drop("_limit")
    return p.select(*PIXEL_COLUMNS, *(f"p{m}" for m in MASKS))


def call_loops_by_p(
    cells: DataFrame, vector: DataFrame, density: DataFrame, bin_size: int | None = None, fdr: float = 0.1, max_ratio: float = 40.0, settings: tuple[int, int, int] | Settings | None = None,
    missing: DataFrame | None = None,
) -> DataFrame:
    """Loops by p-values, at one resolution or several: significant pixels clear of ``missing`` bins (F21), joined to centroids, enriched over all masks (F22), and no more than
    ``max_ratio`` times what they expect (F23)."""
    from contactgrid.operators import lists

    p = written(pixels(cells if "nx" in cells.columns else written(cells, "cells"), vector, density, bin_size, settings=settings), "pixels")
    found = significant(p, fdr).withColumnsRenamed({f"p{m}": f"fdr{m}" for m in MASKS})
    if missing is not None:
        found = clear_of_missing(found, missing)
    return _as_loops(cluster(found, settings=_settings(bin_size, settings))).where(features.fdr_accepts() & lists.clean(max_ratio))


def differential_loops(
    a: DataFrame, b: DataFrame, map_a: tuple[DataFrame, DataFrame, DataFrame], map_b: tuple[DataFrame, DataFrame, DataFrame], bin_size: int, radius: int = 50_000, fraction: float = 0.2, limit: float = 1.3,
    settings: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Loops that the other list doesn't have nearby and that aren't enriched in the other map, labelled with their own.

    A map is its cells, norm vector and expected values by distance, as in call_loops().
    """
    found = loop_differences(a, b, radius, fraction)
    parts = [not_enriched(found.where(F.col("only_in") == name), *other, bin_size, limit, settings) for name, other in (("A", map_b), ("B", map_a))]
    return parts[0].unionByName(parts[1])
