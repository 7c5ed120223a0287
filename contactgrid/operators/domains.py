"""Domain calling by diagonal tiles (C05): corner scores of the preference matrix, components, the merge of tiles, and scores of given domains (C05s, C05r, M07)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid.operators.norm import both_sides
from contactgrid.tables import written

GAP = 7
#: Bins of the window that slides along the diagonal by half of it: no wider domain is found.
TILE = 2_000
VARIANCE, SIGN, LEAST_SIGN, SIGN_STEP = 0.2, 0.5, 0.4, 0.1


def preference(m: np.ndarray) -> np.ndarray:
    """At (i, i + k), of the cells k bins upstream (A) and downstream (B) of bin i, (A - B) / (A + B)."""
    n = len(m)
    out = np.zeros((n, n))
    for k in range(GAP, n // 2):
        i = np.arange(k, n - k)
        a, b = m[i, i - k], m[i, i + k]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[i, i + k] = np.where(a + b > 0, (a - b) / (a + b), 0.0)
    return out


def _sweep(v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width from 1, of all corners (a, a + width), the whole sums of v over their two triangles, each from that of (a, b - 1) and running sums along rows and columns.

    A domain a..b leaves two marks. In rows of its first half, cells whose mirror is upstream of a, columns 2i - a to b, prefer
    downstream (upper); in rows of its second half, cells past b whose mirror is still inside, b to 2i - a, prefer upstream (lower).
    """
    n = len(v)
    right, down = np.zeros((n, n + 1), v.dtype), np.zeros((n + 1, n), v.dtype)
    np.cumsum(v, 1, out=right[:, 1:])
    np.cumsum(v, 0, out=down[1:])
    up, lo = v.diagonal().astype(float), np.zeros(n)
    del v
    for width in range(1, n):
        a = np.arange(0, n - width)
        b = a + width
        # column b comes to the upper triangle, and goes from the lower one, which gets row b
        up = up[:-1] + down[a + width // 2 + 1, b] - down[a, b]
        lo = lo[:-1] - (down[b, b] - down[a + (width + 1) // 2, b]) + right[b, np.minimum(2 * b - a, n - 1) + 1] - right[b, b + 1]
        yield up, lo


def _triangles(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of _sweep() as squares."""
    n = len(v)
    upper, lower = np.zeros((n, n)), np.zeros((n, n))
    for width, (up, lo) in enumerate(_sweep(v), 1):
        a = np.arange(0, n - width)
        upper[a, a + width], lower[a, a + width] = up, lo
    return upper, lower


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected components, by label spreading over the cells of the mask; 0 is outside."""
    number = np.zeros((mask.shape[0] + 2, mask.shape[1] + 2), np.int64)
    i, j = np.nonzero(mask)
    number[i + 1, j + 1] = np.arange(1, len(i) + 1)
    near = [number[i + 1 + di, j + 1 + dj] for di, dj in ((0, 1), (1, -1), (1, 0), (1, 1))]
    a, b = np.concatenate([np.flatnonzero(x) + 1 for x in near]), np.concatenate([x[x > 0] for x in near])
    top = np.arange(len(i) + 1)
    while (top[a] != top[b]).any():
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        np.minimum.at(top, high, low)
        while (top[top] != top).any():
            top = top[top]
    out = np.zeros(mask.shape, np.int64)
    out[i, j] = top[1:]
    return out


def corner_scores(m: np.ndarray, keep: Callable[[int, np.ndarray, np.ndarray], np.ndarray], variance: float = VARIANCE) -> tuple[np.ndarray, ...]:
    """Of the corners (i, j) that are kept, the score and the variances and signs it is made of: i, j, score, uVar, lVar, upSign, loSign; zero where the variance is over its threshold.

    Of a width and the signs of all its corners, ``keep`` tells the places of those to keep. Corners are gone through width by width, so that no square but running sums is held,
    and those of signs, which are whole numbers up to the square's side, in two bytes.
    """
    p = preference(m)
    if len(p) > np.iinfo(np.int16).max:
        raise ValueError(f"{len(p)} bins: take a smaller tile")
    sign = np.sign(p).astype(np.int16)
    sweeps = [_sweep(np.abs(sign)), _sweep(sign), _sweep(p), _sweep(p * p)]
    del p, sign
    most, parts = np.zeros(3), []
    for width, ((nu, nl), (su, sl), (u, l), (vu, vl)) in enumerate(zip(*sweeps, strict=True), 1):  # noqa: E741
        nu, nl = np.maximum(nu, 1), np.maximum(nl, 1)
        su, sl, u, l = su / nu, sl / nl, u / nu, l / nl  # noqa: E741
        vu, vl = vu / nu - u * u, vl / nl - l * l
        made = l - u, sl - su, vu + vl
        most = np.maximum(most, [np.abs(x).max() for x in made])
        if len(at := keep(width, su, sl)):
            parts.append([at, at + width, *(x[at] for x in (*made, vu, vl, su, sl))])
    if not parts:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0),) * 5
    i, j, *made, vu, vl, su, sl = (np.concatenate(x) for x in zip(*parts, strict=True))
    scaled = [x / (top or 1) for x, top in zip(made, most, strict=True)]
    return i, j, np.where(made[2] > variance, 0.0, np.maximum(scaled[0] + scaled[1] - scaled[2], 0.0)), vu, vl, su, sl


def call_tile(m: np.ndarray) -> list[tuple]:
    """Domains of a square on the diagonal: (start, end, score, uVar, lVar, upSign, loSign), under falling sign thresholds until there are some."""
    at = corner_scores(m, lambda _, su, sl: np.flatnonzero((-su >= LEAST_SIGN - 1e-9) & (sl >= LEAST_SIGN - 1e-9)))
    i, j, score, su, sl = at[0], at[1], at[2], at[5], at[6]
    sign = SIGN
    while sign >= LEAST_SIGN - 1e-9:
        told = np.flatnonzero((score > 0) & (-su >= sign) & (sl >= sign))
        mask = np.zeros(m.shape, bool)
        mask[i[told], j[told]] = True
        labels = components(mask)[i[told], j[told]]
        order = told[np.lexsort((j[told], i[told], -score[told], labels))]
        label = np.sort(labels)
        best = order[np.diff(label, prepend=0) > 0]
        if len(best):
            return [(int(i[k]), int(j[k]), *(float(x[k]) for x in at[2:])) for k in best]
        sign -= SIGN_STEP
    return []


def given_corners(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A row for each of the corners (i, j), in their order: score, uVar, lVar, upSign, loSign; zeros for one without a width."""
    n = len(m)
    asked = np.unique(i * n + j)
    width, first = asked % n - asked // n, asked // n
    order = np.argsort(width, kind="stable")
    width, first = width[order], first[order]
    found = corner_scores(m, lambda w, *_: first[np.searchsorted(width, w) : np.searchsorted(width, w, "right")])
    rows = np.zeros((len(asked), 5))
    rows[np.searchsorted(asked, found[0] * n + found[1])] = np.stack(found[2:], 1)
    return rows[np.searchsorted(asked, i * n + j)]


DOMAIN = "chr int, start_bin int, end_bin int, score double, uVarScore double, lVarScore double, upSign double, loSign double"


def _tiles(cells: DataFrame, tile: int) -> DataFrame:
    """The cells of one side of each tile along the diagonal, each half over the next, packed in a row: chr, tile, bin, other, counts."""
    step = tile // 2
    sides = both_sides(cells).where((F.col("bin") <= F.col("other")) & (F.col("other") - F.col("bin") < tile))
    low, high = F.least("bin", "other"), F.greatest("bin", "other")
    first, last = F.greatest(F.ceil((high - tile + 1) / step), F.lit(0)).cast("int"), F.floor(low / step).cast("int")
    dealt = sides.where(first <= last).withColumn("tile", F.explode(F.sequence(first, last)))
    return dealt.groupBy("chr", "tile").agg(*(F.collect_list(c).alias(c) for c in ("bin", "other", "counts")))


def _square(t, step: int, least: int = 0) -> np.ndarray:
    i, j = np.asarray(t.bin) - t.tile * step, np.asarray(t.other) - t.tile * step
    n = max(int(j.max()) + 1, least)
    m = np.zeros((n, n))
    m[i, j] = m[j, i] = t.counts
    return m


def score_domains(domains: DataFrame, cells: DataFrame, tile: int = TILE) -> DataFrame:
    """C05s: given domains (id, chr, start_bin, end_bin) with the scores of their corners, whatever these are.

    A domain is scored in the first tile that holds it whole. One that no tile holds, as it is wider than half a tile and lies across, or wider than one, has null scores.
    """
    step = tile // 2
    wide = domains.select("id", "chr", F.col("start_bin").cast("int").alias("start_bin"), F.col("end_bin").cast("int").alias("end_bin"))
    at = F.greatest(F.ceil((F.col("end_bin") - tile + 1) / step), F.lit(0)).cast("int")
    asked = domains.select("id", "chr", "start_bin", "end_bin", at.alias("tile")).where((F.col("end_bin") - F.col("start_bin") < tile) & (F.col("tile") * step <= F.col("start_bin")))
    asked = asked.groupBy("chr", "tile").agg(F.collect_list(F.struct("id", "start_bin", "end_bin")).alias("asked"))
    kind = "id bigint, " + DOMAIN

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in f.itertuples(index=False):
                low = t.tile * step
                ids, starts, ends = (np.array(c, np.int64) for c in zip(*((r["id"], r["start_bin"], r["end_bin"]) for r in t.asked), strict=True))
                made = given_corners(_square(t, step, int(ends.max()) - low + 1), starts - low, ends - low)
                rows = {"id": ids, "chr": t.chr, "start_bin": starts, "end_bin": ends}
                yield pd.DataFrame(rows | dict(zip((c.split()[0] for c in kind.split(", ")[4:]), made.T, strict=True)))

    scored = written(_tiles(cells, tile).join(asked, ["chr", "tile"]).mapInPandas(run, kind), "scored-domains")
    none = [F.lit(None).cast("double").alias(c.split()[0]) for c in kind.split(", ")[4:]]
    fits = (F.col("end_bin") - F.col("start_bin") < tile) & (F.greatest(F.ceil((F.col("end_bin") - tile + 1) / step), F.lit(0)) * step <= F.col("start_bin"))
    return scored.unionByName(wide.where(~fits).select("*", *none))


def call_domains(cells: DataFrame, tile: int = TILE, least_width: int = 8) -> DataFrame:
    """Domains of each chromosome from tiles along its diagonal, each half over the next; the same domain from two tiles counts once.

    A tile's cells, of one side, are packed in one row and solved by numpy, so that the work is spread over tiles of bounded size; domains within two bins at both ends of a
    stronger one of the next tile are left out.
    """
    step = tile // 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in f.itertuples(index=False):
                rows = [(t.chr, a + t.tile * step, b + t.tile * step, *rest) for a, b, *rest in call_tile(_square(t, step)) if b - a >= least_width]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOMAIN.split(", ")])

    found = _tiles(cells, tile).mapInPandas(run, DOMAIN)
    rank = F.struct(F.col("score"), -F.col("start_bin"), -F.col("end_bin"))
    near = lambda c: F.explode(F.array(*(F.floor((F.col(c) + k) / 4) for k in (-2, 2))))
    grid = found.withColumn("gx", near("start_bin")).withColumn("gy", near("end_bin"))
    best = grid.groupBy("chr", "gx", "gy").agg(F.max(rank).alias("best"))
    lost = grid.join(best, ["chr", "gx", "gy"]).where((F.struct(F.col("score"), -F.col("start_bin"), -F.col("end_bin")) < F.col("best"))).select("chr", "start_bin", "end_bin").distinct()
    return found.join(lost, ["chr", "start_bin", "end_bin"], "left_anti").dropDuplicates(["chr", "start_bin", "end_bin"])


def wider_than(domains: DataFrame, least_width: int) -> DataFrame:
    """domains of more than ``least_width`` bins."""
    return domains.where(F.col("end_bin") - F.col("start_bin") > least_width)


def resolution_for(density: DataFrame, deep: float = 250_000, shallow: float = 100_000) -> DataFrame:
    """C05r: the bin size that a map's depth allows, by what its coarsest density expects on the diagonal, and whether even that is too sparse: bin_size, sparse."""
    return density.where("dist = 0").select(F.when(F.col("value") > deep, 5_000).otherwise(10_000).alias("bin_size"), (F.col("value") < shallow).alias("sparse"))
