"""More on lists of loops, domains and triples."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactgrid.operators import features, intervals

MASKS = ("BL", "Donut", "H", "V")


def _ratios() -> list[Column]:
    return [F.try_divide(F.col("observed"), F.col(f"expected{m}")) for m in MASKS]


def clean(max_ratio: float = 40.0, fdr_sum: float = 1e-5) -> Column:
    """less than ``max_ratio`` times what every mask expects; of bins of 5,000 or more, also collapsed from several or with a small sum of rates."""
    below = F.col("observed") < max_ratio * F.least(*(F.col(f"expected{m}") for m in MASKS))
    sure = (F.col("numCollapsed") > 1) | (sum((F.col(f"fdr{m}") for m in MASKS[1:]), F.col("fdrBL")) <= fdr_sum)
    return below & ((F.col("end1") - F.col("start1") < 5_000) | sure)


def enriched_less_than(limit: float = 1.3) -> Column:
    """observed below ``limit`` times what every mask expects."""
    return F.col("observed") < limit * F.least(*(F.col(f"expected{m}") for m in MASKS))


def with_attribute(rows: DataFrame, value: str) -> DataFrame:
    """features any of whose attributes has the value."""
    return rows.where(F.array_contains(F.map_values("attrs"), value))


def parse_table(lines: DataFrame, header: str) -> DataFrame:
    """A catalog's rows, tab separated under a header, as text columns; rows of another number of columns go."""
    names = header.split("\t")
    t = F.split("value", "\t", -1)
    rows = lines.where((F.size(t) == len(names)) & (F.col("value") != header))
    return rows.select(*(t[k].alias(n) for k, n in enumerate(names)))


def table_lines(rows: DataFrame) -> DataFrame:
    """A catalog's rows as tab separated lines; nulls are empty."""
    return rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)).alias("value"))


def catalog_filter(rows: DataFrame, pattern: str, order: Sequence[str]) -> DataFrame:
    """rows any of whose columns fits the pattern, whatever the case, in order."""
    fits = F.lit(False)
    for c in rows.columns:
        fits = fits | F.coalesce(F.col(c).cast("string").rlike(f"(?i){pattern}"), F.lit(False))
    return rows.where(fits).orderBy(*order)


def distinct_features(rows: DataFrame) -> DataFrame:
    """One of each place; of several the smallest id."""
    return rows.groupBy("chr", *features.ENDS).agg(F.min("id").alias("id"))


#: Orders within a chromosome: O02 of features, by place or by what was observed; O03 of loci; O04 of domains, by both triangles' variances.
FEATURE_ORDER = ("start1", "start2", "end1", "end2", "id")
OBSERVED_ORDER = ("observed", "id")
LOCUS_ORDER = ("x1", "x2", "id")
DOMAIN_ORDER = ("-(uVarScore + lVarScore)", "id")


def ordered(rows: DataFrame, order: Sequence) -> DataFrame:
    """Rows by chromosome and one of these orders, by ranges, so that no task sorts them all."""
    return rows.orderBy("chr", *map(F.expr, order))


def convergence(motifs: DataFrame) -> DataFrame:
    """Counts of ++, +-, -+ and -- of loops with a unique motif at both ends, of other loops with two motifs (non-unique), and of the rest (incomplete).

    motifs: strand1, strand2 (null: no motif), unique1, unique2.
    """
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    status = F.when(F.col("strand1").isNull() | F.col("strand2").isNull(), "incomplete").when(F.col("unique1") & F.col("unique2"), F.concat(sign("strand1"), sign("strand2"))).otherwise("non-unique")
    return motifs.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def merged_layers(layers: Sequence[DataFrame]) -> DataFrame:
    """All layers' features, one of each place."""
    both = layers[0]
    for layer in layers[1:]:
        both = both.unionByName(layer)
    return distinct_features(both)


def without_nearest(rows: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """The features but those nearest to each of the points (id, chr, start1, start2), within the radius."""
    near = features.near_points(points, rows, radius)
    gone = near.groupBy("id").agg(F.min_by("b_id", F.struct("far", "b_id")).alias("gone"))
    return rows.join(gone.select(F.col("gone").alias("id")).distinct(), "id", "left_anti")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of a that aren't in b, by all columns."""
    return a.subtract(b.select(*a.columns))


def common_to_all(lists: Sequence[DataFrame], tolerance: int) -> DataFrame:
    """The first list's features that every other list has within the tolerance."""
    out = lists[0]
    for other in lists[1:]:
        out = features.tolerant(out, other, tolerance)
    return out


def islands(rows: DataFrame, gap: int = 0) -> DataFrame:
    """The rows (id, chr, x1, x2, ...), each with the start of the union of overlapping ones that it is in: island."""
    whole = intervals.merge(rows.select("chr", "x1", "x2"), gap).select(F.col("x1").alias("id"), "chr", "x1", "x2")
    found = intervals.overlap_join(rows.select("id", "chr", "x1", "x2"), whole).select("id", F.col("b_id").alias("island"))
    return rows.join(found, "id")


def by_island(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, at_once: bool = False) -> DataFrame:
    """What run() gives for each island of the rows. Islands that begin in one stretch of a chromosome are one group, as most are small.

    With ``at_once`` run() gets the whole group, and tells its islands apart by the column island: frames of a few rows each cost more than their rows.
    """

    def each(f: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([run(g) for _, g in f.groupby("island", sort=False)])

    return islands(rows).groupBy("chr", F.floor(F.col("island") / (1 << 18)).alias("stretch")).applyInPandas(run if at_once else each, schema)


def non_conflicting(main: DataFrame, more: DataFrame) -> DataFrame:
    """Ids of those of ``more`` that, in the order of their ids, have no edge of main, or of one accepted before, within them. Both: id, chr, x1, x2.

    Only intervals that overlap, one with the next, can decide on each other, so each island of them is a group.
    """
    both = main.select("id", "chr", "x1", "x2", F.lit(0).alias("turn")).unionByName(more.select("id", "chr", "x1", "x2", F.lit(1).alias("turn")))
    both = both.withColumns({"own": F.col("id"), "id": F.xxhash64("turn", "id")})

    def accept(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["island", "turn", "own"])
        found, here = [], None
        for island, turn, own, x1, x2 in zip(*(f[c].tolist() for c in ("island", "turn", "own", "x1", "x2")), strict=True):
            if island != here:
                here, edges = island, []
            k = bisect_left(edges, x1)
            if turn and k < len(edges) and edges[k] <= x2:
                continue
            insort(edges, x1)
            insort(edges, x2)
            if turn:
                found.append(own)
        return pd.DataFrame({"id": np.array(found, "int64")})

    return by_island(both, accept, "id bigint", at_once=True)


SCORES = ["score", "uVarScore", "lVarScore", "upSign", "loSign"]


def binned_scores(rows: DataFrame, distance: int) -> DataFrame:
    """Domain corners joined to boxes: in the order of ids each goes to the first box with an edge nearer than ``distance`` in both directions, which grows.

    rows: id, chr, i, j and scores. A box is its largest i and j, and the means of its scores. Corners farther apart than
    ``distance`` along i, with none between, can't meet, so each island is a group.
    """
    spread = rows.select("id", "chr", F.col("i").cast("long").alias("x1"), (F.col("i") + distance - 1).cast("long").alias("x2"), "i", "j", *SCORES)

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["island", "id"])
        edges: list[tuple[int, int, int, int]] = []
        box = np.empty(len(f), "int64")
        here = None
        for k, (island, i, j) in enumerate(zip(f["island"].tolist(), f["i"].tolist(), f["j"].tolist(), strict=True)):
            if island != here:
                here, known = island, {}  # boxes by the cells of their corners, of which one is next to a row that fits
            cells = ((a, b) for a in range(i // distance - 1, i // distance + 2) for b in range(j // distance - 1, j // distance + 2))
            near = sorted({n for c in cells for n in known.get(c, ())})
            fits = lambda e: min(abs(e[0] - i), abs(e[1] - i)) < distance and min(abs(e[2] - j), abs(e[3] - j)) < distance  # noqa: B023, E731
            n = next((n for n in near if fits(edges[n])), len(edges))
            if n == len(edges):
                edges.append((i, i, j, j))
            else:
                e = edges[n]
                edges[n] = min(e[0], i), max(e[1], i), min(e[2], j), max(e[3], j)
            box[k] = n
            for c in {(a // distance, b // distance) for a in edges[n][:2] for b in edges[n][2:]}:
                at = known.setdefault(c, [])
                if n not in at:
                    at.append(n)
        by = f[SCORES].groupby(box)
        out = by.mean().assign(chr=f["chr"].iloc[0], i=[e[1] for e in edges], j=[e[3] for e in edges], n=by.size())
        return out[["chr", "i", "j", "n", *SCORES]]

    kind = "chr int, i bigint, j bigint, n int, " + ", ".join(f"{s} double" for s in SCORES)
    return by_island(spread, join, kind, at_once=True)


def triple_centroids(triples: DataFrame, tolerance: int) -> DataFrame:
    """Triples (id, chr, x1, x2, x3) joined to centroids: in the order of ids each goes to the first within the tolerance at all three places.

    A centroid is the mean, rounded down, of its members' distinct places, so none is taken that lies farther than the tolerance
    from all members along x1: each island is a group.
    """
    spread = triples.select("id", "chr", "x1", (F.col("x1") + tolerance - 1).alias("x2"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("x3").alias("p3"))

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        sets: list[list[set[int]]] = []
        centres: list[list[int]] = []
        counts: list[int] = []
        for p in zip(f["p1"], f["p2"], f["p3"], strict=True):
            for k, centre in enumerate(centres):
                if all(abs(a - b) < tolerance for a, b in zip(p, centre, strict=True)):
                    for places, a in zip(sets[k], p, strict=True):
                        places.add(a)
                    centres[k] = [sum(places) // len(places) for places in sets[k]]
                    counts[k] += 1
                    break
            else:
                sets.append([{a} for a in p])
                centres.append(list(p))
                counts.append(1)
        x1, x2, x3 = zip(*centres, strict=True)
        return pd.DataFrame({"chr": f["chr"].iloc[0], "x1": x1, "x2": x2, "x3": x3, "n": counts})

    return by_island(spread, join, "chr int, x1 bigint, x2 bigint, x3 bigint, n int")


def contained(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of features where a's rectangle lies within b's."""
    inside = (F.col("b_start1") <= F.col("start1")) & (F.col("end1") <= F.col("b_end1")) & (F.col("b_start2") <= F.col("start2")) & (F.col("end2") <= F.col("b_end2"))
    return features.overlapping_rectangles(a, b).where(inside)


def union_without_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """A, and those of b, in the order of their ids, that overlap none of it and none of b's accepted before.

    Of b's, those that overlap others of b decide on each other island by island along the first axis.
    """
    free = b.join(features.overlapping_rectangles(a, b).select(F.col("b_id").alias("id")).distinct(), "id", "left_anti")
    spread = free.select("id", "chr", F.col("start1").alias("x1"), F.col("end1").alias("x2"), F.col("start2").alias("y1"), F.col("end2").alias("y2"))

    def accept(f: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in f.sort_values("id").itertuples():
            if not any(r.x1 <= k.x2 and k.x1 <= r.x2 and r.y1 <= k.y2 and k.y1 <= r.y2 for k in kept):
                kept.append(r)
        return pd.DataFrame({"id": np.array([r.id for r in kept], "int64")})

    kept = by_island(spread, accept, "id bigint")
    return a.unionByName(free.join(kept, "id", "left_semi").select(*a.columns))
