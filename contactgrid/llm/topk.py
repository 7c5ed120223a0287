"""Exact top-k by inner product: best-first search of M-trees."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactgrid.llm.common import bound_batches, materialize

#: Vectors of a tree, entries of a page, children of an inner node, queries that search together.
SHARD_ROWS, PAGE, FANOUT, QUERY_BLOCK = 8192, 128, 16, 1024
#: Vectors, chosen by hash, that pivots are fitted on, and pivots at most: rows near one pivot share trees.
PIVOT_SAMPLE, MOST_PIVOTS = 4096, 256
#: Trees' roots that are held against a block of queries in one step.
ROOTS_STEP = 4096
#: Blocks of queries that meet the roots under one key, so that no key holds all blocks; rows of a table that is broadcast, at most.
SALT_BLOCKS, BROADCAST_ROWS = 64, 100_000


@dataclass
class Node:
    """A page: routing object, covering radius, distance to the parent's routing object; children, or a leaf's entries."""

    center: np.ndarray
    radius: float
    to_parent: float
    children: list[int] = field(default_factory=list)
    rows: np.ndarray | None = None
    to_center: np.ndarray | None = None


class MTree:
    """Vectors in pages under the Euclidean metric. Every entry keeps its distance to its page's routing object."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 3):
        self.ids, self.vectors = ids, vectors
        self.nodes: list[Node] = []
        rng = np.random.default_rng(seed)
        todo = [(np.arange(len(ids)), vectors.mean(axis=0), -1)]
        while todo:
            rows, center, parent = todo.pop()
            far = np.sqrt(((vectors[rows] - center) ** 2).sum(axis=1))
            up = float(np.sqrt(((center - self.nodes[parent].center) ** 2).sum())) if parent >= 0 else 0.0
            node = Node(center, float(far.max(initial=0.0)), up)
            self.nodes.append(node)
            if parent >= 0:
                self.nodes[parent].children.append(len(self.nodes) - 1)
            if len(rows) <= PAGE:
                node.rows, node.to_center = rows, far
                continue
            pivots = vectors[rng.choice(rows, FANOUT, replace=False)]
            near = ((pivots**2).sum(axis=1) - 2 * vectors[rows] @ pivots.T).argmin(axis=1)
            groups = [rows[near == k] for k in range(FANOUT)]
            if max(map(len, groups)) == len(rows):  # all alike: nothing tells them apart
                groups = np.array_split(rows, ceil(len(rows) / PAGE))
            todo += [(g, vectors[g].mean(axis=0), len(self.nodes) - 1) for g in groups if len(g)]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of each query's k best others of at least its score ``least``, by score, then id; places left over have id -1.

        q.x = q.c + q.(x - c) <= q.c + |q| d(x, c): a page's bound comes from its radius, and before its own
        q.c is computed, from its parent's q.c and the stored distance between both; so does a leaf
        entry's. Pages are taken in order of their best bound over the queries; queries whose k-th best score is
        above a page's bound leave it out. Equal scores count, as a smaller id may be there.
        """
        n = len(queries)
        floor = np.full(n, -np.inf) if least is None else least
        best = np.repeat(np.nextafter(floor, -np.inf)[:, None], k, axis=1)
        best_ids = np.full((n, k), np.iinfo(np.int64).max)
        norm = np.sqrt((queries**2).sum(axis=1))
        slack = 1e-6 * (1 + norm * (1 + max(np.sqrt((x.center**2).sum()) + x.radius for x in self.nodes)))
        at_root = queries @ self.nodes[0].center
        heap = [(-np.inf, 0, at_root, at_root + norm * self.nodes[0].radius)]
        while heap:
            _, i, dot, bound = heapq.heappop(heap)
            node = self.nodes[i]
            on = np.flatnonzero(bound + slack >= best[:, -1])
            if not len(on):
                continue
            if node.rows is None:
                least = best[on, -1] - slack[on]
                near = [c for c in node.children if (dot[on] + norm[on] * (self.nodes[c].to_parent + self.nodes[c].radius) >= least).any()]
                if near:
                    dots = queries @ np.stack([self.nodes[c].center for c in near]).T
                    for c, d in zip(near, dots.T, strict=True):
                        b = d + norm * self.nodes[c].radius
                        heapq.heappush(heap, (-float((b - best[:, -1]).max()), c, d, b))
                continue
            hopeful = dot[on, None] + norm[on, None] * node.to_center >= best[on, -1:] - slack[on, None]
            rows = node.rows[hopeful.any(axis=0)]
            if not len(rows):
                continue
            score = queries[on] @ self.vectors[rows].T
            ids = self.ids[rows]
            own = ids == query_ids[on, None]
            score[own] = -np.inf
            better = (score > best[on, -1:]) | (score == best[on, -1:]) & (ids < best_ids[on, -1:]) & ~own
            hit = np.flatnonzero(better.any(axis=1))
            if len(hit):
                q = on[hit]
                both = np.concatenate([best[q], score[hit]], axis=1)
                both_ids = np.concatenate([best_ids[q], np.where(own[hit], np.iinfo(np.int64).max, np.broadcast_to(ids, (len(hit), len(ids))))], axis=1)
                order = np.lexsort((both_ids, -both), axis=-1)[:, :k]
                best[q], best_ids[q] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)
        best_ids[best < floor[:, None]] = -1
        best_ids[np.isneginf(best)] = -1
        return best_ids, best


def _stack(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    f = f.sort_values("vec_id", kind="stable")
    return f["vec_id"].to_numpy(np.int64), np.stack(f["v"].to_numpy()).astype(np.float64)


def _grow(f: pd.DataFrame) -> pd.DataFrame:
    tree = MTree(*_stack(f))
    root = tree.nodes[0]
    return pd.DataFrame({"dim": f["dim"].iloc[:1], "shard": f["shard"].iloc[:1], "center": [root.center.tobytes()], "radius": [root.radius], "tree": [pickle.dumps(tree)]})


def _gather(f: pd.DataFrame) -> pd.DataFrame:
    ids, vectors = _stack(f)
    return pd.DataFrame({"dim": f["dim"].iloc[:1], "block": f["block"].iloc[:1], "shard": f["shard"].iloc[:1], "queries": [pickle.dumps((ids, vectors, np.full(len(ids), -np.inf)))]})


FOUND = "query_id bigint, vec_id bigint, score bigint"


def _rows(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
    there = ids >= 0
    return pd.DataFrame({"query_id": np.repeat(query_ids, there.sum(axis=1)), "vec_id": ids[there], "score": scores[there].astype(np.int64)})


def _own(k: int):
    """A block's search of the tree that is nearest to it: what it finds, and its queries with the k-th score that they have then."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        query_ids, vectors, _ = pickle.loads(f["queries"].iloc[0])
        ids, scores = pickle.loads(f["tree"].iloc[0]).search(query_ids, vectors, k)
        least = np.where(ids[:, -1] >= 0, scores[:, -1], -np.inf)
        found = pickle.dumps(_rows(query_ids, ids, scores))
        return pd.DataFrame({"dim": f["dim"].iloc[:1], "block": f["block"].iloc[:1], "shard": f["shard"].iloc[:1], "queries": [pickle.dumps((query_ids, vectors, least))], "found": [found]})

    return run


def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for found in f["found"]:
            yield pickle.loads(found)


def _hopeful(f: pd.DataFrame) -> pd.DataFrame:
    """Of a block and some trees' roots, the trees that may hold a better score than a query has: shard, and which queries."""
    _, vectors, least = pickle.loads(f["queries"].iloc[0])
    roots = f["roots"].iloc[0]
    centers = np.stack([np.frombuffer(r["center"], float) for r in roots])
    radius = np.array([r["radius"] for r in roots])
    norm = np.sqrt((vectors**2).sum(axis=1))[:, None]
    slack = 1e-6 * (1 + norm * (1 + np.sqrt((centers**2).sum(axis=1)) + radius))
    on = vectors @ centers.T + norm * radius + slack >= least[:, None]
    on[:, [r["shard"] == f["shard"].iloc[0] for r in roots]] = False  # its own is done
    at = np.flatnonzero(on.any(axis=0))
    return pd.DataFrame({"dim": f["dim"].iloc[0], "block": f["block"].iloc[0], "shard": [roots[i]["shard"] for i in at], "which": [np.flatnonzero(on[:, i]).astype("<i4").tobytes() for i in at]})


def _search(k: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        query_ids, vectors, least = pickle.loads(f["queries"].iloc[0])
        which = np.frombuffer(f["which"].iloc[0], "<i4")
        ids, scores = pickle.loads(f["tree"].iloc[0]).search(query_ids[which], vectors[which], k, least[which])
        return _rows(query_ids[which], ids, scores)

    return run


def _pivots(v: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Of each length of vectors, pivots fitted on a bounded sample: one for each tree, MOST_PIVOTS at most. They only deal rows to trees."""
    rows = v.select("dim", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toPandas()
    found = {}
    for dim, f in rows.groupby("dim"):
        x = np.stack(f["v"].to_numpy()).astype(float)
        count = min(MOST_PIVOTS, len(x), max(1, ceil(n / SHARD_ROWS)))
        p = x[:: max(1, len(x) // count)][:count]
        for _ in range(8):
            near = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            p = np.stack([x[near == k].mean(axis=0) if (near == k).any() else p[k] for k in range(len(p))])
        found[int(dim)] = p
    return found


def exact_top_k(vectors: DataFrame, k: int = 20, query_step: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query, whose vec_id query_step divides, with all other rows.

    Components are floor(64 x), so scores are whole numbers, exact in doubles up to 2**53. Rows are dealt to trees of about SHARD_ROWS
    rows by their nearest pivot, and by hash where more are near one; so are queries to blocks of about QUERY_BLOCK. Every block
    searches the tree of its own pivot first. The k-th score that a query has then is held against the bounds of all other
    trees' roots, and only trees that may hold a better one are searched, for those queries alone, which is the stated
    query set against all rows in blocks; a query's best of each tree are ranked at the end. A tree and a block are one group.

    A vector that is null, empty, or holds a null or non-finite component takes no part, nor does a null vec_id. Only
    vectors of equal length are compared. Rows that share a query's vec_id are its own, and no candidates for it. Equal
    vectors tie, and the smaller vec_id comes first. Fewer than k others: all of them. No rows: no rows. Scores beyond 2**53
    are rounded as doubles are.
    """
    bound_batches(vectors.sparkSession)
    whole = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull())
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), whole.alias("v"))
    n = vectors.count()
    pivots = _pivots(v, n)

    @F.pandas_udf("int")
    def nearest(dim: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(dim), np.int32)
        for d in dim.unique():
            p, at = pivots.get(int(d)), np.flatnonzero(dim == d)
            if p is not None:
                out[at] = ((p**2).sum(axis=1) - 2 * np.stack(x.iloc[at].to_numpy()) @ p.T).argmin(axis=1)
        return pd.Series(out)

    asks = F.pmod("vec_id", F.lit(query_step)) == 0
    v = materialize(v.withColumn("cell", nearest("dim", "v")), "vectors")
    sizes = v.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum(asks.cast("long")).alias("n_asks"))
    parts = sizes.select("dim", "cell", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("parts"), F.greatest(F.ceil(F.col("n_asks") / QUERY_BLOCK), F.lit(1)).cast("int").alias("blocks"))
    parts = materialize(parts, "parts")
    v = v.join(F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts, ["dim", "cell"])
    numbered = lambda part: (F.col("cell").cast("long") * (1 << 32) + part)
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    trees = v.withColumn("shard", numbered(dealt("parts"))).groupBy("dim", "shard").applyInPandas(_grow, "dim int, shard bigint, center binary, radius double, tree binary")
    trees = materialize(trees, "trees")
    asked = v.where(asks).withColumn("block", numbered(dealt("blocks"))).withColumn("shard", numbered(F.lit(0)))
    asked = materialize(asked.groupBy("dim", "block").applyInPandas(_gather, "dim int, block bigint, shard bigint, queries binary"), "queries")
    first = asked.join(trees.select("dim", "shard", "tree"), ["dim", "shard"], "left")
    first = first.where("tree is not null").groupBy("dim", "block").applyInPandas(_own(k), "dim int, block bigint, shard bigint, queries binary, found binary")
    first = materialize(asked.join(first.select("dim", "block", F.col("queries").alias("known"), "found"), ["dim", "block"], "left").select("dim", "block", F.when(F.col("found").isNotNull(), F.col("shard")).otherwise(-1).alias("shard"), F.coalesce("known", "queries").alias("queries"), "found"), "first-found")
    roots = trees.select("dim", "shard", "center", "radius").withColumn("step", F.pmod(F.xxhash64("shard"), F.lit(max(1, ceil(n / SHARD_ROWS / ROOTS_STEP)))))
    roots = roots.groupBy("dim", "step").agg(F.collect_list(F.struct("shard", "center", "radius")).alias("roots"))
    salts = max(1, ceil(first.count() / SALT_BLOCKS))
    roots = roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = first.drop("found").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    pairs = salted.join(roots, ["dim", "salt"]).drop("salt").groupBy("dim", "block", "step").applyInPandas(_hopeful, "dim int, block bigint, shard bigint, which binary")
    pairs = materialize(pairs, "hopeful")
    both = pairs.join(first.select("dim", "block", "queries"), ["dim", "block"]).join(trees.select("dim", "shard", "tree"), ["dim", "shard"])
    found = both.groupBy("dim", "shard", "block").applyInPandas(_search(k), FOUND).unionByName(first.where("found is not null").select("found").mapInPandas(_unpacked, FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
