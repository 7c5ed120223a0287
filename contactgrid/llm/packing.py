"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid.llm.common import bound_batches, free_worker_caches, give_back, materialize, worker_cache
from contactgrid.llm.tokens import RunTokenizer

CAPACITY = 4096
#: The id after each document's ids.
END_ID = 1
#: Pieces that one shard holds, on average. Each shard is a packing problem of its own.
SHARD_PIECES = 4096
ISLANDS, EPOCHS, POPULATION, CHILDREN = 2, 3, 5, 30
#: The share of the other parent's full bins that a crossover injects, and that of the child's other bins that it takes apart.
INJECTED, DISSOLVED = 0.25, 0.3
#: Of each shard, the least filled sequences, up to so many pieces, are packed once more together with those of so many other shards.
LOOSE_PIECES, LOOSE_SHARDS = 256, 16

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@worker_cache
def _tokenizer(path: str) -> RunTokenizer:
    """One for each worker process, so that its cache serves all the tasks that the worker runs."""
    return RunTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32. Null text counts as empty: one piece with the end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            for first, ids, ends in tokenizer.encode(batch.column(1)):
                n = np.diff(ends, prepend=0)
                ids = np.insert(ids, ends, END_ID).astype("<u4")
                begin, n = ends - n + np.arange(len(n)), n + 1
                parts = -(-n // capacity)
                of = np.repeat(np.arange(len(n)), parts)
                k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = k * capacity
                length = np.minimum(n[of] - start, capacity)
                raw, at = memoryview(ids).cast("B"), 4 * (begin[of] + start)
                crc = [zlib.crc32(raw[a : a + x]) for a, x in zip(at.tolist(), (4 * length).tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(first + of)), pa.array(k, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class Grouping:
    """Bins of item numbers with their loads; the items' lengths are shared."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.lengths, self.capacity = lengths, capacity
        self.bins = bins or []
        self.loads = [sum(lengths[i] for i in b) for b in self.bins]

    def best_fit(self, items: list[int]) -> None:
        """Puts items, the longest first, each into the bin that it fills best, or a new one."""
        room = sorted((self.capacity - load, k) for k, load in enumerate(self.loads) if load < self.capacity)
        for i in sorted(items, key=lambda i: (-self.lengths[i], i)):
            n = self.lengths[i]
            at = bisect_left(room, (n, -1))
            if at == len(room):
                self.bins.append([i])
                self.loads.append(n)
                left, k = self.capacity, len(self.bins) - 1
            else:
                left, k = room.pop(at)
                self.bins[k].append(i)
                self.loads[k] += n
            if left > n:
                insort(room, (left - n, k))

    def fill(self, items: list[int]) -> list[int]:
        """Swaps members of bins with room for items that fill these exactly; returns the items that are left over then."""
        by_length: dict[int, list[int]] = {}
        for i in items:
            by_length.setdefault(self.lengths[i], []).append(i)
        for k, load in enumerate(self.loads):
            room = self.capacity - load
            for at, i in enumerate(self.bins[k] if room > 0 else ()):
                if fitting := by_length.get(self.lengths[i] + room):
                    self.bins[k][at] = fitting.pop()
                    self.loads[k] = self.capacity
                    by_length.setdefault(self.lengths[i], []).append(i)
                    break
        return [i for same in by_length.values() for i in same]

    def rank(self) -> tuple[int, int]:
        """The number of bins, then the room outside the emptiest one: least is best, and (n, 0) as good as can be."""
        room = [max(0, self.capacity - x) for x in self.loads]
        return len(room), sum(room) - max(room, default=0)

    def crossover(self, other: Grouping, rng: random.Random) -> Grouping:
        """Injects whole well-filled bins of the other parent, removes the bins that share members with them, best-fits what these leave.

        The emptiest bins, and some of the others with room, are taken apart too, so that there is something to fit.
        """
        best = [k for k, x in enumerate(other.loads) if x >= self.capacity and len(other.bins[k]) > 1]
        best = best or sorted(range(len(other.bins)), key=lambda k: -other.loads[k])[: ceil(len(other.bins) / 4)]
        injected = [list(other.bins[k]) for k in rng.sample(best, ceil(len(best) * INJECTED))]
        doubled = {i for b in injected for i in b}
        with_room = sorted((k for k, x in enumerate(self.loads) if x < self.capacity), key=lambda k: self.loads[k])
        apart = {*with_room[:2], *rng.sample(with_room, int(len(with_room) * DISSOLVED))}
        keep, displaced = [], []
        for k, b in enumerate(self.bins):
            if k in apart or not doubled.isdisjoint(b):
                displaced += [i for i in b if i not in doubled]
            else:
                keep.append(list(b))
        child = Grouping(self.lengths, self.capacity, keep + injected)
        child.best_fit(child.fill(displaced))
        return child

    def labels(self) -> np.ndarray:
        found = np.empty(len(self.lengths), "<i4")
        for k, b in enumerate(self.bins):
            found[b] = k
        return found

    @classmethod
    def of(cls, lengths: list[int], capacity: int, labels: np.ndarray) -> Grouping:
        bins: list[list[int]] = [[] for _ in range(int(labels.max(initial=-1)) + 1)]
        for i, k in enumerate(labels.tolist()):
            bins[k].append(i)
        return cls(lengths, capacity, [b for b in bins if b])

    @classmethod
    def start(cls, lengths: list[int], capacity: int, rng: random.Random, first: float) -> Grouping:
        """Best-fit in decreasing order of lengths; a random share of the items goes first."""
        g = cls(lengths, capacity)
        early = [i for i in range(len(lengths)) if first and rng.random() < first]
        g.best_fit(early)
        g.best_fit(sorted(set(range(len(lengths))).difference(early)))
        return g


def evolve(lengths: list[int], capacity: int, population: list[Grouping], rng: random.Random, children: int = CHILDREN) -> list[Grouping]:
    """One epoch of an island; the fittest come first. It ends early where no packing can be better."""
    least = (ceil(sum(min(n, capacity) for n in lengths) / capacity), 0)
    ranked = [(g.rank(), g) for g in population]
    if not ranked:
        starts = [Grouping.start(lengths, capacity, rng, 0.0)]
        if starts[0].rank() > least:
            starts += [Grouping.start(lengths, capacity, rng, 0.3 * rng.random()) for _ in range(POPULATION - 1)]
        ranked = [(g.rank(), g) for g in starts]
    ranked = sorted(ranked, key=lambda x: x[0])[:POPULATION]
    for _ in range(children if len(ranked) > 1 else 0):
        if ranked[0][0] <= least:
            break
        a, b = sorted(rng.sample(range(len(ranked)), 2))
        child = ranked[a][1].crossover(ranked[b][1], rng)
        rank = child.rank()
        if rank < ranked[-1][0] and all(rank != r for r, _ in ranked):
            ranked[-1] = (rank, child)
            ranked.sort(key=lambda x: x[0])
    return [g for _, g in ranked]


ISLAND = "shard bigint, island int, lengths binary, groupings array<binary>"


def _epoch(capacity: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free_worker_caches()
        for f in frames:
            kept = []
            for shard, island, raw, groupings in zip(f["shard"], f["island"], f["lengths"], f["groupings"], strict=True):
                lengths = np.frombuffer(raw, "<i4").tolist()
                rng = random.Random(f"{seed} {shard} {island}")
                before = [Grouping.of(lengths, capacity, np.frombuffer(g, "<i4")) for g in groupings]
                kept.append([g.labels().tobytes() for g in evolve(lengths, capacity, before, rng)])
            yield f.assign(groupings=kept)

    return run


_ORDER = ["length", "doc_id", "piece", "start", "ids_crc32"]


def _sorted(f: pd.DataFrame) -> pd.DataFrame:
    """The same order of a shard's pieces whenever it is met; pieces that tie are alike."""
    return f.sort_values(_ORDER, ascending=[False, True, True, True, True], na_position="last", kind="stable")


def pack(parts: DataFrame, capacity: int = CAPACITY, seed: int = 11) -> DataFrame:
    """Pieces, as of pieces(), with sequence_id and offset, in as few sequences of at most ``capacity`` as found.

    The pieces are dealt to shards at random, SHARD_PIECES on average, so no key makes a large one. Each shard has
    ISLANDS populations of groupings, which evolve for EPOCHS epochs; between epochs each island gets the
    next one's elites. Fewer sequences win, then those whose room is in one of them. The fittest grouping holds, but for a
    shard's least filled sequences, which are packed again, by the same evolution, with those of LOOSE_SHARDS
    shards. Shards are rows and groups of bounded size; their number grows with the input.
    Pieces of capacity or, should there be such, more are sequences of their own. Equal rows are pieces of their own.
    """
    parts = parts.withColumns({"doc_id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()})
    parts = materialize(parts, "pieces")
    shards = max(1, ceil(parts.count() / SHARD_PIECES))
    parts = materialize(parts.withColumn("shard", F.floor(F.rand(seed) * shards).cast("long")), "shards")
    lengths = lambda f: pd.DataFrame({"shard": [f["shard"].iloc[0]], "lengths": [_sorted(f)["length"].to_numpy("<i4").tobytes()]})
    shard_lengths = materialize(parts.select("shard", *_ORDER).groupBy("shard").applyInPandas(lengths, "shard bigint, lengths binary"), "shard-lengths")
    islands = shard_lengths.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", F.array().cast("array<binary>").alias("groupings"))
    for epoch in range(EPOCHS):
        if epoch:
            elites = islands.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("groupings", 1, 2).alias("elites"))
            islands = islands.join(elites, ["shard", "island"]).select("shard", "island", "lengths", F.concat("elites", "groupings").alias("groupings"))
        islands = materialize(islands.mapInPandas(_epoch(capacity, seed + epoch), ISLAND), "islands")
    best = islands.groupBy("shard").applyInPandas(_fittest(capacity), "shard bigint, labels binary")

    def settle(key: tuple, f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        f = _sorted(f)
        f["bin"] = np.frombuffer(g["labels"].iloc[0], "<i4").astype("int64")
        return _placed(f, capacity)

    kind = f"{PIECES}, no_id boolean, shard bigint, bin bigint, offset bigint, loose boolean"
    placed = parts.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(settle, kind)
    placed = materialize(placed, "placed")

    def again(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = _sorted(f)
        sizes = f["length"].tolist()
        f["bin"] = evolve(sizes, capacity, [], random.Random(f"{seed} {key[0]}"), EPOCHS * CHILDREN)[0].labels().astype("int64")
        f["shard"] = -1 - key[0]
        return _placed(f, capacity)

    loose = placed.where("loose").groupBy(F.floor(F.col("shard") / LOOSE_SHARDS).cast("long").alias("group")).applyInPandas(again, kind)
    doc_id = F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")
    columns = [doc_id, "piece", "start", "length", "ids_crc32", (F.col("shard") * (1 << 22) + F.col("bin")).alias("sequence_id"), "offset"]
    return placed.where("not loose").select(*columns).unionByName(loose.select(*columns))


def _fittest(capacity: int):
    def choose(f: pd.DataFrame) -> pd.DataFrame:
        sizes = np.frombuffer(f["lengths"].iloc[0], "<i4").tolist()
        found = [g[0] for _, g in sorted(zip(f["island"], f["groupings"], strict=True), key=lambda x: x[0]) if len(g)]
        best = min(found, key=lambda g: Grouping.of(sizes, capacity, np.frombuffer(g, "<i4")).rank())
        return pd.DataFrame({"shard": [f["shard"].iloc[0]], "labels": [best]})

    return choose


def _placed(f: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """offset within each bin, and which bins are loose: the least filled ones, while they have few pieces."""
    by_bin = f.groupby("bin", sort=False)["length"]
    f["offset"] = by_bin.cumsum() - f["length"]
    fill = by_bin.agg(["sum", "count"]).sort_values("sum", kind="stable")
    few = fill[(fill["sum"] < capacity) & (fill["count"].cumsum() <= LOOSE_PIECES)].index
    f["loose"] = f["bin"].isin(few)
    return f


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more tokens are cut. Null or empty text: the end id alone. Equal doc_ids and repeated
    rows are documents of their own. No rows: no rows. Columns other than doc_id and text play no part.
    """
    return pack(pieces(docs, tokenizer_path or default_tokenizer(), capacity), capacity)
