"""Phrases whose words stand together, mined by SETM: relations of occurrences, joined with themselves, counted, and cut to their frequent groups."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactgrid.llm.common import materialize
from contactgrid.tables import discard, mark

LONGEST, LEAST_COUNT, BEST, SHARE = 4, 30, 2_000, 80
#: Words of a block of the occurrence relation, about; and bytes of a text that are cut into words together.
BLOCK_WORDS, STEP_BYTES = 1 << 22, 1 << 22
#: Phrases of blocks that are counted together in one part, about.
PART_PHRASES = 1 << 21
#: Bits of a block's number inside its task, and of a phrase's number inside its part.
TASK_BITS, PART_BITS = 16, 32
#: Parts of a language that are ranked before the parts' best are ranked together.
RANK_PARTS = 64

_END = b"\xff"
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _END * 10)
#: Of a block: its occurrences (n of them: at, number) and its phrases (k of them, by number: words, or the ids a and b; counts), packed by columns.
BLOCKS = "block long, lang string, n long, at binary, number binary, k long, words binary, a binary, b binary, counts binary"
DEALT = "part long, block long, lang string, k long, number binary, words binary, a binary, b binary, counts binary"
COUNTED = "block long, k long, number binary, ids binary, id long, lang string, word string, a long, b long, f long"


def _pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers by the bytes of equal weight, compressed; rising ones by their steps."""
    x = np.diff(x, prepend=0) if rising else x
    return pa.compress(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, n: int, rising: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T).view("<i8").ravel()
    return np.cumsum(x) if rising else x


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(*(kinds.get(w, w) for w in c.split())) for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in fields], schema=pa.schema(fields))


class _Block:
    """The occurrences of one language in a block: words get numbers as they come, and the end of a piece is one of them."""

    def __init__(self):
        self.number = defaultdict(count().__next__)
        self.end = self.number[_END]
        self.parts: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        text, start, size = text.lower().translate(_CUT), 0, 0
        while start < len(text):  # by whole pieces, so that a long text isn't a long list
            stop = text.find(_END, start + STEP_BYTES)
            stop = len(text) if stop < 0 else stop
            found = text[start:stop].replace(_END, b" \xff ").split()
            found.append(_END)
            self.parts.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
            size, start = size + len(found), stop
        return size

    def row(self, block: int, lang: str) -> dict | None:
        everything = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        at = np.flatnonzero(everything != self.end)
        if not len(at):
            return None
        number = everything[at] - 1  # the end has 0
        words = list(self.number)[1:]
        return {
            "block": block, "lang": lang, "n": len(at), "at": _pack(at, True), "number": _pack(number),
            "k": len(words), "words": b" ".join(words), "counts": _pack(np.bincount(number, minlength=len(words))),
        }


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks, size, made = defaultdict(_Block), 0, TaskContext.get().partitionId() << TASK_BITS

    def flush():
        nonlocal made
        for lang, block in blocks.items():
            row = block.row(made, lang)
            if row is not None:
                made += 1
                yield _batch([row], BLOCKS)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            size += blocks[lang].add(text)
            if size >= BLOCK_WORDS:
                yield from flush()
                blocks, size = defaultdict(_Block), 0
    yield from flush()


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, the occurrences of frequent phrases, sorted by place, merged with themselves at the next place: pairs that overlap but for one word."""
    for batch in batches:
        for row in batch.to_pylist():
            at, number = _unpack(row["at"], row["n"], True), _unpack(row["number"], row["n"])
            ids = np.concatenate([_unpack(x["ids"], x["k"], True) for x in row["frequent"]])
            order = np.argsort(ids)
            ids, name = ids[order], np.full(int(number.max()) + 1, -1, np.int64)  # -1: not frequent
            name[np.concatenate([_unpack(x["number"], x["k"]) for x in row["frequent"]])[order]] = np.arange(len(ids))
            number = name[number]
            at, number = at[number >= 0], number[number >= 0]
            left = np.flatnonzero(at[1:] == at[:-1] + 1)
            if len(left):
                pairs, new, counts = np.unique(number[left] * len(ids) + number[left + 1], return_inverse=True, return_counts=True)
                phrases = {"k": len(pairs), "a": _pack(ids[pairs // len(ids)], True), "b": _pack(ids[pairs % len(ids)]), "counts": _pack(counts)}
                yield _batch([{"block": row["block"], "n": len(left), "at": _pack(at[left], True), "number": _pack(new), **phrases}], BLOCKS)


def _deal(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Each block's phrases with their counts, dealt by hash to parts: a row for each part that gets any."""
    for batch in batches:
        for row in batch.to_pylist():
            k, counts = row["k"], _unpack(row["counts"], row["k"])
            words = row["words"].split(b" ") if row["words"] is not None else None
            if words:
                part = np.fromiter(map(crc32, words), np.int64, k) % parts
            else:
                a, b = _unpack(row["a"], k, True), _unpack(row["b"], k)
                mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True])
            out = []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                mine = order[low:high]
                told = {"words": zlib.compress(b" ".join(words[i] for i in mine.tolist()), 1)} if words else {"a": _pack(a[mine], True), "b": _pack(b[mine])}
                out.append({"part": int(part[mine[0]]), "block": row["block"], "lang": row["lang"], "k": len(mine), "number": _pack(mine, True), "counts": _pack(counts[mine]), **told})
            yield _batch(out, DEALT)


def _count(dealt: pa.Table, least: int) -> pa.Table:
    """The group count of one part: the frequent phrases (id, lang and word or a and b, f), and of each block its own ones (number, ids)."""
    rows = dealt.select(["block", "part", "lang", "k", "number", "words", "a", "b", "counts"]).to_pylist()
    sizes = np.array([r["k"] for r in rows])
    counts = np.concatenate([_unpack(r["counts"], r["k"]) for r in rows])
    if rows[0]["words"] is not None:
        langs, lang = np.unique([r["lang"] for r in rows], return_inverse=True)
        found = pa.array([w for r in rows for w in zlib.decompress(r["words"]).split(b" ")], pa.binary()).dictionary_encode()
        first, second, words = np.repeat(lang, sizes), found.indices.to_numpy().astype(np.int64), found.dictionary
    else:
        (firsts, first), (seconds, second) = (np.unique(np.concatenate(x), return_inverse=True) for x in (
            [_unpack(r["a"], r["k"], True) for r in rows], [_unpack(r["b"], r["k"]) for r in rows]))
    key, group = np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)
    f = np.bincount(group, counts).astype(np.int64)
    frequent = np.flatnonzero(f >= least)
    ids = np.full(len(f), -1, np.int64)
    ids[frequent] = (rows[0]["part"] << PART_BITS) + np.arange(len(frequent))
    x, y = key[frequent] // (int(second.max()) + 1), key[frequent] % (int(second.max()) + 1)
    one = {"id": pa.array(ids[frequent]), "f": pa.array(f[frequent])}
    if rows[0]["words"] is not None:
        one |= {"lang": pa.array(langs[x].astype(object), pa.string()), "word": words.take(pa.array(y)).cast(pa.string())}
    else:
        one |= {"a": pa.array(firsts[x]), "b": pa.array(seconds[y])}
    mine, low = [], 0
    for r, size in zip(rows, sizes.tolist(), strict=True):
        own = ids[group[low : low + size]]
        low += size
        kept = np.flatnonzero(own >= 0)
        if len(kept):
            order = kept[np.argsort(own[kept])]
            mine.append({"block": r["block"], "k": len(kept), "ids": _pack(own[order], True), "number": _pack(_unpack(r["number"], size, True)[order])})
    blocks = _batch(mine, COUNTED)
    groups = [one.get(f.name, pa.nulls(len(frequent), f.type)) for f in blocks.schema]
    return pa.Table.from_batches([blocks, pa.RecordBatch.from_arrays(groups, schema=blocks.schema)])


def _frequent(blocks: DataFrame, least: int) -> DataFrame:
    """The phrases of all blocks that occur ``least`` times together, and of each block which of its own these are: COUNTED rows of either kind."""
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("k")).first()[0] or 0
    parts = max(total // PART_PHRASES + 1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.select("block", "lang", "k", "words", "a", "b", "counts").mapInArrow(lambda batches: _deal(batches, parts), DEALT)
    return dealt.groupBy("part").applyInArrow(lambda part: _count(part, least), COUNTED)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> tuple[DataFrame, list[DataFrame]]:
    """SETM: (lang, n) and, of each length from 1 to ``longest``, the frequent phrases.

    Occurrences are a relation of (block, place, phrase), sorted by place and stored: about 4 million words a block, packed by
    columns, with a place left free after each piece. Each length is one round: a block's relation is cut to the
    frequent phrases of the length before (a semi-join by the block's own list of them), merged with itself at the next place, and its pairs are counted.
    The counts of all blocks are summed by one shuffle: phrases are dealt by hash to parts of about ``PART_PHRASES``, where a phrase is at most
    one entry a block, however frequent it is; only numbers packed by columns are shuffled.
    Lists: of length 1 (id, lang, word, f), of others (id, a, b, f), where a and b are the ids of the phrase without its last and its first word.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    held, at = materialize(texts.mapInArrow(_occurrences, BLOCKS), "occurrences-1"), mark() - 1
    totals = materialize(held.groupBy("lang").agg(F.sum("n").alias("n")), "words-by-lang")
    groups = []
    for k in range(1, longest + 1):
        found = materialize(_frequent(held, least), f"frequent-{k}")
        groups.append(found.where("id is not null").select("id", *(["lang", "word"] if k == 1 else ["a", "b"]), "f"))
        if k < longest:
            lists = found.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("k", "number", "ids")).alias("frequent"))
            joined = held.select("block", "n", "at", "number").join(lists, "block")
            held = materialize(joined.mapInArrow(_extend, BLOCKS), f"occurrences-{k + 1}")
            discard(docs.sparkSession, at, keep=mark() - at - 1)  # the shorter phrases' occurrences alone
            at = mark() - 1
    return totals, groups


def _spelled(groups: list[DataFrame]) -> list[DataFrame]:
    """The phrases of each length with their words, and heads and tails: the counts of their first 1, 2, … and last 1, 2, … words."""
    none = F.array().cast("array<bigint>")
    out = [groups[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails"))]
    for g in groups[1:]:
        x, y = out[-1].alias("x"), out[-1].alias("y")
        both = g.alias("g").join(x, F.col("g.a") == F.col("x.id")).join(y, F.col("g.b") == F.col("y.id"))
        phrase = F.concat_ws(" ", "x.phrase", "y.last")
        grown = lambda side, c: F.concat(F.col(f"{side}.{c}"), F.array(f"{side}.f"))
        spelled = both.select("g.id", "x.lang", phrase.alias("phrase"), "y.last", "g.f", grown("x", "heads").alias("heads"), grown("y", "tails").alias("tails"))
        out.append(materialize(spelled, f"phrases-{len(out) + 1}"))
    return out


def _lowest_cut(length: int) -> Column:
    """(score, k, l, r) of the cut with the lowest score, by exact integer division; of equal ones the first."""
    wide = lambda c: c.cast("decimal(20,0)")
    cuts = []
    for k in range(1, length):
        left, right = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(length - k - 1))
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide(F.col("f")), wide(left) + wide(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, best: int = BEST, share: int = SHARE) -> DataFrame:
    """The best phrases of 2 to ``longest`` words by language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts split at ``.,;:!?`` and line ends into pieces, these at spaces and tabs into words; a phrase stays in a piece. a is the count
    of a phrase that occurs ``least`` times, n its language's words. A phrase cut in two whose parts occur l and r times scores floor(2000000 a / (l + r)); its lowest cut counts.
    A phrase inside a longer one that occurs at least ``share`` percent as often goes; as counts fall with length, the next longer ones tell.
    The first ``best`` of a language by score, count and phrase (in byte order) are returned; they are ranked in parts first, so that no task sorts a whole language.

    Null or empty text: no words. Null lang: ``und``, together with rows that say so. Repeated rows count as often as they stand. Other columns are not read. No rows, or
    no phrase frequent enough: no rows.
    """
    totals, groups = phrase_counts(docs, longest, least)
    spelled, out = _spelled(groups), None
    for length in range(2, longest + 1):
        c = spelled[length - 1].withColumn("cut", _lowest_cut(length)).select("id", "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        if length < longest:
            g = groups[length]
            inside = g.select(F.col("a").alias("id"), "f").unionByName(g.select(F.col("b").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("longer"))
            c = c.join(inside, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
        c = c.select("lang", "phrase", "a", "l", "r", "score")
        out = c if out is None else out.unionByName(c)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = out.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = first.drop("part", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
