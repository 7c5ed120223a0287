"""Main text of pages: markup, and runs that a host repeats from page to page."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid.llm.common import bound_batches, materialize
from contactgrid.llm.html_blocks import candidate_blocks
from contactgrid.llm.shingles import WordHasher, mix

#: Tokens of a suffix that are compared: runs of so many that pages share count as repeated.
RUN_TOKENS = 8
#: Of so many suffixes in a row in a block, the one of the smallest key, at least, is a seed. So a run of RUN_TOKENS + SEED_WINDOW - 1 tokens has a seed wherever it stands.
SEED_WINDOW = 12
#: Distinct pages of a host that a run has to be on.
MIN_PAGES = 3
#: Tables of repeated runs, or of blocks that they change, of up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _stamp(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


def suffix_keys(hasher: WordHasher, hosts: list[str], pages: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each page, the block and the key of each of its suffixes, in page order.

    A suffix's key is the hash of the host and the suffix's first RUN_TOKENS tokens; suffixes of equal keys are neighbours
    in the host's suffix array. Keys end with their block: one of n tokens has n - RUN_TOKENS + 1 keys, and a
    shorter block is one key of its own. So a block has the same keys whatever stands around it.
    """
    raw = [b.encode(errors="replace") for blocks in pages for b in blocks]
    if not raw:
        return [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in pages]
    words, block = hasher.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]))
    h, inside = np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
    for k in range(RUN_TOKENS):
        inside = np.zeros(len(words), bool)
        n = max(len(words) - k, 0)  # a batch may have fewer words than a run
        inside[:n] = block[k:] == block[:n]
        at = np.flatnonzero(inside)
        h[at] = h[at] * np.uint64(0x9E3779B97F4A7C15) + words[at + k]
    chosen = inside | np.append(True, block[1:] != block[:-1])
    seeds = np.array([zlib.crc32(x.encode()) << 32 | zlib.adler32(x.encode()) for x in hosts], np.uint64)
    counts = [len(b) for b in pages]
    page, first = np.repeat(np.arange(len(pages)), counts), np.cumsum(counts) - counts
    block = block[chosen]
    key = mix(h[chosen] ^ mix(seeds)[page[block]]).view(np.int64)
    cuts = np.searchsorted(page[block], np.arange(1, len(pages)))
    return [(b - n, k) for b, k, n in zip(np.split(block, cuts), np.split(key, cuts), first, strict=True)]


def seeds(keys: np.ndarray, window: int = SEED_WINDOW) -> np.ndarray:
    """The smallest key of each ``window`` neighbours of a block's keys; of a block with fewer, its smallest."""
    if len(keys) <= window:
        return keys.min(keepdims=True) if len(keys) else keys
    return np.unique(np.lib.stride_tricks.sliding_window_view(keys, window).min(axis=1))


def without_runs(block: str, keys: list[int], gone: set[int]) -> str:
    """A block, whose suffix_keys() these are, without the tokens that any run in gone covers."""
    tokens = block.split(" ")
    covered = {j for i, k in enumerate(keys) if k in gone for j in range(i, i + RUN_TOKENS)}
    return " ".join(t for j, t in enumerate(tokens) if j not in covered)


def _steps(batch: pa.RecordBatch, n: int = 200) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, n):
        yield batch.slice(i, n)


class _Page:
    """A page's blocks with their suffixes' keys: texts, whether each may be the article's (kept), whether markup says so (inside)."""

    def __init__(self, stamp: int, texts: list[str], kept: list[bool], inside: list[bool], numbers: np.ndarray, keys: np.ndarray):
        self.stamp, self.texts, self.kept, self.inside = stamp, texts, kept, inside
        self.keys = np.split(keys, np.searchsorted(numbers, np.arange(1, len(texts)))) if texts else []


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[list[_Page]]:
    hasher = WordHasher()
    for batch in batches:
        for part in _steps(batch):
            stamps, urls, *of = (part.column(c).to_pylist() for c in ("page", "url", "blocks", "kept", "inside"))
            keys = suffix_keys(hasher, [host(u) for u in urls], of[0])
            yield [_Page(*x, *k) for *x, k in zip(stamps, *of, keys, strict=True)]


def _batch(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [x.split() for x in kind.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


SEED = "key bigint, page bigint"
BLOCK = "page bigint, block int, text string, kept boolean, inside boolean, seeds array<bigint>, keys array<bigint>"
PARSED = "page_id bigint, url string, page bigint, blocks array<string>, kept array<boolean>, inside array<boolean>"


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each page, and a hash of its host and blocks."""
    for batch in batches:
        for part in _steps(batch):
            ids, urls, pages = (part.column(c).to_pylist() for c in ("page_id", "url", "html"))
            rows = []
            for i, u, page in zip(ids, urls, pages, strict=True):
                blocks = candidate_blocks(page)
                rows.append((i, u, _stamp("\n".join([host(u), *(b[0] for b in blocks)])), *([b[k] for b in blocks] for k in range(3))))
            yield _batch(PARSED, rows)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct seeds of each page."""
    for pages in _pages(batches):
        found = [np.unique(np.concatenate([seeds(k) for k in p.keys])) if p.keys else np.empty(0, np.int64) for p in pages]
        stamps = np.repeat(np.array([p.stamp for p in pages], np.int64), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64()), pa.array(stamps)], ["key", "page"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pages in _pages(batches):
        at = _batch("page bigint, block int, text string, kept boolean, inside boolean", [(p.stamp, n, *x) for p in pages for n, x in enumerate(zip(p.texts, p.kept, p.inside, strict=True))])
        keys = [k for p in pages for k in p.keys]
        yield pa.RecordBatch.from_arrays([*at.columns, _lists([seeds(k) for k in keys]), _lists(keys)], [*at.schema.names, "seeds", "keys"])


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of = [batch.column(c).to_pylist() for c in ("text", "keys", "gone")]
        texts = [without_runs(t, k, set(g)) for t, k, g in zip(*of, strict=True)]
        kept, inside = batch.column("kept"), batch.column("inside")
        yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("block"), pa.array(texts, pa.string()), kept, inside], ["page", "block", "text", "kept", "inside"])


def repeated_runs(pages: DataFrame, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """Of pages as _parsed() gives them, the runs that distinct pages of a host repeat, by key, with the number of pages (n) and of those where markup has them in the article (n_inside); and the blocks that hold any.

    Suffixes are dealt to buckets by their hosts' and first RUN_TOKENS tokens' hash, so that those of one bucket are
    neighbours in the host's suffix array, with that much in common, and no host is in one task. All suffixes of all pages are
    many times the pages' size. So seeds alone are counted first: few of a block's suffixes, the same
    wherever a run stands. Then, of blocks with a seed that pages repeat, all suffixes are.
    """
    counts = pages.mapInArrow(_seeds, SEED).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(counts.where(F.col("n") >= max(min_pages, 2)).select("key"), "repeated-seeds")
    few = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    blocks = pages.mapInArrow(_blocks, BLOCK).withColumn("key", F.explode("seeds")).join(few, "key").drop("key", "seeds").dropDuplicates(["page", "block"])
    blocks = materialize(blocks, "repeated-blocks")
    runs = blocks.select(F.explode(F.array_distinct("keys")).alias("key"), "page", "inside").groupBy("key", "page").agg(F.max("inside").alias("inside"))
    runs = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("inside").cast("long")).alias("n_inside"))
    return materialize(runs.where(F.col("n") >= max(min_pages, 2)), "repeated-runs"), blocks


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of each page; n_repeated, of its distinct blocks those with a run that the host's array finds repeated, and n_told, of these those that markup has in the article.

    The runs are those of one suffix array a host, over all blocks of all its pages: see repeated_runs(). Tokens go that a run covers which
    stands on min_pages distinct pages of the host, unless on most of these markup has it in the article. Pages that show
    the same count as one, so copies of a page don't make it repeated.

    Markup is the check behind that: it leaves out blocks in parts that are named as menus, notices, comments and so on, and where a page
    has an article (or else a main element), what stands in it is the text, and nothing else. What the array would cut there comes back: passages that articles share,
    and sentences that other pages quote in adverts or footers, are the article's. runs_cut tells whether the cuts changed the text.

    Null, empty or textless html: empty text. Null url: a host of its own. Rows that share page_id keep their
    own texts. No rows: no rows. Columns other than page_id, url and html play no part.
    """
    bound_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    p = materialize(p.mapInArrow(_parsed, PARSED), "page-blocks")  # read three times
    runs, blocks = repeated_runs(p, min_pages)
    gone = runs.where("2 * n_inside <= n").select("key")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    at = blocks.select("page", "block", F.explode(F.array_distinct("keys")).alias("key"))
    covered = at.join(gone, "key").groupBy("page", "block").agg(F.collect_set("key").alias("gone"))
    cut = blocks.join(covered, ["page", "block"]).select("page", "block", "text", "kept", "inside", "keys", "gone").mapInArrow(_changed, "page bigint, block int, text string, kept boolean, inside boolean")
    own = F.when(F.col("kept") & ~F.col("inside"), F.struct("block", "text"))
    changed = cut.groupBy("page").agg(F.map_from_entries(F.collect_list(own)).alias("changed"), F.count(F.lit(1)).alias("n_repeated"), F.count_if("inside").alias("n_told"))
    changed = materialize(changed, "changed-blocks")
    few = F.broadcast(changed) if changed.count() <= BROADCAST_ROWS else changed
    texts = p.join(few, "page", "left")
    text = F.transform("blocks", lambda t, n: F.when(F.get("kept", n), F.coalesce(F.try_element_at(F.col("changed"), n), t)).otherwise(""))
    text = F.array_join(F.filter(text, lambda t: t != ""), "\n")
    counts = (F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_repeated", "n_told"))
    return texts.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.coalesce(F.size("changed") > 0, F.lit(False)).alias("runs_cut"), *counts)
