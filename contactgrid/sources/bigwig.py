"""Tracks in indexed binary files (S30, S31, A30): a data source that reads only the sections a range needs, and the job that writes a file.

    bigwig.track(spark, path).where("chr = 'a' and x2 > 500 and x1 < 900")
    bigwig.track(spark, path, zoom=1)   # the first level of summaries

A file has a tree of chromosomes, sections of values, compressed, under a tree of their ranges, and, for each zoom level, sections of summaries under
one of their own. The planner reads the inner nodes of the tree that overlap what is asked; tasks read leaves, and the sections of them that overlap.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from contactgrid.sources.container import _file
from contactgrid.sources.container_format import _put
from contactgrid.tables import written

#: The marks of files, chromosome trees and range trees; lengths of heads, of entries of inner nodes and leaves, and of a summary.
FILE_MARK, NAMES_MARK, RANGES_MARK = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
HEAD, ZOOM_HEAD, TREE_HEAD, INNER, LEAF, SECTION_HEAD, SUMMARY = 64, 24, 48, 24, 32, 24, 32
#: Values of a section, entries of a node, and leaves that a task reads, at most.
SECTION_VALUES, NODE_ENTRIES, TASK_LEAVES = 1_024, 256, 16
VALUES = "chr string, x1 long, x2 long, score double"
SUMMARIES = "chr string, x1 long, x2 long, n long, low double, high double, total double, squares double"
_BOUNDS = np.dtype([("c1", "<u4"), ("b1", "<u4"), ("c2", "<u4"), ("b2", "<u4"), ("at", "<u8"), ("size", "<u8")])
_ITEMS = np.dtype([("x1", "<u4"), ("x2", "<u4"), ("v", "<f4")])
_SUMMED = np.dtype([("c", "<u4"), ("x1", "<u4"), ("x2", "<u4"), ("n", "<u4"), ("low", "<f4"), ("high", "<f4"), ("total", "<f4"), ("squares", "<f4")])
FAR = 2**32 - 1


@dataclass
class Leaves(InputPartition):
    places: list[int]


def _head(f) -> dict:
    mark, version, zooms, names, data, index, _, _, _, summary, size, _ = struct.unpack("<IHHQQQHHQQIQ", f.read_at(HEAD, 0))
    if mark != FILE_MARK:
        raise ValueError("not a track file of this kind, or of the other byte order")
    levels = [struct.unpack("<IIQQ", f.read_at(ZOOM_HEAD, HEAD + k * ZOOM_HEAD)) for k in range(zooms)]
    return {"names": names, "data": data, "index": index, "compressed": size > 0, "levels": [(r, at, i) for r, _, at, i in levels]}


def _names(f, at: int) -> dict[int, tuple[str, int]]:
    """Chromosomes by number: name and length."""
    _, _, key, _, _, _ = struct.unpack("<IIIIQQ", f.read_at(32, at))
    found, todo = {}, [at + 32]
    while todo:
        place = todo.pop()
        leaf, _, n = struct.unpack("<BBH", f.read_at(4, place))
        raw = f.read_at(n * (key + 8), place + 4)
        for k in range(n):
            item = raw[k * (key + 8) : (k + 1) * (key + 8)]
            if leaf:
                number, length = struct.unpack("<II", item[key:])
                found[number] = item[:key].rstrip(b"\0").decode(), length
            else:
                todo.append(struct.unpack("<Q", item[key:])[0])
    return found


def _node(f, place: int) -> tuple[bool, np.ndarray]:
    """Whether a node is a leaf, and its entries."""
    leaf, _, n = struct.unpack("<BBH", f.read_at(4, place))
    kind = _BOUNDS if leaf else np.dtype(_BOUNDS.descr[:5])
    return bool(leaf), np.frombuffer(f.read_at(n * kind.itemsize, place + 4), kind)


class TrackReader(DataSourceReader):
    def __init__(self, path: str, zoom: int):
        self.path, self.zoom = path, zoom
        self.names: set[str] | None = None
        self.low, self.high = 0, FAR

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name == "chr" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = values if self.names is None else self.names & values
            elif name == "x2" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif name == "x1" and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value)
            yield f  # Spark looks at the rows once more

    def overlaps(self, entries: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Entries that can hold an interval of a wanted chromosome that ends at ``low`` or later and starts at ``high`` or earlier."""
        c1, c2 = np.searchsorted(wanted, entries["c1"], "left"), np.searchsorted(wanted, entries["c2"], "right")
        any_ = c2 > c1
        one = entries["c1"] == entries["c2"]
        return any_ & (~one | ((entries["b2"] >= self.low) & (entries["b1"] <= self.high)))

    def wanted(self, f, head: dict) -> np.ndarray:
        return np.array(sorted(k for k, (name, _) in _names(f, head["names"]).items() if self.names is None or name in self.names), np.int64)

    def partitions(self) -> Sequence[InputPartition]:
        with _file(self.path) as f:
            head = _head(f)
            chromosomes, leaves = self.wanted(f, head), []
            todo = [(head["levels"][self.zoom - 1][2] if self.zoom else head["index"]) + TREE_HEAD]
            while todo:
                leaf, entries = _node(f, todo[0])
                if leaf:  # all nodes of a level are alike
                    leaves = todo
                    break
                below = [entries, *(_node(f, place)[1] for place in todo[1:])]
                todo = [int(at) for n in below for at in n["at"][self.overlaps(n, chromosomes)]]
        return [Leaves(leaves[k : k + TASK_LEAVES]) for k in range(0, len(leaves), TASK_LEAVES)] or [Leaves([])]

    def read(self, p: Leaves) -> Iterator[pa.RecordBatch]:
        if not p.places:
            return
        with _file(self.path) as f:
            head = _head(f)
            names, chromosomes = _names(f, head["names"]), self.wanted(f, head)
            for place in p.places:
                entries = _node(f, place)[1]
                for e in entries[self.overlaps(entries, chromosomes)]:
                    raw = f.read_at(int(e["size"]), int(e["at"]))
                    raw = zlib.decompress(raw) if head["compressed"] else raw
                    yield from self.summaries(raw, names, chromosomes) if self.zoom else self.values(raw, names)

    def values(self, raw: bytes, names: dict[int, tuple[str, int]]) -> Iterator[pa.RecordBatch]:
        number, first, _, step, span, kind, _, n = struct.unpack("<IIIIIBBH", raw[:SECTION_HEAD])
        if kind == 1:
            items = np.frombuffer(raw, _ITEMS, n, SECTION_HEAD)
            x1, x2, v = (items[c].astype("f8" if c == "v" else "i8") for c in ("x1", "x2", "v"))
        elif kind == 2:
            items = np.frombuffer(raw, np.dtype([("x1", "<u4"), ("v", "<f4")]), n, SECTION_HEAD)
            x1, v = items["x1"].astype("i8"), items["v"].astype("f8")
            x2 = x1 + span
        else:
            x1, v = first + step * np.arange(n), np.frombuffer(raw, "<f4", n, SECTION_HEAD).astype("f8")
            x2 = x1 + span
        yield pa.RecordBatch.from_arrays([pa.array([names[number][0]] * n, pa.string()), pa.array(x1, pa.int64()), pa.array(x2, pa.int64()), pa.array(v)], ["chr", "x1", "x2", "score"])

    def summaries(self, raw: bytes, names: dict[int, tuple[str, int]], chromosomes: np.ndarray) -> Iterator[pa.RecordBatch]:
        items = np.frombuffer(raw, _SUMMED)
        items = items[np.isin(items["c"], chromosomes)]
        text = pa.array([names[c][0] for c in items["c"].tolist()], pa.string())
        columns = [pa.array(items[c].astype("i8")) for c in ("x1", "x2", "n")] + [pa.array(items[c].astype("f8")) for c in ("low", "high", "total", "squares")]
        yield pa.RecordBatch.from_arrays([text, *columns], [c.split()[0] for c in SUMMARIES.split(", ")])


class TrackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "track"

    def schema(self) -> str:
        return SUMMARIES if int(self.options.get("zoom", 0)) else VALUES

    def reader(self, schema) -> TrackReader:
        return TrackReader(self.options["path"], int(self.options.get("zoom", 0)))


def track(spark: SparkSession, path: str, zoom: int = 0) -> DataFrame:
    """The intervals of a track, or the summaries of its ``zoom``-th level, with conditions on chr, x1 and x2 pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TrackSource)
    return spark.read.format("track").option("zoom", str(zoom)).load(path)


def windows(values: DataFrame, size: int) -> DataFrame:
    """Mean and maximum of the values whose middle is in each window; windows without any up to a chromosome's last one have 0: chr, x1, x2, mean, high."""
    at = F.floor(F.floor((F.col("x1") + F.col("x2")) / 2) / size)
    there = values.groupBy("chr", at.alias("w")).agg(F.avg("score").alias("mean"), F.greatest(F.max("score"), F.lit(0.0)).alias("high"))
    last = there.groupBy("chr").agg(F.max("w").alias("last"))
    every = last.select("chr", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("w"))
    filled = every.join(there, ["chr", "w"], "left").fillna(0.0, ["mean", "high"])
    return filled.select("chr", (F.col("w") * size).alias("x1"), ((F.col("w") + 1) * size).alias("x2"), "mean", "high")


def _sections(rows: DataFrame, pack, per: int) -> DataFrame:
    """Rows (c, x1, x2, ...) in order, by sections of at most ``per`` of a chromosome: c1, b1, c2, b2, content, number (from 0), at (bytes before).

    Rows are sorted by ranges, and sections made within a range and chromosome; sums of a row a range tell where each range's sections begin.
    """
    ranged = rows.repartitionByRange("c", "x1").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ranged-values")
    inside = Window.partitionBy("range", "c").orderBy("x1", "x2")
    cut = ranged.withColumn("section", F.floor((F.row_number().over(inside) - 1) / per))

    def make(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["x1", "x2"])
        content = zlib.compress(pack(f))
        c = int(f["c"].iloc[0])
        return pd.DataFrame({"range": f["range"].iloc[:1], "c1": c, "b1": int(f["x1"].min()), "c2": c, "b2": int(f["x2"].max()), "content": [content], "size": len(content)})

    kind = "range int, c1 long, b1 long, c2 long, b2 long, content binary, size long"
    made = written(cut.groupBy("range", "c", "section").applyInPandas(make, kind), "sections")
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = made.groupBy("range").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).withColumns({"at0": before("s"), "number0": before("n")}).drop("s", "n")
    order = Window.partitionBy("range").orderBy("c1", "b1", "b2")
    placed = made.withColumns({"k": F.row_number().over(order) - 1, "a": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    placed = placed.join(F.broadcast(ranges), "range")  # a row a range
    return written(placed.select("c1", "b1", "c2", "b2", "content", "size", (F.col("k") + F.col("number0")).alias("number"), (F.col("a") + F.col("at0")).alias("at")), "placed-sections")


def _pack_values(f: pd.DataFrame) -> bytes:
    items = np.zeros(len(f), _ITEMS)
    items["x1"], items["x2"], items["v"] = f["x1"], f["x2"], f["score"]
    return struct.pack("<IIIIIBBH", int(f["c"].iloc[0]), int(f["x1"].min()), int(f["x2"].max()), 0, 0, 1, 0, len(f)) + items.tobytes()


def _pack_summaries(f: pd.DataFrame) -> bytes:
    items = np.zeros(len(f), _SUMMED)
    for c in _SUMMED.names:
        items[c] = f[c]
    return items.tobytes()


def _tree(leaves: list[tuple], at: int, leaf_bytes: int, n: int, end: int) -> tuple[bytes, list[tuple[int, bytes]], int]:
    """The head of a range tree at ``at`` and its inner nodes, from one row a leaf (bounds), top down: head, nodes with their places, and where leaves begin."""
    level, rows = [], leaves
    while len(rows) > 1 or not level:
        groups = [rows[k : k + NODE_ENTRIES] for k in range(0, max(len(rows), 1), NODE_ENTRIES)]
        level.append(groups)
        rows = [(*g[0][:2], *max((r[2:4] for r in g), default=(0, 0))) for g in groups if g]
        if len(groups) == 1:
            break
    level.reverse()  # from the root down
    starts, place = [], at + TREE_HEAD
    for groups in level:
        starts.append(place)
        place += len(groups) * (4 + NODE_ENTRIES * INNER)
    nodes = []
    for depth, groups in enumerate(level):
        below, width = (starts[depth + 1], 4 + NODE_ENTRIES * INNER) if depth + 1 < len(level) else (place, leaf_bytes)
        done = 0
        for k, g in enumerate(groups):
            raw = struct.pack("<BBH", 0, 0, len(g)) + b"".join(struct.pack("<IIIIQ", *r[:4], below + (done + i) * width) for i, r in enumerate(g))
            nodes.append((starts[depth] + k * (4 + NODE_ENTRIES * INNER), raw))
            done += len(g)
    bounds = (*leaves[0][:2], *max(r[2:4] for r in leaves)) if leaves else (0, 0, 0, 0)
    return struct.pack("<IIQIIIIQII", RANGES_MARK, NODE_ENTRIES, n, *bounds, end, SECTION_VALUES, 0), nodes, place


def write_track(values: DataFrame, path: str, chromosomes: Sequence[tuple[str, int]], zooms: Sequence[int] = ()) -> None:
    """A track file of intervals (chr, x1, x2, score) that don't overlap, with summaries over windows of ``zooms`` bases.

    chromosomes: their names and lengths; intervals of others go. ``path`` is a file of a file system that driver and executors share and that lets several write to one file. Sections are compressed
    by tasks and stored; prefix sums tell their places; tasks write sections and leaves. The driver writes the head, names, and inner nodes, from a row a leaf of 256 sections.
    """
    spark = values.sparkSession
    names = sorted(chromosomes)
    known = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(names)], "c long, chr string")
    rows = values.join(F.broadcast(known), "chr").where("score is not null").select("c", "x1", "x2", F.col("score").cast("double").alias("score"))
    rows = written(rows, "track-values")
    parts = [(rows, _pack_values, SECTION_VALUES)]
    for size in zooms:
        w = F.explode(F.sequence(F.floor(F.col("x1") / size), F.floor((F.col("x2") - 1) / size))).alias("w")
        part = rows.select("*", w).withColumn("n", F.least("x2", (F.col("w") + 1) * size) - F.greatest("x1", F.col("w") * size))
        v = F.col("score")
        summed = part.groupBy("c", "w").agg(
            F.min(F.greatest("x1", F.col("w") * size)).alias("x1"), F.max(F.least("x2", (F.col("w") + 1) * size)).alias("x2"), F.sum("n").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"),
            F.sum(v * F.col("n")).alias("total"), F.sum(v * v * F.col("n")).alias("squares"),
        ).drop("w")
        parts.append((summed, _pack_summaries, SECTION_VALUES))
    key = max([len(n.encode()) for n, _ in names], default=1)
    at = HEAD + ZOOM_HEAD * len(zooms)
    names_at = at
    tree = struct.pack("<IIIIQQ", NAMES_MARK, max(len(names), 1), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
    tree += b"".join(n.encode().ljust(key, b"\0") + struct.pack("<II", k, length) for k, (n, length) in enumerate(names))
    at += len(tree)
    pieces, placed, places, biggest = [(names_at, tree)], [], [], 0
    leaf_bytes = 4 + NODE_ENTRIES * LEAF
    for frame, pack, per in parts:
        sections = _sections(frame, pack, per)
        bound = lambda c, of, end: of(F.struct(c, end))
        leaves = sections.groupBy(F.floor(F.col("number") / NODE_ENTRIES).alias("leaf")).agg(
            bound("c1", F.min, "b1").alias("lo"), bound("c2", F.max, "b2").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
        ).orderBy("leaf").collect()  # a row a leaf
        n, size = sum(r["n"] for r in leaves), sum(r["size"] for r in leaves)
        data_at, index_at = at, at + 4 + size
        head, nodes, leaves_at = _tree([(*r["lo"], *r["hi"]) for r in leaves], index_at, leaf_bytes, n, index_at)
        pieces += [(data_at, struct.pack("<I", n)), (index_at, head), *nodes]
        pieces += [(leaves_at + r["leaf"] * leaf_bytes, struct.pack("<BBH", 1, 0, r["n"])) for r in leaves]
        places.append((data_at, index_at, leaves_at))
        placed.append(sections)
        at = leaves_at + max(len(leaves), 1) * leaf_bytes
        if not leaves:
            pieces.append((leaves_at, struct.pack("<BBH", 1, 0, 0)))
        biggest = max(biggest, SECTION_HEAD + SECTION_VALUES * SUMMARY)
    first = struct.pack("<IHHQQQHHQQIQ", FILE_MARK, 4, len(zooms), names_at, places[0][0], places[0][1], 0, 0, 0, 0, biggest, 0)
    first += b"".join(struct.pack("<IIQQ", size, 0, data, index) for size, (data, index, _) in zip(zooms, places[1:], strict=True))
    making = f"{path}.making"
    with open(making, "wb") as f:
        for where, raw in [(0, first), *pieces]:
            f.seek(where)
            f.write(raw)
        f.truncate(at)
    for sections, (data_at, _, leaves_at) in zip(placed, places, strict=True):

        def put(r, data_at=data_at, leaves_at=leaves_at) -> list[tuple[int, bytes]]:
            leaf, k = divmod(int(r.number), NODE_ENTRIES)
            where = data_at + 4 + int(r.at)
            entry = struct.pack("<IIIIQQ", int(r.c1), int(r.b1), int(r.c2), int(r.b2), where, int(r.size))
            return [(where, bytes(r.content)), (leaves_at + leaf * leaf_bytes + 4 + k * LEAF, entry)]

        _put(making, sections, put)
    os.replace(making, path)
