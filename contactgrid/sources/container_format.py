"""Containers of maps as a Spark data source, and the job that writes a whole one.

    spark.dataSource.register(ContactMapSource)
    spark.read.format("contactmap").load(path).where("bin_size = 25000 and chr1 = 1 and bin_x < 400")

Conditions on chromosomes, unit, resolution and bins reach the source: other matrices, resolutions and blocks aren't read.
"""

from __future__ import annotations

import json
import math
import os
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from contactgrid.sources import container
from contactgrid.tables import written

#: Bytes of an entry of a block index.
ENTRY = 16
#: Columns of blocks of a file that is written here; with 16 bits for places in blocks, enough for any chromosome.
COLUMNS = 1 << 15
_ARROW = pa.schema([("chr1", pa.int32()), ("chr2", pa.int32()), ("unit", pa.string()), ("bin_size", pa.int32()), ("bin_x", pa.int32()), ("bin_y", pa.int32()), ("counts", pa.float64())])
BLOCK_SHOWN = "chr1 int, chr2 int, unit string, bin_size int, block int, is_read boolean"
FAR = 2**31 - 1


@dataclass
class Blocks(InputPartition):
    """Entries of a block index of one matrix and resolution: how many, and from which byte on."""

    chr1: int
    chr2: int
    unit: str
    bin_size: int
    block_bins: int
    columns: int
    at: int
    n: int
    version: int = 8


def _resolutions(f, position: int) -> Iterator[Blocks]:
    """A matrix's resolutions, by their heads alone: indexes are passed over."""
    r = container.Reader(f, position)
    chr1, chr2, n = (r.value("i") for _ in range(3))
    at = position + 12
    for _ in range(n):
        r = container.Reader(f, at)
        unit = r.text()
        r.take(20)
        size, bins, columns, blocks = (r.value("i") for _ in range(4))
        at += len(unit) + 1 + 36
        yield Blocks(chr1, chr2, unit, size, bins, columns, at, blocks)
        at += blocks * ENTRY


class Wanted:
    """What filters leave of each column: a set of values, or None for all, and a range of bins."""

    def __init__(self):
        self.values: dict[str, set] = {}
        self.low, self.high = {"bin_x": 0, "bin_y": 0}, {"bin_x": FAR, "bin_y": FAR}

    def narrow(self, f: Filter) -> None:
        name = getattr(f, "attribute", ("",))[0]
        if isinstance(f, EqualTo | In) and name in ("chr1", "chr2", "unit", "bin_size"):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.values[name] = self.values.get(name, values) & values
        elif name in self.low and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            if not isinstance(f, LessThan | LessThanOrEqual):
                self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
            if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.high[name] = min(self.high[name], f.value - isinstance(f, LessThan))

    def has(self, name: str, value) -> bool:
        return name not in self.values or value in self.values[name]

    def covers(self, block: np.ndarray, p: Blocks) -> np.ndarray:
        """Which blocks can hold wanted bins: by the square of a number, or, in later versions within a chromosome, by its place along the diagonal and its depth from it."""
        x0, x1, y0, y1 = self.low["bin_x"], self.high["bin_x"], self.low["bin_y"], self.high["bin_y"]
        column, row = block % p.columns, block // p.columns
        if p.version > 8 and p.chr1 == p.chr2:
            along = ((column * p.block_bins <= (x1 + y1) // 2) & ((column + 1) * p.block_bins > (x0 + y0) // 2))
            near, far = max(0, y0 - x1, x0 - y1), max(y1 - x0, x1 - y0)
            depth = lambda gap: math.floor(math.log2(1 + gap / math.sqrt(2) / p.block_bins))
            return along & (row >= depth(near)) & (row <= depth(far))
        inside = lambda k, low, high: (k * p.block_bins <= high) & ((k + 1) * p.block_bins > low)
        return inside(column, x0, x1) & inside(row, y0, y1)


class ContactMapReader(DataSourceReader):
    def __init__(self, path: str, shows_blocks: bool, bins: dict[str, tuple[int | None, int | None]]):
        self.path, self.shows_blocks, self.wanted = path, shows_blocks, Wanted()
        for name, (low, high) in bins.items():
            self.wanted.low[name], self.wanted.high[name] = low or 0, FAR if high is None else high

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.wanted.narrow(f)
            yield f  # Spark looks at the rows once more

    def partitions(self) -> Sequence[InputPartition]:
        c = container.open_container(self.path)
        out = []
        with container._file(self.path) as f:
            there = [r for key, position, _ in c.matrices if all(self.wanted.has(f"chr{k + 1}", int(x)) for k, x in enumerate(key.split("_"))) for r in _resolutions(f, position)]
            entries = sum(size for _, _, size in c.matrices) // ENTRY  # about as many as the file has blocks
            step = max(container.SPLIT_BLOCKS, container.SPLIT_BYTES * entries // max(f.size(), 1))
            for r in there:
                if self.wanted.has("unit", r.unit) and self.wanted.has("bin_size", r.bin_size):
                    out += [Blocks(r.chr1, r.chr2, r.unit, r.bin_size, r.block_bins, r.columns, r.at + k * ENTRY, min(step, r.n - k), c.version) for k in range(0, r.n, step)]
        return out or [Blocks(0, 0, "", 0, 1, 1, 0, 0)]

    def read(self, p: Blocks) -> Iterator[pa.RecordBatch]:
        if not p.n:
            return
        with container._file(self.path) as f:
            entries = np.frombuffer(f.read_at(p.n * ENTRY, p.at), np.dtype([("block", "<i4"), ("at", "<i8"), ("size", "<i4")]))
            on = self.wanted.covers(entries["block"].astype(np.int64), p)
            if self.shows_blocks:
                same = [pa.array([v] * p.n, k) for v, k in ((p.chr1, pa.int32()), (p.chr2, pa.int32()), (p.unit, pa.string()), (p.bin_size, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(entries["block"], pa.int32()), pa.array(on)], ["chr1", "chr2", "unit", "bin_size", "block", "is_read"])
                return
            held, n = [], 0
            for e in entries[on]:
                x, y, c = container.decode_block(container.zlib.decompress(f.read_at(int(e["size"]), int(e["at"]))), p.version)
                keep = np.ones(len(x), bool)
                for name, bins in (("bin_x", x), ("bin_y", y)):
                    keep &= (bins >= self.wanted.low[name]) & (bins <= self.wanted.high[name])
                held.append((x[keep], y[keep], c[keep]))
                n += len(held[-1][0])
                if n >= container.BATCH_CELLS:
                    yield self._batch(p, held, n)
                    held, n = [], 0
            if n:
                yield self._batch(p, held, n)

    @staticmethod
    def _batch(p: Blocks, held: list[tuple[np.ndarray, ...]], n: int) -> pa.RecordBatch:
        same = [pa.repeat(pa.scalar(v, t.type), n) for v, t in zip((p.chr1, p.chr2, p.unit, p.bin_size), _ARROW, strict=False)]
        cells = [pa.array(np.concatenate(v), t.type) for v, t in zip(zip(*held, strict=True), list(_ARROW)[4:], strict=True)]
        return pa.RecordBatch.from_arrays([*same, *cells], schema=_ARROW)


class ContactMapSource(DataSource):
    """``contactmap``: cells of a container; with the option ``blocks`` set, its blocks, and whether the conditions leave them to be read."""

    @classmethod
    def name(cls) -> str:
        return "contactmap"

    def schema(self) -> str:
        return BLOCK_SHOWN if "blocks" in self.options else container.CELLS

    def reader(self, schema) -> ContactMapReader:
        return ContactMapReader(self.options["path"], "blocks" in self.options, json.loads(self.options.get("bins", "{}")))


def contact_map(spark: SparkSession, path: str, blocks: bool = False, bins: dict[str, tuple[int | None, int | None]] | None = None) -> DataFrame:
    """A container by the data source, with conditions pushed into it: Spark needs to be told that Python sources may take them.

    blocks: instead of cells, blocks, and whether ``bins``, ranges of bin_x and bin_y with their ends, leave them to be read.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContactMapSource)
    found = spark.read.format("contactmap").option("bins", json.dumps(bins or {}))
    return (found.option("blocks", "all") if blocks else found).load(path)


def plain_path(path: str) -> str:
    """A path of the shared folder as the file system's own."""
    return path.removeprefix("file://").removeprefix("file:")


def _text(s: str) -> bytes:
    return s.encode() + b"\0"


_ZOOM = ["chr1", "chr2", "unit", "bin_size"]


def _placed(blocks: DataFrame) -> DataFrame:
    """Encoded blocks in the file's order, each with the bytes before it (at) and the blocks of its matrix and resolution before it (place).

    Blocks are sorted by ranges; sums inside a range are a window of it, and what comes before a range is a sum of a row a range (and resolution).
    """
    ranged = blocks.withColumn("size", F.octet_length("content")).repartitionByRange(*_ZOOM, "block").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ranged-blocks")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("n")).withColumn("range_at", before(Window.orderBy("range"))).drop("n")
    counts = ranged.groupBy("range", *_ZOOM).agg(F.count(F.lit(1)).alias("n")).withColumn("range_place", before(Window.partitionBy(*_ZOOM).orderBy("range"))).drop("n")
    inside = Window.partitionBy("range").orderBy(*_ZOOM, "block").rowsBetween(Window.unboundedPreceding, -1)
    zoomed = Window.partitionBy("range", *_ZOOM).orderBy("block")
    here = ranged.withColumns({"at": F.coalesce(F.sum("size").over(inside), F.lit(0)), "place": F.row_number().over(zoomed) - 1})
    here = here.join(F.broadcast(sizes), "range").join(counts, ["range", *_ZOOM])
    return here.select(*_ZOOM, "block", "content", "size", (F.col("at") + F.col("range_at")).alias("at"), (F.col("place") + F.col("range_place")).alias("place"))


def _put(path: str, df: DataFrame, pieces) -> int:
    """Tasks write what pieces() makes of each row, (place, bytes), into the file that all of them see; a task that is run again writes the same bytes to the same places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, f = 0, os.open(path, os.O_WRONLY)
        try:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    for place, data in pieces(row):
                        done += os.pwrite(f, data, place)
            os.fsync(f)
        finally:
            os.close(f)
        yield pd.DataFrame({"bytes": [done]})

    return df.mapInPandas(run, "bytes long").agg(F.sum("bytes")).first()[0] or 0


def write_container(
    contacts: DataFrame, path: str, chromosomes: Sequence[tuple[str, int]], vectors: DataFrame | None = None, genome: str = "unknown", attributes: dict[str, str] | None = None,
    block_bins: int = 1_000, least: float = 0.0,
) -> None:
    """A whole container of version 8 in one file: cells (chr1, chr2, unit, bin_size, bin_x, bin_y, counts) that count ``least`` or more, and norm vectors.

    chromosomes: name and length of numbers 1, 2, ...; number 0 stands for all. ``path`` is a file of a file system that driver and executors
    share and that lets several write to one file. Blocks are encoded by tasks and stored; their sizes' prefix sums are their places in the file; tasks write blocks, their entries
    of the index, and vectors each to its place. The driver writes the heads of matrices and the footer, whose sizes are those of the
    lists of chromosomes and resolutions; the file gets its name when it is whole.
    """
    kept = contacts.where(F.col("counts") >= least)
    encoded = written(container.encode_blocks(kept, block_bins), "encoded-blocks")  # ranges are sampled, which would encode all twice
    blocks = written(_placed(encoded), "placed-blocks")
    zooms = blocks.groupBy(*_ZOOM).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    stats = kept.groupBy(*_ZOOM).agg(F.sum("counts").alias("total"), F.count(F.lit(1)).alias("cells"))
    zooms = zooms.join(stats, _ZOOM).collect()  # a row a matrix and resolution, as the footer has them
    number = lambda r: (r["chr1"], r["chr2"], r["unit"], r["bin_size"])
    sizes = {u: sorted({r["bin_size"] for r in zooms if r["unit"] == u}, reverse=True) for u in ("BP", "FRAG")}
    rest = _text(genome) + struct.pack("<i", len(attributes or {})) + b"".join(_text(k) + _text(v) for k, v in (attributes or {}).items())
    whole = [("All", sum(n for _, n in chromosomes) // 1000), *chromosomes]
    rest += struct.pack("<i", len(whole)) + b"".join(_text(name) + struct.pack("<i", n) for name, n in whole)
    rest += b"".join(struct.pack("<i", len(sizes[u])) + b"".join(struct.pack("<i", s) for s in sizes[u]) for u in ("BP", "FRAG"))
    first = 4 + 4 + 8 + len(rest)
    at, heads, matrices, index_of = first + sum(r["bytes"] for r in zooms), [], [], {}
    for pair in sorted({(r["chr1"], r["chr2"]) for r in zooms}):
        mine = sorted((r for r in zooms if (r["chr1"], r["chr2"]) == pair), key=lambda r: (r["unit"], -r["bin_size"]))
        start = at
        heads.append((at, struct.pack("<iii", *pair, len(mine))))
        at += 12
        for r in mine:
            head = _text(r["unit"]) + struct.pack("<iffffiiii", 0, r["total"], r["cells"], -1, -1, r["bin_size"], block_bins, COLUMNS, r["n"])
            heads.append((at, head))
            index_of[number(r)] = at + len(head)
            at += len(head) + r["n"] * ENTRY
        matrices.append((f"{pair[0]}_{pair[1]}", start, at - start))
    foot = struct.pack("<i", len(matrices)) + b"".join(_text(k) + struct.pack("<qi", *m) for k, *m in matrices) + struct.pack("<i", 0)
    footer = at
    heads.append((footer, struct.pack("<i", len(foot)) + foot))
    at += 4 + len(foot)
    key = ["norm", "chr", "unit", "bin_size"]
    listed = sorted(map(tuple, vectors.groupBy(*key).agg((F.max("bin") + 1).cast("int").alias("n")).collect())) if vectors is not None else []
    entry = lambda v: len(_text(v[0])) + 4 + len(_text(v[2])) + 4 + 8 + 4
    place, vector_at, tail = at + 8 + sum(map(entry, listed)), {}, struct.pack("<ii", 0, len(listed))
    for norm, chr_, unit, size, n in listed:
        vector_at[norm, chr_, unit, size] = place + 4
        heads.append((place, struct.pack("<i", n)))
        tail += _text(norm) + struct.pack("<i", chr_) + _text(unit) + struct.pack("<iqi", size, place, 4 + 8 * n)
        place += 4 + 8 * n
    heads.append((at, tail))
    making = f"{path}.making"
    with open(making, "wb") as f:
        f.write(_text("HIC") + struct.pack("<iq", 8, footer) + rest)
        for where, data in heads:
            f.seek(where)
            f.write(data)
        f.truncate(place)
        for norm, chr_, unit, size, n in listed:  # a bin that a vector doesn't have is nan
            for k in range(0, n, container.AHEAD):
                f.seek(vector_at[norm, chr_, unit, size] + 8 * k)
                f.write(np.full(min(container.AHEAD, n - k), np.nan, "<f8").tobytes())

    def block(r) -> list[tuple[int, bytes]]:
        where = index_of[r.chr1, r.chr2, r.unit, r.bin_size] + ENTRY * int(r.place)
        return [(first + int(r.at), bytes(r.content)), (where, struct.pack("<iqi", r.block, first + int(r.at), r.size))]

    _put(making, blocks, block)
    if vectors is not None:
        values = vectors.where("value is not null").select(*key, "bin", F.col("value").cast("double").alias("value"))
        _put(making, values, lambda r: [(vector_at[r.norm, r.chr, r.unit, r.bin_size] + 8 * int(r.bin), struct.pack("<d", r.value))])
    os.replace(making, path)
