"""Binary containers of multi-resolution maps, versions 6 to 9 (S16, S17, S19), and their blocks of cells.

The driver reads the header and the footer's index of matrices and vectors, by name and place alone. Which blocks a matrix has,
what they hold, and vectors are read by tasks, from their byte ranges, so that a file of any size is many splits. Paths are
URIs of file systems that pyarrow knows, or paths of files that all executors see.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An absent cell of a dense block of 16-bit counts.
NO_SHORT = -32768
#: Bytes that are read ahead.
AHEAD = 1 << 20
#: Blocks that one split reads, about; where they are short, bytes of them.
SPLIT_BLOCKS, SPLIT_BYTES = 64, 1 << 20
#: Blocks, bytes of them and decoded cells that make a batch.
BATCH_BLOCKS, BATCH_BYTES, BATCH_CELLS = 1_000, 1 << 23, 1 << 16


def _file(path: str):
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


class Reader:
    """Little-endian values of a file, from a place on, or of bytes."""

    def __init__(self, source, at: int = 0):
        self.file, self.data, self.at = (None, source, at) if isinstance(source, bytes) else (source, b"", 0)
        if self.file is not None:
            self.file.seek(at)

    def take(self, n: int) -> bytes:
        while self.file is not None and len(self.data) - self.at < n:
            more = self.file.read(max(AHEAD, n))
            if not more:
                raise EOFError
            self.data, self.at = self.data[self.at :] + more, 0
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: str):
        return struct.unpack(f"<{kind}", self.take(struct.calcsize(f"<{kind}")))[0]

    def text(self) -> str:
        out = bytearray()
        while (c := self.take(1)) != b"\0":
            out += c
        return out.decode()

    def array(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.take(n * np.dtype(kind).itemsize), np.dtype(kind).newbyteorder("<"))


@dataclass
class Container:
    """What the header and the footer say; expected: norm, unit, bin_size, values, factors by chromosome."""

    version: int
    genome: str
    attributes: dict[str, str]
    chromosomes: list[tuple[int, str, int]]
    bp_sizes: list[int]
    frag_sizes: list[int]
    matrices: list[tuple[str, int, int]] = field(default_factory=list)
    expected: list[tuple[str, str, int, np.ndarray, dict[int, float]]] = field(default_factory=list)
    vectors: list[tuple[str, int, str, int, int, int]] = field(default_factory=list)


def _expected(r: Reader, norm: str, wide: bool) -> tuple:
    unit, size = r.text(), r.value("i")
    values = r.array("f4" if wide else "f8", r.value("q" if wide else "i")).astype(float)
    factors = {r.value("i"): r.value("f" if wide else "d") for _ in range(r.value("i"))}
    return norm, unit, size, values, factors


def open_container(path: str) -> Container:
    """The header and footer of a container."""
    with _file(path) as f:
        r = Reader(f)
        if r.take(4) != b"HIC\0":
            raise ValueError(f"not a container: {path}")
        version, footer, genome = r.value("i"), r.value("q"), r.text()
        wide = version > 8
        if wide:
            r.take(16)
        attributes = {r.text(): r.text() for _ in range(r.value("i"))}
        chromosomes = [(k, r.text(), r.value("q" if wide else "i")) for k in range(r.value("i"))]
        sizes = [[r.value("i") for _ in range(r.value("i"))] for _ in range(2)]
        out = Container(version, genome, attributes, chromosomes, *sizes)
        r = Reader(f, footer)
        length = r.value("q" if wide else "i")
        out.matrices = [(r.text(), r.value("q"), r.value("i")) for _ in range(r.value("i"))]
        out.expected = [_expected(r, "NONE", wide) for _ in range(r.value("i"))]
        try:
            r = Reader(f, footer + length + (8 if wide else 4))
            out.expected += [_expected(r, r.text(), wide) for _ in range(r.value("i"))]
            out.vectors = [(r.text(), r.value("i"), r.text(), r.value("i"), r.value("q"), r.value("q" if wide else "i")) for _ in range(r.value("i"))]
        except EOFError:  # no normalizations were added
            pass
    return out


def decode_block(raw: bytes, version: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin_x, bin_y and counts of a block's cells."""
    r = Reader(raw)
    n = r.value("i")
    if version < 7:
        cells = r.array([("x", "i4"), ("y", "i4"), ("c", "f4")], n)
        return cells["x"].astype("i4"), cells["y"].astype("i4"), cells["c"].astype(float)
    x0, y0 = r.value("i"), r.value("i")
    count = "f4" if r.value("b") else "i2"
    kind_x, kind_y = [("i4" if r.value("b") else "i2") for _ in range(2)] if version > 8 else ("i2", "i2")
    form = r.value("b")
    if form == 1:
        parts = []
        one = lambda kind: int(r.array(kind, 1)[0])
        for _ in range(one(kind_y)):
            y, columns = one(kind_y), one(kind_x)
            cells = r.array([("x", kind_x), ("c", count)], columns)
            parts.append((cells["x"].astype("i4") + x0, np.full(columns, y + y0, "i4"), cells["c"].astype(float)))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, "i4"), np.zeros(0, "i4"), np.zeros(0))
    if form == 2:
        points, width = r.value("i"), r.value("h")
        c = r.array(count, points)
        at = np.flatnonzero(c != NO_SHORT if count == "i2" else ~np.isnan(c))
        return (at % width + x0).astype("i4"), (at // width + y0).astype("i4"), c[at].astype(float)
    raise ValueError(f"unknown form of block: {form}")


def encode_block(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> bytes:
    """A block of version 8: as rows of cells or dense, with 16-bit or float counts, whichever is shorter."""
    x0, y0 = int(x.min()), int(y.min())
    whole = bool((counts == np.floor(counts)).all() and np.abs(counts).max() < -NO_SHORT)
    kind = "<i2" if whole else "<f4"
    width, height = int(x.max()) - x0 + 1, int(y.max()) - y0 + 1
    order = np.lexsort((x, y))
    x, y, counts = x[order] - x0, y[order] - y0, counts[order]
    size = np.dtype(kind).itemsize
    rows, first, per = np.unique(y, return_index=True, return_counts=True)
    if width * height * size + 6 < len(x) * (2 + size) + 4 * len(rows) + 2:
        dense = np.full(width * height, NO_SHORT if whole else np.nan, kind)
        dense[y * width + x] = counts
        body = struct.pack("<bih", 2, width * height, width) + dense.tobytes()
    else:
        cells = np.zeros(len(x), [("x", "<i2"), ("c", kind)])
        cells["x"], cells["c"] = x, counts
        body = struct.pack("<bh", 1, len(rows)) + b"".join(struct.pack("<hh", row, n) + cells[a : a + n].tobytes() for row, a, n in zip(rows, first, per, strict=True))
    return zlib.compress(struct.pack("<iiib", len(x), x0, y0, 0 if whole else 1) + body)


CELLS = "chr1 int, chr2 int, unit string, bin_size int, bin_x int, bin_y int, counts double"
BLOCKS = "chr1 int, chr2 int, unit string, bin_size int, block int, position bigint, size int"


def _sorted_blocks(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple]:
    """Of cells sorted by ``key`` each block's key, bin_x, bin_y and counts; a block can begin in one batch and end in another."""
    own, parts = None, []
    whole = lambda: tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    for batch in batches:
        if not len(batch):
            continue
        changed = np.zeros(len(batch) - 1, bool)
        for c in key:
            changed |= pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]).to_numpy(zero_copy_only=False)
        first = np.r_[0, np.flatnonzero(changed) + 1]
        keys = zip(*(batch.column(c).take(pa.array(first)).to_pylist() for c in key), strict=True)
        cells = [batch.column(c).to_numpy() for c in ("bin_x", "bin_y", "counts")]
        for k, a, b in zip(keys, first.tolist(), [*first[1:].tolist(), len(batch)], strict=True):
            if parts and k != own:
                yield own, *whole()
                parts = []
            own = k
            parts.append([c[a:b] for c in cells])
    if parts:
        yield own, *whole()


def encode_blocks(contacts: DataFrame, block_bins: int = 1_000) -> DataFrame:
    """The cells as compressed blocks of block_bins x block_bins: chr1, chr2, unit, bin_size, block, content.

    Cells are sorted by block and encoded in a stream, of which a task holds one block's cells and a batch of encoded blocks.
    """
    if block_bins > 32_767:
        raise ValueError("places within a block have 16 bits")
    key = ["chr1", "chr2", "unit", "bin_size", "block"]
    kinds = pa.schema([("chr1", pa.int32()), ("chr2", pa.int32()), ("unit", pa.string()), ("bin_size", pa.int32()), ("block", pa.int32()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for k, x, y, counts in _sorted_blocks(batches, key):
            rows.append((*k, encode_block(x, y, counts)))
            size += len(rows[-1][-1])
            if len(rows) == BATCH_BLOCKS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    side = lambda c: F.floor(F.col(c) / block_bins)
    columns = (side("bin_y") * F.lit(1 << 15) + side("bin_x")).cast("int")
    dealt = contacts.select(*(F.col(c).cast("int").alias(c) for c in ("chr1", "chr2")), "unit", F.col("bin_size").cast("int").alias("bin_size"), "bin_x", "bin_y", F.col("counts").cast("double").alias("counts"), columns.alias("block"))
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "chr1 int, chr2 int, unit string, bin_size int, block int, content binary")


def _decoded(f: pd.DataFrame, contents: Iterator[bytes], version: int) -> Iterator[pd.DataFrame]:
    """The cells of blocks, many blocks a frame."""
    first, n, held = 0, [], []
    for k, content in enumerate(contents):
        held.append(decode_block(zlib.decompress(content), version))
        n.append(len(held[-1][0]))
        if k + 1 == len(f) or sum(n) >= BATCH_CELLS:
            same = {c: np.repeat(f[c].to_numpy()[first : k + 1], n) for c in ("chr1", "chr2", "unit", "bin_size")}
            yield pd.DataFrame(same | {c: np.concatenate(v) for c, v in zip(("bin_x", "bin_y", "counts"), zip(*held, strict=True), strict=True)})
            first, n, held = k + 1, [], []


def decode_blocks(blocks: DataFrame, version: int = 8) -> DataFrame:
    """The cells of blocks, as of encode_blocks()."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield from _decoded(f, iter(f["content"]), version)

    return blocks.mapInPandas(run, CELLS)


def _zooms(raw: bytes) -> Iterator[tuple]:
    """A matrix's blocks at all its resolutions."""
    r = Reader(raw)
    chr1, chr2 = r.value("i"), r.value("i")
    for _ in range(r.value("i")):
        unit = r.text()
        r.take(20)  # an old index, and four statistics
        size = r.value("i")
        r.take(8)
        for _ in range(r.value("i")):
            yield chr1, chr2, unit, size, r.value("i"), r.value("q"), r.value("i")


def read_container(spark: SparkSession, path: str, bin_size: int | None = None, unit: str = "BP", chromosomes: tuple[int, int] | None = None) -> DataFrame:
    """The cells of a container, of one resolution or all, of one matrix or all; what isn't asked for isn't read."""
    c = open_container(path)
    wanted = [m for m in c.matrices if chromosomes is None or m[0] == "_".join(map(str, sorted(chromosomes)))]

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _file(path) as f:
            for frame in frames:
                for at, n in zip(frame["position"], frame["size"], strict=True):
                    rows = [z for z in _zooms(f.read_at(int(n), int(at))) if z[2] == unit and (bin_size is None or z[3] == bin_size)]
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in BLOCKS.split(", ")])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _file(path) as f:
            for frame in frames:
                yield from _decoded(frame, (f.read_at(int(n), int(at)) for at, n in zip(frame["position"], frame["size"], strict=True)), c.version)

    matrices = spark.createDataFrame([m[1:] for m in wanted], "position bigint, size int").repartition(max(1, len(wanted)))
    blocks = matrices.mapInPandas(index, BLOCKS)
    return blocks.repartition("chr1", "chr2", "bin_size", F.floor(F.col("block") / SPLIT_BLOCKS)).mapInPandas(read, CELLS)


def read_vectors(spark: SparkSession, path: str, norm: str | None = None, bins: tuple[int, int] | None = None) -> DataFrame:
    """Norm vectors of a container, whole or from bin to bin: norm, chr, unit, bin_size, bin, value; nan is null. A file without VC_SQRT has it from VC."""
    c = open_container(path)
    wide, n_head = c.version > 8, 8 if c.version > 8 else 4
    width = 4 if wide else 8
    rows = [(v[0], *v) for v in c.vectors if norm is None or v[0] == norm]
    if norm == "VC_SQRT" and not rows:
        rows = [("VC_SQRT", *v) for v in c.vectors if v[0] == "VC"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _file(path) as f:
            for frame in frames:
                for v in frame.itertuples(index=False):
                    first, last = bins or (0, (int(v.size) - n_head) // width - 1)
                    last = min(last, (int(v.size) - n_head) // width - 1)
                    for a in range(first, last + 1, AHEAD):
                        n = min(AHEAD, last + 1 - a)
                        value = np.frombuffer(f.read_at(n * width, int(v.position) + n_head + a * width), "<f4" if wide else "<f8").astype(float)
                        value = np.sqrt(value) if v.norm != v.stored else value
                        yield pd.DataFrame({"norm": v.norm, "chr": v.chr, "unit": v.unit, "bin_size": v.bin_size, "bin": np.arange(a, a + n, dtype="int32"), "value": value})

    index = spark.createDataFrame(rows, "norm string, stored string, chr int, unit string, bin_size int, position bigint, size bigint").repartition(max(1, len(rows)))
    found = index.mapInPandas(read, "norm string, chr int, unit string, bin_size int, bin int, value double")
    return found.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
