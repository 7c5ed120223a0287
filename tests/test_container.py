"""Containers: a small file of version 8 or 9, written here by the format's description, read back."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from contactgrid.sources import container


def text(s):
    return s.encode() + b"\0"


def write(path, version, cells, vectors):
    """cells: {(chr1, chr2, bin_size): [(x, y, count)]}, vectors: {(norm, chr, bin_size): values}."""
    wide = version > 8
    chromosomes = [("All", 5), ("1", 1_000_000), ("2", 500_000)]
    sizes = sorted({k[2] for k in cells}, reverse=True)
    head = text("HIC") + struct.pack("<i", version)
    rest = text("x1") + (struct.pack("<qq", 0, 0) if wide else b"") + struct.pack("<i", 1) + text("software") + text("test")
    rest += struct.pack("<i", len(chromosomes)) + b"".join(text(n) + struct.pack("<q" if wide else "<i", size) for n, size in chromosomes)
    rest += struct.pack("<i", len(sizes)) + b"".join(struct.pack("<i", s) for s in sizes) + struct.pack("<i", 0)
    body, places, at = b"", {}, len(head) + 8 + len(rest)
    for chr1, chr2 in sorted({k[:2] for k in cells}):
        zooms, meta = [], b""
        for size in sizes:
            rows = cells.get((chr1, chr2, size), [])
            blocks = []
            for number in sorted({(y // 10) * 100 + x // 10 for x, y, _ in rows}):
                x, y, c = (np.array(v) for v in zip(*[r for r in rows if (r[1] // 10) * 100 + r[0] // 10 == number], strict=True))
                raw = zlib.decompress(container.encode_block(x, y, c.astype(float)))
                if wide:  # one more flag for each axis
                    raw = raw[:13] + b"\0\0" + raw[13:]
                raw = zlib.compress(raw)
                blocks.append((number, at + len(body), len(raw)))
                body += raw
            zooms.append((size, blocks))
        for size, blocks in zooms:
            meta += text("BP") + struct.pack("<iffffiii", 0, 0, 0, 0, 0, size, 10, 100) + struct.pack("<i", len(blocks)) + b"".join(struct.pack("<iqi", *b) for b in blocks)
        meta = struct.pack("<iii", chr1, chr2, len(zooms)) + meta
        places[f"{chr1}_{chr2}"] = (at + len(body), len(meta))
        body += meta
    number = lambda n: struct.pack("<q" if wide else "<i", n)
    values = lambda v: np.array(v, "<f4" if wide else "<f8").tobytes()
    expected = text("BP") + struct.pack("<i", 1000) + number(3) + values([3, 2, 1]) + struct.pack("<i", 1) + struct.pack("<i", 1) + struct.pack("<f" if wide else "<d", 2.0)
    foot = struct.pack("<i", len(places)) + b"".join(text(k) + struct.pack("<qi", *v) for k, v in places.items()) + struct.pack("<i", 1) + expected
    footer = at + len(body)
    tail_at = footer + (8 if wide else 4) + len(foot)
    index_size = sum(len(text(n)) + 4 + 3 + 4 + 8 + (8 if wide else 4) for n, _, _ in vectors)
    vector_at = tail_at + 4 + 4 + index_size
    index, data = b"", b""
    for (norm, chr_, size), v in vectors.items():
        raw = number(len(v)) + values(v)
        index += text(norm) + struct.pack("<i", chr_) + text("BP") + struct.pack("<iq", size, vector_at + len(data)) + number(len(raw))
        data += raw
    tail = struct.pack("<i", 0) + struct.pack("<i", len(vectors)) + index + data
    path.write_bytes(head + struct.pack("<q", footer) + rest + body + number(len(foot)) + foot + tail)


@pytest.mark.parametrize("version", [8, 9])
def test_container_reads_back(spark, tmp_path, version):
    rng = np.random.default_rng(version)
    cells = {}
    for chr1, chr2 in ((1, 1), (1, 2), (2, 2)):
        for size in (1000, 5000):
            places = {tuple(sorted(p)) for p in rng.integers(0, 60, (80, 2)).tolist()}
            cells[chr1, chr2, size] = [(x, y, float(rng.integers(1, 50)) if size == 1000 else float(np.float32(rng.random()))) for x, y in sorted(places)]
    cells[1, 1, 1000] += [(100 + i, 100 + j, float(i + j + 1)) for i in range(10) for j in range(10)]  # a dense block
    vectors = {("VC", 1, 1000): [1.5, np.nan, 2.0, 4.0], ("KR", 2, 1000): [3.0, 9.0]}
    path = tmp_path / "map.container"
    write(path, version, cells, vectors)
    c = container.open_container(str(path))
    assert (c.version, c.genome, c.attributes, c.bp_sizes) == (version, "x1", {"software": "test"}, [5000, 1000])
    assert c.chromosomes[1] == (1, "1", 1_000_000) and c.expected[0][:3] == ("NONE", "BP", 1000) and c.expected[0][4] == {1: 2.0}
    told = {(a, b, s, x, y, n) for (a, b, s), rows in cells.items() for x, y, n in rows}
    found = [(r.chr1, r.chr2, r.bin_size, r.bin_x, r.bin_y, r.counts) for r in container.read_container(spark, str(path)).collect()]
    assert len(found) == len(told) and set(found) == told
    one = container.read_container(spark, f"file://{path}", 1000, chromosomes=(2, 1)).collect()
    assert {(r.bin_x, r.bin_y, r.counts) for r in one} == set(cells[1, 2, 1000])
    assert [(r.bin, r.value) for r in container.read_vectors(spark, str(path), "VC").orderBy("bin").collect()] == [(0, 1.5), (1, None), (2, 2.0), (3, 4.0)]
    assert [(r.bin, r.value) for r in container.read_vectors(spark, str(path), "VC_SQRT", (2, 9)).orderBy("bin").collect()] == [(2, pytest.approx(2**0.5)), (3, 2.0)]
    assert container.read_vectors(spark, str(path)).count() == 6


def test_old_blocks():
    raw = struct.pack("<i", 2) + struct.pack("<iif", 1, 2, 3.5) + struct.pack("<iif", 4, 5, 6.0)
    x, y, c = container.decode_block(raw, 6)
    assert (x.tolist(), y.tolist(), c.tolist()) == ([1, 4], [2, 5], [3.5, 6.0])
    with pytest.raises(ValueError, match="not a container"):
        container.open_container(__file__)
