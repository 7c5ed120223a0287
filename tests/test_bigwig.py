"""Track files: written by tasks, read back whole, by range and by summaries; and a file of other kinds of sections made here by the format's description."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactgrid.sources import bigwig


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng, rows = np.random.default_rng(2), []
    for name, n in (("a", 3_000), ("bb", 500), ("c", 1)):
        ends = np.cumsum(rng.integers(1, 9, 2 * n))
        rows += [(name, int(x), int(y), float(np.float32(v))) for x, y, v in zip(ends[::2], ends[1::2], rng.normal(size=n), strict=True)]
    df = spark.createDataFrame(rows, "chr string, x1 long, x2 long, score double")
    before = bigwig.SECTION_VALUES, bigwig.NODE_ENTRIES
    bigwig.SECTION_VALUES, bigwig.NODE_ENTRIES = 16, 4  # many nodes, in three levels
    path = str(tmp_path_factory.mktemp("tracks") / "track.bw")
    try:
        bigwig.write_track(df.repartition(6), path, [("bb", 40_000), ("a", 90_000), ("c", 100), ("none", 5)], [50, 400])
    finally:
        bigwig.SECTION_VALUES, bigwig.NODE_ENTRIES = before
    return path, rows, df


def test_all_values_and_ranges_come_back(spark, made):
    path, rows, _ = made
    assert sorted(map(tuple, bigwig.track(spark, path).collect())) == sorted(rows)
    for name, low, high in (("a", 5_000, 5_100), ("a", 0, 1), ("bb", 1_000, 10**9), ("c", 0, 50), ("none", 0, 9)):
        found = bigwig.track(spark, path).where((F.col("chr") == name) & (F.col("x2") > low) & (F.col("x1") < high)).collect()
        assert sorted(map(tuple, found)) == sorted(r for r in rows if r[0] == name and r[2] > low and r[1] < high)


def test_ranges_skip_leaves_and_sections(made):
    path, rows, _ = made
    r = bigwig.TrackReader(path, 0)
    whole = sum(len(p.places) for p in r.partitions())
    list(r.pushFilters([bigwig.EqualTo(("chr",), "a"), bigwig.GreaterThan(("x2",), 5_000), bigwig.LessThan(("x1",), 5_100)]))
    few = r.partitions()
    assert whole > 50 and sum(len(p.places) for p in few) <= 3
    read = sum(len(b) for p in few for b in r.read(p))
    assert 0 < read <= 16 * 4 < len(rows)


def test_summaries_are_those_of_the_values(spark, made):
    path, rows, _ = made
    for level, size in ((1, 50), (2, 400)):
        told = {}
        for name, x1, x2, v in rows:
            for w in range(x1 // size, (x2 - 1) // size + 1):
                n = min(x2, (w + 1) * size) - max(x1, w * size)
                t = told.setdefault((name, w), [0, np.inf, -np.inf, 0.0, 0.0])
                t[0], t[1], t[2], t[3], t[4] = t[0] + n, min(t[1], v), max(t[2], v), t[3] + n * v, t[4] + n * v * v
        found = {(r.chr, r.x1 // size): [r.n, r.low, r.high, r.total, r.squares] for r in bigwig.track(spark, path, level).collect()}
        assert found.keys() == told.keys() and all(found[k] == pytest.approx(told[k], rel=1e-5, abs=1e-5) for k in told)
        some = bigwig.track(spark, path, level).where("chr = 'bb' and x2 > 800 and x1 < 1600").collect()
        assert {(r.chr, r.x1 // size) for r in some} >= {k for k in told if k[0] == "bb" and 800 // size < k[1] < 1600 // size - 1}


def test_windows_of_the_file_are_those_of_the_values(spark, made):
    path, _, df = made
    show = lambda x: sorted(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in bigwig.windows(x, 700).collect())
    assert show(bigwig.track(spark, path)) == show(df)


def test_fixed_and_variable_sections_and_inner_names(spark, tmp_path):
    fixed = struct.pack("<IIIIIBBH", 0, 100, 130, 10, 5, 3, 0, 3) + np.array([1, 2, 3], "<f4").tobytes()
    variable = struct.pack("<IIIIIBBH", 1, 7, 60, 0, 4, 2, 0, 2) + np.array([(7, 0.5), (50, 1.5)], [("x", "<u4"), ("v", "<f4")]).tobytes()
    names = struct.pack("<IIIIQQ", bigwig.NAMES_MARK, 1, 2, 8, 2, 0)
    names_at, leaf = bigwig.HEAD, bigwig.HEAD + 32 + 4 + 2 * 10
    names += struct.pack("<BBH", 0, 0, 2) + b"a\0" + struct.pack("<Q", leaf) + b"b\0" + struct.pack("<Q", leaf + 14)
    names += struct.pack("<BBH", 1, 0, 1) + b"a\0" + struct.pack("<II", 0, 500) + struct.pack("<BBH", 1, 0, 1) + b"b\0" + struct.pack("<II", 1, 300)
    data_at = names_at + len(names)
    parts = [zlib.compress(x) for x in (fixed, variable)]
    index_at = data_at + 4 + sum(map(len, parts))
    index = struct.pack("<IIQIIIIQII", bigwig.RANGES_MARK, 2, 2, 0, 100, 1, 60, index_at, 1, 0) + struct.pack("<BBH", 1, 0, 2)
    index += struct.pack("<IIIIQQ", 0, 100, 0, 125, data_at + 4, len(parts[0])) + struct.pack("<IIIIQQ", 1, 7, 1, 54, data_at + 4 + len(parts[0]), len(parts[1]))
    head = struct.pack("<IHHQQQHHQQIQ", bigwig.FILE_MARK, 4, 0, names_at, data_at, index_at, 0, 0, 0, 0, 1_000, 0)
    path = tmp_path / "two.bw"
    path.write_bytes(head + names + struct.pack("<I", 2) + b"".join(parts) + index)
    told = [("a", 100, 105, 1.0), ("a", 110, 115, 2.0), ("a", 120, 125, 3.0), ("b", 7, 11, 0.5), ("b", 50, 54, 1.5)]
    assert sorted(map(tuple, bigwig.track(spark, str(path)).collect())) == told
    with pytest.raises(Exception, match="not a track file"):
        bigwig.track(spark, __file__).count()


def test_an_empty_track(spark, made, tmp_path):
    path = str(tmp_path / "none.bw")
    bigwig.write_track(made[2].where("x1 < 0"), path, [("a", 10)], [5])
    assert bigwig.track(spark, path).count() == 0 and bigwig.track(spark, path, 1).count() == 0
