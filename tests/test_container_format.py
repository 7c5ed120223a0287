"""The container's data source, and whole files written by tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactgrid.sources import container, container_format


def rows(df):
    return {(r.chr1, r.chr2, r.unit, r.bin_size, r.bin_x, r.bin_y): r.counts for r in df.collect()}


@pytest.fixture(scope="module")
def cells(spark):
    rng, out = np.random.default_rng(5), {}
    for pair in ((1, 1), (1, 2), (2, 2)):
        for size in (1_000, 5_000):
            for x, y in np.sort(rng.integers(0, 1_500, (200, 2)), axis=1).tolist():
                out[(*pair, "BP", size, x, y)] = float(rng.integers(1, 90)) if size == 1_000 else float(np.float32(rng.random()))
    out |= {(1, 1, "FRAG", 1, x, x + k): 1.0 for x in range(50) for k in range(50)}
    return spark.createDataFrame([(*k, v) for k, v in out.items()], container.CELLS), out


def test_a_whole_file_is_written_and_read(spark, cells, tmp_path):
    df, told = cells
    path = str(tmp_path / "map.container")
    values = {("VC", 1, "BP", 1_000): [1.5, None, 2.5], ("KR", 2, "BP", 5_000): [None, 4.0]}
    vectors = spark.createDataFrame([(*k, b, v) for k, vs in values.items() for b, v in enumerate(vs)], "norm string, chr int, unit string, bin_size int, bin int, value double")
    container_format.write_container(df.repartition(5), path, [("1", 5_000_000), ("2", 4_000_000)], vectors, "g1", {"software": "x"}, block_bins=100)
    c = container.open_container(path)
    assert (c.version, c.genome, c.attributes, c.bp_sizes, c.frag_sizes) == (8, "g1", {"software": "x"}, [5_000, 1_000], [1])
    assert c.chromosomes == [(0, "All", 9_000), (1, "1", 5_000_000), (2, "2", 4_000_000)]
    assert rows(container_format.contact_map(spark, path)) == told
    assert rows(container.read_container(spark, path)) == {k: v for k, v in told.items() if k[2] == "BP"}
    found = {}
    for r in container.read_vectors(spark, path).collect():
        found.setdefault((r.norm, r.chr, r.unit, r.bin_size), {})[r.bin] = r.value
    assert found == {k: dict(enumerate(v)) for k, v in values.items()}
    few = str(tmp_path / "few.container")
    container_format.write_container(df, few, [("1", 5_000_000), ("2", 4_000_000)], least=50.0)
    assert rows(container_format.contact_map(spark, few)) == {k: v for k, v in told.items() if v >= 50}


def test_conditions_skip_matrices_resolutions_and_blocks(spark, cells, tmp_path):
    df, told = cells
    path = str(tmp_path / "map.container")
    container_format.write_container(df, path, [("1", 5_000_000), ("2", 4_000_000)], block_bins=100)
    where = (F.col("chr1") == 1) & (F.col("chr2") == 2) & (F.col("bin_size") == 1_000) & (F.col("bin_x") >= 700) & (F.col("bin_x") < 1_300) & (F.col("bin_y") <= 1_200)
    found = container_format.contact_map(spark, path).where(where)
    assert rows(found) == {k: v for k, v in told.items() if k[:4] == (1, 2, "BP", 1_000) and 700 <= k[4] < 1_300 and k[5] <= 1_200} != {}
    every = container_format.contact_map(spark, path, blocks=True)
    assert every.count() == len({(*k[:4], k[4] // 100, k[5] // 100) for k in told}) and every.where("not is_read").count() == 0
    wanted = container_format.Wanted()
    for f in (container_format.GreaterThanOrEqual(("bin_x",), 700), container_format.LessThan(("bin_x",), 1_300), container_format.EqualTo(("bin_y",), 3_000)):
        wanted.narrow(f)
    p = container_format.Blocks(1, 2, "BP", 1_000, 100, 50, 0, 0)
    on = {(int(b) % 50, int(b) // 50) for b in np.arange(2_500)[wanted.covers(np.arange(2_500), p)]}
    assert on == {(x, 30) for x in range(7, 13)}


@pytest.mark.parametrize("low", [0, 130, 900])
def test_later_versions_blocks_by_depth_hold_all_wanted_bins(low):
    rng = np.random.default_rng(1)
    p, wanted = container_format.Blocks(1, 1, "BP", 1_000, 40, 300, 0, 0, 9), container_format.Wanted()
    wanted.low, wanted.high = {"bin_x": low, "bin_y": low + 50}, {"bin_x": low + 90, "bin_y": low + 800}
    for x, y in np.sort(rng.integers(0, 3_000, (4_000, 2)), axis=1).tolist():
        block = int(np.floor(np.log2(1 + (y - x) / np.sqrt(2) / 40))) * 300 + (x + y) // 2 // 40
        if low <= x <= low + 90 and low + 50 <= y <= low + 800:
            assert wanted.covers(np.array([block]), p)[0]
    assert 0 < wanted.covers(np.arange(9 * 300), p).mean() < 0.5


def test_an_empty_map(spark, cells, tmp_path):
    path = str(tmp_path / "empty.container")
    container_format.write_container(cells[0].where("counts < 0"), path, [("1", 10)])
    assert container_format.contact_map(spark, path).count() == 0
