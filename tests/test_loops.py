"""Loop callers step by step against plain Python, and on planted maps."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contactgrid import adapters
from contactgrid.functions.scalars import poisson_p
from contactgrid.operators import binning, features, loops
from contactgrid.plans import registry_loops

RATES = ", ".join(f"fdr{m} double" for m in loops.MASKS)


def pixel_frame(spark, rows: pd.DataFrame, schema=loops.PIXEL):
    frame = spark.createDataFrame(rows)
    return frame.select(*(frame[c.split()[0]].cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")))


def greedy(rows, base, size):
    """Centroids by looking at all pixels that are left, for each seed."""
    rows, out = sorted(rows, key=lambda r: (-r[2], r[0], r[1])), []
    while rows:
        seed, rest = rows[0], []
        members, reach = [seed], float(base)
        cx, cy = seed[0] * size, seed[1] * size
        for r in rows[1:]:
            if math.hypot(r[0] * size - cx, r[1] * size - cy) <= reach:
                members.append(r)
                cx, cy = np.mean([m[0] * size for m in members]), np.mean([m[1] * size for m in members])
                reach = base + round(max(math.hypot(m[0] * size - cx, m[1] * size - cy) for m in members))
            else:
                rest.append(r)
        out.append((seed[0], seed[1], len(members), round(cx) + size // 2, round(cy) + size // 2, round(reach - base)))
        rows = rest
    return sorted(out)


def test_centroids_are_those_of_looking_at_all_pixels(spark):
    rng = np.random.default_rng(4)
    frames, told = [], {}
    for chr_ in (1, 2):
        for size in (5_000, 25_000):
            centres = rng.integers(0, 1500, (40, 2))
            at = np.unique(np.concatenate([c + rng.integers(-6, 7, (20, 2)) for c in centres] + [centres[:3] + k * np.array([[2, 1]]) for k in range(40)]), axis=0)
            counts = rng.integers(1, 50, len(at))
            frames.append(pd.DataFrame({"bin_size": size, "chr": chr_, "bin_x": at[:, 0], "bin_y": at[:, 1], "observed": counts.astype(float)}))
            told[size, chr_] = greedy(list(zip(*at.T.tolist(), counts.tolist(), strict=True)), loops.SETTINGS[size][2], size)
    rows = pd.concat(frames)
    for m in loops.MASKS:
        rows[f"expected{m}"], rows[f"bin{m}"], rows[f"fdr{m}"] = 1.0, 0, 0.0
    found = defaultdict(list)
    for r in loops.cluster(pixel_frame(spark, rows, f"{loops.PIXEL}, {RATES}")).collect():
        found[r.bin_size, r.chr].append((r.bin_x, r.bin_y, r.numCollapsed, r.centroid1, r.centroid2, r.radius))
    assert {k: sorted(v) for k, v in found.items()} == told


def test_thresholds_have_no_upper_end_and_may_not_exist(spark):
    rng = np.random.default_rng(7)
    rows = pd.DataFrame({"bin_size": 10_000, "chr": 1, "bin_x": range(400), "bin_y": range(100, 500), "observed": np.r_[rng.poisson(3, 398), 50_000, 70_000].astype(float)})
    for k, m in enumerate(loops.MASKS):
        rows[f"expected{m}"], rows[f"bin{m}"] = 3.0, 4 + (rows["bin_x"] % 2) * (k == 0)
    rows.loc[rows["bin_x"] < 50, "binBL"] = 30  # a lambda bin of which nothing passes
    p = pixel_frame(spark, rows)
    rates = loops.thresholds(p).toPandas()
    for m in loops.MASKS:
        for b, part in rows.groupby(f"bin{m}"):
            mine = rates[(rates["mask"] == m) & (rates["bin"] == b)].set_index("o")
            passing = []
            for o in sorted(set(part["observed"])):
                told = len(part) * poisson_p(np.array([o]), np.array([2 ** ((b + 1) / 3)]))[0]
                seen = (part["observed"] >= o).sum()
                assert mine.loc[o, "rate"] == pytest.approx(told / seen)
                passing += [o] if o > 0 and told <= 0.1 * seen else []
            assert (mine["least"].isna().all() if not passing else (mine["least"] == min(passing)).all())
    found = {r.observed for r in loops.enriched(p, loops.thresholds(p)).collect()}
    assert {50_000, 70_000} <= found
    assert not any(r.binBL == 30 for r in loops.enriched(p, loops.thresholds(p)).collect())


def test_empty_masks_and_absent_bins_are_no_error(spark):
    """Cells so far apart that masks hold nothing, one with an expected value of 0, and no cells at all."""
    cells = spark.createDataFrame([(1, 1, 10, 60, 40.0), (1, 1, 200, 260, 5.0), (1, 1, 5, 5, 1.0)], "chr1 int, chr2 int, bin_x int, bin_y int, counts double")
    vector = spark.createDataFrame([(1, k, 1.0) for k in range(300)], "chr int, bin int, value double")
    density = spark.createDataFrame([(k, 0.0 if k < 100 else 1.0) for k in range(300)], "dist int, value double")
    for some in (cells, cells.where("counts < 0")):
        assert loops.call_loops(some, vector, density, 10_000).count() == 0
        assert loops.call_loops_by_p(some, vector, density, 10_000).count() == 0
        given = spark.createDataFrame([(1, 1, 100_000, 110_000, 600_000, 610_000)], "id long, chr int, start1 long, end1 long, start2 long, end2 long")
        assert loops.not_enriched(given, some, vector, density, 10_000).count() == 0
    zero = spark.createDataFrame([(5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2)], "observed double, expectedBL double, expectedDonut double, expectedH double, expectedV double, fdrBL double, fdrDonut double, fdrH double, fdrV double, numCollapsed int")
    assert zero.where(features.fdr_accepts()).count() == 1  # more than nothing, without a division


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_callers_find_each_planted_loop_at_several_resolutions(spark, sf):
    d = f"/root/testdata/{sf}"
    at = adapters.loop_pairs(spark, d)
    planted = {(r.chr1, r.pos1 // 500_000) for r in at.where("pos1 % 500000 between 100000 and 107500 and pos2 - pos1 > 180000").groupBy("chr1", "chr2", "pos1").count().collect()}
    merged = registry_loops.c01(spark, d).collect()
    near = lambda r: abs(r.start1 % 500_000 - 100_000) <= 15_000 and r.start2 - r.start1 in range(185_000, 215_001)
    assert {(r.chr, r.start1 // 500_000) for r in merged} <= planted and all(map(near, merged)) and len(merged) == len({(r.chr, r.start1 // 500_000) for r in merged})
    assert len(merged) >= (15 if sf == "sf0.01" else 1)
    by_p = registry_loops.c02(spark, d).collect()
    assert all(map(near, by_p)) and len(by_p) > 0
    assert {r.bin_size for r in by_p} <= set(loops.SETTINGS)


def test_pixels_near_bins_without_a_norm_go(spark):
    cells = binning.bin_contacts(adapters.loop_pairs(spark, "/root/testdata/sf0.01"), [10_000]).drop("unit")
    sizes = adapters.chrom_sizes(adapters.loop_pairs(spark, "/root/testdata/sf0.01"))
    settings = {10_000: loops.SETTINGS[10_000]}
    vector, density, missing = loops.maps_by_size(cells, sizes, [10_000])
    before = loops.call_loops(cells, vector, density, settings=settings, missing=missing).select("chr", "start1").collect()
    lost = before[0]
    gap = spark.createDataFrame([(10_000, lost.chr, lost.start1 // 10_000 + 5)], "bin_size int, chr int, bin int")
    after = loops.call_loops(cells, vector, density, settings=settings, missing=missing.unionByName(gap)).select("chr", "start1").collect()
    assert set(after) == {r for r in before if r.chr != lost.chr or abs(r.start1 - lost.start1 - 50_000) > 50_000} and len(after) < len(before)
    assert missing.where(F.col("bin") < 0).count() == 0


def test_differential_loops_are_the_lost_ones(spark):
    found = registry_loops.c04d(spark, "/root/testdata/sf0.01").collect()
    assert {r.only_in for r in found} == {"A"}
    assert all(r.start1 // 500_000 % 2 == 0 for r in found) and len(found) >= 9
