"""Steps on pairs and tiles that have to stay bounded: how they are planned, beside what they give."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from contactgrid import adapters
from contactgrid.operators import domains, intervals, loops
from contactgrid.plans import registry_loops


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_of_references_are_made_without_pairs(spark):
    r = random.Random(4)
    kind = "id long, chr int, x1 long, x2 long"
    base = [(k, 1 + k % 2, x, x + r.randrange(90)) for k in range(150) for x in (r.randrange(900) - 60,)]
    hits = [(k * 7 % 301, 1 + k % 3, x, x + r.choice((0, 5, 400))) for k in range(300) for x in (r.randrange(900) - 60,)]
    found = intervals.all_references(spark.createDataFrame(base, kind), spark.createDataFrame(hits, kind), width=64)
    assert "b_x1" not in _plan(found)
    over = {b: sorted(h[0] for h in hits if h[1] == b[1] and h[2] <= b[3] and b[2] <= h[3]) for b in base}
    want = {(*b, len(h), ",".join(map(str, h))) for b, h in over.items() if h}
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(want) and set(got) == want
    none = spark.createDataFrame([], kind)
    assert intervals.all_references(none, spark.createDataFrame(hits, kind)).count() == intervals.all_references(spark.createDataFrame(base, kind), none).count() == 0


def test_pixels_take_cells_with_norms_and_sorted_runs(spark):
    d, size = "/root/testdata/sf0.001", 10_000
    cells = registry_loops.planted_cells(spark, d).where(f"bin_size = {size}")
    met, vector, density, _ = loops.normed_maps(cells, adapters.chrom_sizes(adapters.loop_pairs(spark, d)), [size])
    found = loops.pixels(met, vector, density)
    assert "collect_list(counts" not in _plan(found)
    rows = {tuple(r) for r in found.collect()}
    near = lambda a, b: len(a) == len(b) and all(x[:5] == y[:5] and np.allclose(x[5:], y[5:], rtol=1e-9) for x, y in zip(sorted(a), sorted(b), strict=True))
    assert near(rows, {tuple(r) for r in loops.pixels(cells, vector, density).collect()})
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "7")  # a tile's rows come in many batches
        assert near(rows, {tuple(r) for r in loops.pixels(met, vector, density).collect()})
    finally:
        spark.conf.set(key, before)
    # the masks by plain sums over the normalized matrix of a chromosome
    p, w, _ = loops.SETTINGS[size]
    mine = [r for r in rows if r[1] == 1]
    c = {}
    for r in met.where("chr = 1").collect():
        c[r.bin_x, r.bin_y] = c[r.bin_y, r.bin_x] = r.counts / (r.nx * r.ny)
    of = {(r.bin_x, r.bin_y): r.nx * r.ny for r in met.where("chr = 1").collect()}
    mean = {r.dist: r.value for r in density.collect()}
    for r in mine[:40]:
        x, y, told = r[2], r[3], dict(zip(loops.PIXEL_COLUMNS, r, strict=True))
        win = min(max(min(w, (y - x - 1) // 2), p + 1), 20)
        over = lambda at: [sum(v.get(k(a, b), 0.0) for a, b in at) for v, k in ((c, lambda a, b: (a, b)), (mean, lambda a, b: abs(a - b)))]  # noqa: E731, B023
        quarter = lambda g: [(x + i, y - j) for i in range(1, g + 1) for j in range(1, g + 1) if i > p or j > p]  # noqa: E731, B023
        wide = win
        while over(quarter(wide))[0] < 16 and wide < 20 and 2 * (wide + 1) < y - x:
            wide += 1
        arm = [k for k in range(-win, win + 1) if abs(k) > p]
        ring = [(x + i, y + j) for i in range(-win, win + 1) for j in range(-win, win + 1) if max(abs(i), abs(j)) > p and i and j]
        want = {"BL": quarter(wide), "V": [(x + i, y + j) for i in arm for j in (-1, 0, 1)], "H": [(x + i, y + j) for j in arm for i in (-1, 0, 1)], "Donut": ring}
        for m, at in want.items():
            a, b = over(at)
            assert np.isclose(told[f"expected{m}"], a / b * mean[y - x] * of[x, y], rtol=1e-6)
    assert mine


def test_corners_are_scored_without_squares():
    r = np.random.default_rng(5)
    n = 120
    m = np.triu(r.poisson(0.4, (n, n))).astype(float)
    for k in range(0, 90, 30):
        m[k : k + 25, k : k + 25] += np.triu(r.poisson(3, (25, 25)))
    m += np.triu(m, 1).T
    p = domains.preference(m)
    mean = lambda v: [x / np.maximum(c, 1) for x, c in zip(domains._triangles(v), domains._triangles((np.abs(p) > 0).astype(float)), strict=True)]
    (u, l), (su, sl), (vu, vl) = mean(p), mean(np.sign(p)), mean(p * p)  # noqa: E741
    vu, vl = vu - u * u, vl - l * l
    scaled = lambda x: x / np.abs(x).max()
    score = np.where(vu + vl > domains.VARIANCE, 0.0, np.maximum(scaled(l - u) + scaled(sl - su) - scaled(vu + vl), 0.0))
    i = r.integers(0, n, 300)
    j = np.minimum(i + r.integers(0, n, 300), n - 1)  # some without a width, some twice
    assert np.array_equal(domains.given_corners(m, i, j), np.stack([x[i, j] for x in (score, vu, vl, su, sl)], 1))
    big = np.tile(m, (9, 9))
    tracemalloc.start()
    domains.given_corners(big, i, j)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 10 * big.nbytes
