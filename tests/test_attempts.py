"""Balancing that leaves out rows where it doesn't settle."""

from __future__ import annotations

import numpy as np
import pytest

from contactgrid.operators import norm


def sheet(spark, parts):
    rows = [(c, c, i, j, float(m[i, j])) for c, m in parts.items() for i, j in zip(*np.nonzero(np.triu(m)), strict=True)]
    return spark.createDataFrame([(*map(int, r[:4]), r[4]) for r in rows], "chr1 int, chr2 int, bin_x int, bin_y int, counts double")


@pytest.fixture(scope="module")
def parts():
    """1 settles at once; 2 only without its last row, which has a single cell; 3, one row with all others, never."""
    rng = np.random.default_rng(3)
    full = rng.integers(5, 50, (30, 30)).astype(float)
    full += full.T
    late = np.zeros((30, 30))
    late[:29, :29] = full[:29, :29]
    late[0, :] = late[:, 0] = 0
    late[0, 1] = late[1, 0] = 1.0  # row 0 has one cell, in a row that has others: its sum can't be that row's
    star = np.zeros((12, 12))
    star[0, 1:] = star[1:, 0] = 3.0
    return {1: full, 2: late, 3: star}


@pytest.mark.parametrize("local_cells", [norm.LOCAL_CELLS, 0])
def test_attempts_leave_out_rows_where_needed(spark, parts, local_cells):
    some = parts if local_cells else {k: m[:12, :12] for k, m in parts.items()}
    found = norm.balance_by_attempts(sheet(spark, some), (0.0, 0.04) if local_cells else (0.0, 0.1), 1e-3 if local_cells else 1e-2, 60 if local_cells else 8, local_cells=local_cells).toPandas()
    one, two, three = (found[found["chr"] == c].sort_values("bin") for c in (1, 2, 3))
    assert set(one["attempt"]) == {0} and set(two["attempt"]) == {1} and 0 not in set(two["bin"])
    assert three["value"].isna().all() and three["attempt"].isna().all() and three["bin"].tolist() == list(range(12))
    for frame, m in ((one, some[1]), (two, some[2])):
        at, v = frame["bin"].to_numpy(), frame["value"].to_numpy()
        sums = (m[np.ix_(at, at)] / np.outer(v, v)).sum(axis=1)
        assert sums == pytest.approx(sums.mean(), rel=0.03) and (m[np.ix_(at, at)] / np.outer(v, v)).sum() == pytest.approx(m[np.ix_(at, at)].sum(), rel=1e-6)


def test_no_silent_vector_without_an_end(spark, parts):
    found = norm.balance(sheet(spark, parts), 1e-4, 60).toPandas()
    assert found[found["chr"] == 1]["value"].notna().all() and len(found[found["chr"] == 1]) == 30
    assert found[found["chr"] == 3]["value"].isna().all() and len(found[found["chr"] == 3]) == 12


def test_rows_of_tiny_values_are_left_out_of_the_next_attempt(spark):
    m = np.full((10, 10), 1e6)
    m[9, :] = m[:, 9] = 1e-3
    found = norm.balance_by_attempts(sheet(spark, {1: m}), (0.0, 0.0), 1e-6, 1000, 0.01).toPandas()
    assert set(found["attempt"]) == {1} and 9 not in set(found["bin"])


def test_failed_chromosomes_are_not_tried_at_finer_bins(spark, parts):
    coarse = sheet(spark, {1: parts[1], 3: parts[3]}).selectExpr("100 as bin_size", "*")
    fine = sheet(spark, {1: parts[1][:20, :20], 3: parts[1][:20, :20]}).selectExpr("50 as bin_size", "*")
    sizes = spark.createDataFrame([(1, 3000), (3, 3000)], "chr int, length long")
    found = norm.add_norms_at(coarse.unionByName(fine), sizes, ("KR", "VC")).toPandas()
    there = set(zip(found["bin_size"], found["norm"], found["chr"], strict=True))
    assert (50, "KR", 3) not in there and (50, "VC", 3) in there and (50, "KR", 1) in there
    assert found[(found["bin_size"] == 100) & (found["norm"] == "KR") & (found["chr"] == 3)]["value"].isna().all()
