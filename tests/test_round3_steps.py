"""Steps that have to grow with the input: how they are planned, beside what they give."""

from __future__ import annotations

import pytest

from contactgrid.operators import features, images, intervals, lists, pairs
from contactgrid.sources import text


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sites_on_both_sides_without_an_open_frame(spark):
    rows = spark.createDataFrame([(1, 1, 10), (2, 1, 500_000), (3, 1, 350), (4, 2, 7)], "id int, chr int, pos int")
    sites = spark.createDataFrame([(1, 350), (1, 400_000), (1, 900_000)], "chr int, pos int")
    near = pairs._as_of(rows, sites, "pos")
    assert "unboundedfollowing" not in _plan(near).lower()
    got = {r.id: (r._frag, r._prev, r._next) for r in near.collect()}
    assert got == {1: (0, None, 350), 2: (2, 400_000, 900_000), 3: (1, 350, 400_000), 4: (0, None, None)}


def test_pile_up_counts_places_before_it_spreads_them(spark):
    loops = spark.createDataFrame([(k, 1, 500, 600, 900, 1000) for k in range(50)], "id long, chr int, start1 long, end1 long, start2 long, end2 long")
    cells = spark.createDataFrame([(1, 1, 5, 9, 2.0), (1, 1, 6, 9, 3.0)], "chr1 int, chr2 int, bin_x int, bin_y int, counts double")
    pile = features.pile_up(loops, cells, 100, 1)
    plan = pile._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and plan.rindex("Aggregate [") > plan.rindex("Generate explode")
    assert {(r.dx, r.dy): r.value for r in pile.collect()} == {(0, 0): 100.0, (1, 0): 150.0}
    assert {r.id: r.enhancement for r in features.enhancement(loops, cells, 100, 1).collect()} == dict.fromkeys(range(50), 2 / (3 / 8))


@pytest.mark.parametrize("of", [lambda m: images.box_blur(m, 1), lambda m: images.expand_with_zeros(m, 5, 6), lambda m: images.rank_percentile(m)])
def test_images_shuffle_cells_only(spark, of):
    cells = spark.createDataFrame([(1, 1, 0, 1, 2.0), (1, 1, 2, 9, 3.0), (2, 2, 7, 7, 1.0)], "chr1 int, chr2 int, bin_x int, bin_y int, counts double")
    tiled = images.tiles(cells, 4)
    assert tiled.count() == 3 * 16
    assert _plan(of(tiled)).count("Exchange") == 1


def test_expanded_images_are_cropped_too(spark):
    image = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, None), (1, 3, 0, 4.0), (2, 9, 9, 5.0)], "id long, i int, j int, value double")
    got = {(r.id, r.i, r.j): r.value for r in images.expand_with_zeros(image, 2, 3).collect()}
    assert got == {(k, i, j): 1.0 if (k, i, j) == (1, 0, 0) else 0.0 for k in (1, 2) for i in range(2) for j in range(3)}


def _intervals(spark, n, seed):
    rows = [(k, 1 + k % 2, (k * seed) % 997 - 100, (k * seed) % 997 - 100 + k * k % 130, float(k * 31 % 17)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, chr int, x1 long, x2 long, score double")


def test_hits_are_aggregated_without_pairs(spark):
    (a, base), (b, hits) = _intervals(spark, 90, 71), _intervals(spark, 120, 53)
    over = {x[0]: [y for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]] for x in a}
    best = intervals.best_in_locus(base, hits)
    assert "b_x1" not in _plan(best)
    assert {r.id: (r.hit, r.score) for r in best.collect()} == {k: (min(y, key=lambda h: (-h[4], h[0]))[0], max(h[4] for h in y)) for k, y in over.items() if y}
    kept = intervals.preserving_intersect(base, hits)
    assert "b_x1" not in _plan(kept)
    assert {r.id: (r.n_hits, r.first_hit) for r in kept.collect()} == {k: (len(y), min(h[0] for h in y)) for k, y in over.items() if y}


def test_lists_in_nine_cells_are_not_broadcast(spark):
    loops = spark.createDataFrame([(k, 1, k, k + 5, k + 9, k + 12) for k in range(9)], "id long, chr int, start1 long, end1 long, start2 long, end2 long")
    assert "Broadcast" not in _plan(features.compare_lists(loops.where("id % 2 = 0"), loops.where("id % 2 = 1"), 2))


def test_short_lists_of_chromosomes_are_broadcast(spark):
    pairs_ = spark.createDataFrame([("chr1", 5, "2", 6), ("x", 1, "1", 1)], "chr1 string, pos1 int, chr2 string, pos2 int")
    found = text.with_ordinals(pairs_, spark.createDataFrame([(1, "1", 1), (2, "2", 1)], "chr int, name string, length long"), clean=True)
    assert _plan(found).count("BroadcastHashJoin") == 2
    assert [tuple(r) for r in found.select("chr1", "pos1", "chr2", "pos2").collect()] == [(1, 5, 2, 6)]


def test_a_long_island_of_boxes(spark):
    rows = [(k, 1, (k * 37) % 4000, (k * 91) % 50, *(float(k % m) for m in (7, 5, 3, 2, 11))) for k in range(6000)]
    kind = "id long, chr int, i long, j long, " + ", ".join(f"{c} double" for c in lists.SCORES)
    edges, members = [], []
    for r in rows:
        fit = (n for n, e in enumerate(edges) if min(abs(e[0] - r[2]), abs(e[1] - r[2])) < 3 and min(abs(e[2] - r[3]), abs(e[3] - r[3])) < 3)
        n = next(fit, len(edges))
        if n == len(edges):
            edges.append([r[2], r[2], r[3], r[3]])
            members.append([])
        edges[n] = [min(edges[n][0], r[2]), max(edges[n][1], r[2]), min(edges[n][2], r[3]), max(edges[n][3], r[3])]
        members[n].append(r)
    want = sorted((e[1], e[3], len(m), round(sum(r[4] for r in m) / len(m), 6)) for e, m in zip(edges, members, strict=True))
    got = lists.binned_scores(spark.createDataFrame(rows, kind), 3).collect()
    assert sorted((r.i, r.j, r.n, round(r.score, 6)) for r in got) == want


def test_intervals_of_many_islands_are_one_frame(spark):
    main = spark.createDataFrame([(1, 1, 10, 20), (2, 1, 500, 510)], "id long, chr int, x1 long, x2 long")
    more = spark.createDataFrame([(1, 1, 15, 30), (2, 1, 9, 11), (3, 1, 28, 40), (4, 1, 30, 33), (5, 1, 505, 506), (6, 1, 500, 505)], "id long, chr int, x1 long, x2 long")
    assert sorted(r.id for r in lists.non_conflicting(main, more).collect()) == [3, 4, 5]


def test_exponential_of_a_sparse_map_agrees_with_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from pyspark.sql import functions as F

    from contactgrid.plans import catalog

    line = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").withColumns({"l_partkey": F.col("l_partkey") * 10, "l_suppkey": F.col("l_suppkey") * 10})
    line.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    name = "x04_more_transforms"
    got = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLES[name]})").fetchall()
    rows = sorted(tuple(r) for r in got.collect())
    assert max(r[got.columns.index("explogceo")] for r in rows) > 1e12
    assert rows == sorted(want)
