"""More steps that have to grow with the input: how they are planned, beside what they give."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from contactgrid.operators import binning, images, intervals, stats

CELL = "chr1 int, chr2 int, bin_x int, bin_y int, counts double"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_common_parts_are_made_once(spark):
    for seed, (most, far) in enumerate(((300, 60), (40, 40), (100_000, 90_000))):
        r = random.Random(seed)
        a, b = ([(k, 1 + k % 2, x, x + r.randrange(far)) for k in range(70) for x in (r.randrange(most) - 20,)] for _ in range(2))
        of = lambda rows: spark.createDataFrame(rows, "id long, chr int, x1 long, x2 long")
        found = intervals.intersect(of(a), of(b))
        assert "b_x1" not in _plan(found)
        got = [tuple(x) for x in found.collect()]
        want = {(x[1], max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]}
        assert len(got) == len(want) and set(got) == want


def test_windows_of_the_localizer_hold_cells_only(spark):
    loops = spark.createDataFrame([(k, 1, 5000, 6000, 9000, 10_000) for k in range(40)] + [(99, 2, 5000, 6000, 9000, 10_000)], "id long, chr int, start1 long, end1 long, start2 long, end2 long")
    cells = spark.createDataFrame([(1, 1, 5, 9, 60.0), (1, 1, 6, 9, 3.0), (1, 1, 3, 7, 2.0)], CELL)
    found = images.localize(loops, cells, 1000, radius=4, sigma=2)
    assert "sequence(0, 8" not in _plan(found)
    rows = found.collect()
    assert {r.id for r in rows} == set(range(40)) and len({(r.rank, r.start1, r.start2, r.observed, r.expected, r.z, r.p_value) for r in rows}) == 1
    # the same by windows over every place of one loop
    raw = images.loop_images(loops.where("id = 0"), cells, 1000, 4)
    summed = images.box_blur(raw, 1).withColumn("value", F.col("value") * 9)
    both = summed.join(images.gaussian_blur(summed, 2).withColumnRenamed("value", "expected"), ["id", "i", "j"]).toPandas()
    both["expected"] *= both["value"].sum() / both["expected"].sum()
    both["z"] = 2 * (both["value"] ** 0.5 - both["expected"] ** 0.5)
    best = both.sort_values(["z", "i", "j"], ascending=[False, True, True]).iloc[0]
    assert abs(rows[0].z - best.z) < 1e-9 and (rows[0].start1, rows[0].start2) == ((1 + best.i) * 1000, (5 + best.j) * 1000)


def test_counts_are_drawn_in_batches(spark):
    cells = spark.range(3000).select(F.lit(1).alias("chr1"), F.lit(2).alias("chr2"), F.col("id").cast("int").alias("bin_x"), (F.col("id") * 7).cast("int").alias("bin_y"), F.when(F.col("id") == 0, 500_000.0).otherwise(F.col("id") % 80 + 1.0).alias("counts"))
    total, n = cells.agg(F.sum("counts")).first()[0], 3000
    thin = binning.thin(cells, 0.3)
    kept = {r.bin_x: r.counts for r in thin.collect()}
    assert kept == {r.bin_x: r.counts for r in binning.thin(cells.repartition(5), 0.3).collect()}
    assert abs(sum(kept.values()) - 0.3 * total) < 6 * (0.21 * total) ** 0.5
    few = [kept.get(k, 0.0) for k in range(1, n) if k % 80 == 40]  # 41 counts each
    mean = sum(few) / len(few)
    assert abs(mean - 12.3) < 6 * (41 * 0.21 / len(few)) ** 0.5 and 0.3 < sum((v - mean) ** 2 for v in few) / len(few) / (41 * 0.21) < 3
    wide = binning.rebin(cells, 1000, 1500)
    rows = {(r.bin_x, r.bin_y): r.counts for r in wide.collect()}
    assert rows == {(r.bin_x, r.bin_y): r.counts for r in binning.rebin(cells.repartition(5), 1000, 1500).collect()}
    assert sum(rows.values()) == total
    wholly = binning.rebin(cells.where("bin_x = 0"), 1000, 700).collect()  # two bins each way: 700 and 300 of 1,000 places
    assert {(r.bin_x, r.bin_y) for r in wholly} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert all(abs(r.counts / 500_000 - (0.7, 0.3)[r.bin_x] * (0.7, 0.3)[r.bin_y]) < 0.005 for r in wholly)


def test_no_generator_is_made_for_a_small_cell():
    import numpy as np

    draws = binning._draws(np.repeat(np.arange(500), 40), np.tile(np.arange(40), 500), 0)
    assert len(set(draws.tolist())) == len(draws)
    assert abs(((draws >> np.uint64(11)) * 2.0**-53).mean() - 0.5) < 0.02


def test_places_come_by_rows_of_bins(spark):
    r = random.Random(3)
    rows = [(1 + r.randrange(2), 3, x, y, 1.0) for x, y in sorted({(r.randrange(12), r.randrange(30)) for _ in range(150)})]
    cells = spark.createDataFrame(rows, CELL)
    placed = binning.place(cells, "bin_y", "bin_x", "place")
    assert "windowspecdefinition(chr1" in _plan(placed) and any("bin_y" in p.split("bin_x")[0] for p in _plan(placed).split("row_number() windowspecdefinition(")[1:])
    got = {(x.chr1, x.bin_x, x.bin_y): x.place for x in placed.collect()}
    for c in (1, 2):
        mine = sorted((t for t in rows if t[0] == c), key=lambda t: (t[3], t[2]))
        assert [got[c, t[2], t[3]] for t in mine] == list(range(1, len(mine) + 1))


def test_chromosomes_of_a_validated_map_are_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = spark.createDataFrame([(1, 1, 0, 9, 2.0), (1, 2, 3, 1, -1.0), (1, 2, 3, 1, 4.0)], CELL)
        found = stats.validate(cells, spark.createDataFrame([(1, 800), (2, 800)], "chr int, length long"), 100)
        assert _plan(found).count("BroadcastHashJoin") == 2
        assert {tuple(r) for r in found.collect()} == {(1, 1, 1, 0, 0, 1, 0), (1, 2, 1, 1, 0, 0, 1)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lifted_cells_are_copied_behind_the_joins(spark):
    regions = spark.createDataFrame([(1, 1, 0, 2000, 100), (2, 1, 0, 1000, 9000), (3, 2, 500, 1500, 0)], "id long, chr int, x1 long, x2 long, new_start long")
    cells = spark.createDataFrame([(1, 1, 0, 1, 2.0), (1, 2, 1, 1, 3.0), (1, 2, 9, 1, 5.0)], CELL)
    lifted = intervals.lift_cells(cells, regions, 1000)
    plan = lifted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join Inner") and plan.count("Generate inline") == 2
    want = {(a, b, *sorted(((n[a] + x * 1000) // 1000, (n[b] + 1000) // 1000)), 2.0) for n, x in (({1: 100, 2: 9000}, 0),) for a in (1, 2) for b in (1, 2)}
    want |= {(a, 3, 0, (n + 1000) // 1000, 3.0) for a, n in ((1, 100), (2, 9000))}
    assert {tuple(r) for r in lifted.collect()} == want


def test_gram_of_tasks_without_rows(spark):
    from contactgrid.operators import linalg

    rows = spark.createDataFrame([(1, [], [2.0, 1.0])], "chr int, q array<double>, y array<double>")
    assert linalg._gram(rows.repartition(3).unionByName(rows.where("chr = 2")))[1].tolist() == [[4, 2], [2, 1]]


def test_stripes_meet_in_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    from contactgrid.operators import linalg

    monkeypatch.setattr(linalg, "TASK_STRIPES", 4, raising=False)
    oe = spark.createDataFrame([(1, 1, k, k + 1, 1.0 + k % 3) for k in range(31)], "chr1 int, chr2 int, bin_x int, bin_y int, oe double")
    sizes = spark.createDataFrame([(1, 3200)], "chr int, length long")
    found = linalg.pearson(oe, sizes, 100, height=8)
    assert found.rdd.getNumPartitions() == 1 + 16 // 4
    assert found.count() == 32 * 32
    whole = {(r.row, r.row2): r.r for r in linalg.pearson(oe, sizes, 100).collect()}
    assert all(abs(r.r - whole[r.row, r.row2]) < 1e-12 for r in found.collect())


def test_records_are_cut_into_pieces_and_short_ranges_share_tasks(spark, tmp_path):
    from contactgrid.sources import binary

    rows = [(1, k, 2, k * 3, 0.5) for k in range(2501)]
    pairs = spark.createDataFrame(rows, "chr1 int, pos1 int, chr2 int, pos2 int, score float").coalesce(1)
    found = binary.decode_records(binary.encode_records(pairs, binary.SHORT), binary.SHORT)
    assert "Generate explode" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == rows
    binary.write_records(pairs, str(tmp_path / "r"), binary.SHORT, ".bn")
    read = binary.read_binary_pairs(spark, f"{tmp_path}/r/*.bn", 10)
    assert read.rdd.getNumPartitions() <= max(4, spark.sparkContext.defaultParallelism)
    assert sorted(tuple(r) for r in read.collect()) == rows
