"""Lifts make far more pairs than rows: how these are planned and stand in files, beside what they are."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from contactgrid.operators import intervals

KIND = "id long, chr int, x1 long, x2 long"


def _near(n: int, m: int):
    r = random.Random(6)
    rows = [(k, None if k % 41 == 0 else 1 + k % 3, x, x + r.choice((0, 5, 400))) for k in range(n) for x in (r.randrange(12_000) - 600,)]
    places = [(k * 7 % 301, None if k % 37 == 0 else 1 + k % 2, x, x + r.randrange(3_000)) for k in range(m) for x in (r.randrange(12_000) - 600,)]
    r.shuffle(rows)
    return [*rows, (n, 1, 10, 5), (n + 1, 1, None, 900)], [*places, (302, 1, 300, 90), (303, 1, 20, None)]


def _over(rows, places):
    return [(a, b) for a in rows for b in places if None not in (*a, *b) and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]]


def test_lifts_are_those_of_all_pairs(spark):
    rows, places = _near(120, 90)
    a = spark.createDataFrame(rows, KIND)
    b = spark.createDataFrame(places, KIND).withColumns({"new_start": F.col("x1") * 3 + 1000, "inverted": F.col("id") % 2 == 0})
    want_track, want = [], []
    for p, q in _over(rows, places):
        lo, hi, new = max(p[2], q[2]), min(p[3], q[3]), q[2] * 3 + 1000
        want_track.append((p[0], q[0], lo - q[2] + new, hi - q[2] + new, p[0] / 4))
        start = new + q[3] - hi if q[0] % 2 == 0 else new + lo - q[2]
        want.append((p[0], p[1], q[0], start, start + hi - lo))
    for width in (64, intervals.BUCKET):
        assert sorted(tuple(x) for x in intervals.lift(a, b, width).collect()) == sorted(want)
    assert sorted(tuple(x) for x in intervals.lift_track(a.withColumn("score", F.col("id") / 4), b).collect()) == sorted(want_track)
    assert len(want) > 3 * len(rows)
    none = spark.createDataFrame([], KIND)
    assert intervals.overlap_pairs(none, a).count() == intervals.overlap_pairs(a, none).count() == 0


def test_lifted_pairs_stand_in_order_and_no_side_is_broadcast(spark, tmp_path):
    rows, places = (spark.createDataFrame(x, KIND) for x in _near(3_000, 400))
    found = intervals.lift_track(rows.withColumn("score", F.col("id") / 4), places.withColumn("new_start", F.col("x1") * 3 + 1000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange") == 2
    at = {r.id: (r.chr, r.x1, r.x2) for r in rows.collect()}
    seen: dict[int, list] = {}
    for r in found.withColumn("task", F.spark_partition_id()).collect():
        ids = seen.setdefault(r.task, [])
        if not ids or ids[-1] != r.id:
            ids.append(r.id)
    for ids in seen.values():  # a row's pairs stand together, beside its neighbours'
        along = [(at[x][0], at[x][1] // intervals.BUCKET, *at[x][1:]) for x in ids]
        back = sum(p > q for p, q in zip(along, along[1:], strict=False))
        assert back <= 12  # where a stretch begins, and in order of hashes of stretches
    assert sum(map(len, seen.values())) < 2 * 3_000
