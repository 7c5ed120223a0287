"""What the findings of round 4 asked for."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactgrid.operators import images


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(4)
    at = np.unique(rng.integers(0, 40, (300, 2)), axis=0)
    rows = [(1, 1, int(min(a, b)), int(max(a, b)), float(n)) for (a, b), n in zip(at, rng.integers(1, 9, len(at)), strict=True)]
    return spark.createDataFrame(rows, "chr1 int, chr2 int, bin_x int, bin_y int, counts double").groupBy("chr1", "chr2", "bin_x", "bin_y").agg(F.sum("counts").alias("counts"))


@pytest.mark.parametrize(("work", "of"), [(lambda m: images.gaussian_blurred(m, 2), lambda m: images.gaussian_blur(m, 2)), (lambda m: images.interpolated(m, 2, 3), lambda m: images.interpolate(m, 2, 3))])
def test_stacks_of_tiles_agree_with_windows(spark, cells, work, of, monkeypatch):
    monkeypatch.setattr(images, "WINDOW_PIXELS", 300)  # two squares of 9 x 9 at a time are more than a batch
    told = of(images.tiles(cells, 9)).withColumn("value", F.round("value", 6))
    want = {(r.id, r.i, r.j): r.value for r in told.collect()}
    got = images.on_tiles(cells, 9, work)
    assert got.schema.simpleString() == "struct<id:bigint,i:int,j:int,value:double>"
    rows = got.collect()
    assert len(rows) == len(want) and {(r.id, r.i, r.j): r.value for r in rows} == want
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_rounding_is_that_of_spark(spark):
    v = np.r_[np.random.default_rng(1).normal(0, 1e3, 500), np.arange(-9, 10) / 8 * 1e-5, 0.0000005, 2.5000005, 1.0000015, 1e9 + 0.1234565, 12345678901.2345678, 1e300, -1e22, 0.0, np.nan, np.inf]
    frame = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "k int, v double").select("k", F.round("v", 6).alias("v"))
    want = [r.v for r in sorted(frame.collect())]
    assert np.array_equal(images._rounded(v, 6), want, equal_nan=True)


_FAR = ["w09_peaks", "w08_box_blur", "w12_expand_with_zeros", "w11_over_median", "w10_local_gradient", "w11_column_derivative", "w07_rank_percentile", "m04_pearson", "m05_eigenvector", "o07_second_eigenvector_by_rounds"]


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Line items with the keys of the first and of the last of 360 copies of sf0.1."""
    folder = str(tmp_path_factory.mktemp("far"))
    one = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    last = one.withColumns({"l_partkey": F.col("l_partkey") + 359 * 20_000, "l_suppkey": F.col("l_suppkey") + 359 * 1_000, "l_orderkey": F.col("l_orderkey") + 359 * 150_000})
    one.unionByName(last).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", _FAR)
def test_positions_beyond_32_bits(spark, far, name):
    duckdb = pytest.importorskip("duckdb")
    from contactgrid.plans import catalog

    got = catalog.QUERIES[name](spark, far)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in ("m05_eigenvector", "o07_second_eigenvector_by_rounds"):
        return  # two copies alike: the vector isn't the only one
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{far}/lineitem.parquet/*.parquet'")
    with pytest.raises(duckdb.ConversionException):
        con.execute(catalog.ORACLES[name])  # the SQL itself stops there
    sql = catalog.ORACLES[name].replace("* 500 AS INTEGER) AS pos1", "* 500 AS BIGINT) AS pos1").replace("* 500 AS INTEGER) AS pos2", "* 500 AS BIGINT) AS pos2")
    want = con.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
    at = [k for k, c in enumerate(got.columns) if c in ("value", "r")]
    plain = lambda r: (*(v for k, v in enumerate(r) if k not in at), *(None if r[k] is None else round(r[k], 4) + 0.0 for k in at))
    assert sorted(map(plain, rows), key=str) == sorted(map(plain, want), key=str)


def test_blocks_are_encoded_in_a_stream(spark, cells, monkeypatch):
    from contactgrid.sources import container

    for name, small in (("BATCH_BLOCKS", 2), ("BATCH_CELLS", 5)):
        monkeypatch.setattr(container, name, small)
    contacts = cells.unionByName(cells.withColumn("chr2", F.lit(2))).withColumns({"unit": F.lit("BP"), "bin_size": F.lit(1000)}).cache()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a block is many batches, and a batch ends within one
        blocks = container.encode_blocks(contacts, 8)
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan  # no call of Python a block
        names = ["chr1", "chr2", "unit", "bin_size", "bin_x", "bin_y", "counts"]
        found = container.decode_blocks(blocks)
        assert sorted(map(tuple, found.select(*names).collect())) == sorted(map(tuple, contacts.select(*names).collect()))
        n = contacts.selectExpr("chr1", "chr2", "floor(bin_x / 8)", "floor(bin_y / 8)").distinct().count()
        assert blocks.count() == n == blocks.select("chr1", "chr2", "block").distinct().count()
        assert container.decode_blocks(container.encode_blocks(contacts.where("false"), 8)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_short_blocks_share_splits(spark, tmp_path):
    from contactgrid.sources import container, container_format

    rows = spark.range(2_000).selectExpr("1 AS chr1", "1 AS chr2", "'BP' AS unit", "1000 AS bin_size", "cast(id AS int) AS bin_x", "cast(id AS int) AS bin_y", "cast(1 + id AS double) AS counts")
    path = str(tmp_path / "one.map")
    container_format.write_container(rows, path, [("1", 2_000_000)], block_bins=8)
    read = container_format.contact_map(spark, path)
    assert read.rdd.getNumPartitions() < 250 // container.SPLIT_BLOCKS  # 250 blocks of some bytes
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))


def test_sites_of_a_line_are_split_once(spark):
    from contactgrid.sources import text

    lines = spark.createDataFrame([("chr1 10 20 35",), (" chr2\t7 ",), ("chr3",)], "value string")
    found = text.parse_sites(lines)
    assert sorted(map(tuple, found.collect())) == [("chr1", 0, 10), ("chr1", 1, 20), ("chr1", 2, 35), ("chr2", 0, 7)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate" in line or line.startswith("Project")]
    assert made and not any("split(" in line for line in made)  # beside the rows of a line it would be made for each


def test_lifted_features_are_many_tasks(spark):
    from contactgrid.operators import intervals

    features = [(1, 1, 4_990, 5_010, 12_000, 12_500, True, False), (2, 1, 100, 200, 30_000, 30_001, False, False), (3, 2, 4_990, 5_010, 5_000, 5_020, True, True), (4, 1, 900_000, 900_001, 5_000, 5_001, True, True)]
    scaffolds = [(k, 1 + k % 2, 700 * k, 700 * k + 9_000, 10_000 * k, k % 3 == 0) for k in range(30)]
    rows = spark.createDataFrame(features, "id long, chr int, start1 long, end1 long, start2 long, end2 long, strand1 boolean, strand2 boolean")
    found = intervals.lift_features(rows, spark.createDataFrame(scaffolds, "id long, chr int, x1 long, x2 long, new_start long, inverted boolean"))
    want = []
    for i, chr_, *ends, s1, s2 in features:
        of = []
        for a, b, s in ((*ends[:2], s1), (*ends[2:], s2)):
            at = [(k, new + x2 - b if turned else new + a - x1, s != turned) for k, c, x1, x2, new, turned in scaffolds if c == chr_ and x1 <= a and b <= x2]
            of.append([(k, x, x + b - a, strand) for k, x, strand in at])
        want += [(i, *p, *q) for p in of[0] for q in of[1]]
    names = ["id", "scaffold1", "start1", "end1", "strand1", "scaffold2", "start2", "end2", "strand2"]
    assert found.columns == names and len(want) == 40
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism  # however little is shuffled


def test_exponential_has_the_digits_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from contactgrid.functions import transforms

    pairs = [(2.0, 0.003631556666666667), (2.0, 0.0036554733333333334), (2.0, 0.006596523333333333), (1.0, 0.5), (7.0, 1e-4), (3.0, 12.5), (2.0, 0.003631556666666667)]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, c double, ec double").coalesce(1)
    got = [r.v for r in sorted(frame.select("k", transforms.exp_log_digits(F.col("c"), F.col("ec")).alias("v")).collect())]
    want = [duckdb.execute("select CAST(format('{:.8e}', exp(ln(c + 1) / ln(ec + 1))) AS DOUBLE) from (select ?::double c, ?::double ec)", p).fetchone()[0] for p in pairs]
    assert got == want and got[0] == 4.17289666e131 and got[4] == float("inf")  # Java's exponential gives 4.17289665e131
    none = spark.createDataFrame([(1.0, 0.0), (None, 1.0), (1.0, None)], "c double, ec double")
    assert [r.v for r in none.select(transforms.exp_log_digits(F.col("c"), F.col("ec")).alias("v")).collect()] == [None] * 3
