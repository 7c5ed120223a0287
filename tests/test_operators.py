"""Operators that have no SQL, and edge cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contactgrid.functions import scalars
from contactgrid.operators import binning, domains, expected, intervals, linalg, loops, norm, pairs, query
from contactgrid.sources import text
from contactgrid.streaming.ingest import stream_contacts

CELL = "chr1 int, chr2 int, bin_x int, bin_y int, counts double"


def symmetric(n, seed=0):
    m = np.random.default_rng(seed).poisson(5, (n, n)).astype(float) + 1
    return m + m.T


def cells_of(spark, m, chr_=1):
    return spark.createDataFrame([(chr_, chr_, i, j, float(m[i, j])) for i in range(len(m)) for j in range(i, len(m)) if m[i, j]], CELL)


def test_balance_makes_row_sums_equal_and_keeps_the_total(spark):
    m = symmetric(30)
    v = norm.balance(cells_of(spark, m), tolerance=1e-9, rounds=500).toPandas().sort_values("bin")["value"].to_numpy()
    normed = m / np.outer(v, v)
    assert np.allclose(normed.sum(axis=1), normed.sum(axis=1).mean(), rtol=1e-4)
    assert normed.sum() == pytest.approx(m.sum())


def test_eigenvector_finds_two_blocks(spark):
    m = np.ones((20, 20))
    m[:10, :10] = m[10:, 10:] = 4
    m += np.random.default_rng(1).random((20, 20)) * 0.1
    rows = [(1, 1, i, j, float(m[i, j])) for i in range(20) for j in range(i, 20)]
    v = linalg.eigenvector(spark.createDataFrame(rows, "chr1 int, chr2 int, bin_x int, bin_y int, oe double")).toPandas().sort_values("bin")["value"]
    assert len({*np.sign(v[:10])}) == 1 and len({*np.sign(v[10:])}) == 1 and np.sign(v.iloc[0]) != np.sign(v.iloc[19])


def test_smoothed_density_is_raw_where_counts_suffice():
    observed, possible = np.array([1000.0, 900, 800, 1, 1, 1]), np.array([6.0, 5, 4, 3, 2, 1])
    d = expected.smooth_density(observed, possible)
    assert d[0] == observed[0] / possible[0]
    assert (d > 0).all()


def test_empty_inputs(spark):
    cells = spark.createDataFrame([], CELL)
    for df in (norm.coverage(cells), norm.vc(cells), binning.coarsen(cells, 2), binning.matrix_sums(cells), query.min_count(cells, 1)):
        assert df.count() == 0
    loci = spark.createDataFrame([], "id long, chr int, x1 long, x2 long")
    assert intervals.merge(loci).count() == 0 and intervals.intersect(loci, loci).count() == 0


def test_merge_carries_over_stretches(spark):
    rows = [(1, 1, 0, 9_000_000), (2, 1, 5_000_000, 5_000_100), (3, 1, 9_000_001, 9_000_010), (4, 2, 0, 5)]
    found = intervals.merge(spark.createDataFrame(rows, "id long, chr int, x1 long, x2 long")).collect()
    assert sorted((r.chr, r.x1, r.x2, r.n) for r in found) == [(1, 0, 9_000_000, 2), (1, 9_000_001, 9_000_010, 1), (2, 0, 5, 1)]


def test_layouts_and_files(spark, tmp_path):
    assert [text.layout_of(x) for x in ("1 2 3 4", "1 2 3 4 5", "#x", "a " * 8, "a " * 9, "a " * 11, "a " * 16)] == [
        "super_short", "super_short_score", "dcic", "short", "short_score", "medium", "long",
    ]
    with pytest.raises(ValueError):
        text.layout_of("1 2")
    (tmp_path / "p.txt").write_text("0 1 100 0 16 2 200 1 3\n16 X 5 2 0 1 7 3 1.5\n")
    found = text.read_pairs(spark, str(tmp_path / "p.txt")).orderBy("pos1").collect()
    assert [(r.strand1, r.chr1, r.pos1, r.score) for r in found] == [(False, "X", 5, 1.5), (True, "1", 100, 3.0)]
    assert query.parse_region("chr1:1,000-2000") == ("chr1", 1000, 2000)


def test_library_size_solves_its_equation():
    x = scalars.library_size(800, 200)
    assert 800 / x - 1 + np.exp(-1000 / x) == pytest.approx(0, abs=1e-9)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 100, 1, 90, 1.0), (2, 5, 1, 700, 1.0), (1, 95, 1, 101, 2.0), (1, 700, 2, 5, 1.0)]
    pairs = spark.createDataFrame(rows, "chr1 int, pos1 int, chr2 int, pos2 int, score double")
    pairs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))
    q = stream_contacts(stream, 50).writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = binning.bin_contacts(pairs, [50]).drop("unit", "bin_size")
    assert sorted(map(tuple, spark.table("cells").collect())) == sorted(map(tuple, batch.collect()))


def test_loops_are_found_where_planted(spark):
    n, size = 200, 10_000
    rng = np.random.default_rng(0)
    i, j = np.indices((n, n))
    rate = 300 / (1 + np.abs(i - j)) ** 0.9
    planted = {(60, 110), (130, 155)}
    for a, b in planted:
        for di in range(-2, 3):
            for dj in range(-2, 3):
                rate[a + di, b + dj] *= 1 + 8 * np.exp(-(di * di + dj * dj) / 1.5)
    m = np.triu(rng.poisson(rate))
    cells = spark.createDataFrame([(1, 1, int(a), int(b), float(m[a, b])) for a, b in zip(*np.nonzero(m), strict=True)], CELL)
    sizes = spark.createDataFrame([(1, n * size)], "chr int, length long")
    vector = norm.vc_sqrt(cells)
    density = expected.expected(norm.normalize(cells, vector), sizes, size)
    found = {(r.bin_x, r.bin_y) for r in loops.call_loops(cells, vector, density, size).collect()}
    assert found == planted
    fine = loops.call_loops(cells, vector, density, size)
    assert loops.merge_resolutions(fine, fine).count() == len(planted)


def test_unique_motifs_of_all_loops(spark, monkeypatch):
    from contactgrid import adapters
    from contactgrid.plans import registry

    loops_ = spark.createDataFrame([(i, 1, 0, 1000, 25_000, 26_000) for i in range(30)], "id long, chr int, start1 long, end1 long, start2 long, end2 long")
    loci = spark.createDataFrame([(i, 1, 5, 205, float(i)) for i in range(20)], "id long, chr int, x1 long, x2 long, score double")
    genes = spark.createDataFrame([(i, 1, 7, 2007) for i in range(4)], "gene_id long, chr int, x1 long, x2 long")
    for name, table in (("loops", loops_), ("loci", loci), ("genes", genes)):
        monkeypatch.setattr(adapters, name, lambda s, d, table=table: table)
    # each locus, at 60,000 * i, is alone in an end of a loop at 40,000 * k or 25,000 further; genes, at 300,000 * k, overlap each fifth
    assert sorted(r.hit for r in registry.QUERIES["c07_unique_motifs"](spark, "").collect()) == [0, 5, 10, 15]


def test_differential_loops_are_not_enriched_in_the_other_map(spark):
    n, size = 120, 10_000
    rate = np.full((n, n), 20.0)
    rate[20, 60] = 200  # in the other map too, though its list has no loop there
    m = np.triu(np.random.default_rng(3).poisson(rate)).astype(float)
    m[70, 100], m[40, 90] = 0, 20
    cells = spark.createDataFrame(pd.DataFrame([(1, 1, int(x), int(y), m[x, y]) for x, y in zip(*np.nonzero(m), strict=True)]), CELL)
    vector = spark.createDataFrame([(1, i, 1.0) for i in range(n)], "chr int, bin int, value double")
    density = spark.createDataFrame([(i, 20.0) for i in range(n)], "dist int, value double")
    schema = "id long, chr int, start1 long, end1 long, start2 long, end2 long"
    loop = lambda k, x, y: (k, 1, x * size, (x + 1) * size, y * size, (y + 1) * size)
    mine = spark.createDataFrame([loop(1, 20, 60), loop(2, 40, 90), loop(3, 70, 100), loop(4, 10, 50)], schema)
    m2 = (cells, vector, density)
    other = spark.createDataFrame([loop(5, 10, 50)], schema)
    found = {(r.id, r.only_in) for r in loops.differential_loops(mine, other, m2, m2, size).collect()}
    assert found == {(2, "A"), (3, "A")}
    assert {r.id for r in loops.loop_differences(mine, other).collect()} == {1, 2, 3}


def test_domains_are_found_where_planted(spark):
    n = 240
    rate = np.ones((n, n)) * 2
    planted = [(20, 70), (70, 130), (150, 210)]
    for a, b in planted:
        rate[a:b, a:b] += 20
    m = np.triu(np.random.default_rng(0).poisson(rate))
    cells = spark.createDataFrame([(1, 1, int(a), int(b), float(m[a, b])) for a, b in zip(*np.nonzero(m), strict=True)], CELL)
    found = sorted(domains.call_domains(cells).collect(), key=lambda r: -r.score)[:3]
    assert sorted((r.start_bin, r.end_bin + 1) for r in found) == planted
    labels = domains.components(np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0]]) > 0)
    assert len(set(labels[labels > 0])) == 1


def test_triangle_sums_are_whole():
    v = np.triu(np.random.default_rng(1).normal(size=(60, 60)))
    upper, lower = domains._triangles(v)
    for a in range(60):
        for b in range(a + 1, 60):
            half = (b - a) // 2
            assert np.isclose(upper[a, b], sum(v[a + r, a + 2 * r : b + 1].sum() for r in range(half + 1)))
            assert np.isclose(lower[a, b], sum(v[a + r, b + 1 : a + 2 * r + 1].sum() for r in range(half + 1, b - a + 1)))


def test_wide_domains_are_found(spark):
    n = 700
    rate = np.ones((n, n)) * 2
    rate[200:500, 200:500] += 20
    m = np.triu(np.random.default_rng(0).poisson(rate))
    cells = spark.createDataFrame(pd.DataFrame([(1, 1, int(a), int(b), float(m[a, b])) for a, b in zip(*np.nonzero(m), strict=True)]), CELL)
    assert (200, 500) in {(r.start_bin, r.end_bin + 1) for r in domains.call_domains(cells).collect()}


def test_sinks_read_back(spark, tmp_path):
    from contactgrid.sources import sinks

    cells = cells_of(spark, symmetric(6)).selectExpr("chr1", "chr2", "'BP' unit", "5000 bin_size", "bin_x", "bin_y", "counts")
    sinks.write_matrices(cells, f"{tmp_path}/m", least=3.0)
    back = spark.read.parquet(f"{tmp_path}/m").where("unit = 'BP' and bin_size = 5000 and chr1 = 1 and bin_x = 2")
    assert {(r.bin_y, r.counts) for r in back.collect()} == {(r.bin_y, r.counts) for r in cells.where("bin_x = 2 and counts >= 3").collect()}
    loops_ = spark.createDataFrame([("1", 10, 20, 30, 40, 7.0)], "chr string, start1 long, end1 long, start2 long, end2 long, observed double")
    found = text.parse_bedpe(sinks.bedpe_lines(loops_), sinks.bedpe_header()).first()
    assert (found.start1, found.end2, found.color, found.attrs["observed"]) == (10, 40, "0,0,255", "7.0")
    wig = sinks.wig_lines(spark.createDataFrame([(1, 3, 1.5), (1, 4, 2.0), (1, 9, 3.0)], "chr int, bin int, value double"), 10).orderBy("line").collect()
    assert [r.value for r in wig] == ["fixedStep chrom=1 start=31 step=10 span=10", "1.5", "2.0", "fixedStep chrom=1 start=91 step=10 span=10", "3.0"]


def test_assembly_edits():
    from contactgrid.operators import assembly

    layout = [[1, 2, -3], [4, 5]]
    assert assembly.invert(layout, 2, 3) == [[1, 3, -2], [4, 5]]
    assert assembly.move(layout, 1, 2, 4) == [[-3], [4, 1, 2, 5]]
    assert assembly.split(layout, 1) == [[1], [2, -3], [4, 5]]
    assert assembly.merge(layout, 5, 1) == [[1, 2, -3, 4, 5]]
    assert assembly.scatter(layout, 2, 3) == [[1], [2], [-3], [4, 5]]
    h = assembly.History([layout])
    h.apply(assembly.split, 1)
    assert h.undo() == layout and h.redo() == assembly.split(layout, 1)
    lines = [">a 1 100", ">b 2 50", "1 -2"]
    assert assembly.format_assembly(*assembly.parse_assembly(lines)) == lines


def test_resolved_layout(spark):
    from contactgrid.operators import assembly

    scaffolds = spark.createDataFrame([(1, 100), (2, 50), (3, 30)], "id int, length long")
    layout = spark.createDataFrame([(0, 0, -2), (0, 1, 1), (1, 0, 3)], "super_id int, pos int, signed_id int")
    found = {r.id: (r.new_start, r.inverted) for r in assembly.resolve(scaffolds, layout).collect()}
    assert found == {2: (0, True), 1: (50, False), 3: (150, False)}
    assert assembly.aggregates(assembly.resolve(scaffolds, layout)).count() == 3


def test_region_strings_as_columns(spark):
    texts = ["chr1:1,000-2000", " 2:5:9 ", "X", "chr1:5", "", None, "a b"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, value string").select("id", query.regions(F.col("value")).alias("r")).orderBy("id").collect()
    assert [r.r and tuple(r.r) for r in found] == [("chr1", 1000, 2000), ("2", 5, 9), ("X", None, None), None, None, None, None]


def test_subsamples_are_the_same_in_any_order(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("n"))
    ids = lambda f: {r.id for r in f.select("id").collect()}
    some = ids(pairs.subsample(rows, 0.3, 1))
    assert some == ids(pairs.subsample(rows.repartition(5, "k"), 0.3, 1)) and 5_600 < len(some) < 6_400
    assert ids(pairs.subsample(rows, 0.1, 1)) < some != ids(pairs.subsample(rows, 0.3, 2))
    assert pairs.subsample(rows, 0.0).count() == 0 and pairs.subsample(rows, 1.0).count() == 20_000
    whole = pairs.subsample(rows, 0.5, 1, "k").groupBy("k").count().collect()
    assert {r["count"] for r in whole} <= {r["count"] for r in rows.groupBy("k").count().collect()}
