"""Sources that are read in splits: sections over several stretches, and ranges of records."""

from __future__ import annotations

import random

import numpy as np
import pytest

from contactgrid.operators import binning
from contactgrid.sources import binary, sinks, text


def sections(rng, files=3):
    """Lines of files with sections of 0 to 40 values, and what each value is under."""
    lines, told = [], []
    for f in range(files):
        at, number = [], 0
        for _ in range(6):
            size, norm = rng.choice([100, 500]), rng.choice(["VC", "KR"])
            at.append(f"vector {norm} {number} {size} BP")
            for b in range(rng.choice([0, 1, 5, 40])):
                at.append(rng.choice([str(b / 4), "nan", "."]))
                told.append((f, norm, str(number), size, "BP", b, float(at[-1]) if at[-1] not in ("nan", ".") else None))
            number += 1
        lines += [(str(f), k, x) for k, x in enumerate(at)]
    return lines, told


@pytest.mark.parametrize("stretch", [1 << 20, 7, 1])
def test_sections_span_stretches(spark, monkeypatch, stretch):
    lines, told = sections(random.Random(2))
    monkeypatch.setattr(text, "STRETCH_LINES", stretch)
    found = text.parse_norm_vectors(spark.createDataFrame(lines, "file string, line long, value string").repartition(5)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted((t[1:] for t in told), key=key)


@pytest.mark.parametrize("stretch", [1 << 20, 4])
def test_wig_declarations_are_carried(spark, monkeypatch, stretch):
    monkeypatch.setattr(text, "STRETCH_LINES", stretch)
    values = ["track x", "1", "fixedStep chrom=a start=11 step=5 span=2", *map(str, range(9)), "# no value", "9", "variableStep chrom=b span=3", "5 1.5", "9 nan", "fixedStep chrom=c", "7"]
    lines = spark.createDataFrame([("f", k, v) for k, v in enumerate(values)], "file string, line long, value string")
    told = [("a", 10 + 5 * k, 12 + 5 * k, float(k)) for k in range(10)] + [("b", 4, 7, 1.5), ("b", 8, 11, None), ("c", 0, 1, 7.0)]
    assert sorted(map(tuple, text.parse_wig(lines).collect()), key=str) == sorted(told, key=str)


def test_splits_of_files_that_spark_makes(spark, tmp_path):
    """Files of several splits each: sections span three of them and more."""
    lines, told = sections(random.Random(9), 2)
    for f in ("0", "1"):
        (tmp_path / f"{f}.txt").write_text("".join(x + "\n" for g, _, x in lines if g == f))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "40")
        numbered = text.numbered_lines(spark, f"{tmp_path}/*.txt")
        assert numbered.select("file", "stretch").distinct().count() > 10
        found = text.parse_norm_vectors(numbered).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted((t[1:] for t in told), key=key)


@pytest.mark.parametrize("kind", [binary.LONG, binary.SHORT])
def test_one_file_of_records_is_many_tasks(spark, tmp_path, kind):
    rng, ending = np.random.default_rng(1), ".bin" if kind is binary.LONG else ".bn"
    made = np.zeros(1_000, kind)
    for c in kind.names:
        made[c] = rng.integers(0, 2 if kind[c].kind == "b" else 1_000, 1_000)
    (tmp_path / f"one{ending}").write_bytes(made.tobytes() + b"xx")  # a rest that is no record
    (tmp_path / f"none{ending}").write_bytes(b"")
    found = binary.read_binary_pairs(spark, f"{tmp_path}/*{ending}", 64)
    assert found.rdd.getNumPartitions() == 16
    assert sorted(map(tuple, found.collect())) == sorted(tuple(x.item() for x in r) for r in made)


def test_the_chosen_level_alone_is_read(spark, tmp_path):
    levels = {}
    for size in (10, 20, 50):
        path = str(tmp_path / f"level-{size}")
        spark.createDataFrame([(1, 1, k, k, 1.0) for k in range(600 // size)], "chr1 int, chr2 int, bin_x int, bin_y int, counts double").write.parquet(path)
        levels[size] = spark.read.parquet(path)
    for asked, chosen in ((100, 50), (40, 20), (30, 10), (20, 20)):
        df = binning.served(levels, asked)
        assert all(f"level-{chosen}/" in f for f in df.inputFiles()) and df.inputFiles()
        assert df.agg({"counts": "sum"}).first()[0] == 600 // chosen and df.count() == 600 // asked
    with pytest.raises(ValueError, match="divide"):
        binning.served(levels, 15)


def test_wig_lines_without_a_window(spark):
    vector = spark.createDataFrame([(c, b, 1.0 * b) for c in (1, 2) for b in (0, 1, 5, 6, 7, 12)], "chr int, bin int, value double")
    lines = sinks.wig_lines(vector, 10)
    assert "Window" not in lines._jdf.queryExecution().executedPlan().toString()
    assert lines.where("value like 'fixed%'").count() == 6
    back = text.parse_wig(lines.withColumn("file", lines["chr"].cast("string")))
    assert sorted((r.chr, r.x1 // 10, r.score) for r in back.collect()) == sorted((str(r.chr), r.bin, r.value) for r in vector.collect())
