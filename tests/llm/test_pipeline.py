"""The pipeline's stages, each against what it was given."""

from __future__ import annotations

import random
from collections import Counter
from math import ceil

import corpus_pipeline
import pytest
from tests_llm_helpers import classes


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    path = tmp_path_factory.mktemp("tables")
    good = lambda n: "\n".join(" ".join(rng.choice(["the", "house", "of", "green", "trees", "and", "water", "summer", f"v{rng.randrange(400)}"]) for _ in range(12)) + "." for _ in range(n))
    rows = [(i, good(6), "en", f"s{i % 5 if i % 3 else 0}") for i in range(200)]
    rows += [(300 + i, "BUY!! NOW$$$ CA$H!! W1N*** " * 20, "en", "s1") for i in range(40)]
    shared = good(4)
    rows += [(400 + i, f"{good(5)}\n{shared}\n{good(2)}", "en", "s2") for i in range(10)]
    rows += [(500 + i, rows[7][1].replace("water", "water", 1) if i % 2 else rows[7][1].replace("house", "hut", 1), "en", "s3") for i in range(6)] + [(600, None, "en", "s1"), (601, "", None, None)]
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 200)) for i in [*range(0, 200, 2), *range(300, 340, 2)]]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    seen = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.toPandas())
        assert k == 4 or docs.columns == columns
    start, kept, lines, unique, mixed, packed = seen
    clean = set(start[start.doc_id < 200].doc_id) | set(range(400, 410)) | set(range(500, 506))
    assert clean <= set(kept.doc_id) and not set(range(300, 340)) & set(kept.doc_id) and not {600, 601} & set(kept.doc_id)
    assert set(lines.doc_id) <= set(kept.doc_id) and (lines.n_chars == lines.text.str.len()).all()
    windows = Counter(w for t in lines.text for w in set(zip(*(t.split("\n")[k:] for k in range(3)), strict=False)))
    assert max(windows.values()) == 1
    assert set(unique.doc_id) == set(classes(list(zip(lines.doc_id, lines.text, strict=True))).values())
    words = lambda f: f.assign(n=f.text.str.split().str.len()).groupby("source").n.sum()
    before, after = words(unique), words(mixed)
    assert abs(after.sum() - before.sum()) <= 5 and (after <= 3 * before.reindex(after.index) + 1).all()
    assert len(packed.groupby(["doc_id", "ids_crc32"])) <= len(mixed) and packed.groupby("sequence_id").length.sum().max() <= 4096
    assert len(packed[packed.piece == 0]) == len(mixed) and packed.sequence_id.nunique() <= ceil(packed.length.sum() / 4096) + 1


def test_run_gives_whole_packings_of_odd_tables(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: "\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(15)) + "." for _ in range(5))
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, label string"
    rows = [(i, text(), "en", f"s{i % 3}", 1, "r", "l") for i in range(60)] + [(None, text(), None, None, None, None, None), (None, None, "en", "s1", 0, "r", None), (7, "", "en", "s2", 0, None, "l")]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/a/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert got.count() >= 55 and got.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
