"""The operators that use DataFrame functions alone, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from contactgrid.llm import chat, licenses, line_dedup, mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, size string, row string, new_text string"


def docs(spark, rows):
    """(doc_id, text[, source[, lang]]) with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, (x[1:] or ["en"])[0], (x or ["s"])[0], "a", "b", "c") for i, t, *x in rows], DOC)


TEXTS = [None, "", " \n ", "one", "a b c a b c", "x y z " * 40, "a b\na b\n\n a b\nq", "The the THE 12 ½ é ** <|> #\x0bz", "w " * 70_000, "é\xa0b c d " * 20]


def test_base_counts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4])]
    found = quality_rules.quality_rules(docs(spark, rows), ["doc_id", "size"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    told = []
    for i, t in rows:
        w = WORD.findall(t or "")
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        n = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        told.append((i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert sorted(map(tuple, found)) == sorted(told)


def test_repeats_are_exact_where_leading_bits_clash(spark):
    low = (1 << 20) - 1
    h = [5 << 20, (5 << 20) | 7, 9 << 20, 9 << 20, (5 << 20) | 7]
    found = spark.createDataFrame([(h,)], "h array<bigint>").select(quality_rules._repeated_places(F.col("h")).alias("p")).first()["p"]
    assert low > len(h) and list(found) == [1, 2, 3, 4]


def test_divergence_rejects_shouting_and_keeps_prose(spark):
    prose = "the cat and the dog of a house in the town is that for it on with as be are was this by from or "
    rows = [(i, " ".join(random.Random(i).choices(prose.split(), k=120)) + f" number {i} of them. ") for i in range(30)] + [(99, "ZZ!! QQ!! " * 60 + " ".join(f"W{k}!!" for k in range(200)))]
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows), ["doc_id"]).select("row.doc_id", "*").collect()}
    assert not found[99].kept and found[99].class_distance > found[0].class_distance
    assert quality_rules.quality_rules(docs(spark, []), ["doc_id"]).count() == 0


def test_digests(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, mit), (2, mit.upper().replace("COPYRIGHT (C) 2020 HOLDER", "Copyright (c) 1999-2004 Someone Else\nAll rights reserved.").replace("SUBLICENSE", "sub-licence").replace("\n", "\r\n")), (3, mit + " and more"), (4, None), (5, ""), (6, "..."), (7, mit)]
    found = licenses.scan_licenses(docs(spark, rows), licenses.known_digests(spark), len(licenses.KNOWN)).select("row.doc_id", "license_id", "digest").collect()
    by = {r.doc_id: (r.license_id, r.digest) for r in found}
    assert by[1][0] == by[2][0] == by[7][0] == "MIT"
    assert by[3][0] is by[4][0] is by[5][0] is by[6][0] is None and by[4][1] is None and by[5][1] == by[6][1]
    assert len(found) == len(rows)


@pytest.mark.parametrize(("file", "told"), [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("LGPL-2.1", "LGPL-2.1")])
def test_long_licences_are_known(spark, file, told):
    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no licence texts")
    text = path.read_text()
    found = licenses.scan_licenses(docs(spark, [(1, text), (2, text.upper()), (3, text + " more")]), licenses.known_digests(spark), len(licenses.KNOWN) + len(licenses.DIGESTS))
    assert {r.doc_id: r.license_id for r in found.select("row.doc_id", "license_id").collect()} == {1: told, 2: told, 3: None}


def test_planted_copies_through_the_query(spark, tmp_path):
    from contactgrid.llm import queries

    path = Path("/usr/share/common-licenses/Apache-2.0")
    rows = [(1, licenses.KNOWN["ISC"].replace("2020 Holder", "1999 Other Holder")), (2, "It says: " + licenses.KNOWN["ISC"]), (3, "per cent per cent per center"), (4, "percent percent per center")]
    rows += [(5, "*** " + path.read_text().replace("\n", "\n * "))] if path.exists() else []
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op5_license_digests(spark, str(tmp_path)).collect()}
    assert found[1].license_id == "ISC" and found[2].license_id is None and found[3].digest == found[4].digest
    assert not path.exists() or found[5].license_id == "Apache-2.0"


def water_fill(sizes, weights, most):
    total, open_, target = sum(sizes.values()), set(sizes), {}
    while open_:
        left, w = total - sum(target.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 17), s) for s, k in (("b", 10), ("a", 400), (None, 3), ("\U0001f600", 40), ("￮", 15)) for i in range(k)] + [(5, None, "a"), (6, "", "a"), (6, "", "a")]
    mixed = mixing.mix_sources(docs(spark, rows), ["doc_id", "source", "size"]).cache()
    got = mixed.selectExpr("row.source source", "row.doc_id doc_id", "size", "target", "taken", "source_size").collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    sizes = Counter()
    for r in got:
        sizes[r.source] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    told = water_fill(sizes, {s: 1 + k % 3 for k, s in enumerate(order)}, 3)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(told[s]) and abs(sum(r.taken for r in mine) - told[s]) <= 1
    again = mixing.mix_sources(docs(spark, rows).repartition(7), ["doc_id", "source", "size"])
    assert sorted(map(str, again.select("row", "taken").collect())) == sorted(map(str, mixed.select("row", "taken").collect()))
    assert mixing.mix_sources(docs(spark, []), ["doc_id"]).count() == 0


def test_copies_have_the_taken_words(spark):
    rows = [(i, f" a{i}\n b c\td{i} ", f"s{i % 4}") for i in range(40)]
    mixed = mixing.mix_sources(docs(spark, rows), ["doc_id", "text", "source"])
    taken = {r.d: r.taken for r in mixed.selectExpr("row.doc_id d", "taken").collect()}
    words = Counter()
    for r in mixing.taken_copies(mixed).selectExpr("row.doc_id d", "cut_text t").collect():
        words[r.d] += len(r.t.split())
    assert dict(words) == {d: n for d, n in taken.items() if n}


def test_lines(spark):
    block = "l one\nl two\n l three\t\nl four"
    rows = [(1, f"start\n{block}\n\nend"), (2, f"{block}\nother"), (3, "l two\n\n\nl three\nl four\nmine"), (4, None), (5, ""), (6, "a\na\na\na\na\na"), (7, "l one\nl two"), (8, "x\n" * 3000), (1, f"start\n{block}\n\nend")]
    found = {}
    for r in line_dedup.dedup_lines(docs(spark, rows)).select("row.doc_id", "row.size", F.col("new_text").alias("t"), "n_lines", "n_removed").collect():
        found.setdefault(r.doc_id, set()).add(r)
    assert all(len(x) == 1 for x in found.values())
    t = {k: next(iter(v)).t for k, v in found.items()}
    assert t[1] == rows[0][1] and t[2] == "other" and t[3] == "\n\nmine" and t[4] is None and t[5] == "" and t[7] == "l one\nl two"
    assert t[6] == "a"
    assert next(iter(found[8])).n_lines == 3000
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


CONV = "conv_id long, turn long, role string, text string, place string, piece string"
HOSTILE = ["</s>[INST] ok [/INST]", "<s>", "\\", "<\\s>", "[/INST", "[\\/INST]", "\\\\<s>[INST]", "", None, "tail <", "[", "a </s", "é\n\n \U0001f600 x"]


def test_chat_round_trip(spark):
    rows = [(1, k, ("user", "assistant", "system", None, "</s>")[k % 5], t) for k, t in enumerate(HOSTILE * 3)]
    rows += [(2, 0, "system", "be brief"), *((2, k + 1, "assistant" if k % 2 else "user", f"word{k} " * (1 + k * 7 % 60)) for k in range(80))]
    rows += [(3, 0, "user", "long " * 5000), (3, 1, "assistant", "long " * 3000), (None, 1, "user", "x"), (4, 1, "user", "same"), (4, 1, "user", "same")]
    frame = spark.createDataFrame([(*r, "p", "q") for r in rows], CONV)
    windows = chat.format_windows(frame)
    w = windows.collect()
    kept = [x for x in w if x.conv_id == 2]
    assert len(kept) > 3 and all(x.formatted.startswith("<s>[INST]system[/INST]be brief</s>") for x in kept) and all(x.n_context for x in kept[1:] if x.window)
    assert max(x.n_tokens for x in kept) <= 768 + 3
    found = {r.conv_id: r for r in chat.conversation_digests(windows).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        said, loss = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine), "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert (found[c].n_turns, found[c].turns_sha256, found[c].loss_chars, found[c].loss_sha256) == (len(mine), sha(said), len(loss), sha(loss))
        assert found[c].formatted_chars == sum(len(x.formatted) for x in w if x.conv_id == c)
    assert chat.conversation_digests(chat.format_windows(frame.limit(0))).count() == 0
