"""The operators with Python in their tasks, against brute force."""

from __future__ import annotations

import random
import time
import zlib
from collections import Counter
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from contactgrid.llm import html_blocks, html_text, near_dup, packing, quality_model, topk
from contactgrid.llm.shingles import WordHasher, bag_minhash, counted, shingle_sets
from contactgrid.llm.tokens import RunTokenizer
from tests_llm_helpers import bag, classes

DOC = "doc_id long, text string, lang string, source string, a string, bag string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", "z") for i, t in rows], DOC)


# HTML
ARTICLE = "<article><h1>T &amp; x</h1><p>one <b>two</b>\n three<p>four<br>five<form>no</form><aside>no</aside><div class='comment-list'><p>no</p></div></article>"


@pytest.mark.parametrize(
    ("page", "told"),
    [
        (f"<html><head><title>no</title></head><body><nav>no</nav>{ARTICLE}<footer>no</footer>", ["T & x", "one two three", "four five"]),
        ("<header>no</header><main><header><h1>T</h1><i>by me</i></header><p>a</main>", ["T", "a"]),
        ("<div class=ad>no</div><p>yes<!-- <p>no --></p><div id='cookie-notice'>no</div><script>var t='</p><p>no';</script>", ["yes"]),
        ("<article><p>cut of", ["cut of"]), ("<article><p>cut off</p><di", ["cut off"]), ("<p>1 < 2 &lt; 3</p></b></div>", ["1 < 2 < 3"]),
        ("", []), (None, []), ("plain", ["plain"]), ("<p hidden>no</p><p style='display: none'>no</p><p>&eacute;&#x41;&am", ["éA&am"]),
        ("<article class='post'><div class='entry-header'><p>yes</p></div><div class='sidebar'>no</div></article>", ["yes"]),
    ],
)
def test_blocks(page, told):
    assert html_blocks.article_blocks(page) == told


@pytest.mark.parametrize(
    ("page", "told"),
    [
        ("<p id='notice-of-appeal'>a<h2 class='search-title'>b</h2><div class='hidden-gems'>c</div><p class='navigation-history'>d", ["a", "b", "c", "d"]),
        ("<div class='site-footer'>no</div><div id='comment-12'>no</div><p class='ad-300x250'>no</p><ul class=sidebarLeft><li>no</ul><p>yes", ["yes"]),
        ("<article><h2 id='search'>a</h2><p id='discussion'>b</p><p class='advert'>no</p><div id='comments'>no</div></article><p id='copyright'>no", ["a", "b"]),
        ("<p>one<a href=/some/long/path/to/page title=don't>two</a><a title='x>y'>three</a>", ["onetwothree"]),
        ("<p>a<a href=/path/to/the-page-that-was-cut", ["a"]), ("<p>a<a title='never closed>b", ["ab"]), ("<p>&#99999999999999;&#x0000041;&#00000000066;", ["�AB"]),
    ],
)
def test_names_and_quotes(page, told):
    assert html_blocks.article_blocks(page) == told


@pytest.mark.parametrize(
    "page",
    [
        "<a href=/path/to/the-page-that-was-cut" * 100_000, "<a title='" * 400_000, "<" * 2_000_000, "<div>" * 300_000 + "</span>" * 300_000, "<b>" * 200_000 + "<div></b>" * 200_000,
        "&#" + "9" * 1_000_000 + ";", "<!--" * 500_000, "<p a" + "= " * 500_000, "<script>" * 300_000, "<p class='" + "ad " * 300_000 + "'>x", "<x =' " * 100_000 + '"' * 9, "<p>word " * 1_000_000,
    ],
)
def test_any_page_takes_linear_time(page):
    began = time.process_time()
    html_blocks.page_blocks(page)
    assert time.process_time() - began < 30


def test_columns_of_pages_that_clash(spark):
    html = "<article><p>one &amp; two</article>"
    rows = [(1, "http://a/1", html, "b", 7, "t", 1), (2, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, blocks string, page int, text string, n_chars int")
    found = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    assert found == {1: ("http://a/1", "one & two", 9), 2: (None, "", 0)}


def test_host_repeats_go_where_markup_is_silent(spark):
    menu = "<div>Home of all the things that we sell and more of them</div><div>Read our long and repeated terms of service which nobody reads at all ever</div>"
    word = lambda i, k: f"w{i}x{k}"
    rows = [(i, f"http://h.example/{i}", f"{menu}<p>{' '.join(word(i, k) for k in range(60))}</p>", "x") for i in range(8)]
    rows += [(50, "http://other.example/", f"{menu}<p>alone</p>", "x"), (51, None, None, "x"), (52, "http://h.example/z", "", "x"), (0, "http://h.example/0", rows[0][2], "x")]
    rows += [(60 + i, "http://h.example/a", f"<article><p>{'shared words of an article ' * 9}</p></article>", "x") for i in range(4)]
    found = {}
    for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect():
        found.setdefault(r.page_id, []).append(r)
    assert len(found[0]) == 2
    for i in range(8):
        assert found[i][0].text == " ".join(word(i, k) for k in range(60))
    assert found[50][0].text.startswith("Home of") and found[51][0].text == found[52][0].text == "" and found[52][0].n_chars == 0
    assert all(found[60 + i][0].text == ("shared words of an article " * 9).strip() for i in range(4))
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_runs_are_cut_exactly_and_copies_are_no_repeats(spark):
    own = lambda i, n: " ".join(f"u{i}x{k}" for k in range(n))
    shared = " ".join(f"s{k}" for k in range(20))
    pages = [f"<p>{own('copy', 40)}</p>"] * 4
    pages += [f"<div>Read more</div><p>{own(i, 60)} {shared} {own(-i, 5)}</p><p>{shared} {own(i + 10, 3)}</p>" for i in range(1, 5)]
    rows = [(i, "http://h.example/", x) for i, x in enumerate(pages)] + [(90, "http://h.example/", f"<article>{shared}</article>"), (91, "http://g.example/", f"<p>{shared}</p>")]
    found = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == own("copy", 40) for i in range(4))
    assert all(found[3 + i] == f"{own(i, 60)} {own(-i, 5)}\n{own(i + 10, 3)}" for i in range(1, 5))
    assert found[90] == found[91] == shared


def test_runs_against_brute_force(spark):
    """All runs of RUN_TOKENS tokens on three distinct pages of a host, where they are long enough for a seed, are cut from silent pages."""
    rng = random.Random(12)
    n, w = html_text.RUN_TOKENS, html_text.RUN_TOKENS + html_text.SEED_WINDOW - 1
    runs = [[f"r{k}x{i}" for i in range(rng.choice([w, w + 7, 60]))] for k in range(6)]
    pages = []
    for i in range(40):
        blocks = []
        for _ in range(rng.randrange(1, 5)):
            own = [f"p{i}w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 50))]
            at = rng.randrange(len(own) + 1)
            blocks.append(own[:at] + (runs[rng.randrange(6)] if rng.random() < 0.6 else []) + own[at:])
        told, host = i % 4 == 0, f"http://h{i % 3}.example/{i}"
        side = [runs[rng.randrange(3)]] if told else []
        html = "".join(f"<div class=sidebar>{' '.join(x)}</div>" for x in side) + ("<article>" if told else "") + "".join(f"<p>{' '.join(b)}</p>" for b in blocks) + ("</article>" if told else "")
        pages.append((i, host, html, told, blocks, side))
    windows = lambda b: [tuple(b[k : k + n]) for k in range(max(1, len(b) - n + 1))]
    seen = {}
    for i, url, _, told, blocks, side in pages:
        host = i % 3
        for b in blocks:
            for x in windows(b):
                seen.setdefault((host, x), {}).setdefault(i, set()).add("in" if told else "open")
        for b in side:
            for x in windows(b):
                seen.setdefault((host, x), {}).setdefault(i, set()).add("out")
    found = {r.page_id: r for r in html_text.main_text(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()}
    cut = 0
    for i, _, _, told, blocks, _ in pages:
        text = []
        for b in blocks:
            covered = set()
            for k, x in enumerate(windows(b)):
                at = seen[(i % 3, x)].values()
                inside = sum("in" in v for v in at)
                if len(at) >= 3 and 2 * inside <= len(at) and not told:
                    covered.update(range(k, k + n))
            cut += len(covered)
            text.append(" ".join(t for k, t in enumerate(b) if k not in covered))
        assert found[i].text == "\n".join(t for t in text if t)
    assert cut > 500


def test_seeds_are_the_same_wherever_a_run_stands():
    run = [f"r{k}" for k in range(html_text.RUN_TOKENS + html_text.SEED_WINDOW - 1)]
    pages = [[" ".join([f"a{k}" for k in range(n)] + run + [f"z{n}{k}" for k in range(9)])] for n in (0, 13, 57)]
    found = [set(html_text.seeds(k).tolist()) for _, k in html_text.suffix_keys(WordHasher(), ["h"] * 3, pages)]
    assert found[0] & found[1] & found[2]
    other = [set(k.tolist()) for _, k in html_text.suffix_keys(WordHasher(), ["g"], pages[:1])]
    assert not found[0] & other[0]


# Quality
def test_cotraining_on_held_out_documents(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "house", "of", "green", "trees", "and", "water", "in", "summer"]) for _ in range(80)) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "$$$", "!!!", "W1N", "CA$H"]) for _ in range(80))
    rows = [(i, good() if i % 4 else bad()) for i in range(600)] + [(1000, None), (1001, "  \n"), (1002, "Short but fine."), (1, None)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 300)] + [(77777, 1), (None, 0), (5, None)], "doc_id long, quality int")
    found = quality_model.score_quality(docs(spark, rows), labels).collect()
    assert len(found) == len(rows)
    held = [r for r in found if 300 <= r.doc_id < 600]
    assert sum(r.quality_kept == (r.doc_id % 4 > 0) for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in found}
    assert not by[1000].quality_kept and not by[1001].quality_kept and by[1000].quality_score == 0
    none = quality_model.score_quality(docs(spark, rows), labels.where("quality = 1")).where("doc_id = 0").first()
    assert none.quality_score == 1
    assert quality_model.score_quality(docs(spark, []), labels).count() == 0


def test_views_teach_each_other_what_they_are_surest_of(spark):
    rng = random.Random(9)
    word = lambda good: rng.choice(["the", "house", "green", "trees", "water"] if good else ["BUY", "NOW", "$$$", "W1N", "the", "house"])
    rows = []
    for i in range(900):
        good = i % 3 > 0
        told = rng.random() < 0.9
        rows.append((i, " ".join(word(good) for _ in range(rng.choice([3, 8, 40]))), "en", ("press" if good else "spam") if told else "misc"))
    rows += [(5, "BUY " * 50_000, "en", "spam"), (None, "BUY NOW", "en", "spam")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    trained = quality_model.co_train(frame, labels, rounds=1)
    (first,) = trained.rounds
    known = set(trained.rows.ids.tolist())
    assert known == set(range(240)) and first.by_text and first.by_metadata
    pool = [r for r in rows if r[0] is not None and r[0] not in known]
    hashed = {r.doc_id: r.h for r in spark.createDataFrame([(r[0],) for r in pool], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) as h").distinct().collect()}
    pairs = quality_model.count_pairs([r[1].encode() for r in pool])
    views = (quality_model.text_view(pairs, trained.average), quality_model.metadata_view([r[2] for r in pool], [r[3] for r in pool]))
    for view, x, given in ((first.text, views[0], first.by_text), (first.metadata, views[1], first.by_metadata)):
        p, told = view.probability(x), []
        for label, q in ((1.0, p), (0.0, 1 - p)):
            best = sorted((-q[k], hashed[r[0]], r[0]) for k, r in enumerate(pool) if q[k] >= quality_model.SURE)
            told += [(i, label) for _, _, i in best[: quality_model.PER_ROUND]]
        assert given == told
    # each view has learned the rows that the other labelled
    n = (~trained.held).sum()
    assert len(trained.train[1][1]) == n + len(first.by_text) and len(trained.train[0][1]) == n + len(first.by_metadata)
    alone = quality_model.co_train(frame, labels, rounds=0)
    odds = lambda t: t.model().score(pairs, views[1])
    assert (np.abs(odds(alone) - odds(trained)) > 1e-6).any()
    good = np.array([r[0] % 3 > 0 for r in pool])
    assert ((odds(trained) >= 0.5) == good).mean() > 0.95


# Packing
def encoded(tokens, texts):
    found = []
    for _, ids, ends in tokens.encode(pa.array(texts, pa.string())):
        found += np.split(ids, ends[:-1])
    return found


def test_tokens_are_those_of_the_library():
    rng = random.Random(6)
    texts = ["", None, " \n", "It's DON'T' a!b!! c**. d'S'", "<|endoftext|>! x<|startoftext|>*", "é ́x ＡΣ Σ's 12a３ \x1c b x\x85q", "ａ! ²! é!! ß. ǅ. ÉCOLE À×Ã÷ÿ ÀÞß í à", "' ( '("]
    texts += [f"word{k}, Word{k}." for k in range(200)] + ["x" * 300_000, "!?" * 100_000, "long " * 700_000]
    texts += ["".join(rng.choice("aBcé'É.!<|> \n12×ß\u0301 Σ\x1c\xa0íÀ") for _ in range(60)) for _ in range(800)]
    for runs in (50, 1 << 16):
        t = RunTokenizer(packing.default_tokenizer(), runs)
        assert [x.tolist() for x in encoded(t, texts)] == [t.whole.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert [x.tolist() for x in encoded(t, texts[:9])] == [t.whole.encode(x or "", add_special_tokens=False).ids for x in texts[:9]]


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 900)))) for i in range(300)]
    rows += [(400, "x y " * 3000), (401, None), (402, ""), (403, "a " * 4095), (404, "ab" * 500_000), (1, "dup"), (1, "dup"), (None, "no id")]
    got = packing.pack_documents(docs(spark, rows)).toPandas()
    told = Counter()
    for (i, _), ids in zip(rows, encoded(RunTokenizer(packing.default_tokenizer()), [t for _, t in rows]), strict=True):
        ids = np.append(ids, 1).astype("<u4")
        for k in range(0, len(ids), 4096):
            told[(-1 if i is None else i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))] += 1
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype("int64").itertuples(index=False, name=None)) == told
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all() and got.groupby("sequence_id")["length"].sum().max() <= 4096
    assert got["sequence_id"].nunique() == ceil(got["length"].sum() / 4096)
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_genetic_steps_keep_every_item_once():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 60) for _ in range(300)]
    a, b = (packing.Grouping.start(lengths, 100, rng, s) for s in (0.0, 0.5))
    child = a.crossover(b, rng)
    assert sorted(i for x in child.bins for i in x) == list(range(300)) and max(child.loads) <= 100
    best = packing.evolve(lengths, 100, [a, b], rng)[0]
    assert best.rank() <= min(a.rank(), b.rank())
    assert (packing.Grouping.of(lengths, 100, best.labels()).labels() >= 0).all()


def test_crossover_beats_best_fit():
    rng = random.Random(1)
    lengths = []
    for _ in range(60):  # three that fill a bin
        a = rng.randrange(1300, 1800)
        b = rng.randrange(1000, (4096 - a) // 2 + 1)
        lengths += [a, b, 4096 - a - b]
    alone = packing.evolve(lengths, 4096, [], random.Random(2), children=0)[0]
    assert packing.evolve(lengths, 4096, [], random.Random(2), children=90)[0].rank()[0] < alone.rank()[0]


# Near-duplicates
def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(400)]
    change = lambda w, p: [rng.choice(vocabulary) if rng.random() < p else x for x in w]
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    rows += [(k, " ".join(change(base, 0.015 + 0.01 * (k % 3)))) for k in range(90)]  # a group whose members are alike in part
    rows += [(100 + k, " ".join(change(base, 0.5))) for k in range(20)] + [(200 + k, "same text again and  again") for k in range(30)] + [(230, "same text again and again")]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "one  two"), (305, "one"), (306, "p q r s t u " * 40), (307, "p q r s t u " * 36), (308, "p q r s t u " * 20)]
    chain = list(base)
    for k in range(12):
        chain = change(chain, 0.02)
        rows.append((400 + k, " ".join(chain)))
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs(spark, [*rows, (200, rows[110][1])])).distinct().collect()}
    assert found == classes(rows)
    kept = near_dup.drop_near_duplicates(docs(spark, [*rows, (200, rows[110][1]), (None, "x"), (None, "x")]))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(classes(rows).values())) and kept.where("doc_id is null").count() == 2
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


def test_ids_shared_by_rows_have_one_text(spark):
    rng = random.Random(21)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    one, two, other = text(), text(), text()
    rows = [(1, one), (2, two), (7, one), (7, two), (7, None), (8, other), (8, other), (9, "x" * 300_000), (10, "long " * 200_000), (11, "long " * 200_000)]
    runs = [{r.doc_id: r.class_id for r in near_dup.near_duplicates(docs(spark, rng.sample(rows, len(rows)))).collect()} for _ in range(2)]
    assert runs[0] == runs[1] and runs[0][7] in (1, 2) and runs[0][8] == 8 and runs[0][11] == 10
    kept = near_dup.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 8, 9, 10]


def links(texts):
    """All pairs of different texts at a similarity of 0.8 or more, by the rarest members of their multisets."""
    sets = []
    for _, n, h, r, c in shingle_sets(pa.array(texts), 5, WordHasher()):
        sets += [counted(h[r == i], c[r == i]) for i in range(n)]
    often = Counter(x for s in sets for x in s.tolist())
    at, found = {}, set()
    for i, s in enumerate(sets):
        rare = sorted(s.tolist(), key=lambda x: (often[x], x))[: len(s) - ceil(0.8 * len(s)) + 1]
        near = {j for x in rare for j in at.get(x, ())}
        for j in near:
            same = len(np.intersect1d(s, sets[j], assume_unique=True))
            if same >= 0.8 * (len(s) + len(sets[j]) - same):
                found.add((j, i))
        for x in rare:
            at.setdefault(x, []).append(i)
    return found


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_recall_of_links(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, " ".join((r.text or "").split())) for r in frame.select("doc_id", "text").collect()]
    rows = [r for r in rows if r[1]]
    told = links([t for _, t in rows])
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame).collect()}
    joined = sum(found[rows[a][0]] == found[rows[b][0]] for a, b in told)
    assert len(told) > 20 and joined >= 0.99 * len(told)


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") for _ in range(60)] * 3
    texts = [" ".join(base), " ".join(base[:150]), " ".join(base[:90] + [f"n{k}" for k in range(40)])]
    for _, n, h, r, c in shingle_sets(pa.array(texts), 5, WordHasher()):
        sig = bag_minhash(h, r, c, n, 4096)
        sets = [counted(h[r == i], c[r == i]) for i in range(n)]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        true = sum((bag(texts[i]) & bag(texts[j])).values()) / sum((bag(texts[i]) | bag(texts[j])).values())
        exact = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
        assert exact == pytest.approx(true) and (sig[i] == sig[j]).mean() == pytest.approx(true, abs=0.04)


# Search
@pytest.mark.parametrize(("salt_blocks", "broadcast_rows"), [(64, 100_000), (1, 0)])
def test_exact_top_k(spark, monkeypatch, salt_blocks, broadcast_rows):
    monkeypatch.setattr(topk, "SALT_BLOCKS", salt_blocks)
    monkeypatch.setattr(topk, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(topk, "SHARD_ROWS", 300)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(7)
    v = [rng.normal(size=8).astype(float).tolist() for _ in range(1000)]
    v[100:400] = [v[0]] * 300
    rows = [(i, x, "q") for i, x in enumerate(v)] + [(2000, None, "q"), (2020, [1.0, None] * 4, "q"), (2040, [float("nan")] * 8, "q"), (2060, [float("inf")] * 8, "q"), (2080, [], "q"), (None, v[1], "q")]
    rows += [(3000, [1.0, 2.0], "q"), (3001, [2.0, 2.0], "q"), (3002, [-1.0, 0.5], "q")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = {}
    for r in topk.exact_top_k(frame).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {r.vec_id: np.floor(64 * np.array(r.embedding, float)).astype(int) for r in frame.where("vec_id < 1000 or vec_id >= 3000").collect()}
    told = {}
    for q, x in whole.items():
        if q % 20 == 0:
            others = sorted((-int(x @ y), i) for i, y in whole.items() if i != q and len(y) == len(x))[:20]
            told[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(others)]
    assert found == told
    assert topk.exact_top_k(frame.limit(0)).count() == 0
