"""Phrases, periodic runs and personal data against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from itertools import product

import numpy as np
import pytest

from contactgrid.llm import collocations, periodic, private_data
from contactgrid.llm.common import read

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, spans string"


def table(spark, rows):
    """Documents with columns of clashing names; rows are (doc_id, text, lang)."""
    return spark.createDataFrame([(i, t, lang, 7, "x", "y") for i, t, lang in rows], SCHEMA)


# op11


def phrases(rows, longest, least, best, share):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    for lang in n:
        mine = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1 and a >= least}
        kept = []
        for p, a in mine.items():
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= share * a for q, b in mine.items())
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(kept)[:best])]
    return sorted(out)


def test_collocations_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["the", "The", "of", "x", "é", "Été", "a-b", "\xa0", "\x85z"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?"]) for _ in range(rng.randint(0, 40)))
        rows.append((i % 290, text if i % 17 else None, [None, "und", "en", "fr"][i % 4]))
    rows += [(1000 + i, "New York City is big", "en") for i in range(40)] + [(2000, "", "de"), (2001, "one", "it")]
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 200)
    found = collocations.collocations(table(spark, rows).repartition(3), least=5)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    told = phrases(rows, 4, 5, 2_000, 80)
    assert sorted(map(tuple, found.collect())) == told and len(told) > 50
    assert sorted(map(tuple, collocations.collocations(table(spark, rows), least=5, best=3).collect())) == phrases(rows, 4, 5, 3, 80)


def test_collocations_of_nothing_long_texts_and_large_counts(spark, monkeypatch):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(None, None, None)])).count() == 0
    monkeypatch.setattr(collocations, "STEP_BYTES", 50)
    rows = [(1, "a b c d e. " * 4_000 + "z" * 100_000, None)]
    assert sorted(map(tuple, collocations.collocations(table(spark, rows)).collect())) == phrases(rows, 4, 30, 2_000, 80)
    wide = spark.createDataFrame([(10**17, [2 * 10**17], [10**17 + 1])], "f long, heads array<long>, tails array<long>")
    assert wide.select(collocations._lowest_cut(2).alias("c")).first()["c"]["score"] == 2_000_000 * 10**17 // (3 * 10**17 + 1)


# op12


def runs_of(w):
    """{(start, end): period}, by every period and every stretch."""
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            end = i + q
            smaller = any(all(w[k] == w[k + r] for k in range(start, end - r)) for r in range(1, q))
            if end - start >= max(6, 4 * q) and not smaller:
                found[start, end] = q
    return found


def told_runs(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted((s, e - s, q) for (s, e), q in runs_of(w).items())
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha256(listed).hexdigest(), sha256(kept).hexdigest())


def test_runs_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        k, n = rng.choice([1, 2, 3, 30]), rng.randint(0, 70)
        w = [rng.choice("abcdefghijklmnopqrstuvwxyzABCDéß\x85"[:k]) for _ in range(n)]
        if i % 2 and n:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        rows.append((i if i % 50 else None, rng.choice([" ", "\n", "\t "]).join(w) if i % 40 else None, None))
    rows += [(5, "x x x x x x", "en"), (5, "x x x x x x", "en"), (-3, " ".join("ab" * 40), None)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows) > 30
    monkeypatch.setattr(periodic, "STEP_WORDS", 500)
    found = periodic.periodic_runs(table(spark, rows))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted((told_runs(i, t) for i, t, _ in rows), key=key)
    assert periodic.periodic_runs(table(spark, [])).count() == 0


def test_long_periodic_and_repetitive_texts_take_little_time(spark):
    lines = " ".join(f"one two three four five six {i}" for i in range(6_000))
    rows = [(1, "x " * 60_000, None), (2, "a b c d e f g " * 8_000, None), (3, lines, None), (4, "y" * 500_000, None)]
    by_id = {r["doc_id"]: r for r in periodic.periodic_runs(table(spark, rows)).collect()}
    assert (by_id[1]["length"], by_id[1]["period"]) == (60_000, 1) and by_id[2]["period"] == 7
    assert by_id[2]["n_runs"] == 1 and by_id[3]["n_runs"] == 0 and by_id[4]["n_runs"] == 0


# op13

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = kind == 0 or kind == 1 and all(int(x) <= 255 for x in m.group().split(".")) or kind == 2 and 16 <= len(digits) <= 19 and luhn(digits)
            if good or kind == 3 and 8 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_plain_patterns():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice("1129.@@+-() aé%\n") for _ in range(rng.randint(0, 40)))
        assert private_data.base_spans(text) == plain_spans(text)
    card = "4465758382889437"
    for text in (card, f"{card} {card}", f"4-465758382889437,{card}", "256.1.1.1.1", "0000255.1.2.003", "1.2.3.4.5.6.7.8", "a@b@c.d.e.", "+1 (555) 010-9999", "+" + "1" * 16):
        assert private_data.base_spans(text) == plain_spans(text)
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 200_000, "+1" * 100_000, "9 " * 200_000, "@" * 200_000):
        private_data.base_spans(text)  # linear time on any text
        private_data.tokens(text)


def corpus(rng):
    """Documents with personal data as the patterns know it, and clean ones with other numbers."""
    rows, word = [], lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8)))
    card = lambda: next(c for c in iter(lambda: "4" + "".join(rng.choice("0123456789") for _ in range(15)), None) if luhn(c))
    for i in range(400):
        w = [word() for _ in range(40)]
        if i % 2:
            w[5] = f"{word()}@{word()}.example.com"
            w[12] = f"10.{rng.randrange(256)}.3.{rng.randrange(256)},"
            w[20], w[30] = card(), f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        else:
            wrong = str(int(card()) + 1)
            w[5:5] = [str(rng.randrange(1900, 2030)), f"{rng.randrange(100)}%", wrong, f"{rng.randrange(10**6)}", f"2024-0{rng.randrange(1, 9)}-11", "555-0199"]
        rows.append((i, " ".join(w), None))
    return rows


def shown(text, spans):
    return sorted((k, text[int(s) : int(e)]) for k, s, e in (x.split(":") for x in spans.split(",") if x))


def test_labels_are_carried_to_alike_tokens(spark):
    rng = random.Random(8)
    card = "4465758382889437"
    planted = {
        9001: ("Ring +1 (523) 555-1055 today. " + "word " * 60 + "Or 523-555-1055 or 555-1055 tomorrow.", [("phone", "523-555-1055"), ("phone", "555-1055")]),
        9002: (f"Paid with {card} {card} twice", [("card", card), ("card", card)]),
        9003: ("Write to a.b@mail.org, or, masked, a.b[at]mail.org please", [("email", "a.b[at]mail.org")]),
        9004: ("See 555-1055, 4465758382889436, 2024-01-02, 1111 1111, 12.5 3.14 1,000,000 and 1.2.3", []),
    }
    rows = corpus(rng) + [(i, t, None) for i, (t, _) in planted.items()] + [(None, None, None), (7, "", "en")]
    found = private_data.find_private_data(table(spark, rows).repartition(3))
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    by_id = {r["doc_id"]: r for r in found.collect()}
    for i, text, _ in rows:
        base = plain_spans(text or "")
        r, told = by_id[i], ",".join(f"{private_data.KINDS[k]}:{s}:{e}" for k, s, e in base)
        if i != 7:
            assert r["base_sha256"] == sha256(told.encode()).hexdigest() and [r[f"n_{k}"] for k in private_data.KINDS] == [sum(b[0] == k for b in base) for k in range(4)]
            more = [] if i is None or i < 9000 else planted[i][1]
            assert shown(text or "", r["spans"]) == sorted([(private_data.KINDS[k], text[s:e]) for k, s, e in base] + more), text
    assert private_data.find_private_data(table(spark, [])).count() == 0
    again = {r["doc_id"]: r for r in private_data.find_private_data(table(spark, rows).repartition(1)).collect()}
    assert all(again[i]["spans"] == by_id[i]["spans"] for i, _, _ in rows if i != 7)


def exact_marginals(own, edges, potential):
    total = np.zeros_like(own)
    for y in product(range(own.shape[1]), repeat=len(own)):
        score = sum(own[k, v] for k, v in enumerate(y)) + sum(p[y[a], y[b]] for (a, b), p in zip(edges, potential, strict=True))
        for k, v in enumerate(y):
            total[k, v] += np.exp(score)
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize(("edges", "near"), [([(0, 1), (1, 2), (1, 3)], 1e-4), ([(0, 1), (1, 2), (2, 3), (0, 3)], 0.05), ([], 1e-12)])
def test_message_passing_against_enumeration(edges, near):
    rng = np.random.default_rng(2)
    edges = np.array(edges, int).reshape(-1, 2)
    for _ in range(20):
        own, potential = rng.normal(size=(4, 5)), rng.normal(size=(len(edges), 5, 5)) / 2
        assert np.abs(private_data.marginals(own, edges, potential) - exact_marginals(own, edges, potential)).max() < near


def test_the_fit_is_at_its_maximum():
    rng = np.random.default_rng(3)
    told = np.unique(rng.integers(0, 560 * 125 * 6, 60))
    n = rng.integers(1, 50, len(told)).astype(float)

    def value(w):
        rest, alike = told // 6, told % 6 - 1
        rest, after = rest // 5, rest % 5
        rest, before = rest // 5, rest % 5
        score = w.own[private_data._attributes(rest // 5)].sum(1) + w.chain[before] + w.chain[:, after].T + np.where((alike >= 0)[:, None], w.skip[alike], 0)
        log_p = score[np.arange(len(told)), rest % 5] - np.log(np.exp(score).sum(1))
        moved = (w.own**2).sum() + (w.chain**2).sum() + ((w.skip - private_data.AGREE * np.eye(5)) ** 2).sum() / 2
        return (n * log_p).sum() / n.sum() - private_data.PENALTY / 2 * moved

    w = private_data.Weights().fit(told, n)
    best = value(w)
    for part in (w.own, w.chain):
        for k in rng.integers(0, part.size, 12):
            for step in (0.05, -0.05):
                part.flat[k] += step
                assert value(w) <= best + 1e-4
                part.flat[k] -= step


def test_whole_table_keeps_the_patterns_spans(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    told = {r["doc_id"]: plain_spans(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    for r in private_data.find_private_data(docs).collect():
        assert {f"{private_data.KINDS[k]}:{s}:{e}" for k, s, e in told[r["doc_id"]]} <= set(r["spans"].split(",")) | {""}
