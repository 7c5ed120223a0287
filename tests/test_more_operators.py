"""Operators without SQL, against brute force or planted signals."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from contactgrid.functions import scalars
from contactgrid.operators import assembly, binning, chromosomes, domains, images, lists, loops, motifs, norm, query, stats
from contactgrid.sources import text
from contactgrid.tables import discard, mark, shared_folder, written

CELL = "chr1 int, chr2 int, bin_x int, bin_y int, counts double"


def cells_of(spark, m, chr_=1):
    return spark.createDataFrame(pd.DataFrame([(chr_, chr_, int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(np.triu(m)), strict=True)]), CELL)


def test_rounds_and_tasks_find_the_same_vector(spark):
    m = np.random.default_rng(2).poisson(5, (20, 20)).astype(float) + 1
    m = m + m.T
    both = cells_of(spark, m).unionByName(cells_of(spark, m[:8, :8], 2))
    values = lambda n: [r.value for r in norm.balance(both, 1e-6, local_cells=n).orderBy("chr", "bin").collect()]
    assert values(60) == pytest.approx(values(10_000), rel=1e-4)
    few = norm.balance(both, low=0.9).groupBy("chr").count().collect()
    assert all(r["count"] <= 20 for r in few)


def test_score_boxes(spark):
    rng = random.Random(1)
    rows = [(k, 1 + k % 2, rng.randrange(300), rng.randrange(300), *(rng.random() for _ in range(5))) for k in range(200)]
    told = []
    for c in (1, 2):
        boxes = []
        for r in [x for x in rows if x[1] == c]:
            for b in boxes:
                if min(abs(b[0] - r[2]), abs(b[1] - r[2])) < 9 and min(abs(b[2] - r[3]), abs(b[3] - r[3])) < 9:
                    b[:4] = min(b[0], r[2]), max(b[1], r[2]), min(b[2], r[3]), max(b[3], r[3])
                    b[4].append(r[4])
                    break
            else:
                boxes.append([r[2], r[2], r[3], r[3], [r[4]]])
        told += [(c, b[1], b[3], len(b[4]), round(sum(b[4]) / len(b[4]), 9)) for b in boxes]
    frame = spark.createDataFrame(rows, "id long, chr int, i long, j long, " + ", ".join(f"{s} double" for s in lists.SCORES))
    assert sorted((r.chr, r.i, r.j, r.n, round(r.score, 9)) for r in lists.binned_scores(frame, 9).collect()) == sorted(told)


def test_triples(spark):
    rng = random.Random(2)
    rows = [(k, 1, *(rng.randrange(3) * 50 + rng.randrange(30) for _ in range(3))) for k in range(150)]
    kept = []
    for r in rows:
        for c in kept:
            if all(abs(a - b) < 20 for a, b in zip(r[2:], c[0], strict=True)):
                for s, a in zip(c[1], r[2:], strict=True):
                    s.add(a)
                c[0], c[2] = [sum(s) // len(s) for s in c[1]], c[2] + 1
                break
        else:
            kept.append([list(r[2:]), [{a} for a in r[2:]], 1])
    found = lists.triple_centroids(spark.createDataFrame(rows, "id long, chr int, x1 long, x2 long, x3 long"), 20).collect()
    assert sorted((r.x1, r.x2, r.x3, r.n) for r in found) == sorted((*c[0], c[2]) for c in kept)


def test_poisson_tails_of_any_mean():
    def told(o, m):
        """The sum of all terms from the count on, in exact logarithms."""
        below = math.fsum(math.exp(-m + k * math.log(m) - math.lgamma(k + 1)) for k in range(int(o)))
        above = math.fsum(math.exp(-m + k * math.log(m) - math.lgamma(k + 1)) for k in range(int(o), int(max(o, m) + 40 * math.sqrt(max(o, m)) + 60)))
        return above if above < below else 1 - below

    pairs = [(0, 1), (1, 1), (5, 2), (50, 30), (30, 100), (3, 0.2), (1000, 800), (800, 800), (700, 800), (10_300, 10_000), (9_900, 10_000), (1_001_000, 1_000_000), (999_000, 1_000_000)]
    o, m = (np.array(x, float) for x in zip(*pairs, strict=True))
    assert scalars.poisson_p(o, m) == pytest.approx([told(*x) for x in pairs], abs=1e-9)
    assert 0 < scalars.poisson_p(np.array([1000.0]), np.array([800.0]))[0] < 1e-11
    assert scalars.poisson_p(np.array([0.0, 3, 3, np.nan]), np.array([0.0, 0.0, np.inf, 1])).tolist()[:3] == [1, 0, 1]
    assert scalars.poisson_tail(2000.0, 5) == [1.0] * 5  # far below the mean


def test_loops_by_p_values_are_found_where_planted(spark):
    n, size = 160, 10_000
    i, j = np.indices((n, n))
    rate = 300 / (1 + np.abs(i - j)) ** 0.9
    for di in range(-2, 3):
        for dj in range(-2, 3):
            rate[60 + di, 110 + dj] *= 1 + 8 * np.exp(-(di * di + dj * dj) / 1.5)
    m = np.triu(np.random.default_rng(0).poisson(rate))
    vector = spark.createDataFrame([(1, k, 1.0) for k in range(n)], "chr int, bin int, value double")
    density = spark.createDataFrame([(k, 300 / (1 + k) ** 0.9) for k in range(n)], "dist int, value double")
    cells = cells_of(spark, m)
    assert {(r.bin_x, r.bin_y) for r in loops.call_loops_by_p(cells, vector, density, size).collect()} == {(60, 110)}
    given = spark.createDataFrame([(1, 1, 600_000, 610_000, 1_100_000, 1_110_000)], "id long, chr int, start1 long, end1 long, start2 long, end2 long")
    (scored,) = loops.score_loops(given, cells, vector, density, size).collect()
    assert scored.observed == m[60, 110] and scored.observed > 2 * scored.expectedDonut
    # the fine peak inside a coarse loop that is off by some bins
    coarse = spark.createDataFrame([(1, 1, 620_000, 630_000, 1_080_000, 1_090_000)], "id long, chr int, start1 long, end1 long, start2 long, end2 long")
    (peak,) = images.localize(coarse, cells, size, radius=8, sigma=2).collect()
    assert abs(peak.start1 // size - 60) <= 1 and abs(peak.start2 // size - 110) <= 1 and peak.p_value < 0.01


def test_scores_of_given_domains_are_those_of_called_ones(spark):
    n = 120
    rate = np.ones((n, n)) * 2
    rate[20:70, 20:70] += 20
    cells = cells_of(spark, np.random.default_rng(0).poisson(rate))
    called = domains.call_domains(cells, 400).collect()
    rows = [(k, r.chr, r.start_bin, r.end_bin) for k, r in enumerate(called)]
    found = {r.id: r for r in domains.score_domains(spark.createDataFrame(rows, "id long, chr int, start_bin int, end_bin int"), cells, 400).collect()}
    assert len(found) == len(called) and all(found[k].score == pytest.approx(r.score) and found[k].loSign == pytest.approx(r.loSign) for k, r in enumerate(called))
    wide = spark.createDataFrame([(7, 1, 3, 900), (8, 1, 21, 69)], "id long, chr int, start_bin int, end_bin int")
    assert {r.id: r.score is None for r in domains.score_domains(wide, cells, 400).collect()} == {7: True, 8: False}


def test_random_draws_keep_what_they_should(spark):
    m = np.full((40, 40), 100.0)
    cells = cells_of(spark, m)
    thin = [r.counts for r in binning.thin(cells, 0.3).collect()]
    assert sum(thin) == pytest.approx(0.3 * 100 * len(thin), rel=0.05) and thin == [r.counts for r in binning.thin(cells, 0.3).collect()]
    wide = binning.rebin(cells, 1000, 1500)
    assert wide.agg({"counts": "sum"}).first()[0] == 100 * 820 and wide.agg({"bin_y": "max"}).first()[0] == 26
    assert {tuple(r) for r in binning.rebin(cells, 1000, 2000).collect()} == {tuple(r) for r in binning.coarsen(cells, 2).collect()}


def test_positions_and_names(spark):
    assert query.parse_position("chr1:1,000-2.5m:25kb") == ("chr1", 1000, 2_500_000, 25_000)
    assert query.parse_position("X") == ("X", None, None, None) and query.parse_position("3:500") == ("3", 500, 500, None)
    with pytest.raises(ValueError, match="not a position"):
        query.parse_position("1:2:3:4:5")
    lines = spark.createDataFrame([("chr2 50",), ("chr1 70",), ("junk",), ("chrX 9",)], "value string").coalesce(1)
    assert [(r.chr, r.name) for r in text.parse_chrom_sizes(lines).orderBy("chr").collect()] == [(1, "chr2"), (2, "chr1"), (3, "chrX")]
    dim = spark.createDataFrame([(1, "chr1", 9), (2, "CHRX", 8), (3, "MT", 2)], "chr int, name string, length long")
    assert [r.chr for r in chromosomes.autosomes(dim).collect()] == [1]


def test_written_tables_can_be_discarded(spark):
    since = mark()
    a, b = (written(spark.range(3), "t") for _ in range(2))
    assert a.count() == 3 and shared_folder(spark)
    discard(spark, since, keep=1)
    assert b.count() == 3 and mark() == since + 1


def test_phasing_files_and_layouts_as_rows(spark):
    lines = [">a 10 A G 1", ">a 20 C T 2", ">b 5 G C 3", "1 -2", "-3"]
    frame = spark.createDataFrame(list(enumerate(lines)), "line long, value string")
    variants, chains = assembly.phasing_rows(frame)
    scaffolds, layout = assembly.phasing_scaffolds(variants, chains)
    assert {(r.id, r.name) for r in scaffolds.collect()} == {(1, "a:10:A"), (2, "a:10:G"), (3, "a:20:C"), (4, "a:20:T"), (5, "b:5:G"), (6, "b:5:C")}
    assert {(r.super_id, r.pos, r.signed_id) for r in layout.collect()} == {(6, 0, 1), (6, 1, 4), (7, 0, 2), (7, 1, 3), (8, 0, 6), (9, 0, 5)}
    assert [r.value for r in assembly.phasing_lines(scaffolds, layout).orderBy("part", "line").collect()] == lines
    text_ = [">s1 1 100", ">s2 2 50", ">s3 3 70", "1 -3", "2"]
    rows = assembly.assembly_rows(spark.createDataFrame(list(enumerate(text_)), "line long, value string"))
    assert [r.value for r in assembly.assembly_lines(*rows).orderBy("part", "line").collect()] == text_
    told = assembly.parse_assembly(text_)
    assert [tuple(r) for r in rows[0].select("name", "id", "length").orderBy("id").collect()] == told[0]
    assert assembly.assembly_lines(*(r.where("1 = 0") for r in rows)).count() == 0


def test_copies_are_found_by_place_and_tile(spark):
    rng = random.Random(5)
    rows = [(k, rng.random() < 0.5, 1, rng.randrange(3), True, 2, 7, rng.randrange(2), rng.randrange(300), rng.randrange(300)) for k in range(300)]
    rows += [(1000 + k, True, 1, 0, True, 2, 7, 0, 10, 10) for k in range(50)]  # a place with many
    df = spark.createDataFrame(rows, "name long, strand1 boolean, chr1 int, pos1 int, strand2 boolean, chr2 int, pos2 int, tile int, x int, y int")
    told = {}
    for r in rows:
        before = [o for o in rows if o[1:7] == r[1:7] and o[0] < r[0]]
        close = any(o[7] == r[7] and math.hypot(o[8] - r[8], o[9] - r[9]) <= 50 for o in before)
        told[r[0]] = "unique" if not before else "opt" if close else "pcr"
    found = stats.find_duplicates(df)
    assert {r["name"]: r.kind for r in found.collect()} == told and set(told.values()) == {"unique", "opt", "pcr"}
    assert stats.duplicate_counts(found).first().asDict() == {k: list(told.values()).count(k) for k in ("opt", "pcr", "unique")}


def test_directed_motifs_against_brute_force(spark):
    rng = random.Random(11)
    at = [rng.randrange(0, 4_000_000, 1_000) for _ in range(40)]
    lps = [(k, 1, a, a + 5_000, a + 200_000, a + 205_000) for k, a in enumerate(at)]
    peaks = [(k, 1, x, x + 300) for k, x in enumerate(y + rng.randrange(-3_000, 6_000) for lp in lps for y in (lp[2], lp[2], lp[4], lp[4]))]
    found_motifs = [(1000 + k, 1, p[2] + rng.randrange(-50, 200), p[2] + 220, rng.random(), rng.random() < 0.5) for k, p in enumerate(peaks)]
    loops_df = spark.createDataFrame(lps, "id long, chr int, start1 long, end1 long, start2 long, end2 long")
    peaks_df = spark.createDataFrame([(*p, 1.0) for p in peaks], "id long, chr int, x1 long, x2 long, score double")
    motifs_df = spark.createDataFrame(found_motifs, "id long, chr int, x1 long, x2 long, score double, forward boolean")

    def merged(spans):
        out = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(max((a + b) // 2 - 7_500, 0), (a + b) // 2 + 7_500) if b - a < 15_000 else (a, b) for a, b in out]

    hits = lambda a, b: a[0] <= b[1] and b[0] <= a[1]
    up, down = merged([lp[2:4] for lp in lps]), merged([lp[4:6] for lp in lps])
    told = set()
    for mine, other, forward in ((up, down, True), (down, up, False)):
        for anchor in mine:
            if any(hits(anchor, o) for o in other):
                continue
            inside = [p for p in peaks if hits(anchor, p[2:4])]
            if len(inside) > 1:
                for p in inside:
                    best = [m for m in found_motifs if m[5] == forward and hits(p[2:4], m[2:4])]
                    if best:
                        told.add((p[0], max(best, key=lambda m: (m[4], -m[0]))[0], forward))
    found = {(r.id, r.hit, r.forward) for r in motifs.directed_motifs(loops_df, peaks_df, motifs_df).collect()}
    assert found == told and len(told) > 5


def test_tiles_cover_all_intra_cells(spark):
    rows = [(1, 1, 0, 0, 2.0), (1, 1, 0, 3, 5.0), (1, 1, 5, 17, 7.0), (2, 2, 4, 5, 3.0), (1, 2, 0, 0, 9.0)]
    cells = spark.createDataFrame(rows, "chr1 int, chr2 int, bin_x int, bin_y int, counts double")
    found = {(r.id, r.i, r.j): r.value for r in images.tiles(cells, 4).collect()}
    number = lambda c, a, b: (c * 2**20 + a) * 2**20 + b
    assert len(found) == 3 * 16
    assert {k: v for k, v in found.items() if v} == {
        (number(1, 0, 0), 0, 0): 2.0, (number(1, 0, 0), 0, 3): 5.0, (number(1, 0, 0), 3, 0): 5.0, (number(1, 1, 4), 1, 1): 7.0,
        (number(2, 1, 1), 0, 1): 3.0, (number(2, 1, 1), 1, 0): 3.0,
    }
    assert images.tiles(cells.where("false"), 4).count() == 0


def test_library_sizes_solve_their_equation():
    unique, again = np.array([900.0, 10.0, 5.0, 0.0, 10**9]), np.array([100.0, 90.0, 0.0, 4.0, 1.0])
    size = scalars.library_sizes(unique, again)
    assert list(size[2:4]) == [0.0, 0.0]
    for c, n, x in zip(unique[[0, 1]], (unique + again)[[0, 1]], size[[0, 1]], strict=True):
        assert abs(c / x - 1 + np.exp(-n / x)) < 1e-9
    assert size[4] > 10**17


def test_text_matrices_of_several_chromosomes_balance_apart(spark):
    cells = [(c, f"{i}\t{j}\t{1 + (i * 3 + j * c) % 5}") for c in (1, 2) for i in range(6) for j in range(i, 6)]
    lines = spark.createDataFrame(cells, "chr int, value string")
    both = {(r.chr, r.bin): r.value for r in norm.balance_text(lines, "chr").collect()}
    for c in (1, 2):
        alone = {r.bin: r.value for r in norm.balance_text(lines.where(f"chr = {c}")).collect()}
        assert {b: both[c, b] for b in alone} == pytest.approx(alone, rel=1e-4)
