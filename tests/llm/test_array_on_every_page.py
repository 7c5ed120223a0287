"""The host suffix array works on pages with an article too; markup checks what it cuts."""

from __future__ import annotations

from contactgrid.llm import html_text


def test_the_array_works_on_every_page(spark):
    run = " ".join(f"s{k}" for k in range(24))
    own = lambda i: " ".join(f"u{i}x{k}" for k in range(30))
    rows = [(i, "http://h.example/", f"<div>{run}</div><article><p>{own(i)}</p></article>") for i in range(4)]
    rows += [(4, "http://h.example/", f"<article><p>{own(4)}</p><p>{run}</p></article>"), (5, "http://g.example/", f"<article><p>{run}</p></article>"), (6, None, None)]
    found = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all((found[i].text, found[i].n_repeated, found[i].n_told) == (own(i), 1, 0) for i in range(4))
    assert (found[4].text, found[4].n_repeated, found[4].n_told) == (f"{own(4)}\n{run}", 1, 1)  # the array cuts it, markup gives it back
    assert (found[5].text, found[5].n_repeated) == (run, 0) and (found[6].text, found[6].n_repeated) == ("", 0)
    assert not any(r.runs_cut for r in found.values())


def test_a_batch_with_fewer_words_than_a_run(spark):
    rows = [(1, "http://h.example/", "<p>one two"), (2, None, None)]
    found = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    assert {r.page_id: r.text for r in found.collect()} == {1: "one two", 2: ""}
