"""Removing lines that stand in repeated three-line windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgrid.llm.common import let, materialize

WINDOW_LINES = 3


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\x0c\r"))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("twin"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))


def _windows(docs: DataFrame, n: int) -> DataFrame:
    """(doc, twin, at, a, b): each window of n consecutive lines with words, as 128 bits of hash."""
    bare = F.filter(F.transform("lines", _bare), lambda x: x != "")

    def windows(line: Column) -> Column:
        hashed = lambda i, *seed: F.xxhash64(*seed, *(F.get(line, i + k) for k in range(n)))
        starts = F.sequence(F.lit(0), F.size(line) - n)
        return F.transform(starts, lambda i: F.struct(i.alias("at"), hashed(i).alias("a"), hashed(i, F.lit("second")).alias("b")))

    empty = F.array().cast("array<struct<at:int,a:bigint,b:bigint>>")
    found = let(bare, lambda x: F.when(F.size(x) >= n, windows(x)).otherwise(empty))
    return _lines(docs).select("doc", "twin", F.inline(found))


def dedup_lines(docs: DataFrame, window_lines: int = WINDOW_LINES) -> DataFrame:
    """The documents with the later occurrences of repeated three-line windows removed.

    Lines are split at \\n. Those with a word, trimmed of white space, form overlapping windows of three
    consecutive ones; blank lines don't count and stay. Of all windows with equal lines the first stays:
    the one of the smallest doc_id (nulls last), there the first place. Every other occurrence's lines go,
    where occurrences that overlap are merged: of six equal lines five are in later windows and go. Returns row (struct of all input columns), new_text,
    n_lines (those with a word), n_removed.

    The windows are counted, and their first places found, with partial sums before the shuffle, so one that a third of the documents
    share is a row a task; what repeats is a table of its own, so that its join can be split. No window function follows.
    Null or empty text: as it was. A text of fewer than three lines with words: as it was. Rows that share
    doc_id and text count as one document and get the same result. No rows: no rows.
    """
    windows = _windows(docs, window_lines)
    place = F.struct(F.col("doc").isNull().alias("no_doc"), "doc", "twin", "at")
    repeated = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = materialize(repeated, "line-windows")
    covered = windows.join(repeated, ["a", "b"]).where(~place.eqNullSafe(F.col("first"))).select("doc", "twin", "at")
    covered = covered.groupBy("doc", "twin").agg(F.collect_set("at").alias("hit"))
    full = F.filter(F.transform("lines", lambda x, i: F.when(_bare(x) != "", i)), lambda i: i.isNotNull())
    rows = _lines(docs).withColumn("full", full).alias("d").join(
        covered.alias("c"), F.col("d.doc").eqNullSafe(F.col("c.doc")) & F.col("d.twin").eqNullSafe(F.col("c.twin")), "left"
    ).select("d.*", "c.hit")
    spans = F.transform("hit", lambda at: F.slice(F.col("full"), at + 1, window_lines))
    gone = F.array_distinct(F.flatten(spans))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    text = F.array_join(F.transform(stay, lambda i: F.element_at(F.col("lines"), i + 1)), "\n")
    return rows.select(
        "row",
        F.when(F.col("hit").isNull(), F.col("row.text")).otherwise(text).alias("new_text"),
        F.size("full").cast("long").alias("n_lines"),
        F.when(F.col("hit").isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias("n_removed"),
    )


def with_text(deduped: DataFrame, columns: list[str]) -> DataFrame:
    """The input's columns again, with the new text."""
    put = lambda c: F.col("new_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c)
    return deduped.select(*map(put, columns))
