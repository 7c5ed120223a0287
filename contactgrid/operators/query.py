"""Region queries, lookups and windows of matrices."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_REGION = r"^([^:\s]+)(?::([\d,]+)[:-]([\d,]+))?$"


def parse_region(text: str) -> tuple[str, int | None, int | None]:
    """chr or chr:start:end (also chr:start-end, with commas)."""
    m = re.match(_REGION, text.strip())
    if not m:
        raise ValueError(f"not a region: {text!r}")
    number = lambda x: int(x.replace(",", "")) if x else None
    return m[1], number(m[2]), number(m[3])


def regions(text: Column) -> Column:
    """chr, x1, x2 of region strings as parse_region() reads them, as a struct of each row; null where a string is none."""
    t = F.trim(text)
    number = lambda k: F.replace(F.regexp_extract(t, _REGION, k), F.lit(","), F.lit("")).try_cast("long")
    return F.when(t.rlike(_REGION), F.struct(F.regexp_extract(t, _REGION, 1).alias("chr"), number(2).alias("x1"), number(3).alias("x2")))


def parse_position(text: str) -> tuple[str, int | None, int | None, int | None]:
    """What is typed into a position field: chr, start and end (one position: both the same), and a resolution after a last colon.

    Also chr:start-end and chr:start:end, with commas and with k or m for thousands and millions; resolutions end with bp, kb or mb.
    """
    unit = {"": 1, "k": 1_000, "m": 1_000_000}
    number = lambda x: round(float(x[1].replace(",", "")) * unit[(x[2] or "").lower()])
    parts = [p for p in re.split(r"[:\-\s]+", text.strip()) if p]
    if not parts:
        raise ValueError(f"not a position: {text!r}")
    resolution = re.fullmatch(r"([\d.,]+)([kKmM]?)[bB][pP]?", parts[-1]) if len(parts) > 1 else None
    places = [re.fullmatch(r"([\d.,]+)([kKmM]?)", p) for p in (parts[1:-1] if resolution else parts[1:])]
    if len(places) > 2 or not all(places):
        raise ValueError(f"not a position: {text!r}")
    start = number(places[0]) if places else None
    return parts[0], start, number(places[1]) if len(places) > 1 else start, number(resolution) if resolution else None


def in_region(chr1: int, x: tuple[int, int], chr2: int, y: tuple[int, int], bin_size: int) -> Column:
    """cells whose bins' starts are in the ranges, both ends included; within a chromosome, the mirrored ranges too."""
    start_x, start_y = F.col("bin_x") * bin_size, F.col("bin_y") * bin_size
    on = (F.col("chr1") == min(chr1, chr2)) & (F.col("chr2") == max(chr1, chr2))
    straight, turned = start_x.between(*x) & start_y.between(*y), start_x.between(*y) & start_y.between(*x)
    if chr1 == chr2:
        return on & (straight | turned)
    return on & (straight if chr1 < chr2 else turned)


def dump(cells: DataFrame, chr1: int, x: tuple[int, int], chr2: int, y: tuple[int, int], bin_size: int) -> DataFrame:
    """X, y and value of the cells of a region."""
    return cells.where(in_region(chr1, x, chr2, y, bin_size)).select((F.col("bin_x") * bin_size).alias("x"), (F.col("bin_y") * bin_size).alias("y"), F.col("counts").alias("value"))


def lookup(cells: DataFrame, points: DataFrame) -> DataFrame:
    """the count at each point (chr, bin_x, bin_y in either order), 0 where there is no cell."""
    p = points.withColumns({"bin_x": F.least("bin_x", "bin_y"), "bin_y": F.greatest("bin_x", "bin_y")})
    c = cells.where("chr1 = chr2").select(F.col("chr1").alias("chr"), "bin_x", "bin_y", "counts")
    return p.join(c, ["chr", "bin_x", "bin_y"], "left").withColumn("counts", F.coalesce("counts", F.lit(0.0)))


def min_count(cells: DataFrame, least: float) -> DataFrame:
    """F12."""
    return cells.where(F.col("counts") >= least)


def window(cells: DataFrame, chr_: int, row: int, col: int, rows: int, cols: int) -> DataFrame:
    """A rows x cols window as dense rows (i, j, value), cells below the diagonal mirrored."""
    sides = cells.where((F.col("chr1") == chr_) & (F.col("chr2") == chr_))
    both = sides.select("bin_x", "bin_y", "counts").unionByName(sides.where("bin_x <> bin_y").select(F.col("bin_y").alias("bin_x"), F.col("bin_x").alias("bin_y"), "counts"))
    here = both.where(F.col("bin_x").between(row, row + rows - 1) & F.col("bin_y").between(col, col + cols - 1))
    here = here.select((F.col("bin_x") - row).alias("i"), (F.col("bin_y") - col).alias("j"), "counts")
    spark = cells.sparkSession
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
    return grid.join(here, ["i", "j"], "left").select("i", "j", F.coalesce("counts", F.lit(0.0)).alias("value"))


def cross_hair(cells: DataFrame, chr_: int, bin_: int, n_bins: int) -> DataFrame:
    """One row of a chromosome's symmetric matrix, 0 where there is no cell."""
    mine = cells.where((F.col("chr1") == chr_) & (F.col("chr2") == chr_) & ((F.col("bin_x") == bin_) | (F.col("bin_y") == bin_)))
    mine = mine.select(F.when(F.col("bin_x") == bin_, F.col("bin_y")).otherwise(F.col("bin_x")).alias("bin"), "counts")
    every = cells.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(mine, "bin", "left").select("bin", F.coalesce("counts", F.lit(0.0)).alias("value"))
