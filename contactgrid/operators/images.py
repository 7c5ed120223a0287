"""Images: dense windows of matrices as rows id, i, j, value (W07-W12, A43), and the localizer of peaks in them.

Rows and columns of an image are window partitions, so the images of many loops are worked on at once, and none is in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from contactgrid.functions.scalars import poisson_upper
from contactgrid.operators.norm import both_sides
from contactgrid.tables import written

#: Places of dense images that a task is dealt: as many as it sorts in memory.
TASK_PIXELS = 500_000
#: Places of windows that the localizer works on at once.
WINDOW_PIXELS = 1_000_000
#: Digits for any double to six places and more.
_EXACT = Context(prec=400)


def _row() -> WindowSpec:
    return Window.partitionBy("id", "i").orderBy("j")


def _column() -> WindowSpec:
    return Window.partitionBy("id", "j").orderBy("i")


def rank_percentile(image: DataFrame) -> DataFrame:
    """The share, in percent, of an image's values that are smaller; 0 for zeros."""
    all_ = Window.partitionBy("id")
    share = 100 * (F.rank().over(all_.orderBy("value")) - 1) / F.count(F.lit(1)).over(all_)
    return image.withColumn("value", F.when(F.col("value") == 0, F.lit(0.0)).otherwise(share))


def _blurred(by: WindowSpec, radius: int) -> Column:
    """The mean of the 2r + 1 values around; beyond an edge the edge's value stands."""
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, n = F.row_number().over(by), F.count(F.lit(1)).over(whole)
    outside = lambda room, edge: F.greatest(F.lit(radius) - room, F.lit(0)) * edge
    inside = F.sum("value").over(by.rowsBetween(-radius, radius))
    edges = outside(place - 1, F.first("value").over(whole)) + outside(n - place, F.last("value").over(whole))
    return (inside + edges) / (2 * radius + 1)


def box_blur(image: DataFrame, radius: int) -> DataFrame:
    """The mean of the square of 2r + 1 around each value."""
    return image.withColumn("value", _blurred(_row(), radius)).withColumn("value", _blurred(_column(), radius))


def boxes(sigma: int, n: int = 3) -> list[int]:
    """The odd widths of n boxes whose blurs, one after the other, come near a Gaussian's."""
    width = int((12 * sigma * sigma / n + 1) ** 0.5)
    width -= 1 - width % 2
    narrow = round((12 * sigma * sigma - n * width * width - 4 * n * width - 3 * n) / (-4 * width - 4))
    return [width if k < narrow else width + 2 for k in range(n)]


def gaussian_blur(image: DataFrame, sigma: int) -> DataFrame:
    """W08."""
    for width in boxes(sigma):
        image = box_blur(image, (width - 1) // 2)
    return image


def peaks(image: DataFrame, radius: int, by: str = "value") -> DataFrame:
    """The positive values that none within the radius exceeds by the column ``by``; of equals the first row, then column, stays."""
    rank = F.struct(F.col(by).alias("v"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))
    most = image.withColumn("_own", rank).withColumn("_most", F.max("_own").over(_row().rangeBetween(-radius, radius)))
    most = most.withColumn("_most", F.max("_most").over(_column().rangeBetween(-radius, radius)))
    return most.where((F.col("value") > 0) & (F.col("_own") == F.col("_most"))).drop("_own", "_most")


def local_gradient(image: DataFrame, step: int = 1) -> DataFrame:
    """How far a value is above the mean of its eight neighbours at the step, by its own root; rows where it is, away from the edges."""
    west, east = F.lag("value", step).over(_row()), F.lead("value", step).over(_row())
    three = image.withColumn("_three", west + F.col("value") + east).withColumn("_two", west + east)
    around = F.lag("_three", step).over(_column()) + F.lead("_three", step).over(_column()) + F.col("_two")
    gradient = F.try_divide(F.col("value") - around / 8, F.sqrt("value"))
    return three.withColumn("value", gradient).where("value > 0").drop("_three", "_two")


def column_derivative(image: DataFrame) -> DataFrame:
    """Each value less the next one down its column; the last row goes."""
    return image.withColumn("value", F.col("value") - F.lead("value").over(_column())).where("value is not null")


def over_median(image: DataFrame, limit: float) -> DataFrame:
    """Values by the median of their column, at most ``limit``; columns of median 0 go."""
    median = F.percentile("value", F.lit(0.5)).over(Window.partitionBy("id", "j"))
    return image.withColumn("value", F.least(F.try_divide("value", median), F.lit(limit))).where("value is not null")


def box_max(image: DataFrame, rows: int, columns: int) -> DataFrame:
    """An image made smaller: the largest value of each box of rows x columns."""
    at = lambda c, n: F.floor(F.col(c) / n).cast("int").alias(c)
    return image.groupBy("id", at("i", rows), at("j", columns)).agg(F.max("value").alias("value"))


def interpolate(image: DataFrame, rows: int, columns: int) -> DataFrame:
    """An image made larger by whole factors: values between those of the image lie on lines between them; beyond the last ones they stay."""
    def along(m: DataFrame, c: str, by: WindowSpec, times: int) -> DataFrame:
        step = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("_k")
        rest = [x for x in ("id", "i", "j") if x != c]
        m = m.withColumn("_next", F.coalesce(F.lead("value").over(by), F.col("value"))).select("*", step)
        part = F.col("_k") / times
        return m.select(*rest, (F.col(c) * times + F.col("_k")).alias(c), (F.col("value") * (1 - part) + F.col("_next") * part).alias("value"))

    return along(along(image, "j", _row(), columns), "i", _column(), rows).select("id", "i", "j", "value")


def expand_with_zeros(image: DataFrame, rows: int, columns: int) -> DataFrame:
    """An image of rows x columns, 0 where the given one ends."""
    return _filled(image, rows, columns)


def _filled(image: DataFrame, rows: int, columns: int) -> DataFrame:
    """Every place of rows x columns of each image, with its value or 0; the zeros are made where the image's other rows are, without a join."""
    place = F.col("i") * columns + F.col("j")
    there = image.groupBy("id").agg(F.collect_list(F.when(F.col("i").between(0, rows - 1) & F.col("j").between(0, columns - 1), F.struct(place.alias("place"), F.coalesce("value", F.lit(0.0)).alias("value")))).alias("there"))
    empty = F.array_except(F.sequence(F.lit(0), F.lit(rows * columns - 1)), F.col("there.place"))
    zeros = F.transform(empty, lambda k: F.struct(k.alias("place"), F.lit(0.0).alias("value")))
    flat = there.select("id", F.inline(F.concat("there", zeros)))
    return flat.select("id", F.floor(F.col("place") / columns).cast("int").alias("i"), (F.col("place") % columns).alias("j"), "value")


def display_limit(image: DataFrame, share: float = 0.95, every: int = 10) -> DataFrame:
    """Of each image, the percentile of every tenth value off the diagonal, in order of rows and columns: where a colour scale ends."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("i", "j"))
    off = image.where("i <> j and value > 0").withColumn("_place", place).where(F.col("_place") % every == 0)
    return off.groupBy("id").agg(F.percentile("value", F.lit(share)).alias("top"))


def tiles(cells: DataFrame, n: int) -> DataFrame:
    """The squares of n x n bins that hold a map's intra cells, as images: id, i, j, value, 0 where there is no cell.

    Squares lie on a grid over each chromosome's matrix, on its diagonal and above; one on the diagonal holds mirrored cells too. tile_id() tells a square's id.
    Only the cells are shuffled, by square; the zeros are made in the tasks, of which each gets about TASK_PIXELS places, and what is done
    by image, row or column stays in these tasks.
    """
    return _filled(_tile_cells(cells, n), n, n)


def _tile_cells(cells: DataFrame, n: int) -> DataFrame:
    """The cells of tiles(), dealt by square: id, i, j, value."""
    at = lambda c: F.floor(F.col(c) / n)
    inside = lambda c: (F.col(c) % n).cast("int")
    one = lambda i, j: F.struct(inside(i).alias("i"), inside(j).alias("j"))
    mirrored = (F.col("bin_x") != F.col("bin_y")) & (at("bin_x") == at("bin_y"))
    places = F.when(mirrored, F.array(one("bin_x", "bin_y"), one("bin_y", "bin_x"))).otherwise(F.array(one("bin_x", "bin_y")))
    here = cells.where("chr1 = chr2").select(tile_id(F.col("chr1"), at("bin_x"), at("bin_y")).alias("id"), "counts", F.inline(places))
    here = written(here, "tile-cells")
    pixels = here.agg(F.approx_count_distinct("id")).first()[0] * n * n
    dealt = here.repartition(1 + pixels // TASK_PIXELS, "id")
    return dealt.groupBy("id", "i", "j").agg(F.sum("counts").alias("value"))


def _rounded(v: np.ndarray, places: int) -> np.ndarray:
    """Spark's round() of an array: by products where that is certain, by decimals near a half and beyond what products can tell."""
    scaled = v * 10.0**places
    whole = np.rint(scaled)
    out = whole / 10.0**places
    with np.errstate(invalid="ignore"):
        unsure = ~((np.abs(np.abs(scaled - whole) - 0.5) > 1e-3) & (np.abs(scaled) < 2.0**40)) & np.isfinite(v)
    if unsure.any():
        out[unsure] = [float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP, _EXACT)) for x in v[unsure].tolist()]
    return out


def on_tiles(cells: DataFrame, n: int, work: Callable[[np.ndarray], np.ndarray], places: int = 6) -> DataFrame:
    """What ``work`` makes of tiles(), rounded: id, i, j, value. It gets many squares of n x n at once, as a stack, and gives as many images of any size.

    A square is a row of its cells; its zeros and what ``work`` makes are only there while a stack of about WINDOW_PIXELS places is worked on.
    """
    place = (F.col("i") * n + F.col("j")).alias("place")
    held = _tile_cells(cells, n).groupBy("id").agg(F.collect_list(F.struct(place, F.coalesce("value", F.lit(0.0)).alias("value"))).alias("there"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, WINDOW_PIXELS // (n * n))
        for batch in batches:
            for low in range(0, len(batch), step):
                ids, there = batch.column("id").slice(low, step), batch.column("there").slice(low, step)
                raw, cell = np.zeros((len(ids), n * n)), there.flatten()
                raw[np.repeat(np.arange(len(ids)), pc.list_value_length(there).to_numpy()), cell.field("place").to_numpy()] = cell.field("value").to_numpy()
                made = _rounded(work(raw.reshape(-1, n, n)), places)
                rows, columns = made.shape[1:]
                few = max(1, WINDOW_PIXELS // (rows * columns))
                for k in range(0, len(made), few):
                    part = made[k : k + few]
                    i, j = np.divmod(np.arange(rows * columns, dtype="int32"), np.int32(columns))
                    values = [np.repeat(ids.slice(k, few).to_numpy(), rows * columns), np.tile(i, len(part)), np.tile(j, len(part)), part.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["id", "i", "j", "value"])

    return held.mapInArrow(run, "id bigint, i int, j int, value double")


def tile_id(chr_: Column, row: Column, column: Column) -> Column:
    """A square's number from its chromosome's and its row and column of squares, each below 2**20."""
    return ((chr_.cast("long") * (1 << 20) + row) * (1 << 20) + column).cast("long")


def loop_images(loops: DataFrame, cells: DataFrame, bin_size: int, radius: int) -> DataFrame:
    """The windows of ``radius`` bins around the loops' middles as images, their id the loop's; i, j from 0."""
    mid = lambda e: F.floor(F.floor((F.col(f"start{e}") + F.col(f"end{e}")) / 2) / bin_size)
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.lit(2 * radius))).alias(c)
    at = loops.select("id", "chr", mid(1).alias("x0"), mid(2).alias("y0")).select("*", spread("i")).select("*", spread("j"))
    a, b = F.col("x0") - radius + F.col("i"), F.col("y0") - radius + F.col("j")
    at = at.select("id", "chr", "i", "j", F.least(a, b).cast("int").alias("bin_x"), F.greatest(a, b).cast("int").alias("bin_y"))
    c = cells.where("chr1 = chr2").select(F.col("chr1").alias("chr"), "bin_x", "bin_y", "counts")
    return at.join(c, ["chr", "bin_x", "bin_y"], "left").select("id", "i", "j", F.coalesce("counts", F.lit(0.0)).alias("value"))


def _box_mean(m: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """_blurred() of a stack of images."""
    m = np.moveaxis(m, axis, -1)
    n = m.shape[-1]
    padded = np.pad(m, ((0, 0), (0, 0), (radius, radius)))
    inside = np.zeros(m.shape)
    for k in range(2 * radius + 1):
        inside += padded[..., k : k + n]
    first, last = np.maximum(radius - np.arange(n), 0), np.maximum(radius - np.arange(n)[::-1], 0)
    return np.moveaxis((inside + (first * m[..., :1] + last * m[..., -1:])) / (2 * radius + 1), -1, axis)


def _box_means(m: np.ndarray, radius: int) -> np.ndarray:
    """box_blur() of a stack of images."""
    return _box_mean(_box_mean(m, radius, 2), radius, 1)


def gaussian_blurred(m: np.ndarray, sigma: int) -> np.ndarray:
    """gaussian_blur() of a stack of images."""
    for width in boxes(sigma):
        m = _box_means(m, (width - 1) // 2)
    return m


def interpolated(m: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """interpolate() of a stack of images."""
    for axis, times in ((2, columns), (1, rows)):
        m = np.moveaxis(m, axis, -1)
        following = np.concatenate((m[..., 1:], m[..., -1:]), axis=-1)
        part = np.arange(times) / times
        m = np.moveaxis((m[..., None] * (1 - part) + following[..., None] * part).reshape(*m.shape[:-1], -1), -1, axis)
    return m


def _outstanding(z: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """peaks() of a stack of images by z, which is -inf where nothing is told: image, row and column of each."""
    n = z.shape[-1]
    padded = np.pad(z, ((0, 0), (radius, radius), (radius, radius)), constant_values=-np.inf)
    most = padded
    for axis in (1, 2):
        most = np.max([np.take(most, range(k, k + n), axis) for k in range(2 * radius + 1)], axis=0)
    at, i, j = np.nonzero((value > 0) & (z > -np.inf) & (z >= most))
    stays = np.ones(len(at), bool)
    for di, dj in ((di, dj) for di in range(-radius, 1) for dj in range(-radius, radius + 1) if (di, dj) < (0, 0)):
        stays &= padded[at, i + radius + di, j + radius + dj] != z[at, i, j]
    return at[stays], i[stays], j[stays]


def localize(loops: DataFrame, cells: DataFrame, bin_size: int, radius: int = 25, window: int = 1, sigma: int = 3, most_p: float = 0.1, n: int = 1) -> DataFrame:
    """The fine peaks inside coarse loops: id, rank, start1, start2, observed, expected, z, p_value.

    What a loop's window holds is summed over boxes of ``window`` bins around each cell; the same, blurred, and of equal mass
    over all, is what is expected. Cells that stand out most from it within a box of their own are peaks; the p-value of a
    peak counts all of its window. At most n of a loop, the strongest first.

    Loops of one place share a window. Cells meet it by squares as wide, and only those that it holds are shuffled, a row a window; its zeros are made in the tasks, which work on many windows at once.
    """
    width = 2 * radius + 1
    mid = lambda e: F.floor(F.floor((F.col(f"start{e}") + F.col(f"end{e}")) / 2) / bin_size)
    at = loops.select("id", "chr", mid(1).alias("x0"), mid(2).alias("y0"))
    square = lambda c: F.floor(c / width)
    touched = lambda c: F.explode(F.array_distinct(F.array(square(F.col(c) - radius), square(F.col(c) + radius))))
    windows = at.select("chr", "x0", "y0").distinct().withColumn("tx", touched("x0")).withColumn("ty", touched("y0"))
    sides = both_sides(cells).withColumns({"tx": square(F.col("bin")), "ty": square(F.col("other"))})
    i, j = F.col("bin") - F.col("x0") + radius, F.col("other") - F.col("y0") + radius
    seen = windows.join(sides.hint("merge"), ["chr", "tx", "ty"]).where(i.between(0, width - 1) & j.between(0, width - 1))
    held = seen.groupBy("chr", "x0", "y0").agg(F.collect_list((i * width + j).cast("int")).alias("place"), F.collect_list(F.coalesce("counts", F.lit(0.0)).cast("double")).alias("counts"))
    step = max(1, WINDOW_PIXELS // width**2)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for low in range(0, len(f), step):
                g = f.iloc[low : low + step]
                raw = np.zeros((len(g), width * width))
                raw[np.repeat(np.arange(len(g)), g["place"].str.len()), np.concatenate(g["place"].to_numpy())] = np.concatenate(g["counts"].to_numpy())
                value = _box_means(raw.reshape(len(g), width, width), window) * (2 * window + 1) ** 2
                expected = value
                for box in boxes(sigma):
                    expected = _box_means(expected, (box - 1) // 2)
                with np.errstate(invalid="ignore", divide="ignore"):
                    expected = expected * (value.sum(axis=(1, 2)) / expected.sum(axis=(1, 2)))[:, None, None]
                    z = np.where(expected > 0, 2 * (np.sqrt(value) - np.sqrt(expected)), -np.inf)
                k, row, column = _outstanding(z, value, 2 * window + 1)
                peak = {c: v[k, row, column] for c, v in (("value", value), ("expected", expected), ("z", z))}
                yield g[["chr", "x0", "y0"]].iloc[k].assign(i=row, j=column, n_peaks=np.bincount(k, minlength=len(g))[k], **peak)

    found = held.mapInPandas(run, "chr int, x0 long, y0 long, i int, j int, n_peaks long, value double, expected double, z double")
    found = found.withColumn("p_value", F.least(poisson_upper(F.round("value"), F.col("expected")) * F.col("n_peaks"), F.lit(1.0))).where(F.col("p_value") <= most_p)
    rank = F.row_number().over(Window.partitionBy("chr", "x0", "y0").orderBy(F.col("z").desc(), "i", "j"))
    start = lambda o, c: ((F.col(o) - radius + F.col(c)) * bin_size).cast("long")
    best = found.withColumn("rank", rank).where(F.col("rank") <= n).join(at, ["chr", "x0", "y0"])
    return best.select("id", "chr", "rank", start("x0", "i").alias("start1"), start("y0", "j").alias("start2"), F.col("value").alias("observed"), "expected", "z", "p_value")
