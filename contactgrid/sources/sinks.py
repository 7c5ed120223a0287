"""Sinks: dumps, feature lists, intervals, vectors and partitioned matrices (K01-K03, K06-K10, K14); see binary.py for K05 and K15, container.py for K02's blocks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The attribute columns of exported loops and domains, by layout.
LAYOUTS = {
    "NA": [],
    "FINAL": ["observed", "expectedBL", "expectedDonut", "expectedH", "expectedV", "fdrBL", "fdrDonut", "fdrH", "fdrV", "numCollapsed", "centroid1", "centroid2", "radius"],
    "ENRICHED": ["observed", "expectedBL", "expectedDonut", "expectedH", "expectedV", "binBL", "binDonut", "binH", "binV", "fdrBL", "fdrDonut", "fdrH", "fdrV"],
    "LOCALIZED": [
        "observed", "expectedBL", "expectedDonut", "expectedH", "expectedV", "fdrBL", "fdrDonut", "fdrH", "fdrV", "numCollapsed", "centroid1", "centroid2", "radius", "highRes_start_1", "highRes_end_1",
        "highRes_start_2", "highRes_end_2", "upstream_start_1", "upstream_end_1", "downstream_start_2", "downstream_end_2", "localX", "localY", "localObserved", "localPval", "localZscore", "localPeakID",
    ],
    "ARROWHEAD": ["score", "uVarScore", "lVarScore", "upSign", "loSign"],
}


def write_matrices(contacts: DataFrame, path: str, least: float = 0.0, mode: str = "overwrite") -> None:
    """Cells by unit, bin size and chromosomes, so that a region query reads its own folder; sorted, so that it skips row groups."""
    keep = contacts.where(F.col("counts") >= least)
    dealt = keep.repartition("unit", "bin_size", "chr1", "chr2", F.floor(F.col("bin_x") / 4096))
    dealt.sortWithinPartitions("unit", "bin_size", "chr1", "chr2", "bin_x", "bin_y").write.mode(mode).partitionBy("unit", "bin_size", "chr1", "chr2").option("compression", "zstd").parquet(path)


def write_sparse_text(cells: DataFrame, path: str, bin_size: int) -> None:
    """X, y and value, separated by tabs."""
    cells.select((F.col("bin_x") * bin_size).alias("x"), (F.col("bin_y") * bin_size).alias("y"), "counts").write.mode("overwrite").option("sep", "\t").csv(path)


def bedpe_lines(features: DataFrame, layout: str = "FINAL") -> DataFrame:
    """A line for each feature, and the header as attribute ``header`` of the layout: see bedpe_header()."""
    there = set(features.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) if c in there else F.lit("NA")
    dot = F.lit(".")
    parts: list[Column] = [*(F.col(c).cast("string") for c in ("chr", "start1", "end1", "chr", "start2", "end2")), dot, dot, dot, dot, F.lit("0,0,255"), *map(text, LAYOUTS[layout])]
    return features.select(F.concat_ws("\t", *parts).alias("value"))


def bedpe_header(layout: str = "FINAL") -> str:
    return "\t".join(["#chr1", "x1", "x2", "chr2", "y1", "y2", "name", "score", "strand1", "strand2", "color", *LAYOUTS[layout]])


def write_bed(intervals: DataFrame, path: str) -> None:
    """K09."""
    intervals.select("chr", "x1", "x2").write.mode("overwrite").option("sep", "\t").csv(path)


def wig_lines(vector: DataFrame, bin_size: int) -> DataFrame:
    """Fixed-step lines of chr, line (its order) and value: a header for each run of consecutive bins, then its values."""
    before = vector.select("chr", (F.col("bin") + 1).alias("bin"), F.lit(False).alias("first"))
    v = vector.join(before, ["chr", "bin"], "left").withColumn("first", F.coalesce("first", F.lit(True)))
    head = F.concat(F.lit("fixedStep chrom="), F.col("chr").cast("string"), F.lit(" start="), (F.col("bin") * bin_size + 1).cast("string"), F.lit(f" step={bin_size} span={bin_size}"))
    value = F.col("value").cast("string")
    lines = F.when(F.col("first"), F.array(F.struct((2 * F.col("bin")).alias("line"), head.alias("value")), F.struct((2 * F.col("bin") + 1).alias("line"), value.alias("value"))))
    lines = lines.otherwise(F.array(F.struct((2 * F.col("bin") + 1).alias("line"), value.alias("value"))))
    return v.select("chr", F.inline(lines))


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors beside those that are there, by type, unit and bin size."""
    vectors.write.mode("append").partitionBy("norm", "unit", "bin_size").parquet(path)


#: Bins of a vector that one .npy content holds.
NPY_BINS = 1 << 20


def npy_vectors(vector: DataFrame) -> DataFrame:
    """Vectors as contents of .npy files, dense from bin 0, nan where there is no value: chr, first, content. Longer ones in parts of NPY_BINS bins."""

    def save(f: pd.DataFrame) -> pd.DataFrame:
        first = int(f["part"].iloc[0]) * NPY_BINS
        v = np.full(int(f["bin"].max()) - first + 1, np.nan)
        v[f["bin"].to_numpy() - first] = f["value"]
        out = io.BytesIO()
        np.save(out, v)
        return pd.DataFrame({"chr": f["chr"].iloc[:1], "first": [first], "content": [out.getvalue()]})

    parts = vector.select("chr", F.col("bin").cast("int").alias("bin"), F.col("value").cast("double").alias("value"), F.floor(F.col("bin") / NPY_BINS).alias("part"))
    return parts.groupBy("chr", "part").applyInPandas(save, "chr int, first int, content binary")


def read_npy(contents: DataFrame) -> DataFrame:
    """The values of npy_vectors() again: chr, bin, value; null where it is nan."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for chr_, first, content in zip(f["chr"], f["first"], f["content"], strict=True):
                v = np.load(io.BytesIO(content))
                yield pd.DataFrame({"chr": chr_, "bin": first + np.arange(len(v), dtype="int32"), "value": v})

    rows = contents.select("chr", "first", "content").mapInPandas(load, "chr int, bin int, value double")
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def matrix_lines(dense: DataFrame) -> DataFrame:
    """A line for each row i of a dense window (i, j, value), or of each of many by their ``id``: its values in brackets, in order."""
    row = F.transform(F.sort_array(F.collect_list(F.struct("j", "value"))), lambda x: x["value"].cast("string"))
    return dense.groupBy(*(c for c in ("id", "i") if c in dense.columns)).agg(F.concat(F.lit("["), F.array_join(row, ", "), F.lit("]")).alias("value"))
