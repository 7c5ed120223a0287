"""Motifs at loop anchors (C07) and genes near them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid.operators import intervals

ANCHOR_WIDTH = 15_000


def numbered(df: DataFrame) -> DataFrame:
    """An id for each interval of a list, from its place."""
    return df.withColumn("id", F.xxhash64("chr", "x1", "x2"))


def unique_motifs(loops: DataFrame, tracks: Sequence[DataFrame], motifs: DataFrame) -> DataFrame:
    """Anchors, widened, whose narrowed protein peak is alone, and the best motif in each: anchor id, hit, score.

    The first track's peaks that are alone in an anchor are narrowed, track by track, to those that also overlap one of the next; then the motif of the
    highest score over each is the anchor's.
    """
    anchors = numbered(intervals.anchors(loops, ANCHOR_WIDTH))
    peaks = intervals.in_locus(anchors, tracks[0], True)
    for track in tracks[1:]:
        peaks = intervals.overlap_join(peaks, track, "left_semi")
    return intervals.best_in_locus(peaks, motifs)


def directed_motifs(loops: DataFrame, peaks: DataFrame, motifs: DataFrame) -> DataFrame:
    """In anchors that are only upstream, or only downstream, ends of loops and hold several peaks, the best motif that points inward."""
    up = intervals.merge(loops.select("chr", F.col("start1").alias("x1"), F.col("end1").alias("x2")))
    down = intervals.merge(loops.select("chr", F.col("start2").alias("x1"), F.col("end2").alias("x2")))
    up, down = numbered(intervals.widen(up, ANCHOR_WIDTH)), numbered(intervals.widen(down, ANCHOR_WIDTH))
    out = None
    for mine, other, forward in ((up, down, True), (down, up, False)):
        alone = intervals.overlap_join(mine, other, "left_anti")
        several = intervals.in_locus(alone, peaks, False)
        found = intervals.best_in_locus(several, motifs.where(F.col("forward") == forward)).withColumn("forward", F.lit(forward))
        out = found if out is None else out.unionByName(found)
    return out


def genes_at_loops(loops: DataFrame, genes: DataFrame, width: int = 0) -> DataFrame:
    """C11: names of genes that overlap a loop's anchor."""
    anchors = numbered(intervals.anchors(loops, width))
    return intervals.overlap_join(genes, anchors, "left_semi").select("name").distinct()
