"""Connected components of links between documents, by joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each end of the links (a, b); a component is named by its smallest id.

    Each round takes the smallest label among a document and its neighbours, then that label's own label,
    so that chains shorten by half; rounds end when nothing changes. Tables are written between rounds. A hub
    of any number of links is summed in parts before the shuffle, and its join starts at scans, so that it can be split.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "least").alias("next"), "component")
        step = materialize(step, "labels-step")
        jump = step.select(F.col("id").alias("of"), F.col("next").alias("jump"))
        after = step.join(jump, step["next"] == jump["of"]).select("id", F.least("next", "jump").alias("component"), (F.least("next", "jump") < F.col("component")).alias("moved"))
        after = materialize(after, "labels-next")
        labels = after.select("id", "component")
        if not after.where("moved").limit(1).count():
            return labels
