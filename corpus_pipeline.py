"""The corpus pipeline: five stages over the documents table, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgrid.llm import line_dedup, mixing, near_dup, packing, quality_model
from contactgrid.llm.common import materialize, read
from contactgrid.tables import discard, mark


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    rated = quality_model.score_quality(docs, read(spark, sf_dir, "labels"))
    return rated.where("quality_kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of three-line windows; those of which nothing is left go."""
    found = line_dedup.dedup_lines(docs)
    kept = found.where("n_removed = 0 or n_removed < n_lines")
    return with_n_chars(line_dedup.with_text(kept, docs.columns), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a source's last one, if it is cut, in part."""
    copies = mixing.taken_copies(mixing.mix_sources(docs, docs.columns))
    put = lambda c: F.col("cut_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c)
    return with_n_chars(copies.select(*map(put, docs.columns)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


def with_n_chars(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars of the texts as they are now, where the table has that column."""
    if "n_chars" not in columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Training, signatures and the genetic algorithm have no SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = mark()
        after = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, since, keep=1)  # the stage's own tables; what it returned stays
        docs = after
    return docs
