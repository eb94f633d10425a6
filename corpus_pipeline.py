"""The corpus pipeline: quality, line dedup, near-duplicates, mixing, packing; each stage works on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenza.llm import lines, minhash, mixing, packing, quality
from evidenza.llm.common import read, text_or_empty, written


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs, n_chars (if there) counted again."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, keeps."""
    model = quality.train(written(quality.graded(docs, read(spark, sf_dir, "labels")), "quality-sample"))
    return quality.kept(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines, of which one occurrence stays."""
    return _like(docs, lines.deduplicated(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.deduplicated(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix trains on them, range-sorted by position: one row for each time, sources near their targets."""
    return _like(docs, mixing.trained(docs))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with the sequence it stands in and its place there."""
    return packing.packed(written(packing.pieces(docs.withColumn("text", text_or_empty("text"))), "pack-pieces"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("minhash", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]
#: SQL cannot express the classifier, the signatures or the tokens; tests/llm holds each operator against a plain version, and of the stages columns, counts and kept rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
