"""A corpus pipeline: quality rules, line dedup, near-dedup, source mix, and a tokenizer's round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bpe_codec, line_dedup, near_sets, queries, quality_rules
from ridgeline.llm.common import materialize, table, text_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality(docs, carry=docs.columns).where("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later copies; those that only had such lines go. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: candidates by SimHash and Golay indices, links by five-word shingles with a similarity of 0.8 or more."""
    return near_sets.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is read."""
    return queries.mixed(docs).select(*docs.columns)


def codec_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    text_batches(spark)
    trip = bpe_codec.round_trip_column(F.col("text"), queries.tokenizer_path("byte_bpe_50k.json"))
    return docs.select("doc_id", "text").withColumn("trip", trip).select("doc_id", "trip.*")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("bpe_round_trip", codec_stage),
]

#: The stages' estimates, components and tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
