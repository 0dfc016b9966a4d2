"""A training corpus from raw documents: quality, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; it calls one
operator of `martflow.llm`. All but the last return the columns of `documents`; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.chosen_path import drop_near_duplicates
from martflow.llm.common import bounded, stored, table
from martflow.llm.decontaminate import drop_contaminated
from martflow.llm.host_rules import keep_good
from martflow.llm.merge_replay import round_trip
from martflow.llm.pii import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their rules and their host's verdict keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies (five-word shingles, 0.8)."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; `n_chars` is that of the new text."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `n_tokens`, `ids`, and whether decoding them gives the text again."""
    bounded(spark)
    own = F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    keyed = docs.select(F.struct("doc_id", own.alias("digest")).alias("key"), "text")
    encoded = round_trip(keyed, id="key")
    same = F.md5("decoded") == F.col("key.digest")
    return encoded.select("key.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("tokens", tokens),
]

#: Similarity joins, models and merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
