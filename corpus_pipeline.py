"""The corpus pipeline: five stages over `documents`, each an operator of sieveline.llm applied to all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet on the shared folder and gives
the next stage the reread table. All stages but the last return the columns of documents.

Defined results: a null or empty text has no letters, so language ID rejects it; rows equal in id and text share a
decision, except that the near-duplicate stage keeps one row of them; null ids are kept like others; columns beside those
of documents are carried through every stage; empty tables give empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontaminate, jaccard_join, langid, line_dedup, mixing
from sieveline.llm.common import cut, table

#: Language ID rejects a text without letters, or with less than this part of its letters in scripts of learned languages; a text
#: that mixes learned languages is kept, however evenly.
MIN_EXPLAINED = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which MIN_EXPLAINED of the letters or more are in learned scripts."""
    out = langid.predict(docs, langid.fit(langid.train_rows(docs)))
    good = out.where((F.col("lang_pred") != langid.UND) & (F.col("explained") >= MIN_EXPLAINED))
    return good.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated line chunks out of the texts; rows that lose all their words go, and n_chars follows the text."""
    out = line_dedup.dedup(docs, drop_emptied=True)
    return out.select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that the Jaccard join links."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row per copy taken, with its shard and its place in it."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontamination),
    ("mixing", source_mixing),
]

#: No stage has a SQL form: a trained model, hash-chosen boundaries and seeded draws stand in the way. tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
