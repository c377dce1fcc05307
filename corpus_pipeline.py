"""A corpus from raw documents to batches: five stages, each by one operator.

``STAGES`` holds ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a frame that is stored before the next stage reads it. All but the last keep the
columns of ``documents``. Defined results of a stage are those of its operator; in
particular null texts count as empty, rows with a null id are never taken for copies, and
an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filltape.llm import near_dedup, packing, quality, substring_dedup, toxicity
from filltape.llm.common import stored, table

#: Near copies share at least this percentage of their shingles.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the operator's threshold."""
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(docs, machine, docs["text"]) < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the least id.

    Of several texts with one id only those that were judged a copy go.
    """
    found = near_dedup.judged_texts(docs, NEAR_PERCENT)
    copies = found.filter("not kept").select("doc_id", "text_hash").distinct()
    # The whole row in one column, so that none of its columns clashes with the two keys.
    marked = docs.select(
        F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash")
    )
    return marked.join(copies, ["doc_id", "text_hash"], "left_anti").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of earlier ones; a text that loses nothing stays as it is.

    A document that loses every word stays with an empty text.
    """
    parsed = substring_dedup.substring_dedup(docs)
    cut = F.size("spans") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        n_chars = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", n_chars)
    return parsed.select(row.alias("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and place in it, by its number of words."""
    return packing.pack(docs, packing.word_count(F.col("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: Fitting and hashing have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
