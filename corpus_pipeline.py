"""Corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, source mix.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each
stage's result as Parquet in the shared scratch folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm import decontam, jaccard, langid, mixing, substring
from lagweave.llm.common import materialize


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns and all of docs in the struct ``row``, so that no other column can meet one an operator adds."""
    return docs.select(*names, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the model learns from those with a lang.

    Without a single lang nothing can be told apart and all documents stay.
    """
    model = langid.train(docs)
    if not model.langs:
        return docs
    return langid.identify(_packed(docs, "text"), model).where(f"lang_pred <> '{langid.UNKNOWN}'").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard of 0.8 or more), that with the least doc_id.

    Candidates come from SimHash anchors and, as no anchor reaches fingerprints so far apart, from min-hash bands; all are checked.
    """
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a smaller doc_id has; n_chars follows the text, and a text left without words goes."""
    out = substring.remove_repeats(_packed(docs, "doc_id", "text")).where("n_words = 0 or n_removed < n_words")
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(F.col("row").withField("text", F.col("text")).withField("n_chars", n_chars).alias("row")).select("row.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix with the words taken of each, repeats counted."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("source_mix", source_mix),
]

#: SQL cannot express the stages (trained models, similarity); tests compare the whole with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
