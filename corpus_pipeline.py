"""A corpus pipeline of five stages; each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import bpe, language, linededup, mixing, simhash
from leafwork.llm.common import table, written
from leafwork.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no learned language codes in 4.5 bits a byte (and 64 once), go; a null lang becomes the predicted one."""
    return language.keep_known(docs, language.learn(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and sentences are cut out of the texts; every document stays, with its new number of characters."""
    out = linededup.without_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.apply_mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    return bpe.encoded(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language_stage), ("near_duplicates", near_duplicate_stage), ("repeats", repeats_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: No DuckDB form: byte context trees, components and the knapsack are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
