"""One query for each corpus operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import bpe, idcodec, language, linededup, mixing, quality, shards, simhash, spotsigs, telephony
from leafwork.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idcodec.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).read()


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.described(telephony.media_of(table(spark, sf_dir, "documents")))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each removed unit: where it stood, and the document and offset of the occurrence that was kept."""
    return linededup.repeats(table(spark, sf_dir, "documents")).drop("th")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality, op2_token_ids, op3_shards, op4_language, op5_spotsigs, op6_simhash, op7_mixing, op8_telephony, op9_repeats, op10_bpe, pipeline)}

ORACLE_SQL: dict[str, str] = {}
