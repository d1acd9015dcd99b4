"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.llm import ann, bpe, language_id, mixing, near_dedup, pu_quality, quality_rules, secret_scan, token_counts, toxicity
from quadspark.llm.language_id import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fold(rows: DataFrame, folds: int, fold: int) -> DataFrame:
    return rows.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), *rows.columns[1:])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_fold(language_id.identify(docs, docs.where(~held_out("doc_id", 3, 1))), 3, 1)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.fertility(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_fold(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 4, 2)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_fold(pu_quality.score(docs, pu_quality.fit(docs, table(spark, sf_dir, "labels"))), 4, 2)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an empty cache each time, so that a run's figures are those of encoding every distinct text
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_quality_rules,
        op3_secret_scans,
        op4_byte_bpe,
        op5_toxicity,
        op6_nearest_neighbours,
        op7_mixing,
        op8_quality_classifier,
        op9_token_counts,
        op10_near_dedup,
    )
}
SQL = {"op7_mixing": mixing.SQL}
