"""A training corpus from documents: language, near-duplicates, secrets, source mix, tokens.

Each stage takes what the one before it kept, written as Parquet in between.

Tables may have further columns of any names, also those of an operator's results; they are carried
along. Rows with a null id are each a document of their own, rows that share an id are one. A null text
has no language and goes. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.llm import bpe, language_id, mixing, near_dedup, secret_scan
from quadspark.scratch import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language: what is null or has no letter goes."""
    # under names of its own no column of the table clashes with one of the result
    own = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    others = tuple(n for c, n in own.items() if c != "doc_id")
    found = language_id.identify(plain, plain, id_col=own["doc_id"], text_col=own["text"], lang_col=own["lang"], keep=others)
    return found.where(F.col("lang_pred") != "und").select(*[F.col(n).alias(c) for c, n in own.items()])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, a similarity of 0.8): the least id."""
    scratch = Scratch(spark, "one-of-each")
    kept = near_dedup.near_duplicates(docs).where("kept").select("doc_id")
    times = scratch.save(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept")
    # what is kept grows with the corpus: a shuffle at every size, never a broadcast
    out = docs.join(times.hint("merge"), docs.doc_id.eqNullSafe(times.doc_id), "left_semi")
    if times.where("n > 1 AND doc_id IS NOT NULL").isEmpty():
        return out
    # rows that share an id are one document, the least row of them; rows without an id are each their own
    others = [c for c in docs.columns if c != "doc_id"]
    known = out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row"))
    return known.select("doc_id", "row.*").select(*docs.columns).unionByName(out.where("doc_id IS NULL").select(*docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with found secrets replaced by marks."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their weights: rows repeat or go as the mix takes them."""
    return mixing.mixed(docs, length_col="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, starts, ends, n_split, decoded_sha256)`` of every row: its tokens, the characters
    that they stand for, and the digest of what they decode to."""
    return bpe.encode(docs, decoded=True)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
    ("byte_bpe", tokens),
]

#: Language identification and byte-pair encoding have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
