"""Bounded samples of labelled rows, for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.language_id import held_out


def unit_hash(salt: str, *cols: str):
    """A hash of the columns as a number from 0 up to 1."""
    return F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def labelled_sample(labels: DataFrame, label_col: str, max_rows: int, fold: tuple[int, int] | None, id_col: str = "doc_id", balanced: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """``(id, label)`` of about ``max_rows`` rows a label at most, chosen by hash, and all rows' counts.

    ``balanced`` takes as many of each label. ``fold`` is (folds, the one that is held out and never taken). An id with several labels has the
    largest; null ids and labels are left out. The result is bounded, so it may be broadcast.
    """
    rows = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1))
    if fold:
        rows = rows.where(~held_out(id_col, *fold))
    rows = rows.groupBy(id_col).agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    most = min([max_rows, *counts.values()]) if balanced else max_rows
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, min(1.0, most / n)).otherwise(share)
    return rows.where(unit_hash("labelled", id_col) < share), counts


def labelled_texts(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, label, text)`` of the chosen ids, one row each: of several rows with one id the least text
    (null before any), put together within tasks first, so that a hot id adds one row."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), id_col)
    return rows.groupBy(id_col, "label").agg(F.min("text").alias("text"))


def sampled_texts(docs: DataFrame, max_rows: int, salt: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(text)`` of about ``max_rows`` different rows at most, chosen by a hash of id and text; equal
    rows count once, however many there are."""
    rows = docs.select(F.xxhash64(F.lit(salt), F.col(id_col), F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    chosen = F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40)) < min(1.0, max_rows / max(n, 1))
    return rows.where(chosen).groupBy("h").agg(F.min("text").alias("text")).select("text")
