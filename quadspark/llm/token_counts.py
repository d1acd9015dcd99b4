"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content; a tokenizer's is the SHA-256 of its file.
Counts already stored under both keys are joined; only distinct missing texts are encoded, and
their counts are appended to the cache, a Parquet folder partitioned by tokenizer.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.common import map_texts
from quadspark.scratch import Scratch

#: Texts with a share of 1 / HOT of all rows or more, and LEAST_HOT copies, are joined by broadcast.
HOT, LEAST_HOT = 10_000, 1_000
CACHE_SCHEMA = "digest binary, n_tokens bigint, tokenizer string"


def normalised(text_col: str):
    """Content as it is counted. A null is empty; nothing else may change, as counts are exact."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def file_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def counter(path: str):
    """A maker of functions from texts to counts: tokenizers for .json, sentencepiece for .model."""

    def make():
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            return lambda texts: {"n_tokens": [len(ids) for ids in model.encode(texts, num_threads=1)]}
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def work(texts):
            # one text a call: each call's encodings are gone before the next text
            return {"n_tokens": [len(tokenizer.encode_batch_fast([t], add_special_tokens=False)[0]) if t else 0 for t in texts]}

        return work

    return make


def count_tokens(docs: DataFrame, cache_dir: str | None = None, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row, also null and repeated ones.

    ``cache_dir`` is the cache, made if missing; None begins an empty one in the scratch folder.
    ``path`` is the tokenizer file, readable under the same path on every worker. Two runs that
    append the same miss leave equal rows, which the next read makes one. A null text counts as an
    empty one; an empty table gives an empty result; only the two named columns are read.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = file_digest(path)
    scratch = Scratch(spark, "token-counts")
    cache_dir = cache_dir or f"{scratch.root}/cache"

    def cached() -> DataFrame:
        empty = spark.createDataFrame([], CACHE_SCHEMA)
        empty.write.mode("append").partitionBy("tokenizer").parquet(cache_dir)  # so that the folder can be read when it is new
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).where(F.col("tokenizer") == tokenizer).select("digest", "n_tokens").dropDuplicates(["digest"])

    text = normalised(text_col)
    keyed = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("__content"))
    # one text for each digest: duplicates go within tasks first, so no copy group is gathered
    missing = keyed.join(cached(), "digest", "left_anti").dropDuplicates(["digest"])
    counted = map_texts(missing, counter(path), pa.schema([("n_tokens", pa.int64())]), "digest", "__content")
    counted.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache_dir)

    # texts with very many copies take their count from a table of at most HOT rows, so no task gets all
    # copies of one; the bound holds as each of them has more than one row in HOT
    rows = docs.select(F.col(id_col), F.unhex(F.sha2(text, 256)).alias("__digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = scratch.save(rows, "rows")
    least = max(LEAST_HOT, rows.count() // HOT + 1)
    hot = rows.groupBy("__digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("__digest")
    hot = scratch.save(hot, "hot")
    counts = cached().withColumnRenamed("digest", "__digest")
    often = rows.join(F.broadcast(counts.join(F.broadcast(hot), "__digest", "left_semi")), "__digest")
    seldom = rows.join(F.broadcast(hot), "__digest", "left_anti").join(counts, "__digest")
    return often.unionByName(seldom).select(F.col(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
