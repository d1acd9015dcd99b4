"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key, of its id and text, so rows that share an id or have none are
spread too. The key range is cut into equal slices, and every (source, slice) is summed with partial
aggregation; prefix sums over runs of slices, and over the slices of a run, give each slice its offset,
and a window within one slice finishes the prefix sum. So the order within a source is one global
random order, yet no task holds a source, nor a number of slices that grows faster than the square root
of its rows. The mix reads each source in that order, again and again, until its budget is spent, and
cuts the last document at the exact word.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadspark.llm.common import WORD
from quadspark.scratch import Scratch

#: Rows of a slice of one source; a window sorts about this many at once.
SLICE_ROWS = 1_000


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds ``target`` to a table ``(skey, source_size)`` that has one row a source.

    Sources by ``skey`` get the weights in turn and share the sum of all sizes; a source above
    ``most`` times its size stops there, and the rest is shared by weight again until none is above.
    The position of a source comes from a range sort and counts a partition, not one sorted list.
    """
    ordered = scratch.save(sizes.orderBy("skey").withColumn("at", F.monotonically_increasing_id()), "sources")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    parts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = ordered.withColumn("part", part).join(parts.withColumn("before", before).drop("n"), "part")
    place = place.withColumn("turn", (F.col("before") + row) % len(weights))
    weight = reduce(lambda c, k: c.when(F.col("turn") == k, float(weights[k])), range(1, len(weights)), F.when(F.col("turn") == 0, float(weights[0])))
    place = scratch.save(place.select("skey", "source_size", weight.alias("weight")), "weights")
    level: float | None = None
    cap = F.col("source_size") * most
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        total, stopped, open_weight, n_above = place.agg(
            F.sum("source_size"), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight"))), F.sum(above.cast("long"))
        ).first()
        if not total or not open_weight:
            break
        new = (total - most * (stopped or 0)) / open_weight
        if level is not None and n_above == seen:
            break
        level, seen = new, n_above
    return place.select("skey", "source_size", F.least(cap, F.col("weight") * F.lit(level or 0.0)).cast("double").alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: float = 3.0,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row, and the columns of ``keep``.

    ``size`` counts words (a null text has none); sources are taken by code point, a null one is a
    source of its own and last. ``taken`` are the words the mix takes of the row, over all epochs;
    a source's sum is its target without the fraction. The key is a hash of seed and id, so a rerun
    takes the same; rows equal in id and text follow each other and are interchangeable. Rows without
    words take nothing. An empty table gives none. ``keep`` may not name columns of the result; other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit(""))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    rows = docs.select(
        F.col(id_col),
        *[F.col(c).alias(f"__keep_{c}") for c in keep],
        F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("a"), F.col(source_col))).alias("__skey"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        key.alias("__key"),
    )
    light = scratch.save(rows.drop(*[f"__keep_{c}" for c in keep]), "rows")
    n_slices = max(1, light.count() // SLICE_ROWS)
    at = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * n_slices)
    sums = light.groupBy("__skey", at.alias("__slice")).agg(F.sum("__size").alias("slice_size"))
    sums = scratch.save(sums, "slices")
    sources = targets(sums.groupBy(F.col("__skey").alias("skey")).agg(F.sum("slice_size").alias("source_size")), scratch, weights, most)
    # a run holds about the square root of all slices
    span = max(1, math.isqrt(n_slices))
    sums = sums.withColumn("__run", F.floor(F.col("__slice") / span))
    before = lambda size, *by: Window.partitionBy(*by).orderBy(size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = sums.groupBy("__skey", "__run").agg(F.sum("slice_size").alias("run_size"))
    runs = runs.withColumn("run_at", F.sum("run_size").over(before("__run", "__skey")) - F.col("run_size")).drop("run_size")
    offset = F.sum("slice_size").over(before("__slice", "__skey", "__run")) - F.col("slice_size")
    placed = sums.withColumn("in_run", offset).join(runs, ["__skey", "__run"]).withColumn("offset", F.col("in_run") + F.col("run_at"))
    placed = placed.join(sources, F.col("__skey") == F.col("skey")).select("__skey", "__slice", "offset", "source_size", "target")
    base = light if not keep else rows
    within = Window.partitionBy("__skey", "__slice").orderBy("__key", F.col(id_col), "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = base.withColumn("__slice", at).withColumn("__upto", F.sum("__size").over(within)).join(placed, ["__skey", "__slice"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - (F.col("offset") + F.col("__upto") - F.col("__size"))
    taken = epochs * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), rest))
    return run.select(
        F.col(id_col), F.col("__size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"__keep_{c}").alias(c) for c in keep]
    )


def mixed(docs: DataFrame, text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, the last time perhaps cut short.

    A row that is taken for part of its words has its text cut after the last of them;
    ``length_col``, if there is one of that name, then has the length of what is left. Columns may have
    any names, also those of the mix. Options are those of :func:`mix`.
    """
    # under names of its own no column of the input clashes with one of the mix
    own = {c: f"__m{k}" for k, c in enumerate(docs.columns)}
    named = {k: own[options.pop(k, default)] for k, default in (("id_col", "doc_id"), ("source_col", "source"))}
    text_at = own[text_col]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    others = tuple(n for n in own.values() if n != named["id_col"])
    took = mix(plain, text_col=text_at, keep=others, **named, **options).where("taken > 0")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size"))))
    rows = took.withColumn("__copy", copy)
    left = F.col("taken") - (F.col("__copy") - 1) * F.col("size")
    words = F.regexp_extract_all(F.col(text_at), F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0))
    text = F.when(left >= F.col("size"), F.col(text_at)).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), ""))
    length = lambda n: F.length(text).cast("long") if n == own.get(length_col) else F.col(n)
    return rows.select(*[(text if n == text_at else length(n)).alias(c) for c, n in own.items()])


#: The same in DuckDB's SQL, over a table documents.
SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE 3.0::DOUBLE * source_size / w END AS ratio FROM s
), c AS (
  SELECT *, (SELECT sum(source_size) FROM s) AS total,
         coalesce(sum(source_size) OVER q, 0) AS stopped,
         sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM r WINDOW q AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT coalesce(max(CASE WHEN is_first THEN lvl END), 0) AS lvl FROM (
    SELECT CAST(total - 3 * stopped AS DOUBLE) / open_w AS lvl,
           row_number() OVER (ORDER BY ratio, source) = min(CASE WHEN CAST(total - 3 * stopped AS DOUBLE) / open_w <= ratio THEN rn END) OVER () AS is_first
    FROM (SELECT *, row_number() OVER (ORDER BY ratio, source) AS rn FROM c))
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, w * lvl) AS target FROM s, l
), p AS (
  SELECT doc_id, size, source_size, target,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
         CAST(floor(target) AS BIGINT) AS budget
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - (upto - size))) END AS BIGINT) AS taken
FROM p
"""
