"""Cosine search over named vector spaces, exact and by an index.

``vectors (space, node, vec)``. The distance is 1 - cosine, within 0 and 2; a zero vector or one of
another length is at distance 1. Filters come before the ranking, so k results are found if there are k.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """1 - distance: the cosine, 0 where it is undefined."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    ok = (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / norms))).otherwise(F.lit(0.0))


def _literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def top_k(vectors: DataFrame, query: list[float], k: int, space: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """``(node, score)`` of the k nearest, nearest first, ties to smaller nodes; ``allowed (node)`` limits them."""
    rows = vectors if space is None else vectors.where(F.col("space") == space)
    rows = rows if allowed is None else rows.join(allowed.select("node").distinct(), "node", "left_semi")
    return rows.select("node", cosine(F.col("vec"), _literal(query)).alias("score")).orderBy(F.desc("score"), "node").limit(k)


def quantize(vec: Column) -> tuple[Column, Column]:
    """int8 codes and their scale: the largest component is 127."""
    most = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))
    scale = most / 127
    return F.transform(vec, lambda x: F.when(scale > 0, F.round(x.cast("double") / scale)).otherwise(0).cast("tinyint")), scale


def top_k_int8(vectors: DataFrame, query: list[float], k: int, space: str | None = None, width: int | None = None) -> DataFrame:
    """Two phases: rank by codes, then the best ``width`` (4k) again on the vectors themselves."""
    rows = vectors if space is None else vectors.where(F.col("space") == space)
    codes, _ = quantize(F.col("vec"))
    near = rows.withColumn("__c", codes).withColumn("__s", cosine(F.col("__c"), _literal(query))).orderBy(F.desc("__s"), "node").limit(max(width or 4 * k, k))
    return top_k(near.drop("__c", "__s"), query, k)


#: Bytes of queries that one scan takes along.
QUERY_BYTES = 64 << 20


def _unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column with norm 1; a null, zero or one of another length is all zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    good = lengths == dim
    out = np.zeros((len(column), dim))
    if good.any():
        out[good] = np.asarray(column.filter(pa.array(good)).flatten(), np.float64).reshape(-1, dim)
    out[~np.isfinite(out).all(1)] = 0
    norms = np.linalg.norm(out, axis=1)
    return out / np.where(norms > 0, norms, 1)[:, None]


#: Scores that a task of a batch search holds at once.
SCORES = 1 << 22


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, max_bytes: int = QUERY_BYTES) -> DataFrame:
    """``(query, rank, node, score)`` for each row of ``queries (query, vec)``.

    Queries go to all rows in blocks of at most ``max_bytes``, a scan a block, as one matrix product per
    Arrow batch; each task keeps its k best, and a window merges them.
    """
    spark = vectors.sparkSession
    kinds = dict(queries.dtypes), dict(vectors.dtypes)
    source = queries.select("query", F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    shape = source.agg(F.max(F.size("vec")), F.count(F.lit(1))).first()
    if not shape[1]:
        return spark.createDataFrame([], f"query {kinds[0]['query']}, rank int, node {kinds[1]['node']}, score double")
    blocks = max(1, -(-shape[0] * 8 * shape[1] // max_bytes))

    def search(block: int) -> DataFrame:
        own = source if blocks == 1 else source.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        got = own.toArrow()
        held = spark.sparkContext.broadcast((got.column("query").combine_chunks(), _unit_rows(got.column("vec"), shape[0])))

        def run(batches):
            names, unit = held.value
            best: tuple | None = None
            worst = np.full(len(unit), -np.inf)  # what a query's k-th best has at least
            for batch in batches:
                # a matrix of bounded size at a time, whatever the number of queries and the length of a batch
                step = max(k, min(len(batch), SCORES // max(1, min(len(unit), SCORES // 1024))))
                for at in range(0, len(batch), step):
                    nodes, rows = batch.column("node").slice(at, step), _unit_rows(batch.column("vec").slice(at, step), unit.shape[1]).T
                    keep, wide = min(k, len(nodes)), max(1, SCORES // len(nodes))
                    for low in range(0, len(unit), wide):
                        scores = np.clip(unit[low : low + wide] @ rows, -1, 1)
                        # ties at the last place all go on: which of them counts is decided by node
                        limit = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
                        limit = np.maximum(limit, worst[low : low + wide])
                        q, n = np.nonzero(scores >= limit[:, None])
                        fresh = q + low, nodes.take(pa.array(n)), scores[q, n]
                        best = fresh if best is None else tuple(pa.concat_arrays([x, y]) if isinstance(x, pa.Array) else np.concatenate([x, y]) for x, y in zip(best, fresh, strict=True))
                        if len(best[0]) > 4 * k * len(unit) + 10_000:
                            best = _trimmed(best, k)
                            full = np.bincount(best[0], minlength=len(unit)) >= k
                            least = np.full(len(unit), np.inf)
                            np.minimum.at(least, best[0], best[2])
                            worst[full] = least[full]
            if best is not None:
                q, node, score = _trimmed(best, k)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), node, pa.array(score)], names=["query", "node", "score"])

        return vectors.select("node", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, f"query {kinds[0]['query']}, node {kinds[1]['node']}, score double")

    out = reduce(DataFrame.unionByName, [search(block) for block in range(blocks)])
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "node", "score")


def _trimmed(best: tuple, k: int) -> tuple:
    """The k best of each query, ties to smaller nodes; where few tie with the last, those too."""
    q, node, score = best
    order = np.lexsort((-score, q))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(q[order]) != 0]))
    sizes = np.diff(np.append(starts, len(q)))
    last = score[order[starts + np.minimum(sizes, k) - 1]]
    keep = order[score[order] >= np.repeat(last, sizes)]
    if len(keep) > 2 * k * len(sizes):
        name = pc.rank(node.take(pa.array(keep)), sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False)
        keep = keep[np.lexsort((name, -score[keep], q[keep]))]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(q[keep]) != 0]))
        keep = keep[np.arange(len(keep)) - np.repeat(starts, np.diff(np.append(starts, len(keep)))) < k]
    return q[keep], node.take(pa.array(keep)), score[keep]


# --- an index of cells ---------------------------------------------------------------------------

#: What the cells of an index are fitted on, at most, and how many they are, at most.
FIT_ROWS, MAX_CELLS = 16_384, 4_096
#: Vectors of the fit that set how many cells a search visits for the wanted recall.
CALIBRATION, RECALL = 64, 0.95
#: Candidates of a search that names no breadth.
DEFAULT_EF = 400
INDEX_DDL = "node string, vec array<float>, code binary, scale float, cell int"


def cells_of(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Centres of about n cells by k-means over unit vectors."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.choice(len(distinct), min(n, len(distinct)), replace=False)]
    for _ in range(10):
        label = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centres)
    return centres


def build_cells(vectors: DataFrame, scratch_save: Callable[[DataFrame, str], DataFrame], k: int = 10) -> tuple[DataFrame, np.ndarray, int] | None:
    """``(node, vec, code, scale, cell)`` sorted by cell, the centres, and the cells that a search visits so
    that it finds RECALL of the true neighbours; None without vectors.

    ``vectors (node, vec)``; zero vectors are in cell 0. Codes are int8 with one scale a vector.
    """
    n = vectors.count()
    if not n:
        return None
    dim = vectors.agg(F.max(F.size("vec"))).first()[0]
    chosen = vectors.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1.0, FIT_ROWS / n) * (1 << 30))).toArrow()
    sample = _unit_rows(chosen.column("vec"), dim) if chosen.num_rows else np.ones((1, dim)) / np.sqrt(dim)
    centres = cells_of(sample, int(min(MAX_CELLS, max(1, 2 * np.sqrt(n)), max(1, len(sample) // 4))))
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        for batch in batches:
            unit = _unit_rows(batch.column("vec"), dim)
            most = np.abs(unit).max(1, initial=0)
            scale = np.where(most > 0, most / 127, 1)
            codes = np.round(unit / scale[:, None]).astype(np.int8)
            cell = (unit @ held.value.T).argmax(1) if len(unit) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("vec"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float32)), pa.array(cell.astype(np.int32))],
                names=["node", "vec", "code", "scale", "cell"],
            )

    placed = vectors.select("node", F.col("vec").cast("array<float>").alias("vec")).mapInArrow(place, INDEX_DDL)
    index = scratch_save(placed.repartitionByRange("cell").sortWithinPartitions("cell", "node"), "index")
    # true neighbours of some vectors, and the places of their cells in each one's order of visits
    some = chosen.slice(0, min(CALIBRATION, chosen.num_rows))
    if not some.num_rows:
        return index, centres, len(centres)
    queries = vectors.sparkSession.createDataFrame(some.select(["node", "vec"])).select(F.col("node").alias("query"), "vec")
    truth = batch_top_k(index, queries, k + 1).where("query <> node").join(index.select("node", "cell"), "node").select("query", "cell").collect()
    unit = dict(zip(some.column("node").to_pylist(), _unit_rows(some.column("vec"), dim), strict=True))
    order = {q: np.argsort(np.argsort(-(centres @ x), kind="stable")) for q, x in unit.items()}
    at = np.sort(np.array([order[r[0]][r[1]] for r in truth]))
    visits = int(at[min(len(at) - 1, int(np.ceil(RECALL * len(at))))]) + 1 if len(at) else len(centres)
    return index, centres, visits


def search_cells(index: DataFrame, centres: np.ndarray, visits: int, query: list[float], k: int, ef: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """``(node, score)``: the k nearest found in the nearest cells, ties to smaller nodes.

    Rows are ranked by codes, of which the ``ef`` best (at least 2k) are ranked again on the vectors. A
    breadth other than DEFAULT_EF visits more or fewer cells in proportion. ``allowed (node)`` is applied
    before the ranking; while fewer than k rows are left, more cells are visited, in the end all.
    """
    q = np.asarray(query, np.float64)
    norm = np.linalg.norm(q)
    unit = q / norm if norm > 0 and len(q) == centres.shape[1] else np.zeros(centres.shape[1])
    ef = max(ef or DEFAULT_EF, 2 * k)
    order = np.argsort(-(centres @ unit), kind="stable")
    take = int(min(len(order), max(1, np.ceil(visits * ef / max(DEFAULT_EF, 2 * k)))))
    spark = index.sparkSession
    limits = None if allowed is None else allowed.select("node").distinct()

    def rows(n: int) -> DataFrame:
        own = index if n == len(order) else index.where(F.col("cell").isin(*order[:n].tolist()))
        return own if limits is None else own.join(limits, "node", "left_semi")

    while take < len(order) and rows(take).limit(k).count() < k:
        take = min(len(order), take * 4)
    held = spark.sparkContext.broadcast(unit.astype(np.float32))

    def rank(batches):
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, -1).astype(np.float32)
            score = (codes @ held.value) * np.asarray(batch.column("scale"))
            best = (batch.column("node"), score) if best is None else (pa.concat_arrays([best[0], batch.column("node")]), np.concatenate([best[1], score]))
            if len(best[1]) > ef:
                limit = -np.partition(-best[1], ef - 1)[ef - 1]
                keep = np.flatnonzero(best[1] >= limit)
                best = best[0].take(pa.array(keep)), best[1][keep]
        if best is not None:
            yield pa.RecordBatch.from_arrays([best[0], pa.array(best[1].astype(np.float64))], names=["node", "near"])

    near = rows(take).select("node", "code", "scale").mapInArrow(rank, "node string, near double").orderBy(F.desc("near"), "node").limit(ef)
    found = rows(take).select("node", "vec").join(F.broadcast(near.select("node")), "node", "left_semi")  # ef rows
    return top_k(found, query, k)


def visible(vectors: DataFrame, quads: DataFrame) -> DataFrame:
    """Vectors of nodes that are the subject of a live quad of the snapshot."""
    return vectors.join(quads.select(F.col("s").alias("node")).distinct(), "node", "left_semi")


def check_dims(vectors: DataFrame, spaces: dict[str, int]) -> DataFrame:
    """``(space, node, dims, expected)`` of vectors whose length is not that of their declared space."""
    want = F.create_map(*[F.lit(x) for kv in spaces.items() for x in kv]) if spaces else F.lit(None).cast("map<string,int>")
    return vectors.select("space", "node", F.size("vec").alias("dims"), want[F.col("space")].alias("expected")).where(F.col("expected").isNotNull() & (F.col("dims") != F.col("expected")))
