"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

The top of the tree is fitted on a bounded sample, and every row is put in a leaf. A leaf of more than
LEAF_ROWS rows is then split by a k-means of its own, fitted where its rows are on a bounded sample of
them; rounds of this deepen the tree with the table, so leaves do not grow. The tree is an array of
centroids, one for some thousands of rows, whose size is checked against MAX_TREE: beyond it leaves stay
as they are, and are dealt out in blocks.

A query takes nodes from a priority queue, nearest centroid first, so leaves come in the order in which
they are worth a visit. How many it visits is calibrated: true neighbours of some queries are found by
brute force over all rows in blocks, and visits widen until the wanted share of them lies in the leaves
visited. Rows and queries then meet by leaf.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadspark.llm.common import releasing
from quadspark.llm.labelled import unit_hash
from quadspark.scratch import Scratch

BLOCK = 16_384  # rows of a leaf that one group of queries meets at once
LEAF_ROWS = 16_384  # a leaf of more is split
SPLIT_ROWS = 2_048  # what a split is fitted on, about
BRANCH = 8
MAX_TREE = 256 << 20  # bytes of centroids that all tasks get


class Tree:
    """Nodes as centroids with child lists; leaves are numbered."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf_rows: int = 128, seed: int = 11):
        self.centroids: list[np.ndarray] = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])]
        self.children: list[np.ndarray | None] = [None]
        self.leaf: list[int] = [-1]
        self.n_leaves = 0
        rng = np.random.default_rng(seed)
        work = [(0, sample)]
        while work:
            node, own = work.pop()
            label = split(own, branch, rng) if len(own) > leaf_rows else None
            if label is None:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            at = []
            for c in np.unique(label):
                part = own[label == c]
                at.append(len(self.centroids))
                self.centroids.append(part.mean(0))
                self.children.append(None)
                self.leaf.append(-1)
                work.append((at[-1], part))
            self.children[node] = np.array(at)
        self.points = np.stack(self.centroids)

    @property
    def nbytes(self) -> int:
        return self.points.nbytes

    def deepened(self, centroids: dict[int, np.ndarray]) -> Tree:
        """The tree with some leaves split into children around the given centroids, a row each."""
        out = Tree.__new__(Tree)
        out.centroids, out.children, out.leaf = list(self.centroids), list(self.children), list(self.leaf)
        for node, leaf in enumerate(self.leaf):
            if leaf in centroids and self.children[node] is None:
                kids = range(len(out.centroids), len(out.centroids) + len(centroids[leaf]))
                out.centroids += list(centroids[leaf])
                out.children += [None] * len(kids)
                out.leaf += [-1] * len(kids)
                out.children[node], out.leaf[node] = np.array(kids), -1
        # leaves that stay keep their numbers, new ones follow
        out.n_leaves = self.n_leaves
        for node, kids in enumerate(out.children):
            if kids is None and out.leaf[node] < 0:
                out.leaf[node] = out.n_leaves
                out.n_leaves += 1
        out.points = np.stack(out.centroids)
        return out

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child from the root down."""
        out = np.zeros(len(rows), np.int32)
        work = [(0, np.arange(len(rows)))]
        while work:
            node, own = work.pop()
            if not len(own):
                continue
            kids = self.children[node]
            if kids is None:
                out[own] = self.leaf[node]
                continue
            p = self.points[kids]
            best = ((p * p).sum(1) - 2 * rows[own] @ p.T).argmin(1)
            work += [(int(kid), own[best == c]) for c, kid in enumerate(kids)]
        return out

    def visits(self, query: np.ndarray, n: int) -> list[int]:
        """The first ``n`` leaves in best-bin-first order."""
        out: list[int] = []
        heap = [(0.0, 0)]
        while heap and len(out) < n:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if kids is None:
                out.append(self.leaf[node])
                continue
            d = ((self.points[kids] - query) ** 2).sum(1)
            for distance, kid in zip(d.tolist(), kids.tolist(), strict=True):
                heapq.heappush(heap, (distance, kid))
        return out


def split(rows: np.ndarray, branch: int, rng) -> np.ndarray | None:
    """Labels of a k-means with distinct starts; None if all rows are one point."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) < 2:
        return None
    centres = distinct[rng.choice(len(distinct), min(branch, len(distinct)), replace=False)]
    label = np.full(len(rows), -1, np.int64)
    for _ in range(12):
        d = (centres * centres).sum(1) - 2 * rows @ centres.T
        new = d.argmin(1)
        if (new == label).all():
            break
        label = new
        centres = np.stack([rows[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))])
    return label if len(np.unique(label)) > 1 else None


def nearest(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """``(query number, row id, distance)`` of the k nearest rows of each query, by (distance, id).

    A product finds what may be among them; distances are then exact differences in double precision.
    """
    if not len(rows):
        return
    norms = (rows * rows).sum(1)
    for a in range(0, len(queries), 64):
        q = queries[a : a + 64]
        d = norms - 2 * q @ rows.T + (q * q).sum(1)[:, None]
        slack = 1e-9 * (norms.max() + (q * q).sum(1))
        for x in range(len(q)):
            take = k + 1  # one may be the query itself
            limit = np.partition(d[x], take - 1)[take - 1] if len(rows) > take else np.inf
            near = np.flatnonzero(d[x] <= limit + slack[x])
            near = near[row_ids[near] != ids[a + x]]
            exact = np.sqrt(((rows[near] - q[x]) ** 2).sum(1))
            for o in np.lexsort((row_ids[near], exact))[:k]:
                yield a + x, int(row_ids[near[o]]), float(exact[o])


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """``(id, v array<double>)`` of rows that take part, and their number of components.

    Rows with a null id or vector, no component, a null or non-finite one or only zeros take no part,
    nor do those whose length is not the commonest one (the longer of two as common).
    """
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists(v, lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = most[0] if most else 0
    return rows.where(F.size("v") == dim), dim


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    recall: float = 0.97,
    sample_rows: int = 16_384,
    calibration: int = 128,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows found nearest to each query, by Euclidean distance.

    ``queries`` has the same columns; a query's own id is no candidate. Ties go to smaller ids. With
    k rows or fewer a query gets all of them. ``sample_rows`` bounds what the top of the tree is fitted
    on, ``calibration`` the queries whose true neighbours set the number of leaves visited for the wanted
    mean ``recall``. Rows with one id and vector count once; of an id with several vectors each is a
    candidate, and the least by value is its query. Without usable rows there is no result;
    other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows, dim = usable(vectors, id_col, vec_col)
    # rows with one id and vector are one; of equal vectors no query needs more than the k + 1 of least id.
    # Both go within tasks first, so that a hot row or vector is not gathered
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = scratch.save(rows.distinct().withColumn("r", rank).where(F.col("r") <= k + 1).select("id", "v"), "rows")
    asked = usable(queries, id_col, vec_col)[0].where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    index, tree, sizes = build(rows, max(dim, 1), sample_rows, scratch)
    n_visits = calibrate(index, asked, tree, dim, k, recall, calibration)

    def visit(batches):
        for batch in batches:
            ids, v = np.array(batch.column("id")), _matrix(batch.column("v"), dim)
            for a in range(0, len(ids), 64):
                leaves = [tree.value.visits(q, n_visits) for q in v[a : a + 64]]
                met = np.array([(x, leaf, block) for x, own in enumerate(leaves, a) for leaf in own for block in range(-(-sizes.get(leaf, 1) // BLOCK))], np.int64).reshape(-1, 3)
                for b in range(0, len(met), 8192):
                    x, leaf, block = met[b : b + 8192].T
                    arrays = [pa.array(ids[x]), _lists(v[x]), pa.array(leaf, pa.int32()), pa.array(block, pa.int32()), pa.array(np.ones(len(x), np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "v", "leaf", "block", "side"])

    def dealt(batches):
        for batch in batches:
            leaf, ids = np.array(batch.column("leaf")), np.array(batch.column("id"))
            parts = np.array([-(-sizes.get(n, 1) // BLOCK) for n in leaf.tolist()], np.uint64)
            block = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)) % parts
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("leaf"), pa.array(block.astype(np.int32)), pa.array(np.zeros(len(ids), np.int32))], names=["id", "v", "leaf", "block", "side"])

    shape = "id bigint, v array<double>, leaf int, block int, side int"
    met = index.mapInArrow(releasing(dealt), shape).unionByName(asked.mapInArrow(releasing(visit), shape))
    met = met.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "side")

    def emit(best: dict[int, list[tuple[float, int]]]) -> pa.RecordBatch:
        rows = [(q, v, s) for q, found in best.items() for s, v in found]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    def compare(batches):
        """The k best of each query over all leaves of the task, so that few rows are shuffled."""
        key, ids, vs = None, [], []
        base: tuple | None = None
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            tags = np.stack([np.array(batch.column(c)) for c in ("leaf", "block", "side")], axis=1)
            v, own = _matrix(batch.column("v"), dim), np.array(batch.column("id"))
            cuts = np.flatnonzero((tags[1:] != tags[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(tags)], strict=True):
                if a == b:
                    continue
                at = tuple(tags[a][:2])
                if at != key:
                    key, ids, vs, base = at, [], [], None
                if tags[a][2] == 0:
                    ids.append(own[a:b])
                    vs.append(v[a:b])
                elif ids:
                    if base is None:
                        base = np.concatenate(vs), np.concatenate(ids)
                    fresh: dict[int, list[tuple[float, int]]] = {}
                    for q, vec_id, score in nearest(v[a:b], own[a:b], *base, k):
                        fresh.setdefault(int(own[a + q]), []).append((score, vec_id))
                    for q, found in fresh.items():
                        best[q] = heapq.nsmallest(k, {*best.get(q, ()), *found})
                    if len(best) > 50_000:
                        yield emit(best)
                        best = {}
        yield emit(best)

    found = met.mapInArrow(releasing(compare), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), rows.ravel())


def build(rows: DataFrame, dim: int, sample_rows: int, scratch: Scratch):
    """``(id, v, leaf)`` of rows ``(id, v)``, the broadcast tree, and rows by leaf (bounded by its leaves).

    Samples are bounded: ``sample_rows`` for the top, SPLIT_ROWS for each leaf that is split, where its
    rows are. A leaf that one point fills, or that its sample does not split, stays as it is.
    """
    spark, n = rows.sparkSession, rows.count()
    row_hash = lambda salt: unit_hash(salt, "id", "v")
    chosen = rows.where(row_hash("tree") < min(1.0, sample_rows / max(n, 1))).toArrow()
    sample = _matrix(chosen.column("v").combine_chunks(), dim) if chosen.num_rows else np.zeros((0, dim))
    sample = sample[np.lexsort((*sample.T[:4], np.array(chosen.column("id"), np.int64)))] if len(sample) else sample
    tree, whole, turn = spark.sparkContext.broadcast(Tree(sample)), set(), 0
    while True:
        index = scratch.save(rows.mapInArrow(releasing(_placing(tree, dim)), "id bigint, v array<double>, leaf int"), f"index-{turn}")
        sizes = {r[0]: r[1] for r in index.groupBy("leaf").count().collect()}
        large = {leaf: size for leaf, size in sizes.items() if size > LEAF_ROWS and leaf not in whole}
        if not large or tree.value.nbytes + len(large) * BRANCH * dim * 8 > MAX_TREE:
            return index, tree, sizes
        share = spark.createDataFrame([(leaf, min(1.0, SPLIT_ROWS / size)) for leaf, size in large.items()], "leaf int, share double")
        some = index.join(F.broadcast(share), "leaf").where(row_hash(f"split-{turn}") < F.col("share"))

        def fit(pdf):
            own = pdf.sort_values("id")
            matrix = np.stack(own.v.to_numpy())
            label = split(matrix, BRANCH, np.random.default_rng(int(own.leaf.iloc[0])))
            parts = [] if label is None else [matrix[label == c].mean(0) for c in np.unique(label)]
            return pd.DataFrame({"leaf": [own.leaf.iloc[0]] * len(parts), "centre": [p.tolist() for p in parts]})

        found: dict[int, list] = {}
        for r in some.select("id", "v", "leaf").groupBy("leaf").applyInPandas(fit, "leaf int, centre array<double>").toLocalIterator():
            found.setdefault(r[0], []).append(r[1])
        whole |= large.keys() - found.keys()
        if found:
            tree = spark.sparkContext.broadcast(tree.value.deepened({leaf: np.array(sorted(c)) for leaf, c in found.items()}))
            scratch.drop(f"index-{turn}")
        turn += 1


def _placing(tree, dim: int):
    def place(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.assign(_matrix(batch.column("v"), dim))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(leaf, pa.int32())], names=["id", "v", "leaf"])

    return place


def brute_force(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, dim: int, k: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(query, vec_id, score, *extra)``: the k nearest of all rows to a bounded set of queries, in blocks."""
    held = rows.sparkSession.sparkContext.broadcast((queries, ids))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row_ids = np.array(batch.column("id"))
            found = list(nearest(*held.value, _matrix(batch.column("v"), dim), row_ids, k))
            at = {x: n for n, x in enumerate(row_ids.tolist())}
            take = pa.array([at[f[1]] for f in found], pa.int64())
            columns = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c).take(take) for c in extra], names=["query", "vec_id", "score", *extra])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(releasing(run), ", ".join(["query int, vec_id bigint, score double", *[f"{c} {kinds[c]}" for c in extra]]))
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    return out.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def calibrate(index: DataFrame, asked: DataFrame, tree, dim: int, k: int, recall: float, calibration: int) -> int:
    """The number of leaves to visit so that the chosen queries find the wanted share of true neighbours."""
    every = tree.value.n_leaves
    total = asked.count()
    some = asked.where(unit_hash("calibration", "id") < min(1.0, calibration / max(total, 1))).toArrow()
    if not some.num_rows:
        return every
    queries, ids = _matrix(some.column("v").combine_chunks(), dim), np.array(some.column("id"), np.int64)
    truth = brute_force(index, queries, ids, dim, k, ("leaf",)).select("query", "leaf").toPandas()
    place = [{leaf: n for n, leaf in enumerate(tree.value.visits(q, every))} for q in queries]
    at = np.array([place[q][leaf] for q, leaf in zip(truth["query"], truth["leaf"], strict=True)])
    visits = 1
    while visits < every and (at < visits).mean() < recall:
        visits = min(every, max(visits + 1, visits * 5 // 4))
    return visits
