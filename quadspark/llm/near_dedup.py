"""MinHash near-dedup with sequential Bayesian verification.

1. Each text's set of word shingles gets a MinHash signature. Texts with one and the same set are one
   class from here on, so exact copies cost nothing more.
2. Signatures are cut into bands, as many as keep the chance that a pair at the threshold shares no
   band under the miss probability. In each bucket, pairs are compared batch by batch of their
   signatures, and a pair goes as soon as the posterior chance (uniform prior) that its similarity
   reaches the threshold is under the miss probability. What is left joins candidate groups. A bucket
   of more than BLOCK classes is joined to its least member instead, pair by pair comparison being left
   to the next step.
3. Each candidate group comes together with its full sets. Pairs that survive the posterior are
   verified on the full sets, the likeliest first; a pair whose ends are linked already needs no more.
   Groups of more than BLOCK classes are dealt out in blocks that each get a few hub members. What is
   then not linked to the largest part is compared with the rest in pairs of blocks: either of the
   whole group, or bucket by bucket, as links share a bucket, whichever moves fewer rows. So a large
   cluster with few members apart costs one pass over it, and a group that chance hits hold together
   costs what its buckets hold, not its square.
4. Components of the verified links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadspark.llm.common import WordHasher, map_texts, releasing, shingles
from quadspark.llm.graphs import TASK_EDGES, components
from quadspark.scratch import Scratch

ROWS = 4  # hashes a band
BATCH = 16  # hashes compared before the posterior is looked at again
BLOCK = 512  # classes compared pair by pair in one task
HUBS = 4


def n_bands(percent: int, miss: float) -> int:
    """Bands that leave a pair at the threshold without a shared one with probability under ``miss``."""
    return max(4, math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** ROWS)))


class Posterior:
    """The least agreements after each batch of hashes at which a pair may still reach the threshold."""

    def __init__(self, k: int, percent: int, miss: float):
        t = percent / 100
        self.ends = [*range(BATCH, k, BATCH), k]
        self.least = []
        for n in self.ends:
            # P(similarity >= t | m of n agree) under a uniform prior is P(Binomial(n + 1, t) <= m)
            below, m = 0.0, 0
            for m in range(n + 1):
                below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if below >= miss:
                    break
            self.least.append(m)

    def alive(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of signatures (rows of both) survive all batches, and their agreements."""
        at = np.arange(len(left))
        agree = np.zeros(len(left), np.int32)
        start = 0
        for end, least in zip(self.ends, self.least, strict=True):
            agree += (left[at, start:end] == right[at, start:end]).sum(1, dtype=np.int32)
            keep = agree >= least
            at, agree, start = at[keep], agree[keep], end
        return at, agree


class MinHash:
    """Signatures of sets of 64-bit hashes."""

    def __init__(self, k: int):
        rng = np.random.default_rng(20240229)
        self.factors = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One row a set; the row of an empty set is of no use."""
        out = np.zeros((len(bounds) - 1, len(self.factors)), np.uint32)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            starts = bounds[:-1][full]
            for j, factor in enumerate(self.factors):
                out[full, j] = np.minimum.reduceat(((h * factor) >> np.uint64(32)).astype(np.uint32), starts)
        return out


def _signed(docs: DataFrame, width: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_shingles, digest, sig)``; digest and signature are null for an empty set."""
    schema = pa.schema([("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    def make():
        import xxhash

        hasher, minhash = WordHasher(), MinHash(k)

        def work(texts):
            h, bounds = shingles(*hasher(texts), width)
            sigs = minhash(h, bounds)
            n = np.diff(bounds)
            return {
                "n_shingles": n,
                "digest": [xxhash.xxh3_128_digest(h[bounds[i] : bounds[i + 1]].tobytes()) if n[i] else None for i in range(len(n))],
                "sig": [sigs[i].tobytes() if n[i] else None for i in range(len(n))],
            }

        return work

    return map_texts(docs, make, schema, id_col, text_col)


def map_groups(df: DataFrame, keys: list[str], work: Callable[[list[dict]], Iterator[tuple[int, int]]]) -> DataFrame:
    """Edges ``(a, b)`` from a function over the rows of each group; groups must be bounded."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held: list[dict] = []
        key = None
        out: list[tuple[int, int]] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in batch.slice(k, 256).to_pylist():
                    of = tuple(row[c] for c in keys)
                    if of != key:
                        out.extend(work(held) if held else [])
                        held, key = [], of
                    held.append(row)
                if len(out) > 50_000:
                    yield _edges(out)
                    out = []
        out.extend(work(held) if held else [])
        yield _edges(out)

    return rows.mapInArrow(releasing(run), "a bigint, b bigint")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def bucket_edges(members: DataFrame, posterior: Posterior) -> DataFrame:
    """A forest over the surviving pairs of each bucket, from rows ``(bucket, rep, sig)``.

    All buckets of a batch are compared together: rows are sorted by bucket, and each row meets the
    row ``d`` places on for d = 1, 2, ... as long as any bucket is that large.
    """
    rows = members.repartition("bucket").sortWithinPartitions("bucket", "rep")

    def forest(bucket, rep, sig):
        label = np.arange(len(rep))
        out = []
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        first = np.repeat(starts, np.diff(np.append(starts, len(rep))))
        last = np.repeat(np.append(starts[1:], len(rep)), np.diff(np.append(starts, len(rep))))
        for d in range(1, int((last - first).max(initial=0))):
            i = np.flatnonzero(np.arange(len(rep)) + d < last)
            i = i[label[i] != label[i + d]]
            for p in range(0, len(i), 8192):
                part = i[p : p + 8192]
                hit, _ = posterior.alive(sig[part], sig[part + d])
                for x in part[hit]:
                    if label[x] != label[x + d]:
                        own = slice(first[x], last[x])
                        low, high = sorted((label[x], label[x + d]))
                        label[own][label[own] == high] = low
                        out.append((int(rep[x]), int(rep[x + d])))
        return out

    def run(batches):
        held = None
        for batch in batches:
            bucket = np.array(batch.column("bucket"))
            rep = np.array(batch.column("rep"))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(rep), -1)
            if held is not None:
                bucket, rep, sig = (np.concatenate(pair) for pair in zip(held, (bucket, rep, sig), strict=True))
            cut = int(np.searchsorted(-(bucket == bucket[-1]).astype(np.int8)[::-1], 0)) if len(bucket) else 0
            done = len(bucket) - cut  # the last bucket may go on in the next batch
            if done:
                yield _edges(forest(bucket[:done], rep[:done], sig[:done]))
            held = bucket[done:], rep[done:], sig[done:]
        if held is not None:
            yield _edges(forest(*held))

    return rows.mapInArrow(releasing(run), "a bigint, b bigint")


def verified(percent: int, posterior: Posterior, across: bool = False) -> Callable[[list[dict]], Iterator[tuple[int, int]]]:
    """A function from a block's rows to a forest of links that hold on the full sets.

    With ``across``, only pairs of a row of side 0 with one of another class count.
    """

    def work(rows: list[dict]) -> Iterator[tuple[int, int]]:
        if len(rows) < 2:
            return
        sigs = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(len(rows), -1)
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        reps = [r["rep"] for r in rows]
        label = np.array([r["part"] for r in rows]) if across else np.arange(len(rows))
        side = np.array([r["side"] for r in rows]) if across else None
        found = []
        for i in range(len(rows)):
            if across and side[i]:
                continue
            j = np.flatnonzero(label != label[i]) if across else np.arange(i + 1, len(rows))
            for p in range(0, len(j), 2048):
                to = j[p : p + 2048]
                hit, agree = posterior.alive(np.broadcast_to(sigs[i], (len(to), sigs.shape[1])), sigs[to])
                found += zip(agree.tolist(), [i] * len(hit), to[hit].tolist(), strict=True)
        found.sort(key=lambda f: (-f[0], f[1], f[2]))
        for _, i, j in found:
            if label[i] == label[j]:
                continue
            small, large = sorted((len(sets[i]), len(sets[j])))
            if 100 * small < percent * large:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (small + large - both):
                label[label == label[j]] = label[i]
                yield reps[i], reps[j]

    return work


def _tasks(df: DataFrame) -> int:
    """Tasks for a table of ids, by its measured length."""
    return 2 + df.count() // TASK_EDGES


def _counted(df: DataFrame, by: str, name: str) -> DataFrame:
    return df.join(df.groupBy(by).agg(F.count(F.lit(1)).alias(name)), by)


def _units(units: DataFrame) -> DataFrame:
    """Of each ``(cand, unit)`` with several parts: the largest, the rows in all and outside of it, the
    blocks that these make, and the rows that comparing them moves."""
    counts = units.groupBy("cand", "unit", "part").agg(F.count(F.lit(1)).alias("c"))
    most = counts.groupBy("cand", "unit").agg(F.max(F.struct("c", F.col("part").alias("main"))).alias("m"), F.sum("c").alias("all"))
    most = most.select("cand", "unit", "m.main", (F.col("all") - F.col("m.c")).alias("outside"), "all").where("outside > 0")
    most = most.withColumn("n0", F.ceil(F.col("outside") / BLOCK)).withColumn("n1", F.ceil(F.col("all") / BLOCK))
    return most.withColumn("moves", F.col("outside") * F.col("n1") + F.col("all") * F.col("n0"))


def _links(groups: DataFrame, members: DataFrame, percent: int, posterior: Posterior, scratch: Scratch) -> DataFrame:
    """Links within candidate groups, from rows ``(cand, size, rep, shingles, sig)`` and ``(bucket, rep)``."""
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK))
    blocks = groups.select("cand", block.alias("block"), "rep", "shingles", "sig")
    large = groups.where(F.col("size") > BLOCK)
    sizes = large.select("cand", F.ceil(F.col("size") / BLOCK).alias("n")).distinct()
    if sizes.isEmpty():
        return scratch.save(map_groups(blocks, ["cand", "block"], verified(percent, posterior)), "links")
    rank = F.row_number().over(Window.partitionBy("cand").orderBy(F.xxhash64(F.lit("hub"), "rep"), "rep"))
    hubs = large.select("cand", "rep", rank.alias("r")).where(F.col("r") <= HUBS).join(sizes, "cand")
    hubs = hubs.join(large.select("cand", "rep", "shingles", "sig"), ["cand", "rep"])
    hubs = hubs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    own = F.pmod(F.xxhash64("rep"), F.col("n"))
    hubs = hubs.where(own != F.col("block")).select(*blocks.columns)
    links = scratch.save(map_groups(blocks.unionByName(hubs), ["cand", "block"], verified(percent, posterior)), "links")

    # large groups: what is outside the largest part, against all that is in another part
    parts = components(links, scratch, "parts")
    own = large.join(parts, large.rep == parts.node, "left").select("cand", "rep", F.coalesce("label", "rep").alias("part"))
    tasks = _tasks(large.select("cand"))
    own = scratch.save(own.coalesce(tasks), "own")
    kinds = {"group": own.select("cand", F.col("cand").alias("unit"), "rep", "part"), "bucket": members.select(F.col("bucket").alias("unit"), "rep").join(own, "rep").select("cand", "unit", "rep", "part")}
    found = {kind: scratch.save(_units(units).coalesce(tasks), f"units-{kind}") for kind, units in kinds.items()}
    if found["group"].isEmpty():
        return links
    moves = [found[kind].groupBy("cand").agg(F.sum("moves").alias(kind)) for kind in kinds]
    # a group without a bucket of several parts has nothing left to compare
    by_bucket = moves[0].join(moves[1], "cand", "left").select("cand", (F.coalesce("bucket", F.lit(0)) < F.col("group")).alias("by_bucket"))
    parts = []
    for kind, units in kinds.items():
        plan = found[kind].join(by_bucket.where(F.col("by_bucket") == (kind == "bucket")), "cand").drop("by_bucket", "moves")
        parts.append(units.join(plan, ["cand", "unit"]).withColumn("kind", F.lit(kind)))
    rest = scratch.save(parts[0].unionByName(parts[1]).coalesce(tasks), "rest")
    if rest.isEmpty():
        return links
    h = F.xxhash64("rep")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rest.where("part <> main").withColumn("i", F.pmod(h, "n0")).withColumn("j", upto("n1")).withColumn("side", F.lit(0))
    # in a unit of one block each row comes once
    right = rest.where("part = main OR n1 > 1").withColumn("j", F.pmod(h, "n1")).withColumn("i", upto("n0")).withColumn("side", F.lit(1))
    keys = ["kind", "cand", "unit", "i", "j"]
    pairs = left.unionByName(right).select(*keys, "side", "part", "rep")
    pairs = pairs.join(large.select("rep", "shingles", "sig"), "rep")
    more = scratch.save(map_groups(pairs, keys, verified(percent, posterior, across=True)), "more-links")
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every row.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text's set holds its distinct
    ``width``-word shingles, or its whole sequence if it has fewer words. Sets with a Jaccard
    similarity of ``percent`` or more are linked; ``component_id`` is the least id reachable, ``kept``
    whether it is the row's own. Texts that are null or without words have an empty set and are linked
    with nothing. Rows with one id count as one document. A null id is linked with nothing: its
    ``component_id`` is null and ``kept`` true. Sets are compared as 64-bit hashes of their shingles.
    Ids are integers. An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    bands = n_bands(percent, miss)
    k = bands * ROWS
    posterior = Posterior(k, percent, miss)
    # a duplicate pair on the way must not name its input's columns
    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    signed = scratch.save(_signed(plain, width, k, "__id", "__text"), "signed")

    able = signed.where(F.col("__id").isNotNull() & F.col("digest").isNotNull())
    classes = scratch.save(able.groupBy("digest").agg(F.min("__id").alias("rep"), F.min_by("sig", "__id").alias("sig")), "classes")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + 4 * ROWS * i, 4 * ROWS)) for i in range(bands)])
    buckets = classes.select("rep", F.explode(keys).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least")).where("n > 1")
    members = scratch.save(buckets.join(shared, "bucket"), "members")
    small = members.where(F.col("n") <= BLOCK).select("bucket", "rep").join(classes.select("rep", "sig"), "rep")
    star = members.where(F.col("n") > BLOCK).select(F.col("rep").alias("a"), F.col("least").alias("b"))
    edges = scratch.save(bucket_edges(small, posterior).unionByName(star).where("a <> b").distinct(), "edges")

    cands = components(edges, scratch, "cands").select(F.col("node").alias("rep"), F.col("label").alias("cand"))
    cands = scratch.save(_counted(cands, "cand", "size").coalesce(_tasks(cands)), "sized")
    # candidates grow with the corpus, so the join is the same shuffle at every size, never a broadcast
    texts = plain.join(cands.hint("merge"), plain["__id"] == cands.rep).select("cand", "size", "rep", "__text")
    groups = scratch.save(_with_sets(texts, width, k), "groups")
    links = _links(groups, members.select("bucket", "rep"), percent, posterior, scratch)
    scratch.drop("members")
    labels = components(links, scratch, "labels")

    of_class = classes.join(labels, classes.rep == labels.node, "left").select("digest", F.coalesce("label", "rep").alias("component"))
    out = signed.select("__id", "n_shingles", F.when(F.col("__id").isNotNull(), F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    component = F.coalesce("component", "__id")
    return out.select(F.col("__id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("__id")).alias("kept"))


def _with_sets(texts: DataFrame, width: int, k: int) -> DataFrame:
    schema = pa.schema([("shingles", pa.binary()), ("sig", pa.binary())])

    def make():
        hasher, minhash = WordHasher(), MinHash(k)

        def work(batch):
            h, bounds = shingles(*hasher(batch), width)
            sigs = minhash(h, bounds)
            return {"shingles": [h[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(batch))], "sig": [s.tobytes() for s in sigs]}

        return work

    return map_texts(texts, make, schema, "rep", "__text", carry=("cand", "size"))
