"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary labelled texts, back off to class unigrams and these to
one shared distribution: continuation counts of words over all documents. What discounts take from a
context's pairs, and all of a pair seen once, goes to the backoff, so probabilities add up to one.

A word's continuation count is the number of different words before it. It is gathered for each word
of the corpus (by its full 64-bit hash) as bitmaps of hashed predecessors at halving rates, which tasks
OR together: they do not saturate, and a word costs a row for each bitmap in use, about the logarithm
of its count. These tables grow with the corpus and stay distributed. Tasks get the counts of the words
of the labelled sample only, which bounds them: of a word that no labelled text has, both classes give
the backoff's share, and its count cancels out of their ratio.

A text's statistic is the difference of its two log-likelihoods per word; a logistic fit on the
labelled rows, each without its own counts, turns it into a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.common import WordHasher, map_texts, releasing, slices
from quadspark.llm.labelled import labelled_sample, labelled_texts
from quadspark.scratch import Scratch

#: Buckets of words, as a power of two; the tables over words of the labelled sample are bounded by it.
WORD_BITS = 20
#: Bitmaps of predecessors: level l takes one in 2^(l + 1) of them, into QUARTERS masks of 64 bits.
LEVELS, QUARTERS = 40, 4
#: Levels with more bits set than this are left out of an estimate.
FULL = 200
#: Stands before a text's first word.
_START = np.uint64(0xD6E8FEB86659FD93)
#: Rows of masks that a task holds before it puts equal ones together.
HELD = 1 << 20
#: Pairs of words have more bits, as a false hit after a rare word would weigh much. Pairs seen once
#: are left to the backoff, and so are not kept.
PAIR_BITS = 42
#: A toxic text is mostly ordinary words: each of its words comes from the toxic model with this
#: probability, else from the ordinary one. So words that are merely commoner in ordinary texts
#: count little against a few toxic ones.
SHARE = 0.01
#: Log ratio of the two models at one word, at most.
MOST = 5.0
#: How many pairs of its own in a context weigh as much as the pairs of both classes there.
OWN = 10.0
_PAIR = np.uint64(0x9FB21C651E98DF25)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _pairs(words: np.ndarray) -> np.ndarray:
    """A hash of each word with the one before it, for words from the second on."""
    h = (words[:-1] * _PAIR) ^ words[1:]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Model:
    """Tables over buckets, index 0 for ordinary and 1 for toxic texts."""

    word: np.ndarray  # (2, words) counts
    cut: np.ndarray  # discounts of words seen 0, 1, 2 and more times
    mass: np.ndarray  # (2, 1) what the discounts took from a class's words
    common: np.ndarray  # hashes of the labelled words with two predecessors or more, sorted
    shared: np.ndarray  # (common) the distribution that both classes back off to
    rare: float  # the same of a labelled word with one predecessor; of any other word it cancels out
    pairs: np.ndarray  # hashes of the pairs kept, sorted
    pair: np.ndarray  # (2, pairs) their counts
    context: np.ndarray  # (2, words) times a word comes before another
    follow: np.ndarray  # (2, the same) what the discounts took from the pairs it begins
    discount: np.ndarray  # of pairs seen 0, 1, 2 and more times
    weights: np.ndarray | None = None

    def backoff(self, words: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.full(len(words), self.rare)
        near = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
        return np.where(self.common[near] == words, self.shared[near], self.rare)

    def gain(self, words: np.ndarray, bounds: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each text, the toxic one mixed with SHARE.

        With ``labels`` the texts are among those counted; their own counts are then left out.
        """
        if not len(words):
            return np.zeros(len(bounds) - 1)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = _bucket(words, WORD_BITS)
        n = self.word[:, at] - (0 if labels is None else _own(owner, at, labels))
        total = self.word.sum(1, keepdims=True)
        low = (np.maximum(n - self.cut[np.clip(n, 0, 3)], 0) + np.maximum(self.mass, 1) * self.backoff(words)) / np.maximum(total, 1)
        logs = np.log(low)
        inner = owner[1:] == owner[:-1]
        if inner.any() and len(self.pairs):
            pair, ctx = _bucket(_pairs(words), PAIR_BITS), _bucket(words[:-1], WORD_BITS)
            near = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            seen = self.pair[:, near] * (self.pairs[near] == pair)
            if labels is not None:
                seen = np.maximum(seen - _own(owner[1:], near, labels), 0)
            n = self.context[:, ctx]
            # both classes give the same share to the backoff, so a pair that neither knows leaves the ratio
            # of the words; the rest is shared out by a class's pairs and, as OWN times one pair, by both classes'
            taken = self.follow[:, ctx]
            share = taken.sum(0) / np.maximum(n.sum(0), 1)
            known = np.maximum(n - taken, 0)
            cut = np.maximum(seen - self.discount[np.minimum(seen, 3)], 0) * (seen > 1)
            both = known.sum(0)
            some = both > 1e-6
            pooled = cut.sum(0) / np.where(some, both, 1)
            mixed = np.where(some, (1 - share) * (cut + OWN * pooled) / (known + OWN) + share * low[:, 1:], low[:, 1:])
            logs[:, 1:] = np.where(inner, np.log(mixed), logs[:, 1:])
        sums = np.concatenate([[0.0], np.cumsum(np.log1p(SHARE * np.expm1(np.clip(logs[1] - logs[0], -MOST, MOST))))])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def features(self, texts: list[str], hasher: WordHasher, labels: np.ndarray | None = None) -> np.ndarray:
        words, bounds = hasher(texts)
        n = np.diff(bounds)
        gain = self.gain(words, bounds, labels)
        per_word = gain / np.maximum(n, 1)
        return np.stack([np.ones(len(n)), np.log(np.maximum(per_word, -0.009) + 0.011)], axis=1)

    def scores(self, texts: list[str], hasher: WordHasher) -> np.ndarray:
        z = self.features(texts, hasher) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _own(owner: np.ndarray, at: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each class and place, how often a text of that class has the thing at the place itself."""
    _, back, times = np.unique(owner.astype(np.int64) << 32 | at, return_inverse=True, return_counts=True)
    return np.stack([times[back] * (labels[owner] == c) for c in (0, 1)])


def _emit(found: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(found)


def _parts(df: DataFrame, key: str, parts: int = 8):
    """The rows of a bounded table as numpy columns, a part at a time, so that the driver holds little."""
    for k in range(parts):
        got = df.where(F.pmod(F.col(key), F.lit(parts)) == k).toArrow()
        yield [got.column(c).to_numpy() for c in got.column_names]


def sketch(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, slot, mask)`` of words and hashes of what stands before each; a slot is a quarter of a level."""
    level = np.minimum(np.bitwise_count((before & (~before + np.uint64(1))) - np.uint64(1)), LEVELS - 1).astype(np.int64)
    place = before >> np.uint64(56)
    return merged(words, level * QUARTERS + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))


def merged(words: np.ndarray, slots: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one word and slot as one."""
    if not len(words):
        return words, slots, masks
    key = words ^ (slots.astype(np.uint64) + np.uint64(1)) * _PAIR
    order = np.argsort(key)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    return words[order[starts]], slots[order[starts]], np.bitwise_or.reduceat(masks[order], starts)


def estimates(bits: np.ndarray) -> np.ndarray:
    """Numbers of different things from the bits set at each level, a row a word.

    The levels from the first that is not too full on are counted, each by its share of empty bits.
    """
    size = 64 * QUARTERS
    counted = -size * np.log1p(-np.minimum(bits, size - 0.5) / size)
    base = np.argmax(bits <= FULL, axis=1)
    counted[np.arange(LEVELS) < base[:, None]] = 0
    return counted.sum(1) * 2.0**base


@dataclass
class Shared:
    """Continuation counts: of the wanted words those with two predecessors or more, sorted by hash; and
    over all words of the corpus how many have that many, the sum of these counts, and how many have one."""

    words: np.ndarray
    counts: np.ndarray
    often: int
    total: float
    single: int


def shared_counts(docs: DataFrame, scratch: Scratch, wanted: DataFrame, text_col: str = "text") -> Shared:
    """Counts over all documents; ``wanted (word)`` are the hashes, bounded in number, that are handed out."""

    def run(batches):
        hasher = WordHasher(alphanumeric=True)
        held, total, limit = [], 0, HELD

        def emit(rows):
            for k in range(0, len(rows[0]), 50_000):
                word, slot, mask = (r[k : k + 50_000] for r in rows)
                yield _emit({"word": word.view(np.int64), "slot": slot.astype(np.int32), "mask": mask.view(np.int64)})

        for batch in batches:
            column = batch.column(0)
            for a, b in slices(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()):
                words, bounds = hasher([t or "" for t in column.slice(a, b - a).to_pylist()])
                before = np.concatenate([np.full(1, _START), words[:-1]]) if len(words) else words
                before[bounds[:-1][bounds[:-1] < len(words)]] = _START
                held.append(sketch(words, before))
                total += len(held[-1][0])
                if total > limit:
                    held = [merged(*map(np.concatenate, zip(*held, strict=True)))]
                    total = len(held[0][0])
                    if total > limit // 2:
                        yield from emit(held[0])
                        held, total = [], 0
        if held:
            yield from emit(merged(*map(np.concatenate, zip(*held, strict=True))))

    masks = docs.select(F.col(text_col).cast("string")).mapInArrow(releasing(run), "word bigint, slot int, mask bigint")
    slots = masks.groupBy("word", "slot").agg(F.bit_count(F.bit_or("mask")).cast("int").alias("bits"))
    by_word = slots.groupBy("word").agg(F.sum("bits").alias("ones"), F.collect_list(F.struct("slot", "bits")).alias("slots"))
    by_word = scratch.save(by_word.select("word", "ones", F.when(F.col("ones") > 1, F.col("slots")).alias("slots")), "shared")

    def count(batches):
        for batch in batches:
            at = batch.column("slots")
            found = at.flatten()
            owner = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
            bits = np.zeros((len(at), LEVELS))
            np.add.at(bits, (owner, found.field("slot").to_numpy() // QUARTERS), found.field("bits").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(estimates(bits).astype(np.float32))], names=["word", "n"])

    often = scratch.save(by_word.where("ones > 1").select("word", "slots").mapInArrow(releasing(count), "word bigint, n float"), "often")
    single = by_word.where("ones = 1").count()
    n, total = often.agg(F.count(F.lit(1)), F.sum(F.col("n").cast("double"))).first()
    parts = list(_parts(often.join(F.broadcast(wanted), "word"), "word"))
    words = np.concatenate([w.view(np.uint64) for w, _ in parts])
    order = np.argsort(words)
    return Shared(words[order], np.concatenate([c for _, c in parts])[order], n, total or 0.0, single)


def class_counts(rows: DataFrame, scratch: Scratch) -> tuple[dict[str, np.ndarray], DataFrame]:
    """Counts of words (kind 0) and pairs (2) by class over rows ``(label, text)``, and the different
    words ``(word)`` by their full hashes (kind 3)."""

    def run(batches):
        hasher = WordHasher(alphanumeric=True)
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist())
            column = batch.column("text")
            for a, b in slices(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()):
                words, bounds = hasher([t or "" for t in column.slice(a, b - a).to_pylist()])
                owner = np.repeat(labels[a:b], np.diff(bounds))
                inner = np.ones(len(words), bool)
                inner[bounds[:-1][bounds[:-1] < len(words)]] = False
                inner = inner[1:]
                pair = _bucket(_pairs(words), PAIR_BITS)[inner] if len(words) else np.zeros(0, np.int64)
                ctx = _bucket(words[:-1], WORD_BITS)[inner] if len(words) else pair
                each = np.unique(words).view(np.int64)
                yield _emit({"kind": np.full(len(each), 3, np.int32), "key": each, "n": np.ones(len(each), np.int64)})
                for kind, bucket, label in ((0, _bucket(words, WORD_BITS), owner), (2, (pair << WORD_BITS) + ctx, owner[1:][inner] if len(words) else owner)):
                    keys, n = np.unique(bucket * 2 + label, return_counts=True)
                    yield _emit({"kind": np.full(len(keys), kind, np.int32), "key": keys, "n": n})

    counts = rows.mapInArrow(releasing(run), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    out = {"word": np.zeros((2, 1 << WORD_BITS), np.int32), "context": np.zeros((2, 1 << WORD_BITS), np.int32), "follow": np.zeros((2, 1 << WORD_BITS), np.float32)}
    for key, n in _parts(counts.where("kind = 0").select("key", F.col("n").cast("int")), "key"):
        out["word"][key % 2, key // 2] = n
    pairs = counts.where("kind = 2")
    of = {r[0]: r[1] for r in pairs.where("n <= 4").groupBy("n").count().collect()}
    out["discount"] = discounts(*[of.get(k, 0) for k in (1, 2, 3, 4)])
    # pairs seen once are not kept: all of them goes to the backoff
    cut = [0.0, 1.0, *map(float, out["discount"][2:])]
    taken = F.least("n", F.element_at(F.array(*map(F.lit, cut)), F.least("n", F.lit(3)).cast("int") + 1))
    context = F.col("key").bitwiseAND((2 << WORD_BITS) - 1)
    by = pairs.groupBy(context.alias("context")).agg(F.sum("n").cast("int").alias("n"), F.sum(taken).cast("float").alias("taken"))
    for key, n, part in _parts(scratch.save(by, "contexts"), "context"):
        out["context"][key % 2, key // 2], out["follow"][key % 2, key // 2] = n, part
    kept = [np.stack([key, n]) for key, n in _parts(pairs.where("n >= 2").select("key", F.col("n").cast("int")), "key")]
    key, n = np.concatenate(kept, axis=1)
    del kept
    out["pairs"], at = np.unique(key >> (WORD_BITS + 1), return_inverse=True)
    out["pair"] = np.zeros((2, len(out["pairs"])), np.int32)
    np.add.at(out["pair"], (key % 2, at), n)
    return out, counts.where("kind = 3").select(F.col("key").alias("word"))


def discounts(*seen: int) -> np.ndarray:
    """Discounts of things seen 0, 1, 2 and 3 or more times, from how many were seen 1 to 4 times."""
    n1, n2, n3, n4 = (max(1, n) for n in seen)
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.5, 0.7, 0.9], [0, 0.95, 1.8, 2.7])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic fit by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 8192, fold: tuple[int, int] | None = (4, 2), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model. Class counts and the logistic fit see at most about ``max_rows`` rows a class; the
    shared backoff counts see all documents; rows with one labelled id count once. Without labelled
    rows of both classes every score is the share of toxic ones (0 without any)."""
    chosen, total = labelled_sample(labels, label_col, max_rows, fold, id_col)
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.save(labelled_texts(docs, chosen, id_col, text_col), "rows")
    counts, wanted = class_counts(rows.select("label", "text"), scratch)
    shared = shared_counts(docs, scratch, wanted, text_col)
    cut = discounts(*np.bincount(np.minimum(counts["word"].ravel(), 5), minlength=6)[1:5])
    whole = shared.total + 0.1 * shared.often + 1.1 * (shared.single + 1)  # and one word that is nowhere
    mass = np.stack([[np.minimum(n, cut[np.minimum(n, 3)]).sum()] for n in counts["word"]])
    model = Model(counts["word"], cut, mass, shared.words, ((shared.counts + 0.1) / whole).astype(np.float32), 1.1 / whole, counts["pairs"], counts["pair"], counts["context"], counts["follow"], counts["discount"])

    holder = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher = WordHasher(alphanumeric=True)
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()):
                labels = np.array(batch.column("label").slice(a, b - a).to_pylist())
                x = holder.value.features([t or "" for t in column.slice(a, b - a).to_pylist()], hasher, labels)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    seen = rows.select("label", "text").mapInArrow(releasing(run), "label int, x array<double>").toPandas()
    model.weights = np.zeros(2)
    if seen.label.nunique() == 2:
        # rows weigh as the labels are spread, not as the sample is
        y = seen.label.to_numpy(float)
        model.weights = logistic(np.stack(seen.x.to_numpy()), y)
        true = total[1] / (total[0] + total[1])
        model.weights[0] += np.log(true / (1 - true)) - np.log(y.mean() / (1 - y.mean()))
    else:
        true = total.get(1, 0) / max(1, sum(total.values()))
        model.weights[0] = np.log(max(true, 1e-9) / max(1 - true, 1e-9))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted)`` of every row; null and empty texts are scored as without words.

    Null ids and repeated rows stay as they are, an empty table gives an empty result, and only the two
    named columns are read.
    """
    holder = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("score", pa.float64()), ("predicted", pa.int32())])

    def make():
        hasher = WordHasher(alphanumeric=True)

        def work(texts):
            s = holder.value.scores(texts, hasher)
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

        return work

    return map_texts(docs, make, schema, id_col, text_col)
