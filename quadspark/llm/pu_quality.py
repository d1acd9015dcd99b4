"""Quality by positive-unlabelled learning.

Trusted positives (rows labelled good) and unlabelled web text train one small network by the
non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).
The class prior comes from the data: a first classifier tells positives from unlabelled rows, and the
prior is the least ratio of the unlabelled to the positive share above a threshold of it. Rows labelled
bad are never used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.common import SPACES, WordHasher, map_texts, releasing, shingles, slices
from quadspark.llm.labelled import labelled_sample, labelled_texts, sampled_texts
from quadspark.llm.toxicity import logistic

_CLASSES = 7


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.int8)  # 0: other symbols
    for b in range(128):
        c = chr(b)
        out[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:'\"()-?" else out[b]
    out[list(SPACES)] = 5
    out[128:] = 6
    return out


class Features:
    """Shape of a text: shares of byte classes, sizes, repetition."""

    names = ("symbols", "lower", "upper", "digits", "marks", "space", "other", "words", "word_len", "long_words", "distinct", "distinct3", "top_word", "words_a_line", "marks_a_word", "symbols_a_word")

    def __init__(self):
        self.hasher, self.classes = WordHasher(), _byte_classes()

    def __call__(self, texts: list[str]) -> np.ndarray:
        words, bounds = self.hasher(texts)
        triples, ends3 = shingles(words, bounds, 3)
        out = np.zeros((len(texts), len(self.names)))
        for k, text in enumerate(texts):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            own = words[bounds[k] : bounds[k + 1]]
            n, size = len(own), max(len(data), 1)
            share = np.bincount(self.classes[data], minlength=_CLASSES) / size
            if n:
                counts = np.unique(own, return_counts=True)[1]
                gaps = np.flatnonzero(self.hasher.space[data])
                longest = float(np.diff(gaps, prepend=-1).max(initial=0)) if len(gaps) else size
                out[k, 7:] = (
                    np.log1p(n) / 10,
                    (size - len(gaps)) / n / 10,
                    min(longest, 100) / 100,
                    len(counts) / n,
                    (ends3[k + 1] - ends3[k]) / max(n - 2, 1),
                    counts.max() / n,
                    np.log1p(n / (text.count("\n") + 1)) / 5,
                    min(share[4] * size / n, 3) / 3,
                    min(share[0] * size / n, 5) / 5,
                )
            out[k, :7] = share
        return out


@dataclass
class Net:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    std: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -35, 35)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from a classifier's values on both.

    Above any threshold the unlabelled share is at least prior times the positive share; the least
    ratio, with a margin for the size of the samples, bounds the prior. Only thresholds that nine in ten
    positives pass are looked at: further up, what the classifier learnt by heart lowers the ratio.
    """
    cuts = np.quantile(positive, np.linspace(0.005, 0.1, 40))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + margin) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def risk(params: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk with logistic losses, and the step's direction: its gradient, or, where the
    estimated risk on negatives is below zero, the one that brings it back up."""
    x, n, m = np.concatenate([positive, unlabelled]), len(positive), len(unlabelled)
    h = np.tanh(x @ params[0] + params[1])
    g = h @ params[2] + params[3]
    s = 1 / (1 + np.exp(-np.clip(g, -35, 35)))
    # losses: positive -log s, negative -log(1 - s)
    negative = -np.log(np.maximum(1 - s, 1e-16))
    good = prior * -np.log(np.maximum(s[:n], 1e-16)).mean()
    rest = negative[n:].mean() - prior * negative[:n].mean()
    dg = np.zeros(len(x))
    if rest >= 0:
        dg[:n] = prior * (s[:n] - 1) / n - prior * s[:n] / n
        dg[n:] = s[n:] / m
    else:
        dg[:n] = prior * s[:n] / n
        dg[n:] = -s[n:] / m
    dh = np.outer(dg, params[2]) * (1 - h * h)
    return good + max(0.0, rest), [x.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()])]


def train(positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 16, epochs: int = 150, rate: float = 0.01, seed: int = 7) -> Net:
    """A net by Adam steps on the non-negative risk; the same inputs give the same net."""
    both = np.concatenate([positive, unlabelled])
    mean, std = both.mean(0), np.maximum(both.std(0), 1e-3)
    zp, zu = (np.clip((v - mean) / std, -8, 8) for v in (positive, unlabelled))

    squares = lambda z: np.concatenate([z, np.minimum(z * z, 16), np.ones((len(z), 1))], axis=1)
    y = np.concatenate([np.ones(len(zp)), np.zeros(len(zu))])
    w = logistic(squares(np.concatenate([zp, zu])), y, ridge=1.0)
    prior = class_prior(squares(zp) @ w, squares(zu) @ w)

    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    params = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order_p, order_u = rng.permutation(len(zp)), rng.permutation(len(zu))
        parts = max(1, len(zu) // 1024)
        for part_p, part_u in zip(np.array_split(order_p, parts), np.array_split(order_u, parts), strict=True):
            if not len(part_p) or not len(part_u):
                continue
            _, grads = risk(params, zp[part_p], zu[part_u], prior)
            grads[0] += 1e-4 * params[0]
            grads[2] += 1e-4 * params[2]
            step += 1
            for k, grad in enumerate(grads):
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad * grad
                params[k] = params[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Net(mean, std, params[0], params[1], params[2], float(params[3][0]), prior)


def _vectors(rows: DataFrame) -> np.ndarray:
    """Feature vectors of a bounded number of rows ``(text)``, on the driver."""

    def run(batches):
        features = Features()
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(list(features([t or "" for t in column.slice(a, b - a).to_pylist()])), pa.list_(pa.float64()))], names=["x"])

    got = rows.select("text").mapInArrow(releasing(run), "x array<double>").toPandas()
    x = np.stack(got.x.to_numpy()) if len(got) else np.zeros((0, len(Features.names)))
    return x[np.lexsort(x.T)] if len(x) else x  # by value, so that the order of tasks does not matter


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 4096, fold: tuple[int, int] | None = (4, 2), id_col: str = "doc_id", text_col: str = "text") -> Net | None:
    """The net, from about ``max_rows`` positives and twice as many unlabelled rows at most.

    Unlabelled rows are any rows of ``docs``, chosen by hash; no label of theirs is looked at. Equal
    rows, and rows with one labelled id, count once. None if there are no positives or no documents.
    """
    positives, _ = labelled_sample(labels.where(F.col(label_col) == 1), label_col, max_rows, fold, id_col)
    x_p = _vectors(labelled_texts(docs, positives, id_col, text_col))
    x_u = _vectors(sampled_texts(docs, 2 * max_rows, "unlabelled", id_col, text_col))
    return train(x_p, x_u) if len(x_p) and len(x_u) else None


def score(docs: DataFrame, net: Net | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted)`` of every row; null and empty texts score 0. Without a net all score 0.5.

    Null ids and repeated rows stay as they are, an empty table gives an empty result, and only the two
    named columns are read.
    """
    schema = pa.schema([("score", pa.float64()), ("predicted", pa.int32())])

    def make():
        features = Features()

        def work(texts):
            if net is None:
                s = np.full(len(texts), 0.5)
            else:
                s = net.scores(features(texts))
                s[[k for k, t in enumerate(texts) if not t]] = 0.0
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

        return work

    return map_texts(docs, make, schema, id_col, text_col)
