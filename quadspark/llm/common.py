"""Shared parts of the operators: Arrow batch mapping, word hashing on whole batches.

Conventions held by every operator of this subpackage:

* only the named id and text columns of the input are read, so other columns, whatever their
  names, cannot clash with an output column;
* a null text counts as an empty one unless the operator's docstring says otherwise;
* a null id is carried through to the output as null; repeated rows give repeated results.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Texts are worked on in slices of about this many characters, so that one Arrow batch of long
#: texts does not blow up a Python worker. A longer text is a slice of its own.
SLICE_CHARS = 1 << 18


def release_memory() -> None:
    """Give what a task has freed back to the system, as Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The batch function, with :func:`release_memory` at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


# --- Arrow batches ------------------------------------------------------------------------

def slices(sizes: Iterable[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most the limit, or that hold one row."""
    start = total = n = 0
    for n, size in enumerate(sizes, 1):
        if total and total + size > limit:
            yield start, n - 1
            start, total = n - 1, 0
        total += size
    if n > start:
        yield start, n


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], dict[str, list | pa.Array]]],
    schema: pa.Schema,
    id_col: str = "doc_id",
    text_col: str = "text",
    nulls: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Rows ``(id, *carry, *schema)`` from a function over lists of texts; no shuffle.

    ``make`` runs once a task and returns the function, so that models load once. Null texts come
    as "" (as None with ``nulls``).
    """
    cols = [id_col, *carry]
    picked = df.select(*[F.col(c) for c in cols], F.col(text_col).cast("string").alias("__text"))
    ddl = {f.name: f.dataType for f in picked.schema.fields}
    out = ", ".join([f"`{c}` {ddl[c].simpleString()}" for c in cols] + [f"`{f.name}` {_ddl(f.type)}" for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("__text")), 0).to_pylist()
            for a, b in slices(lengths):
                part = batch.slice(a, b - a)
                texts = part.column("__text").to_pylist()
                got = work(texts if nulls else [t or "" for t in texts])
                arrays = [part.column(c) for c in cols]
                arrays += [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], type=f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(arrays, names=[*cols, *schema.names])

    return picked.mapInArrow(releasing(run), out)


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{_ddl(kind.value_type)}>"
    return {"int64": "bigint", "int32": "int", "double": "double", "bool": "boolean", "string": "string", "binary": "binary", "float": "float"}[str(kind)]


# --- words of a whole batch, hashed without a Python loop -------------------------------------

def _mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 finaliser), in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class WordHasher:
    """64-bit hashes of the words of a list of texts.

    A word's hash is a polynomial over random 64-bit values of its bytes, taken as a difference of
    prefix sums and brought back to power 0, then mixed; equal words get equal hashes anywhere.
    """

    BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64

    def __init__(self, lower: bool = True, alphanumeric: bool = False):
        """``alphanumeric`` makes every other ASCII character part words too."""
        values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        if lower:
            values[65:91] = values[97:123]  # A-Z count as a-z
        self.values = values
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True
        if alphanumeric:
            self.space[[b for b in range(128) if not chr(b).isalnum()]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            step = np.uint64(pow(self.BASE, k, 1 << 64))
            back = np.uint64(pow(self.BASE, -k, 1 << 64))
            self.up = np.concatenate([self.up, self.up * step])
            self.down = np.concatenate([self.down, self.down * back])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's words start (one entry more than texts)."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
        self._powers(len(data))
        gap = self.space[data]
        edge = np.diff(gap.astype(np.int8), prepend=np.int8(1))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        last = last[last > 0] if len(last) and last[0] == 0 else last
        terms = self.values[data]
        terms *= self.up[: len(data)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        words = _mix((sums[last] - sums[first]) * self.down[first])
        bounds = np.concatenate([[0], np.searchsorted(first, ends)])
        return words, bounds


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their bounds.

    A text with fewer words than the width has its whole sequence as one shingle; without words, none.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), n)
    starts = np.concatenate([[0], np.cumsum(n)])
    at = bounds[:-1][owner] + np.arange(len(owner)) - starts[:-1][owner]
    left = np.minimum(counts[owner], width)
    mult = _mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    h = np.zeros(len(owner), np.uint64)
    for j in range(width):
        use = left > j
        h[use] += words[at[use] + j] * mult[j]
    h = _mix(h + left.astype(np.uint64))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[keep], h[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int64)
