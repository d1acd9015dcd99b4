"""Byte-level BPE encoding and decoding over Arrow batches.

The rank file is turned into a ``tokenizers`` model once on the driver: bytes map to printable
characters, a merge is every split of a token into two known tokens, in rank order. Pieces that are
a token are taken whole, as the rank format asks for. The pattern's matches are encoded once and kept
in a bounded cache, as most matches come again. Offsets come from token byte lengths and a
byte-to-character map; a token that starts or ends within a character covers that character.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain
from operator import or_

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.common import map_texts, releasing

RANKS = "byte_bpe_50k.tiktoken"


def byte_table() -> list[str]:
    """Printable character of each byte: itself where printable in Latin-1, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A ``tokenizers`` definition that encodes one match of the pattern as the ranks do."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    table = byte_table()
    shown = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [
        (shown[token[:k]], shown[token[k:]])
        for token in sorted(ranks, key=ranks.get)
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    ]
    tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


def token_bytes(definition: str) -> list[bytes]:
    """Bytes of each id: the characters of the vocabulary's tokens through the byte table reversed."""
    vocabulary = json.loads(definition)["model"]["vocab"]
    byte_of = {char: b for b, char in enumerate(byte_table())}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte_of[char] for char in token)
    return out


def char_offsets(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Character start and end of each token, and how many tokens have a bound within a character."""
    if text.isascii():
        ends = np.cumsum(lengths)
        return ends - lengths, ends, 0
    data = np.frombuffer(text, np.uint8)
    head = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(head)])  # characters begun before each byte
    inside = np.concatenate([~head, [False]])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    split = inside[starts] | inside[ends]
    return before[starts] - inside[starts], before[ends], int(split.sum())


#: A match of the pattern: its ids, these as text, the bytes they decode to, tokens bounded within a
#: character. Plain tuples, which the garbage collector then leaves alone.
Piece = tuple[tuple[int, ...], str, bytes, int]


class Codec:
    """Encodes texts to ids and offsets and decodes ids; one per task."""

    CACHE = 400_000  # pieces kept, each of at most 64 characters: about 160 MB

    def __init__(self, definition: str, table: list[bytes], pattern: str, digests: bool = True):
        """Without ``digests`` pieces are kept without their text and bytes."""
        gc.set_threshold(200_000)  # the cache makes many objects and no cycles
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.table = table
        self.names = [str(i) for i in range(len(table))]
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.within = [bool(t) and 0x80 <= t[0] < 0xC0 for t in table]  # tokens that begin within a character
        self.matches = regex.compile(pattern).findall
        self.digests = digests
        self.cache: dict[str, Piece] = {}

    def pieces(self, texts: list[str]) -> Iterator[list[Piece]]:
        """The encoded matches of each text."""
        for text in texts:
            found = self.matches(text)
            cache = self.cache
            if missing := [p for p in dict.fromkeys(found) if p not in cache]:
                if len(cache) + len(missing) > self.CACHE:
                    cache = self.cache = {}
                    missing = list(dict.fromkeys(found))
                fresh = {p: self._piece(p, e.ids) for p, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True)}
                cache.update((p, piece) for p, piece in fresh.items() if len(p) <= 64)
                yield [cache[p] if p in cache else fresh[p] for p in found]
            else:
                yield [cache[p] for p in found]

    def _piece(self, text: str, ids: list[int]) -> Piece:
        split = 0
        if not text.isascii():
            within = [self.within[i] for i in ids]
            split = sum(map(or_, within, within[1:] + [False])) if any(within) else 0
        if not self.digests:
            return tuple(ids), "", b"", split
        names = self.names
        return tuple(ids), " ".join([names[i] for i in ids]), self.decode(ids), split

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
        """Ids of each text, and how many tokens have a bound within a character."""
        for pieces in self.pieces(texts):
            yield np.fromiter(chain.from_iterable([p[0] for p in pieces]), np.int32), sum([p[3] for p in pieces])

    def decode(self, ids: list[int]) -> bytes:
        table = self.table
        return b"".join([table[i] for i in ids])


def _load(spark, path: str | None, pattern: str | None):
    definition = tokenizer_json(read_ranks(path or public_tokenizers.path(RANKS)))
    return spark.sparkContext.broadcast((definition, token_bytes(definition), pattern or public_tokenizers.PATTERN))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True, decoded: bool = False) -> DataFrame:
    """``(id, ids array<int>[, starts, ends array<int>], n_split[, decoded_sha256])``: the tokens of every text.

    Null and empty texts have no tokens. Offsets are code points; a token that holds part of a
    character has that character's whole span. ``n_split`` counts tokens bounded within a character.
    With ``decoded`` the ids are decoded again and the bytes' digest (lowercase hex) stands beside them.
    Null ids and repeated rows stay as they are, and only the two named columns are read.
    """
    model = _load(docs.sparkSession, path, pattern)
    fields = [("ids", pa.list_(pa.int32()))] + [("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))] * offsets + [("n_split", pa.int64())] + [("decoded_sha256", pa.string())] * decoded

    def make():
        codec = Codec(*model.value, digests=False)

        def work(texts):
            found = list(codec.encode(texts))
            # lists of all texts are one run of numbers each, cut at the same places
            bounds = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in found])]).astype(np.int32)
            lists = lambda parts: pa.ListArray.from_arrays(bounds, np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32))
            out = {"ids": lists([ids for ids, _ in found]), "n_split": [split for _, split in found]}
            if offsets:
                at = [char_offsets(text.encode(), codec.lengths[ids]) for text, (ids, _) in zip(texts, found, strict=True)]
                out |= {"starts": lists([a[0] for a in at]), "ends": lists([a[1] for a in at])}
            if decoded:
                out["decoded_sha256"] = [hashlib.sha256(codec.decode(ids.tolist())).hexdigest() for ids, _ in found]
            return out

        return work

    return map_texts(docs, make, pa.schema(fields), id_col, text_col)


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """``(id, bytes binary, text string)`` from ids; text has U+FFFD where the bytes are not UTF-8.

    Null ids decode to nothing. An id outside the vocabulary raises IndexError.
    """
    model = _load(rows.sparkSession, path, None)
    picked = rows.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("__ids"))

    def run(batches):
        table = model.value[1]
        for batch in batches:
            raw = [b"".join([table[i] for i in ids or []]) for ids in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())],
                names=[id_col, "bytes", "text"],
            )

    kind = picked.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(releasing(run), f"`{id_col}` {kind}, bytes binary, text string")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256, n_split)``: encode, decode, keep digests.

    The same codec as :func:`encode` and :func:`decode`, without moving ids out of the worker. Null and
    empty texts have no tokens and the digests of nothing. Null ids and repeated rows stay as they are,
    an empty table gives an empty result, and only the two named columns are read.
    """
    model = _load(docs.sparkSession, path, pattern)
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_split", pa.int64())])

    def make():
        codec = Codec(*model.value)

        def work(texts):
            out = {name: [] for name in schema.names}
            for pieces in codec.pieces(texts):
                out["n_tokens"].append(sum([len(p[0]) for p in pieces]))
                out["ids_sha256"].append(hashlib.sha256(" ".join([p[1] for p in pieces]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join([p[2] for p in pieces])).hexdigest())
                out["n_split"].append(sum([p[3] for p in pieces]))
            return out

        return work

    return map_texts(docs, make, schema, id_col, text_col)
