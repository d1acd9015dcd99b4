"""Secret scans over nested encodings.

A worklist starts with the text as it is. Each layer is scanned, then unwrapped: URL escapes and
Unicode escapes decode in place, a base64 run (joined over line ends) becomes a layer of its own at
each of the four alignments, compressed bytes are inflated from wherever their mark stands in a run.
Bytes that are no text are replaced, never a reason to drop a layer. Every character of a layer knows
the span of the original text that it came from, so a finding in any layer maps back. A layer already
seen (same text, same place) is not taken up again, and unwrapping stops when no layer is new.

The worklist is a stack of layers still to come, made one by one: a layer's own layers come before its
neighbours, and inflated bytes come in parts, so that memory is bounded by the depth of nesting.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadspark.llm.common import map_texts, releasing

#: Kinds in the order in which findings at one place are listed, and their patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})(?:\\u([0-9A-Fa-f]{4}))?|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: A run, with the lines that it goes on in; 12 characters or more in all.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{12,}+|[A-Za-z0-9+/_-]{4,}+(?=[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]))(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]++)*={0,2}")
_PIECE = re.compile(r"[A-Za-z0-9+/_-]+=*")
#: How compressed bytes begin in base64, as whole groups: gzip, zlib, bzip2, xz, zstd.
_PACKED = re.compile(r"(?=H4s|e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])|Qlpo|/Td6WFo|KLUv)")
#: Decoded bytes without any of these hold no finding and nothing to unwrap.
_WORTH = re.compile(rb"[A-Za-z0-9+/_-]{12}|[A-Za-z0-9+/_-]{4}[\x20\t]*\r?\n|%[0-9A-Fa-f]{2}|\\[uUx]|&#|password|passwd|secret|token|api_?key", re.IGNORECASE)
#: ASCII in UTF-16 or UTF-32, of either byte order.
_WIDE = re.compile(rb"(?:[\t-\x7e]\0+){6}")
#: Inflated bytes are taken in parts of this size, which overlap.
PART = 16 << 20
OVERLAP = 1 << 20
#: What one text may inflate to in all its layers (a nest of decompression bombs has no end otherwise);
#: the row's ``oversized`` counts what was left off there. Its first bytes are scanned all the same.
MAX_UNWRAPPED = 1 << 30
#: After this many rounds of escapes within escapes, what is left of them is decoded in one step, so
#: that nesting without end (%25252525...) takes time in proportion to its length.
ROUNDS = 16


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Findings of the three kinds, as (start, end, kind): whole matches, leftmost, per kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return found


#: A run of 24 or more is a whole match of HEX exactly if no hex digit stands before it.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


@dataclass
class Layer:
    """Text unwrapped so far; its characters' places in the original, or None where they are 1:1.

    Places never go down from one character to the next.
    """

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    path: tuple[str, ...] = ()
    rounds: int = 0  # of escapes in place since the last layer of another kind

    def span(self, a: int, b: int) -> tuple[int, int]:
        if a >= b:
            return (0, 0)
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))

    def replaced(self, parts: list[tuple[int, int, list[tuple[str, int, int]]]], step: str) -> Layer:
        """A layer with ranges replaced by characters, each from a subrange of this layer."""
        text, first, last, at = [], [], [], 0
        for a, b, chars in [*parts, (len(self.text), len(self.text), [])]:
            text += [self.text[at:a], *[c[0] for c in chars]]
            first += [np.arange(at, a), [c[1] for c in chars]]
            last += [np.arange(at + 1, a + 1), [c[2] for c in chars]]
            at = b
        first, last = (np.concatenate(x).astype(np.int64) for x in (first, last))
        if self.starts is not None:
            first, last = self.starts[first], self.ends[last - 1]
        return Layer("".join(text), first, last, (*self.path, step), self.rounds + 1)


def constant(text: str, span: tuple[int, int], path: tuple[str, ...]) -> Layer:
    return Layer(text, np.full(len(text), span[0], np.int64), np.full(len(text), span[1], np.int64), path)


def _bytes_as_text(raw: bytes, places: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Characters of bytes and their places; a stray byte stands for its Latin-1 character."""
    out, at = [], 0
    for char in raw.decode("utf-8", "surrogateescape"):
        size = 1 if 0xDC80 <= ord(char) <= 0xDCFF else len(char.encode())
        out.append((chr(raw[at]) if size == 1 else char, places[at][0], places[at + size - 1][1]))
        at += size
    return out


def _url(layer: Layer) -> list[Layer]:
    parts = []
    for m in _URL.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        parts.append((m.start(), m.end(), _bytes_as_text(raw, [(k, k + 3) for k in range(m.start(), m.end(), 3)])))
    return [layer.replaced(parts, "url")] if parts else []


def _code(m: re.Match) -> int:
    braced, long, four, _, two, hexa, deci = m.groups()
    return int(deci) if deci else int(braced or long or four or two or hexa, 16)


def _char(code: int) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _unicode(layer: Layer) -> list[Layer]:
    parts = []
    for m in _UNICODE.finditer(layer.text):
        code, pair = _code(m), m[4]
        if pair and 0xD800 <= code < 0xDC00 <= (low := int(pair, 16)) < 0xE000:
            chars = [(chr(0x10000 + ((code - 0xD800) << 10) + low - 0xDC00), m.start(), m.end())]
        else:
            half = m.start() + 6 if pair else m.end()
            chars = [(_char(code), m.start(), half)] + ([(_char(int(pair, 16)), half, m.end())] if pair else [])
        parts.append((m.start(), m.end(), chars))
    return [layer.replaced(parts, "unicode")] if parts else []


#: Where an escape may begin or go on; what lies between two of these is left alone by _settled.
_REGION = re.compile(r"[%\\&][%\\&#;{}xuU0-9A-Fa-f]*")
#: The escape that the end of a text completes.
_TAIL = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)$")


def _settled(layer: Layer) -> list[Layer]:
    """The layer with escapes within escapes decoded until none is left, in one pass.

    Characters are put on a stack; where they complete an escape, it goes and its character comes.
    Bytes of URL escapes stay apart until the region ends, and are then read as UTF-8.
    """
    parts = []
    for m in _REGION.finditer(layer.text):
        stack: list[tuple[str, int, int]] = []
        hit = False
        for at in range(m.start(), m.end()):
            stack.append((layer.text[at], at, at + 1))
            while (stack[-1][0] in ";}" or stack[-1][0].isalnum()) and (found := _TAIL.search("".join(x[0] for x in stack[-10:]))):
                n = len(found[0])
                a, b = stack[-n][1], stack[-1][2]
                del stack[-n:]
                if found[0][0] == "%":
                    code = int(found[0][1:], 16)
                    char = chr(code) if code < 0x80 else chr(0xDC00 + code)
                else:
                    char = _char(_code(_UNICODE.match(found[0])))
                stack.append((char, a, b))
                hit = True
        if not hit:
            continue
        chars, k = [], 0
        while k < len(stack):
            end = k
            while end < len(stack) and 0xDC80 <= ord(stack[end][0]) <= 0xDCFF:
                end += 1
            if end > k:
                chars += _bytes_as_text(bytes(ord(x[0]) - 0xDC00 for x in stack[k:end]), [x[1:] for x in stack[k:end]])
                k = end
            else:
                chars.append(stack[k])
                k += 1
        parts.append((m.start(), m.end(), chars))
    return [layer.replaced(parts, "settled")] if parts else []


_MAKERS = {"gzip": (b"\x1f\x8b", lambda: zlib.decompressobj(31)), "zlib": (b"\x78", zlib.decompressobj), "bzip2": (b"BZh", bz2.BZ2Decompressor), "xz": (b"\xfd7zXZ\x00", lzma.LZMADecompressor), "zstd": (b"\x28\xb5\x2f\xfd", None)}


class Budget:
    """How much one text may still inflate to."""

    def __init__(self):
        self.left, self.spent = MAX_UNWRAPPED, 0


def _members(source: Iterator[bytes], magic: bytes, maker) -> Iterator[bytes]:
    """Bytes of all members in a row, piece by piece; broken data ends it."""
    reader, data = maker(), b""
    for chunk in source:
        data += chunk
        while data:
            if reader.eof:
                data = data.lstrip(b"\0")
                if len(data) < len(magic):
                    break
                if not data.startswith(magic):
                    return
                reader = maker()
            while True:
                try:
                    got = reader.decompress(data, 1 << 20)
                except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
                    return
                if got:
                    yield got
                if reader.eof:
                    data = reader.unused_data
                    break
                data = getattr(reader, "unconsumed_tail", b"")
                if len(got) < 1 << 20:
                    break
            if not reader.eof:
                break


class _File:
    """Pieces of bytes as something to read from."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def read(self, n: int = -1) -> bytes:
        while n < 0 or len(self.held) < n:
            if (more := next(self.pieces, None)) is None:
                break
            self.held += more
        n = len(self.held) if n < 0 else n
        out, self.held = self.held[:n], self.held[n:]
        return out


def _frames(source: Iterator[bytes]) -> Iterator[bytes]:
    import zstandard

    reader = zstandard.ZstdDecompressor().stream_reader(_File(source), read_across_frames=True)
    try:
        while got := reader.read(1 << 20):
            yield got
    except zstandard.ZstdError:
        return  # what follows the last whole frame is no frame


def _format(head: bytes) -> str | None:
    return next((name for name, (magic, _) in _MAKERS.items() if head.startswith(magic)), None)


def _unpacked(raw: bytes, chain: list[str]) -> Iterator[bytes]:
    """The bytes under a chain of formats, piece by piece."""
    pieces = iter([raw])
    for name in chain:
        magic, maker = _MAKERS[name]
        pieces = _frames(pieces) if maker is None else _members(pieces, magic, maker)
    return pieces


def _broken(head: bytes) -> bool:
    """Whether the first bytes of a stream are none of it already."""
    name = _format(head)
    if name is None or _MAKERS[name][1] is None:
        return name is None
    try:
        _MAKERS[name][1]().decompress(head, 1 << 16)
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return True
    return False


def _decode(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _layers(raw: bytes, steps: tuple[str, ...], places: Callable[[int, int], tuple[int, int]] | None, whole: tuple[int, int]) -> Iterator[Layer]:
    """Layers of decoded bytes: as UTF-8, and without NULs if they look like wider characters.

    ``places`` gives the span of the bytes of a range; without it each has the whole one.
    """
    wide = [(raw.replace(b"\0", b""), (*steps, "utf-16"))] if _WIDE.search(raw) else []
    for data, path in [(raw, steps), *wide]:
        if not _WORTH.search(data):
            continue
        if places is None or data is not raw:
            yield constant(data.decode("utf-8", "replace"), whole, path)
            continue
        chars, spans, at = [], [], 0
        for char in data.decode("utf-8", "surrogateescape"):
            stray = 0xDC80 <= ord(char) <= 0xDCFF
            size = 1 if stray else len(char.encode())
            chars.append("\ufffd" if stray else char)
            spans.append(places(at, at + size))
            at += size
        yield Layer("".join(chars), *(np.array([x[n] for x in spans], np.int64) for n in (0, 1)), path)


def _inflated(raw: bytes, steps: tuple[str, ...], span: tuple[int, int], budget: Budget) -> Iterator[Layer]:
    """Layers of compressed bytes, of what is compressed in them, and so on; cycles end by digest.

    Bytes come in parts of PART that overlap by OVERLAP. Each level of nesting is read again from the
    outermost bytes, so no level is ever held in whole.
    """
    chain: list[str] = []
    seen, head = set(), raw[:8]
    while name := _format(head):
        chain.append(name)
        head, held, fresh, digest = b"", bytearray(), 0, hashlib.sha256()
        for got in _unpacked(raw, chain):
            if budget.left <= 0:
                budget.spent += 1
                break
            budget.left -= len(got)
            digest.update(got)
            head = head if len(head) >= 8 else (head + got)[:8]
            held += got
            fresh += len(got)
            if len(held) >= PART:
                yield from _layers(bytes(held), (*steps, *chain), None, span)
                held, fresh = held[-OVERLAP:], 0
        if digest.digest() in seen:
            return
        seen.add(digest.digest())
        if fresh:
            yield from _layers(bytes(held), (*steps, *chain), None, span)


def _base64(layer: Layer, budget: Budget) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        pieces = [(p.start(), p.end()) for p in _PIECE.finditer(layer.text, m.start(), m.end())]
        body = "".join(layer.text[a:b] for a, b in pieces).rstrip("=").replace("-", "+").replace("_", "/")
        if len(body) < 12:
            continue
        firsts = list(accumulate((b - a for a, b in pieces[:-1]), initial=0))  # where each piece starts in the body
        spans = [layer.span(a, b) for a, b in pieces]

        def piece(at, firsts=firsts):
            return bisect_right(firsts, at) - 1

        for shift in range(4):
            places = None
            if len(pieces) > 1:

                def places(a, b, shift=shift, spans=spans, piece=piece, last=len(body) - 1):
                    """The pieces that hold the characters of bytes a to b."""
                    return spans[piece(shift + a * 8 // 6)][0], spans[piece(min(shift + (b * 8 - 1) // 6, last))][1]

            yield from _layers(_decode(body[shift:]), (*layer.path, "base64"), places, (spans[0][0], spans[-1][1]))
        for found in _PACKED.finditer(body):
            at = found.start()
            if not _broken(_decode(body[at : at + 64])):
                yield from _inflated(_decode(body[at:]), (*layer.path, "base64"), (spans[piece(at)][0], spans[-1][1]), budget)


def _unwrapped(layer: Layer, budget: Budget) -> Iterator[Layer]:
    if layer.rounds == ROUNDS:
        yield from _settled(layer)
    elif layer.rounds < ROUNDS:
        if "%" in layer.text:
            yield from _url(layer)
        if "\\" in layer.text or "&#" in layer.text:
            yield from _unicode(layer)
    yield from _base64(layer, budget)


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, str, str]], int]:
    """Base spans; findings of unwrapped layers (start, end, kind, path, value); oversized layers.

    A layered finding is listed only where no finding of the same kind, in a layer before it, has
    the same span of the original; an equal finding of the text as it is does not count as new.
    """
    base = base_spans(text)
    known = {(a, b, kind) for a, b, kind in base}
    extra, budget = [], Budget()
    work, seen = [iter([Layer(text)])], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        whole = layer.span(0, len(layer.text))
        mark = hashlib.sha256(f"{whole}{layer.rounds >= ROUNDS}".encode() + layer.text.encode("utf-8", "surrogatepass")).digest()
        if mark in seen:
            continue
        seen.add(mark)
        if layer.path:
            for a, b, kind in base_spans(layer.text):
                s, e = layer.span(a, b)
                if (s, e, kind) not in known:
                    known.add((s, e, kind))
                    extra.append((s, e, kind, ">".join(layer.path), layer.text[a:b]))
        work.append(_unwrapped(layer, budget))
    return base, extra, budget.spent


def joined(spans) -> str:
    order = {kind: k for k, kind in enumerate(KINDS)}
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans, layered, oversized)`` of every row.

    Counts and ``base_sha256`` are of the text as it is; ``spans`` has those and the spans of what
    is found in unwrapped layers; ``layered`` lists the latter as kind:start:end:path. Null and
    empty texts hold nothing: counts 0, empty strings. Null ids and repeated rows stay as they are, an
    empty table gives an empty result, and only the two named columns are read.
    """
    schema = pa.schema([*[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("layered", pa.string()), ("oversized", pa.int64())])

    def make():
        def work(texts):
            out = {name: [] for name in schema.names}
            for text in texts:
                base, extra, oversized = scan(text)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + [s[:3] for s in extra]))
                out["layered"].append(",".join(f"{k}:{a}:{b}:{path}" for a, b, k, path, _ in extra))
                out["oversized"].append(oversized)
            return out

        return work

    return map_texts(docs, make, schema, id_col, text_col)


def redact_text(text: str, mark: str = "[{kind}]") -> str:
    """The text with every found span, merged where they overlap, replaced by a mark."""
    base, extra, _ = scan(text)
    out, at = [], 0
    merged: list[list] = []
    for a, b, kind in sorted(base + [s[:3] for s in extra]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[at:a], mark.format(kind=kind)]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows as they are, with secrets of the text column replaced; a null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact_text(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(releasing(run), docs.schema)
