"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of that text. A
document is parsed greedily into longest matches against each automaton; the number of phrases,
times log2 of the automaton's text length, over the document's length estimates its cross entropy
in bits a character, so languages with unequal text compare. The language with the least wins.

An automaton is laid out as a double array: a state is an offset, its move by a character stands at
offset plus character, and names the state that it belongs to. So it takes eight bytes a move (at most
three moves a character of its text) and a row of the alphabet for the root, whatever the language's
number of characters. A failing move counts a phrase and goes on from the root; many stretches of text
walk side by side, so a step is a few numpy operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.llm.common import map_texts

#: Documents longer than this are walked as stretches of it; each stretch begins with a new phrase.
STRETCH = 512


def codes(text: str) -> np.ndarray:
    """Code points of the text in lower case, with every run of other than letters as one space."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(raw, 0xFFFF)
    letters = _letters()[small] | (raw > 0xFFFF)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    return np.where(letters, small, 32)[keep].astype(np.uint16)


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() or 0x300 <= c < 0x370 for c in range(0x10000)]))
    return _LETTERS[0]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


def double_array(moves: list[dict[int, int]], width: int) -> np.ndarray:
    """Moves of an automaton at ``offset + character``: the owner's offset in the upper 32 bits, below it
    the next state's offset times 4 plus the phrases that end.

    Offsets are unique, the root's is 0, and its row has every character, those that it knows not too:
    they end one phrase and lead back to it. Entries of no move have an owner that no state has.
    """
    order = sorted(range(1, len(moves)), key=lambda k: -len(moves[k]))
    size = 4 * width + 2 * sum(map(len, moves)) + len(moves)
    used = bytearray(b"\1" * width + b"\0" * (size - width))
    taken = bytearray(size)
    taken[0] = 1
    offset = [0] * len(moves)
    start: dict[int, int] = {}  # where the search for a state of so many moves goes on
    for k in order:
        own = sorted(moves[k])
        n = min(len(own), 8)
        if not own:
            at = start[n] = taken.index(0, start.get(n, width))
        else:
            place, tries = start.get(n, width) - 1, -1
            while True:
                place, tries = used.index(0, place + 1), tries + 1
                if place + 2 * width > len(used):
                    used.extend(bytes(len(used)))
                    taken.extend(bytes(len(taken)))
                at = place - own[0]
                if at >= 0 and not taken[at] and not any([used[at + c] for c in own]):
                    break
            # one move fits wherever a place is free; of more, what fitted badly is passed over from now on
            start[n] = place if n == 1 or tries > 16 else start.get(n, width)
        offset[k], taken[at] = at, 1
        for c in own:
            used[at + c] = 1
    owner = np.full(max(offset) + width, -1, np.int64)
    to = np.zeros(len(owner), np.int64)
    owner[:width], to[:width] = 0, 1
    for k, own in enumerate(moves):
        for c, q in own.items():
            owner[offset[k] + c], to[offset[k] + c] = offset[k], offset[q] * 4
    return (owner << 32) | to


class Parser:
    """The automata of all languages over one alphabet."""

    def __init__(self, texts: dict[str, list[int]]):
        self.langs = sorted(texts)
        times: dict[int, int] = {}
        for text in texts.values():
            for c in text:
                times[c] = times.get(c, 0) + 1
        symbols = sorted(times, key=lambda c: (-times[c], c))
        self.width = len(symbols) + 1  # 0 is any other character
        self.code = np.zeros(0x10000, np.int32)
        self.code[symbols] = np.arange(1, len(symbols) + 1)
        self.tables, self.fails, self.bits = [], [], []
        for lang in self.langs:
            moves = suffix_automaton([int(self.code[c]) for c in texts[lang]])
            table = double_array(moves, self.width)
            # a failing move ends a phrase and begins one from the root, unless the root fails too
            fail = (table[: self.width] & 0xFFFFFFFF) + 1
            self.tables.append(table)
            self.fails.append(fail)
            self.bits.append(float(np.log2(len(texts[lang]) + 1)))

    @property
    def nbytes(self) -> int:
        return self.code.nbytes + sum(t.nbytes for t in (*self.tables, *self.fails))

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each part by language; the parts are walked side by side, long ones first."""
        out = np.zeros((len(parts), len(self.langs)), np.int64)
        lengths = np.array([len(p) for p in parts])
        order = np.argsort(-lengths, kind="stable")
        grid = np.zeros((int(lengths.max(initial=0)), len(parts)), np.int32)
        for col, k in enumerate(order):
            grid[: lengths[k], col] = self.code[parts[k]]
        active = np.searchsorted(-lengths[order], -np.arange(len(grid)), side="left")
        for n, (table, fail) in enumerate(zip(self.tables, self.fails, strict=True)):
            state, count = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
            for row, m in zip(grid, active, strict=True):
                step = table[state[:m] + row[:m]]
                step = np.where(step >> 32 == state[:m], step & 0xFFFFFFFF, fail[row[:m]])
                count[:m] += step & 3
                state[:m] = step >> 2
            out[order, n] = count + (state > 0)  # the end cuts off a phrase that has begun
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character by language, and the number of characters walked, for each text."""
        walked = [codes(t) for t in texts]
        parts = [w[i : i + STRETCH] for w in walked for i in range(0, len(w), STRETCH)]
        owner = np.repeat(np.arange(len(texts)), [-(-len(w) // STRETCH) for w in walked])
        total = np.zeros((len(texts), len(self.langs)))
        if parts:
            np.add.at(total, owner, self.phrases(parts))
        n = np.array([len(w) for w in walked])
        return total * np.array(self.bits) / np.maximum(n, 1)[:, None], n


def sample(docs: DataFrame, max_chars: int, chunk: int, id_col: str, text_col: str, lang_col: str) -> dict[str, list[int]]:
    """Text to learn from: up to ``max_chars`` characters a language, from rows chosen by hash.

    Different texts of a language are taken in proportion by a threshold on their hash, so about
    ``2 * max_chars / chunk`` come to the driver, each with one stretch of ``chunk`` characters from a
    hash-chosen place. Equal texts count once, before they are gathered, however many there are.
    """
    text = F.col(text_col).cast("string")
    labelled = docs.where(F.col(lang_col).isNotNull() & (F.length(text) > 0)).select(F.col(lang_col).cast("string").alias("lang"), text.alias("t"), F.xxhash64(F.lit("lang"), text).alias("h"))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}
    if not counts:
        return {}
    want = -(-2 * max_chars // chunk)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, want / max(n, 1))).otherwise(share)
    unit = F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    start = (F.pmod(F.shiftright("h", 20), F.greatest(F.length("t") - chunk, F.lit(0)) + 1) + 1).cast("int")
    rows = labelled.where(unit < share).select("lang", "h", F.substring(F.col("t"), start, F.lit(chunk)).alias("t")).distinct().collect()
    texts: dict[str, list[int]] = {}
    for lang, _, text in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        own = texts.setdefault(lang, [])
        if len(own) < max_chars:
            own.extend([int(c) for c in codes(text)[: max_chars - len(own)]] + [32])
    return {lang: text for lang, text in texts.items() if len(text) > 1}


def identify(docs: DataFrame, train: DataFrame, max_chars: int = 24_000, chunk: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, lang_pred, score)`` of every row of ``docs``, learnt from the labelled rows of ``train``.

    ``score`` is 0.5 to 1: the second-best entropy's share of the best two (1 with one language).
    Texts that are null or have no letter, and all texts if nothing was learnt, are ``und``, score 0.
    Equal entropies go to the first language by name. The sample that is learnt from is bounded by
    ``max_chars`` a language; with over 16 languages the bound is shared among them. The automata that
    all tasks get take about 40 to 60 bytes a character of the sample. Null ids and repeated rows stay as
    they are, an empty table gives an empty result, and only the named columns are read.
    """
    texts = sample(train, max_chars, chunk, id_col, text_col, lang_col)
    if len(texts) > 16:
        texts = {lang: text[: max(1000, 16 * max_chars // len(texts))] for lang, text in texts.items()}
    model = docs.sparkSession.sparkContext.broadcast(Parser(texts))
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def make():
        parser: Parser = model.value

        def work(batch):
            out = {"lang_pred": [], "score": []}
            bits, n = parser.entropies(batch)
            for k, text in enumerate(batch):
                if not n[k] or not parser.langs or not any(map(str.isalpha, text)):
                    out["lang_pred"].append("und")
                    out["score"].append(0.0)
                    continue
                best, *rest = np.argsort(bits[k], kind="stable")
                out["lang_pred"].append(parser.langs[best])
                out["score"].append(float(bits[k][rest[0]] / (bits[k][best] + bits[k][rest[0]])) if rest else 1.0)
            return out

        return work

    return map_texts(docs, make, schema, id_col, text_col, carry=keep)


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves ``fold`` by ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
