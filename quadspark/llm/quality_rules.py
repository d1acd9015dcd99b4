"""Quality rules from tokeniser fertility.

Public vocabularies measure each text: characters per token under a byte-level BPE, the share of
tokens that a piece vocabulary can only spell as raw bytes, and the entropy of the text's piece
distribution. A text goes when a measure leaves the band of its kind: its main script, its stated
language and its length class (a power of four of words), as entropy and fertility go with all three.

Bands come from the documents themselves. Over the texts of a kind that pass the base rules, a band is
the median and ``spread`` robust standard deviations (the quartiles' distance by 1.349) to both sides,
so that junk under a quarter of a kind does not move it. A band is mixed with a fixed, wide one of the
script, which counts as PRIOR texts: rare kinds have wide bands, at every size of the table.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadspark.llm.common import WORD, map_texts
from quadspark.scratch import Scratch


#: Texts that a script's fixed band counts as.
PRIOR = 20
#: Kinds of text that are joined by broadcast, at most.
HOT = 10_000
#: Robust standard deviations to both sides of the median, and the least of one for each measure.
SPREAD = 3.5
LEAST = {"chars_per_token": 0.08, "byte_share": 0.01, "token_entropy": 0.02}
#: Width of the bins that each measure is counted in.
WIDTH = {"chars_per_token": 0.005, "byte_share": 0.001, "token_entropy": 0.001}


@dataclass(frozen=True)
class Band:
    """What a script's texts keep to: characters per token, byte-fallback share, token entropy.

    Entropy is in bits per token as a share of what it could be: log2 of the number of tokens, or
    8 bits if that is less, as a long text's entropy levels off at that of its language.
    """

    chars_low: float
    chars_high: float
    bytes_high: float
    entropy_low: float
    entropy_high: float = 2.0


#: Script: range of code points (first, last) of its letters.
SCRIPTS = {
    "latin": r"A-Za-z\u00C0-\u024F\u1E00-\u1EFF",
    "cyrillic": r"\u0400-\u052F",
    "greek": r"\u0370-\u03FF\u1F00-\u1FFF",
    "arabic": r"\u0600-\u06FF\u0750-\u077F",
    "hebrew": r"\u0590-\u05FF",
    "indic": r"\u0900-\u0DFF",
    "cjk": r"\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF",
}
#: The fixed bands. Letters of no script above have the band "other", texts without letters "none".
BANDS = {
    "latin": Band(1.75, 8.0, 0.10, 0.60),
    "cyrillic": Band(0.6, 5.0, 0.10, 0.45),
    "greek": Band(0.4, 4.0, 0.30, 0.40),
    "arabic": Band(0.4, 4.0, 0.40, 0.40),
    "hebrew": Band(0.4, 4.0, 0.60, 0.40),
    "indic": Band(0.2, 4.0, 0.95, 0.30),
    "cjk": Band(0.25, 4.0, 0.70, 0.35),
    "other": Band(0.2, 8.0, 0.95, 0.30),
    "none": Band(2.0, 8.0, 0.10, 0.60),
}

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORDS = re.compile(WORD)


def main_script(text: str, patterns: dict[str, re.Pattern]) -> str:
    """The script with most letters; ties go to the first of SCRIPTS, texts without a letter are "none"."""
    if text.isascii():
        return "latin" if patterns["latin"].search(text) else "none"
    counts = {name: sum(map(len, p.findall(text))) for name, p in patterns.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other" if any(map(str.isalpha, text)) else "none"


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated windows of three."""
    words = _WORDS.findall(text)
    n = len(words)
    seen: set[str] = set()
    n_dup = 0
    for line in text.split("\n"):
        if _WORDS.search(line):
            n_dup += line in seen
            seen.add(line)
    covered = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        hit = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
        cover = np.zeros(n, bool)
        for shift in range(3):
            cover[shift : shift + len(hit)] |= hit
        covered = int(cover.sum())
    return n, sum(map(len, words)), len(_SYMBOLS.findall(text)), n_dup, covered


def measures(docs: DataFrame, bpe_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``(id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, script,
    chars_per_token, byte_share, token_entropy)`` of every row, in one pass without a shuffle.

    A null or empty text has no words, so it fails the base rules; its measures are null.
    """
    bpe_path = bpe_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    piece_path = piece_path or public_tokenizers.path("piece_bpe_32k.model")
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    doubles = ["chars_per_token", "byte_share", "token_entropy"]
    schema = pa.schema([(c, pa.int64()) for c in longs] + [("base_failed", pa.bool_()), ("script", pa.string())] + [(c, pa.float64()) for c in doubles])

    def make():
        import sentencepiece
        import tiktoken

        from quadspark.llm.bpe import read_ranks

        bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(bpe_path), special_tokens={})
        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        is_byte = np.array([pieces.is_byte(i) for i in range(pieces.vocab_size())])
        patterns = {name: re.compile(f"[{chars}]+") for name, chars in SCRIPTS.items()}

        def measure(text: str) -> tuple[float, float, float]:
            ids = np.array(pieces.encode(text, num_threads=1), np.int64)
            counts = np.bincount(ids)
            p = counts[counts > 0] / len(ids)
            entropy = float(-(p * np.log2(p)).sum() / min(np.log2(len(ids)), 8.0)) if len(ids) > 1 else 1.0
            return len(text) / len(bpe.encode_ordinary(text)), float(is_byte[ids].mean()), entropy

        def work(texts):
            out = {name: [] for name in schema.names}
            for text in texts:
                base = base_rules(text)
                failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
                measured = measure(text) if base[0] else (None, None, None)
                for name, value in zip(schema.names, (*base, failed, main_script(text, patterns), *measured), strict=True):
                    out[name].append(value)
            return out

        return work

    lang = F.lit("") if lang_col is None or lang_col not in docs.columns else F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    return map_texts(docs.select(F.col(id_col), F.col(text_col).alias("__text"), lang.alias("__lang")), make, schema, id_col, "__text", carry=("__lang",))


def length_class() -> Column:
    """The power of four at or under a text's number of words, from its binary digits."""
    return F.floor((F.length(F.bin(F.greatest(F.col("n_words"), F.lit(1)))) - 1) / 2).cast("int")


def _fixed(bands: dict[str, Band], edge: str) -> Column:
    """An edge of the fixed band of the row's script."""
    out = F.lit(float(getattr(bands["other"], edge)))
    for script, band in bands.items():
        out = F.when(F.col("script") == script, F.lit(float(getattr(band, edge)))).otherwise(out)
    return out


def calibrated(rows: DataFrame, bands: dict[str, Band], spread: float = SPREAD) -> DataFrame:
    """``(script, __lang, length, n, <measure>_low, <measure>_high)`` of each kind of text among ``rows``.

    Measures are counted in bins of WIDTH, task by task and then in all, so a kind that holds most rows
    is a few thousand numbers wherever they meet; quartiles are those of the counts, at middles of bins.
    """
    edges = {"chars_per_token": ("chars_low", "chars_high"), "byte_share": (None, "bytes_high"), "token_entropy": ("entropy_low", "entropy_high")}
    kind = ["script", "__lang", "length"]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) / WIDTH[m]).alias("bin")) for m in edges])).alias("x")
    bins = rows.where(~F.col("base_failed")).select("script", "__lang", length_class().alias("length"), each)
    bins = bins.groupBy(*kind, F.col("x.measure").alias("measure"), F.col("x.bin").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    within = Window.partitionBy(*kind, "measure")
    upto = F.sum("c").over(within.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = bins.withColumn("upto", upto).withColumn("n", F.sum("c").over(within))
    at = lambda m, q: F.min(F.when((F.col("measure") == m) & (F.col("upto") >= F.col("n") * q), F.col("bin")))
    quartiles = [F.array(*[(at(m, q) + 0.5) * WIDTH[m] for q in (0.25, 0.5, 0.75)]).alias(f"q_{m}") for m in edges]
    found = placed.groupBy(*kind).agg(F.first("n").alias("n"), *quartiles)
    out = []
    for measure, (low, high) in edges.items():
        q = F.col(f"q_{measure}")
        width = spread * F.greatest((q[2] - q[0]) / 1.349, F.lit(LEAST[measure]))
        mixed = lambda own, fixed: (F.col("n") * own + PRIOR * _fixed(bands, fixed)) / (F.col("n") + PRIOR)
        out.append((mixed(q[1] - width, low) if low else F.lit(0.0)).alias(f"{measure}_low"))
        out.append(mixed(q[1] + width, high).alias(f"{measure}_high"))
    return found.select("script", "__lang", "length", "n", *out)


def fertility(docs: DataFrame, bands: dict[str, Band] | None = None, spread: float = SPREAD, bpe_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Base counts, measures and verdict of every row.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed`` (under 50
    words, or over half of the words in repeated windows), ``kept`` (false if base_failed, else
    whether all measures are within the band of the text's kind), ``script, chars_per_token, byte_share,
    token_entropy``. A null or empty text has no words, so it fails; its measures are null. A null
    language is a language of its own, and so is a missing column. A null id and repeated rows stay as
    they are; an empty table gives an empty result. Only the named columns are read.
    """
    scratch = Scratch(docs.sparkSession, "fertility")
    rows = scratch.save(measures(docs, bpe_path, piece_path, id_col, text_col, lang_col), "measures")
    limits = calibrated(rows, bands or BANDS, spread)
    limits = scratch.save(limits, "bands")
    kind = ["script", "__lang", "length"]
    passed = rows.where(~F.col("base_failed")).withColumn("length", length_class())
    # kinds with a share of 1 / HOT of all rows or more are HOT at most, so they go to all tasks and no
    # task gets all rows of one; the others are joined
    few = F.broadcast(limits.where(F.col("n") >= rows.count() // HOT + 1))
    judged = passed.join(few, kind).unionByName(passed.join(few.select(*kind), kind, "left_anti").join(limits, kind))
    within = [F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")) for m in LEAST]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    shown = lambda df, kept: df.select(F.col(id_col), *names, kept.alias("kept"), "script", "chars_per_token", "byte_share", "token_entropy")
    return shown(judged, within[0] & within[1] & within[2]).unionByName(shown(rows.where("base_failed"), F.lit(False)))
