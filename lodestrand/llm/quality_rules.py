"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback says how well it knows a text: the
characters that a token covers, the share of tokens that are bare bytes, and
the entropy of the tokens (a replacement character counts as a bare byte).  Where
it has the letters of a script but few longer pieces, so that random letters look
like words, a second vocabulary, of byte pairs, says how many characters its
tokens cover.  A word's script is that of its letters, so quotes and emoji do not
matter; words of private-use, unassigned or replacement characters alone have the
script none.  Each script has bands of these; a text outside its script's bands
is rejected, as is one that fails the plain counts.  Bands are parameters and the
same for every corpus, so a verdict depends on its text alone.  They lie between
what a declaration of human rights and random letters of each script measure;
random Georgian letters, which neither vocabulary tells from words, are kept.

Defined results: a null text has zero words, fails the plain counts and is not
kept, and so does an empty one; very long texts are counted whole; repeated
rows each give their row; an empty table gives an empty table; of other columns
just the named keys come along, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import functools
import itertools
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, configure, ragged, release, sums
from .textstats import Words, char_lengths, line_counts, repeated_words, symbol_counts

#: First code points of blocks of Unicode, with the script that they begin (fixed values).
SCRIPT_STARTS = (
    (0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"),
    (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "other"), (0x1780, "khmer"), (0x1800, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD7B0, "other"),
    (0x20000, "cjk"), (0x30000, "other"),
)
SCRIPTS = (*dict.fromkeys(name for _, name in SCRIPT_STARTS), "none")
NONE = len(SCRIPTS) - 1
REPLACEMENT = "\ufffd"


@dataclass(frozen=True)
class Band:
    """What a text of a script may measure.

    chars_per_token: least and most characters of a token.  byte_share: most of
    the tokens that may be bare bytes.  entropy: least bits a token, as a share
    of what as many tokens (at most entropy_tokens) could have, all different.
    second: least characters of a token of the second vocabulary (0: not asked).
    """

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float
    second: float = 0.0
    entropy_tokens: int = 256


BANDS = {
    "latin": Band((1.5, 12.0), 0.15, 0.45),
    "greek": Band((0.6, 8.0), 0.15, 0.35, 1.1),
    "cyrillic": Band((1.1, 10.0), 0.15, 0.4, 1.4),
    "armenian": Band((0.5, 6.0), 0.35, 0.3),
    "hebrew": Band((0.4, 6.0), 0.15, 0.3, 1.25),
    "arabic": Band((0.4, 6.0), 0.15, 0.3, 1.0),
    "indic": Band((0.3, 6.0), 0.4, 0.2),
    "thai": Band((0.4, 8.0), 0.3, 0.2, 0.8),
    "georgian": Band((0.5, 6.0), 0.35, 0.3),
    "khmer": Band((0.4, 6.0), 0.45, 0.2),
    "cjk": Band((0.4, 6.0), 0.4, 0.25),
    "other": Band((0.2, 12.0), 0.93, 0.2),  # scripts of which the vocabulary knows few letters or none
    "none": Band((1.5, 12.0), 0.15, 0.45),
}
#: Words kept with their tokens by a task before it starts afresh.
CACHE_WORDS = 300_000


def top_letter(word: str) -> int:
    """The highest code point of the letters of a word; -1 without letters, -2 if it has private-use, unassigned or replacement characters instead."""
    top = max((ord(c) for c in word if c.isalpha()), default=-1)
    if top < 0 and any(c == REPLACEMENT or unicodedata.category(c) in ("Co", "Cn", "Cs") for c in word):
        return -2
    return top


class Fertility:
    """Tokens of distinct words by a sentencepiece model with byte fallback, and how many a rank file of byte pairs gives those of the scripts asked."""

    def __init__(self, path: str, second: tuple[str, str] | None = None, asked: tuple[str, ...] = ()):
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pairs = None
        if second:
            with open(second[0], "rb") as lines:
                ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
            self.pairs = tiktoken.Encoding("second", pat_str=second[1], mergeable_ranks=ranks, special_tokens={})
        self.asked = np.array([s in asked for s in SCRIPTS])
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) or REPLACEMENT in self.model.id_to_piece(i) for i in range(self.size)])
        self.starts = np.array([s for s, _ in SCRIPT_STARTS])
        self.kinds = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.tokens = np.empty(0, dtype=np.int32)
        self.count = np.empty(0, dtype=np.int64)
        self.at = np.empty(0, dtype=np.int64)
        self.bare = np.empty(0, dtype=np.int64)
        self.script = np.empty(0, dtype=np.int8)
        self.second = np.empty((0, 2), dtype=np.int64)

    def places(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > CACHE_WORDS:
            self.clear()
        new = [w for w in words if w not in self.place]
        if new:
            text = [w.decode("utf-8", "replace") for w in new]
            got = self.model.encode(text, num_threads=1)
            count = np.array([len(x) for x in got], dtype=np.int64)
            flat = np.fromiter(itertools.chain.from_iterable(got), dtype=np.int32, count=int(count.sum()))
            top = np.array([top_letter(t) for t in text])
            script = np.select([top == -2, top == -1], [NONE, -1], self.kinds[np.searchsorted(self.starts, np.maximum(top, 0), side="right") - 1]).astype(np.int8)
            second = np.zeros((len(new), 2), dtype=np.int64)
            if self.pairs is not None:
                for i in np.flatnonzero(self.asked[script] & (script >= 0)).tolist():
                    second[i] = len(text[i]), len(self.pairs.encode_ordinary(" " + text[i]))
            self.at = np.concatenate([self.at, len(self.tokens) + np.cumsum(count) - count])
            self.tokens, self.count = np.concatenate([self.tokens, flat]), np.concatenate([self.count, count])
            self.bare = np.concatenate([self.bare, sums(self.is_byte[flat], count)])
            self.script, self.second = np.concatenate([self.script, script]), np.concatenate([self.second, second])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        return np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))


@functools.lru_cache(maxsize=1)
def _fertility(path: str, second: tuple[str, str] | None, asked: tuple[str, ...]) -> Fertility:
    """A worker's vocabularies; each task empties their words when it ends."""
    return Fertility(path, second, asked)


def entropies(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Bits a value of each run of values (each under size); 0 for an empty run."""
    doc = np.repeat(np.arange(len(counts)), counts)
    keys, n = np.unique(doc * size + values, return_counts=True)
    weigh = np.bincount(keys // size, weights=n * np.log2(n), minlength=len(counts))
    total = np.maximum(counts, 1)
    return np.log2(total) - weigh / total


def measure(texts: list[str], fertility: Fertility, w: Words | None = None) -> dict[str, np.ndarray]:
    """Every count of the rules, an array with a place for each text."""
    w = w or Words(texts)
    at = fertility.places(w.distinct)
    each = fertility.count[at][w.numbers]
    tokens = sums(each, w.counts)
    chars = w.by_word(char_lengths(w.distinct)) if w.distinct else np.zeros(len(texts), dtype=np.int64)
    flat = fertility.tokens[ragged(fertility.at[at][w.numbers], each)].astype(np.int64)
    letters, pairs = (w.by_word(fertility.second[at, i]) if w.distinct else np.zeros(len(texts)) for i in (0, 1))
    weight = np.zeros((len(texts), len(SCRIPTS)))
    if w.total:
        script = fertility.script[at][w.numbers]
        np.add.at(weight.reshape(-1), (w.doc * len(SCRIPTS) + script)[script >= 0], 1.0)
    return {
        "n_words": w.counts,
        "word_chars": chars,
        "n_symbols": symbol_counts(texts),
        "n_dup_lines": line_counts(texts)[1],
        "n_repeat_words": repeated_words(w),
        "n_tokens": tokens,
        "chars_per_token": chars / np.maximum(tokens, 1),
        "byte_share": w.by_word(fertility.bare[at]) / np.maximum(tokens, 1) if w.distinct else np.zeros(len(texts)),
        "token_entropy": entropies(flat, tokens, fertility.size),
        "second_chars": np.where(pairs > 0, letters / np.maximum(pairs, 1), np.nan),
        "script": weight.argmax(axis=1),
    }


def judge(got: dict[str, np.ndarray], bands: dict[str, Band], min_words: int, repeat_share: float) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (got["n_words"] < min_words) | (100 * got["n_repeat_words"] > repeat_share * got["n_words"])
    parts = (lambda b: b.chars_per_token[0], lambda b: b.chars_per_token[1], lambda b: b.byte_share, lambda b: b.entropy, lambda b: b.second, lambda b: b.entropy_tokens)
    low, high, byte, entropy, second, cap = (np.array([f(bands[s]) for s in SCRIPTS])[got["script"]] for f in parts)
    fit = (got["chars_per_token"] >= low) & (got["chars_per_token"] <= high) & (got["byte_share"] <= byte)
    fit &= got["token_entropy"] >= entropy * np.log2(np.maximum(np.minimum(got["n_tokens"], cap), 1))
    fit &= ~(got["second_chars"] < second)  # not a number where the second vocabulary was not asked
    return failed, ~failed & fit


def rate(df: DataFrame, path: str, second: tuple[str, str] | None = None, keys: Sequence[str] = ("doc_id",), text: str = "text", bands: dict[str, Band] | None = None, min_words: int = 50, repeat_share: float = 50) -> DataFrame:
    """A row per text: the keys, the counts, what the vocabulary measures, script, base_failed and kept.

    path: sentencepiece model with byte fallback, readable on every executor.
    second: rank file of a byte-pair vocabulary, likewise, and its pattern.
    repeat_share: percent of words in repeated three-word windows that fails a text.
    """
    configure(df.sparkSession)
    bands = bands or BANDS
    keys = list(keys)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]
    asked = tuple(s for s in SCRIPTS if bands[s].second > 0)
    reals = ["chars_per_token", "byte_share", "token_entropy", "second_chars"]
    names = [*keys, *longs, *reals, "script", "base_failed", "kept"]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(c, T.LongType()) for c in longs] + [T.StructField(c, T.DoubleType()) for c in reals] + [T.StructField("script", T.StringType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = _fertility(path, second, asked)
        for batch, texts in chunks(batches, text):
            got = measure(texts, fertility)
            failed, kept = judge(got, bands, min_words, repeat_share)
            columns = [pa.array(got[c].astype(np.int64)) for c in longs] + [pa.array(got[c], from_pandas=True) for c in reals]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns, pa.array([SCRIPTS[i] for i in got["script"]]), pa.array(failed), pa.array(kept)], names=names)
        fertility.clear()
        release()

    return df.select(*keys, text).mapInArrow(run, schema)
