"""Counts of whole texts that the quality operators share, worked out in numpy arrays.

All texts of a chunk are held as one array of word numbers, so that the cost
is a few array operations a word, whatever the lengths of the texts.
"""

from __future__ import annotations

import numpy as np

from .common import Numbering, sums, words_of

SYMBOLS = "#*$%&|<>"


class Words:
    """The words of some texts: numbers (place in distinct), and how many each text has."""

    def __init__(self, texts: list[str], lower: bool = False):
        found, self.counts = words_of(texts, lower)
        numbers = Numbering()
        self.numbers = np.fromiter(map(numbers.__getitem__, found), dtype=np.int64, count=len(found))
        self.distinct: list[bytes] = list(numbers)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.total = len(found)
        self.docs = len(texts)

    def text(self, i: int) -> str:
        return self.distinct[i].decode("utf-8", "replace")

    def by_word(self, values: np.ndarray) -> np.ndarray:
        """Sum over each text's words of a value that each distinct word has."""
        return sums(values[self.numbers], self.counts)


def char_lengths(words: list[bytes]) -> np.ndarray:
    """Code points of each word: bytes that do not continue another."""
    if not words:
        return np.empty(0, dtype=np.int64)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    return sums((flat & 0xC0) != 0x80, np.array([len(w) for w in words], dtype=np.int64))


def ascii_strip(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r")


def symbol_counts(texts: list[str]) -> np.ndarray:
    return np.array([sum(map(t.count, SYMBOLS)) for t in texts], dtype=np.int64)


def line_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those of them equal to an earlier one."""
    n, dup = np.empty(len(texts), dtype=np.int64), np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if ascii_strip(x)]
        n[i], dup[i] = len(lines), len(lines) - len(set(lines))
    return n, dup


def repeated_words(w: Words, size: int = 3) -> np.ndarray:
    """Words of each text that lie in windows of size words found twice or more in it."""
    n = w.total
    if n < size:
        return np.zeros(w.docs, dtype=np.int64)
    m = n - size + 1
    inside = w.doc[:m] == w.doc[size - 1 :]
    key, span = w.numbers[:m], len(w.distinct)
    for k in range(1, size):  # pairs of numbers are renumbered before they outgrow 63 bits
        if span * len(w.distinct) >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            span = len(values)
        key, span = key * len(w.distinct) + w.numbers[k : m + k], span * len(w.distinct)
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]  # within a key, texts stay together
    same = (key[order[1:]] == key[order[:-1]]) & (w.doc[order[1:]] == w.doc[order[:-1]])
    again = np.zeros(len(order), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(n, dtype=bool)
    hit = order[again]
    for k in range(size):
        covered[hit + k] = True
    return sums(covered, w.counts)
