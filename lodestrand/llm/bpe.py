"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a part of the corpus lie one after another in one array
of symbols.  An inverted index holds, for each rank, the places whose token
pair merges into that rank; ranks are replayed in order over the whole part at
once, and a merge touches its two neighbours only, whose new pairs go into the
index.  This equals merging each piece by itself, lowest rank and leftmost
first, which is what the tiktoken library does.

Defined results: a null text encodes as an empty text (no ids); an empty text
gives an empty array; very long texts are encoded whole; repeated rows each
give their row; an empty table gives an empty table; all other columns pass
through as they are, but for one that has the output's name: the output takes
its place.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbering, chunks, configure, ragged, release, sums

#: Unicode white space; the regex module's \s has the same members but for no guarantee.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces kept with their ids by a task before it starts afresh, and ranks of pairs.
CACHE_PIECES, CACHE_PAIRS = 300_000, 500_000


class Vocabulary:
    """Ranks of a vocabulary file, with tables for the replay."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens: dict[int, bytes] = {r: t for t, r in self.ranks.items()}
        top = max(self.tokens) + 1
        self.size = top
        body = [self.tokens.get(i, b"") for i in range(top)]
        self.token_len = np.array([len(t) for t in body], dtype=np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(body), dtype=np.uint8)
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.first_pairs = np.full(65536, -1, dtype=np.int64)
        for t, r in self.ranks.items():
            if len(t) == 2:
                self.first_pairs[t[0] * 256 + t[1]] = r
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
        self.pair_rank: dict[int, int] = {}

    def pair(self, left: int, right: int) -> int:
        """Rank of two tokens in a row, or -1."""
        key = left * self.size + right
        got = self.pair_rank.get(key)
        if got is None:
            if len(self.pair_rank) > CACHE_PAIRS:
                self.pair_rank.clear()
            got = self.pair_rank[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return got


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def replay(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and how many each has; no piece is empty."""
    if not pieces:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
    n = len(data)
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    start = np.cumsum(size) - size
    whole = np.array([v.ranks.get(p, -1) for p in pieces], dtype=np.int64)
    live = np.repeat(whole < 0, size)

    after = np.arange(1, n + 1)
    after[start + size - 1] = -1
    before = np.arange(-1, n - 1)
    before[start] = -1
    rank = np.full(n, -1, dtype=np.int64)
    rank[:-1] = v.first_pairs[data[:-1] * 256 + data[1:]]
    rank[after < 0] = -1
    rank[~live] = -1
    places = np.flatnonzero(rank >= 0)
    order = places[np.argsort(rank[places], kind="stable")]
    values, at = np.unique(rank[order], return_index=True)
    index = {int(r): part.tolist() for r, part in zip(values, np.split(order, at[1:]), strict=True)} if len(values) else {}
    queue = [int(r) for r in values]  # sorted, so a heap

    symbol, nxt, prv = v.byte_rank[data].tolist(), after.tolist(), before.tolist()
    known, pair, push, pop, wide = v.pair_rank, v.pair, heapq.heappush, heapq.heappop, v.size
    while queue:
        r = pop(queue)
        todo = index.pop(r)
        todo.sort()
        for k, i in enumerate(todo):
            j = nxt[i]
            a = symbol[i]
            if a < 0 or j < 0:
                continue
            q = known.get(a * wide + symbol[j])
            if (pair(a, symbol[j]) if q is None else q) != r:
                continue
            m, p = nxt[j], prv[i]
            symbol[i], symbol[j], nxt[i] = r, -1, m
            again = False
            if m >= 0:
                prv[m] = i
                q = known.get(r * wide + symbol[m])
                if q is None:
                    q = pair(r, symbol[m])
                if q >= 0:
                    again = q <= r
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        push(queue, q)
            if p >= 0:
                q = known.get(symbol[p] * wide + r)
                if q is None:
                    q = pair(symbol[p], r)
                if q >= 0:
                    again = again or q <= r
                    if q in index:
                        index[q].append(p)
                    else:
                        index[q] = [p]
                        push(queue, q)
            if again:  # a pair of no higher rank came up: it goes before what is left here
                if left := todo[k + 1 :]:
                    if r in index:
                        index[r] += left
                    else:
                        index[r] = left
                        push(queue, r)
                break
    out = np.array(symbol, dtype=np.int64)
    keep = out >= 0
    keep[~live] = False
    lone = start[whole >= 0]
    out[lone], keep[lone] = whole[whole >= 0], True
    return out[keep], sums(keep.astype(np.int64), size)


class Encoder:
    """Texts to ids; keeps the ids of pieces it has met, within a bound."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.v.pair_rank.clear()
        self.numbers = Numbering()
        self.ids = np.empty(0, dtype=np.int32)
        self.count = np.empty(0, dtype=np.int64)
        self.at = np.empty(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if len(self.numbers) > CACHE_PIECES:
            self.clear()
        find, number = self.v.pattern.findall, self.numbers.__getitem__
        old = len(self.numbers)
        found: list[np.ndarray] = []
        for t in texts:
            found.append(np.fromiter(map(number, find(t)), dtype=np.int64))
        if len(self.numbers) > old:
            new = [p.encode("utf-8", "surrogatepass") for p in itertools.islice(self.numbers, old, None)]
            ids, count = replay(self.v, new)
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])
            self.ids, self.count = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.count, count])
        pieces = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        each = self.count[pieces]
        return self.ids[ragged(self.at[pieces], each)], sums(each, np.array([len(f) for f in found], dtype=np.int64))


@functools.lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Encoder:
    """A worker's encoder; each task empties it when it ends."""
    return Encoder(vocabulary(path, pattern))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=kind))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with an array<int> column of token ids; text is dropped, the rest stays.

    path: a rank file (base64 token, rank), readable on every executor.
    pattern: splits texts into pieces that are merged separately.
    """
    configure(df.sparkSession)
    rest = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch, texts in chunks(batches, text):
            ids, counts = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [_lists(ids, counts, pa.int32())], names=[*rest, out])
        encoder.clear()
        release()

    return df.select(*rest, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a binary column of the bytes that the ids stand for; all other columns stay.

    Null ids give empty bytes; an id that the vocabulary lacks is an error.
    """
    configure(df.sparkSession)
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.BinaryType())])
    asked = [*rest, F.col(ids).alias("_ids")] if ids == out else rest
    held = "_ids" if ids == out else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            column = batch.column(held)
            flat = np.asarray(column.flatten(), dtype=np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= v.size):
                raise ValueError("an id is not in the vocabulary")
            counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
            size = v.token_len[flat]
            body = v.token_bytes[ragged(v.token_at[flat], size)]
            ends = np.concatenate(([0], np.cumsum(sums(size, counts)))).astype(np.int32)
            decoded = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), decoded], names=[*rest, out])
        release()

    return df.select(*asked).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, hex digests of the ids' decimals and of the decoded bytes."""
    both = decode(encode(docs.select("doc_id", "text"), path, pattern), path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
