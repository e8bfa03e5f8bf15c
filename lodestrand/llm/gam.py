"""Quality classifier: a generalised additive model with pairwise interactions.

Counts of a text become features; each feature is cut into bins, and cyclic
boosting of shallow trees on one feature at a time (then on chosen pairs of
features) leaves a table of scores per bin.  A text's score is the sum of one
table entry per feature and per pair, added for all rows at once.

Defined results: a null text counts as an empty one, and both are scored by
their (all zero) counts; very long texts are counted whole; repeated rows each
give their row; rows that share a key count once in training; an empty table
gives an empty table; where no labelled row can be learnt from, every score is
0.5; of other columns just the key comes along, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, configure, fold, sums
from .textstats import Words, char_lengths, line_counts, repeated_words, symbol_counts

#: Labelled rows that training uses at most, those of least hash.
TRAINING_ROWS = 20_000
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "variety", "upper", "digits", "shouts", "stops", "bare", "line_words", "short", "capitals", "top_word", "longest", "entropy", "non_ascii")


def _table(members: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[[ord(c) for c in members]] = 1
    return out


def features(texts: list[str]) -> np.ndarray:
    """A row of features for each text; an empty text has zeros."""
    w = Words(texts)
    n = np.maximum(w.counts, 1)
    out = np.zeros((len(texts), len(FEATURES)))
    if not w.total:
        return out
    size = np.array([len(x) for x in w.distinct], dtype=np.int64)
    flat = np.frombuffer(b"".join(w.distinct), dtype=np.uint8)
    start = np.cumsum(size) - size
    upper = (flat >= 65) & (flat <= 90)
    upper[1:] |= (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E)
    letter = upper | ((flat >= 97) & (flat <= 122)) | (flat >= 0xC0)
    chars = char_lengths(w.distinct)
    of = lambda mask: sums(mask, size)
    letters, uppers = of(letter), of(upper)
    total = np.maximum(w.by_word(chars), 1)
    key = w.doc * len(w.distinct) + w.numbers
    keys, times = np.unique(key, return_counts=True)
    owner = keys // len(w.distinct)
    kinds = np.bincount(owner, minlength=w.docs)
    top = np.zeros(w.docs)
    np.maximum.at(top, owner, times)
    lines, dup = line_counts(texts)
    last = flat[start + size - 1]
    longest = np.zeros(w.docs)
    np.maximum.at(longest, owner, chars[keys % len(w.distinct)])
    out[:, 0] = np.log1p(w.counts)
    out[:, 1] = total / n
    out[:, 2] = symbol_counts(texts) / n
    out[:, 3] = dup / np.maximum(lines, 1)
    out[:, 4] = repeated_words(w) / n
    out[:, 5] = np.log1p(kinds) / np.log1p(n)
    out[:, 6] = w.by_word(uppers) / np.maximum(w.by_word(letters), 1)
    out[:, 7] = w.by_word(of((flat >= 48) & (flat <= 57))) / total
    out[:, 8] = w.by_word(of(_table("!?")[flat])) / n
    out[:, 9] = w.by_word(_table(".,;:")[last]) / n
    out[:, 10] = w.by_word((letters == 0).astype(np.int64)) / n
    out[:, 11] = np.log1p(w.counts / np.maximum(lines, 1))
    out[:, 12] = w.by_word((chars <= 3).astype(np.int64)) / n
    out[:, 13] = w.by_word(upper[start].astype(np.int64)) / n
    out[:, 14] = top / n
    out[:, 15] = np.log1p(longest)
    out[:, 16] = np.log2(n) - np.bincount(owner, weights=times * np.log2(times), minlength=w.docs) / n
    out[:, 17] = w.by_word(of(flat >= 0xC0)) / total
    out[w.counts == 0] = 0
    return out


@dataclass
class Model:
    """Bin edges and score tables; pairs have coarser bins, each a run of the fine ones."""

    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The bin of each value; a missing one counts as 0."""
        x = np.nan_to_num(x)
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), dtype=np.int64)

    def margins(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.prior)
        for f, t in enumerate(self.tables):
            out += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.grids, strict=True):
            out += t[b[:, f] // self.coarse, b[:, g] // self.coarse]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(self.bins(x))))


def _best_cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; 0 if none helps."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + lam) + (gt - gl) ** 2 / (ht - hl + lam) - gt**2 / (ht + lam)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, lam: float) -> np.ndarray:
    """Leaf value of each bin, of a tree over bins in order; the best cut comes first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best_cut(g[a:z], h[a:z], lam), a, z) for a, z in parts]
        gain, k, a, z = max(found)
        if gain <= 1e-9:
            break
        parts.remove((a, z))
        parts += [(a, a + k), (a + k, z)]
    out = np.empty(len(g))
    for a, z in parts:
        out[a:z] = -g[a:z].sum() / (h[a:z].sum() + lam)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a depth-two tree over a grid: one cut across, one of each half along."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        ca, cb = np.cumsum(a, axis=0), np.cumsum(b, axis=0)
        for k in range(len(a) - 1):
            halves = ((ca[k], cb[k]), (ca[-1] - ca[k], cb[-1] - cb[k]))
            cuts = [_best_cut(x, y, lam) for x, y in halves]
            gain = sum(c[0] for c in cuts) + sum(x.sum() ** 2 / (y.sum() + lam) for x, y in halves) - g.sum() ** 2 / (h.sum() + lam)
            if gain > best[0]:
                value = np.empty_like(a, dtype=float)
                for rows, (x, y), (_, c) in zip((slice(0, k + 1), slice(k + 1, None)), halves, cuts, strict=True):
                    c = c or len(x)
                    value[rows, :c] = -x[:c].sum() / (y[:c].sum() + lam)
                    value[rows, c:] = -x[c:].sum() / (y[c:].sum() + lam) if c < len(x) else 0.0
                best = (gain, value.T if turn else value)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 250, rate: float = 0.08, leaves: int = 3, pairs: int = 6, pair_rounds: int = 60, lam: float = 5.0) -> Model:
    """Boost tables feature by feature, round after round, then those of the most helpful pairs."""
    model = Model()
    if not len(y):
        return model
    x = np.nan_to_num(x)
    share = (y.sum() + 1) / (len(y) + 2)
    model.prior = float(np.log(share / (1 - share)))
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.bins(x)
    margin = np.full(len(y), model.prior)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(b[:, f], g, len(t)), np.bincount(b[:, f], h, len(t)), leaves, lam)
            t += step
            margin += step[b[:, f]]
    c = b // model.coarse
    wide = [len(t) // model.coarse + 1 for t in model.tables]

    def grid(f: int, k: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, f] * wide[k] + c[:, k], v, wide[f] * wide[k]).reshape(wide[f], wide[k])

    g, h = slopes()
    gains = sorted(((pair_tree(grid(f, k, g), grid(f, k, h), lam)[0], f, k) for f in range(x.shape[1]) for k in range(f)), reverse=True)
    model.pairs = [(f, k) for gain, f, k in gains[:pairs] if gain > 0]
    model.grids = [np.zeros((wide[f], wide[k])) for f, k in model.pairs]
    for _ in range(pair_rounds if model.pairs else 0):
        for (f, k), t in zip(model.pairs, model.grids, strict=True):
            g, h = slopes()
            step = rate * pair_tree(grid(f, k, g), grid(f, k, h), lam)[1]
            t += step
            margin += step[c[:, f], c[:, k]]
    return model


def featurize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and an array of features of each text."""
    configure(docs.sparkSession)
    schema = T.StructType([docs.schema[key], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            x = features(texts)
            ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))], names=[key, "features"])

    return docs.select(key, text).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAINING_ROWS) -> Model:
    """A model of labelled texts, of at most rows of them.

    A key counts once.  The labels of least hash are taken: a share of the hash
    range that holds a few more than rows of them, so that what is sent to all
    tasks to pick the texts, and what comes back, is bounded.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    there = known.agg(F.count("*")).first()[0]
    if not there:
        return Model()
    share = min(1.0, (1.1 * rows + 300) / there)
    taken = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = docs.select(key, text).join(F.broadcast(taken.select(key)), key, "left_semi")
    once = featurize(picked, key, text).groupBy(key).agg(F.min("features").alias("features"))
    got = once.join(F.broadcast(taken), key).select(F.xxhash64(key).alias("h"), F.col(key).cast("string").alias("k"), "features", "_label").collect()
    got = sorted(got)[:rows]
    return fit(np.array([r.features for r in got]).reshape(-1, len(FEATURES)), np.array([r._label for r in got], dtype=float))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the score of each text."""
    configure(docs.sparkSession)
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(model.score(features(texts)))], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model, accept: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs that score accept or more, with all their columns."""
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            yield batch.filter(pa.array(model.score(features(texts)) >= accept))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, accept: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of each document.

    Learns from labelled documents whose crc32(doc_id) modulo parts is not held;
    their text alone makes features.
    """
    model = train(docs.where(fold("doc_id", parts) != held), labels.where(fold("doc_id", parts) != held))
    return score(docs, model).select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
