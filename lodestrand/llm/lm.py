"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

P(word | context) = P(class | context) * P(place | class, context) * P(word | place).
The class of a word comes from its last two bytes; the frequent endings have a
class each.  In a class, its most frequent words have a place each and all
others share one.  Both softmaxes, over classes and over the places of a class,
sum weights of hashed features: a bias, the word before, the word skipped to,
and for classes the pair of classes before.  Words
that share a place have their add-one relative frequency there, with room for
words not met in training, so the probabilities of all words and the end add up
to 1.

Texts are cut into words once and kept as packed numbers in a table.  Word
counts cover every training text and are exact.  Weights are trained in rounds
over every training text: each task starts from the weights sent out, takes
Adagrad steps on its positions (each round has its own of every text, and all
rounds together have each position once), and what it changed is averaged over
tasks by how often each met a feature.  Texts are scored in sparse numpy batches.

log10(count + 1) of rare words is looked up where the counts lie: the most
frequent words are sent to all tasks (at most HEAD of them), others are dealt
out by hash, packed, and the sums come back by batch of texts.

Defined results: a null or empty text is just its end; very long texts are
scored whole; repeated rows each give their row; an empty table gives an empty
table; without training texts N is 0 and every score is that of nothing known;
of other columns just the key comes along, so clashing names do no harm.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, chunks, configure, discard, fold, plan_bytes, release, sums, unpacked, written
from .textstats import Words

#: Words whose counts are sent to all tasks, at most.
HEAD = 65_536
OWN_CLASSES = 32
CLASSES = 48
#: Places of a class: the first for all words without one of their own.
PLACES = 32
#: A training round uses one position of each so many; all rounds use every position.
ROUNDS = 2
#: Of Adagrad's steps.
RATE = 0.05
#: Bytes of input for each range of word hashes; one task holds a range.
RANGE_BYTES = 4 << 20
#: Bytes of packed tokens for each task of training at least, if there are tasks enough: each sends what it changed.
TASK_BYTES = 32 << 20
SLAB = 1 << 14
BATCH = 1 << 13
END_HASH = np.uint64(1)
END_ENDING = 0
#: Sums of weights stop here, so that no exponential overflows.
STEEPEST = np.float32(60)
_PRIME = np.uint64(0x9E3779B97F4A7C15)

#: Rows of the classes' weights: bias, word before, word skipped to, pair of classes before.
WORD_ROWS, SKIP_ROWS = 1 << 13, 1 << 12
_WIDE = CLASSES + 1
CLASS_OFFSETS = np.cumsum([0, 1, WORD_ROWS, SKIP_ROWS])
CLASS_ROWS = int(CLASS_OFFSETS[-1]) + _WIDE * _WIDE
#: Rows of the places' weights: bias of each class, and with the class the word before and the word skipped to.
PLACE_WORDS, PLACE_SKIPS = 1 << 13, 1 << 12
PLACE_OFFSETS = np.cumsum([0, CLASSES, PLACE_WORDS])
PLACE_ROWS = int(PLACE_OFFSETS[-1]) + PLACE_SKIPS


@dataclass
class Corpus:
    """Some texts as token arrays: each text's words, then its end.

    hashes and endings: of each distinct word, the end last.  tokens: its number
    at each position.  counts: tokens of each text.
    """

    hashes: np.ndarray
    endings: np.ndarray
    tokens: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Corpus:
        w = Words(texts, lower=True)
        d = w.distinct
        hashes = np.concatenate((np.fromiter(map(xxhash.xxh64_intdigest, d), dtype=np.uint64, count=len(d)), [END_HASH]))
        hashes[:-1][hashes[:-1] == END_HASH] = 2
        size = np.array([len(x) for x in d], dtype=np.int64)
        flat = np.frombuffer(b"".join(d), dtype=np.uint8).astype(np.int64)
        last = np.cumsum(size) - 1
        before = np.where(size > 1, flat[np.maximum(last - 1, 0)], 0) if len(d) else np.zeros(0, dtype=np.int64)
        counts = w.counts + 1
        ends = np.cumsum(counts)
        tokens = np.full(int(ends[-1]) if len(ends) else 0, len(d), dtype=np.int64)
        inside = np.ones(len(tokens), dtype=bool)
        inside[ends - 1] = False
        tokens[inside] = w.numbers
        return cls(hashes, np.concatenate((before * 256 + flat[last], [END_ENDING])).astype(np.int64), tokens, counts)

    def __post_init__(self) -> None:
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        ends = np.cumsum(self.counts)
        self.place = np.arange(len(self.tokens)) - np.repeat(ends - self.counts, self.counts)


@dataclass
class Tables:
    """What scoring needs of the counts, besides rare words."""

    head: np.ndarray  # hashes, sorted
    head_counts: np.ndarray
    head_place: np.ndarray  # 0: none of its own
    class_of: np.ndarray  # by ending
    in_place: np.ndarray  # log10(tokens + words + 1) of what shares the first place of each class
    class_prior: np.ndarray  # log of each class's share of tokens
    place_prior: np.ndarray  # log of each place's share of its class
    total: int
    words: int

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head of each hash, and whether it is there."""
        if not len(self.head):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        return at, self.head[at] == hashes

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at, there = self.found(hashes)
        return np.where(there, self.head_place[at], 0) if len(self.head) else np.zeros(len(hashes), dtype=np.int64)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights by which every context has the frequencies of training."""
        w = np.zeros((CLASS_ROWS, CLASSES), dtype=np.float32), np.zeros((PLACE_ROWS, PLACES), dtype=np.float32)
        w[0][0], w[1][:CLASSES] = self.class_prior, self.place_prior
        return w


def contexts(c: Corpus, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weight rows of each token's features, a column per token: those of its class, and those of its place."""
    n = len(c.tokens)
    mixed = ((c.hashes * _PRIME) >> np.uint64(40)).astype(np.int64)
    word, kind = mixed[c.tokens], classes[c.tokens]

    def back(values: np.ndarray, k: int, none: int) -> np.ndarray:
        out = np.full(n, none, dtype=np.int64)
        there = np.flatnonzero(c.place >= k)
        out[there] = values[there - k]
        return out

    one, two = back(kind, 1, CLASSES), back(kind, 2, CLASSES)
    before, skipped = back(word, 1, 0), back(word, 2, 0)
    outer = (np.zeros(n, dtype=np.int64), before % WORD_ROWS, skipped % SKIP_ROWS, two * _WIDE + one)
    own = kind * 40503
    inner = (kind, (before + own) % PLACE_WORDS, (skipped + own) % PLACE_SKIPS)
    return np.stack([r + o for r, o in zip(outer, CLASS_OFFSETS, strict=True)]), np.stack([r + o for r, o in zip(inner, PLACE_OFFSETS, strict=True)])


def _sums(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = np.take(weights, rows[0], axis=0, mode="clip")
    for r in rows[1:]:
        x += np.take(weights, r, axis=0, mode="clip")
    return np.clip(x, -STEEPEST, STEEPEST, out=x)


def shares(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probability of each outcome in each context."""
    x = _sums(weights, rows)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], dtype=x.dtype))[:, None]
    return x


def log_shares(weights: np.ndarray, rows: np.ndarray, outcome: np.ndarray) -> np.ndarray:
    """Log probability of the outcome in each context."""
    out = np.empty(len(outcome))
    for a in range(0, len(outcome), SLAB):
        x, y = _sums(weights, rows[:, a : a + SLAB]), outcome[a : a + SLAB]
        own = x[np.arange(len(y)), y].astype(float)
        np.exp(x, out=x)
        out[a : a + SLAB] = own - np.log(x @ np.ones(x.shape[1], dtype=x.dtype))
    return out


def improve(weights: np.ndarray, squares: np.ndarray, visits: np.ndarray, rows: np.ndarray, outcome: np.ndarray, rate: float = RATE) -> None:
    """One Adagrad step per batch of positions, in place."""
    for a in range(0, len(outcome), BATCH):
        r, y = rows[:, a : a + BATCH], outcome[a : a + BATCH]
        miss = shares(weights, r)
        np.negative(miss, out=miss)
        miss[np.arange(len(y)), y] += 1
        for own in r:
            if own[0] == own[-1] and (own == own[0]).all():  # a bias
                _step(weights, squares, miss.sum(axis=0)[None] / np.sqrt(len(own), dtype=np.float32), own[:1], rate)
                visits[own[0]] += len(own)
                continue
            order = np.argsort(own.astype(np.uint16), kind="stable")  # rows fit, and narrow keys sort fast
            own = own[order]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            at, times = own[starts], np.diff(np.append(starts, len(own)))
            g = np.add.reduceat(np.take(miss, order, axis=0, mode="clip"), starts, axis=0)
            g /= np.sqrt(times, dtype=np.float32)[:, None]
            _step(weights, squares, g, at, rate)
            visits[at] += times


def _step(weights: np.ndarray, squares: np.ndarray, g: np.ndarray, at: np.ndarray, rate: float) -> None:
    q = np.take(squares, at, axis=0, mode="clip")
    q += g * g
    squares[at] = q
    q += np.float32(1e-3)
    g *= np.float32(rate)
    g /= np.sqrt(q, out=q)
    weights[at] += g


PACKED = "batch long, keys array<long>, trains binary, counts binary, hashes binary, endings binary, times binary, tokens binary"


def tokenised(docs: DataFrame, key: str, text: str, training: Column) -> DataFrame:
    """Texts as packed tokens, a row for some of them: batch, keys, trains (whether training uses each), counts,
    and of the distinct words hashes, endings and times in training texts; key is an integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 30
        for rows, texts in chunks(batches, text):
            c = Corpus.of(texts)
            trains = np.asarray(rows.column("_trains").to_numpy(zero_copy_only=False), dtype=bool)
            times = np.bincount(c.tokens[trains[c.doc]], minlength=len(c.hashes))
            keys = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), rows.column(key).cast(pa.int64()))
            packed = [binaries(x, np.array([0, len(x)])) for x in (trains.astype("u1"), c.counts.astype("<u4"), c.hashes, c.endings.astype("<u2"), times.astype("<u4"), c.tokens.astype("<u4"))]
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), keys, *packed], names=[x.split()[0] for x in PACKED.split(", ")])
            batch += 1

    return docs.select(key, text, F.coalesce(training, F.lit(False)).alias("_trains")).mapInArrow(run, PACKED)


def _corpora(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, Corpus]]:
    """batch, keys, trains and tokens of packed rows."""
    for b in batches:
        for i in range(b.num_rows):
            of = lambda name, kind: np.frombuffer(b.column(name)[i].as_py(), dtype=kind)  # noqa: B023, E731
            c = Corpus(of("hashes", "<u8"), of("endings", "<u2").astype(np.int64), of("tokens", "<u4").astype(np.int64), of("counts", "<u4").astype(np.int64))
            yield b.column("batch")[i].as_py(), b.column("keys")[i].values, of("trains", "u1").astype(bool), c
    release()


COUNTS = "part long, hashes binary, endings binary, counts binary"


def counted(tokens: DataFrame, ranges: int) -> DataFrame:
    """part, hashes, endings and counts (packed, by range of hash) of all tokens of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        room = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, e, n = (np.concatenate(x) for x in zip(*held, strict=True))
            values, at, which = np.unique(h, return_index=True, return_inverse=True)
            return values, e[at], np.bincount(which, weights=n, minlength=len(values)).astype(np.int64)

        def dealt() -> pa.RecordBatch:
            h, e, n = merged()
            part = (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(h))
            return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), binaries(h, cuts), binaries(e, cuts), binaries(n, cuts)], names=["part", "hashes", "endings", "counts"])

        for b in batches:
            for h, e, n in zip(*(b.column(c).to_pylist() for c in ("hashes", "endings", "times")), strict=True):
                n = np.frombuffer(n, dtype="<u4")
                own = n > 0
                held.append((np.frombuffer(h, dtype="<u8")[own], np.frombuffer(e, dtype="<u2")[own], n[own]))
                room += int(own.sum())
            if room > 1_500_000:
                held = [merged()]
                room = len(held[0][0])
                if room > 1_000_000:
                    yield dealt()
                    held, room = [], 0
        if room:
            yield dealt()
        held = []
        release()

    def add(table: pa.Table) -> pa.Table:
        h, e, n = (unpacked(table.column(c), k) for c, k in (("hashes", "<u8"), ("endings", "<u2"), ("counts", "<i8")))
        values, at, which = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(which, weights=n, minlength=len(values)).astype(np.int64)
        return pa.table({"part": table.column("part")[:1], "hashes": [values.tobytes()], "endings": [e[at].tobytes()], "counts": [n.tobytes()]})

    return tokens.select("hashes", "endings", "times").mapInArrow(run, COUNTS).groupBy("part").applyInArrow(add, COUNTS)


def _numbers(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for h, e, n in zip(*(b.column(c).to_pylist() for c in ("hashes", "endings", "counts")), strict=True):
        yield np.frombuffer(h, dtype="<u8"), np.frombuffer(e, dtype="<u2"), np.frombuffer(n, dtype="<i8")


def tables(counts: DataFrame) -> Tables:
    """Totals, classes, places and the head of the counts; what reaches the driver is bounded by HEAD and the number of endings."""
    bits = 48  # how many words have each count, by its logarithm, says from which count on the head is taken

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words, hist = np.zeros(65536, dtype=np.int64), np.zeros(65536, dtype=np.int64), np.zeros(bits * 8, dtype=np.int64)
        for b in batches:
            for _, e, n in _numbers(b):
                tokens += np.bincount(e, weights=n, minlength=65536).astype(np.int64)
                words += np.bincount(e, minlength=65536)
                hist += np.bincount((np.log2(n) * 8).astype(np.int64), minlength=bits * 8)
        at, steps = np.flatnonzero(words), np.flatnonzero(hist)
        yield pa.RecordBatch.from_pydict({"e": pa.array(np.concatenate((at, -1 - steps))), "n": pa.array(np.concatenate((tokens[at], hist[steps]))), "v": pa.array(np.concatenate((words[at], steps * 0)))})

    rows = counts.mapInArrow(totals, "e long, n long, v long").groupBy("e").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # a row per ending and step
    tokens, words, hist = np.zeros(65536, dtype=np.int64), np.zeros(65536, dtype=np.int64), np.zeros(bits * 8, dtype=np.int64)
    for r in rows:
        if r.e >= 0:
            tokens[r.e], words[r.e] = r.n, r.v
        else:
            hist[-1 - r.e] = r.n
    class_of = OWN_CLASSES + 1 + np.arange(65536) * 40503 % 65536 % (CLASSES - OWN_CLASSES - 1)
    free = tokens.copy()
    free[END_ENDING] = 0
    best = np.argsort(-free, kind="stable")[:OWN_CLASSES]
    class_of[best] = np.arange(1, OWN_CLASSES + 1)
    class_of[END_ENDING] = 0
    n, v = (np.bincount(class_of, weights=x, minlength=CLASSES) for x in (tokens, words))
    least, room = bits * 8, HEAD
    while least > 0 and hist[least - 1] <= room:
        least -= 1
        room -= hist[least]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, e, x in _numbers(b):
                keep = (np.log2(x) * 8).astype(np.int64) >= least
                if not keep.any():  # most ranges: no row of them reaches the driver
                    continue
                yield pa.RecordBatch.from_pydict({"h": pa.array([h[keep].tobytes()]), "e": pa.array([e[keep].tobytes()]), "n": pa.array([x[keep].tobytes()])})

    top = counts.mapInArrow(heads, "h binary, e binary, n binary").collect()
    h, e, c = (np.frombuffer(b"".join(bytes(r[i]) for r in top), dtype=k) for i, k in enumerate(("<u8", "<u2", "<i8")))
    order = np.argsort(h)
    h, c, kind = h[order], c[order], class_of[e[order]]
    place = np.zeros(len(h), dtype=np.int64)
    ranked = np.lexsort((h, -c, kind))
    first = np.searchsorted(kind[ranked], np.arange(CLASSES))
    rank = np.arange(len(h)) - first[kind[ranked]]
    place[ranked] = np.where(rank < PLACES - 1, rank + 1, 0)
    own = place > 0
    held = np.zeros((CLASSES, PLACES))
    held[kind[own], place[own]] = c[own]
    rest_n, rest_v = n - held.sum(axis=1), v - (held > 0).sum(axis=1)
    held[:, 0] = rest_n
    used = (held > 0) | (np.arange(PLACES) == 0)
    prior = np.where(used, held + 0.5, 0)
    place_prior = np.where(used, np.log(np.maximum(prior, 0.5) / prior.sum(axis=1, keepdims=True)), -STEEPEST)
    return Tables(h, c, place, class_of, np.log10(rest_n + rest_v + 1), np.log((n + 1) / (n.sum() + CLASSES)), place_prior, int(tokens.sum()), int(words.sum()))


def _changed(tokens: DataFrame, t: Tables, weights: tuple[np.ndarray, ...], turn: int, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[np.ndarray, np.ndarray]]:
    """What a round over all training texts changes in the weights, averaged by visits; and the visits.

    Round turn of so many rounds uses the positions that leave turn when divided by rounds.
    """
    sent = tokens.sparkSession.sparkContext.broadcast((t, weights))
    blocks, salts = 16, 64
    shapes = [w.shape for w in weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, start = sent.value
        w, squares, visits = [x.copy() for x in start], [np.zeros_like(x) for x in start], [np.zeros(len(x)) for x in start]
        for _, _, trains, c in _corpora(batches):
            classes, places = t.class_of[c.endings], t.places(c.hashes)
            at = np.flatnonzero(trains[c.doc] & ((c.place + c.counts[c.doc]) % rounds == turn))
            at = at[np.argsort((at.astype(np.uint64) * _PRIME) >> np.uint64(40))]
            for k, (rows, outcome) in enumerate(zip(contexts(c, classes), (classes, places), strict=True)):
                improve(w[k], squares[k], visits[k], np.take(rows, at, axis=1), outcome[c.tokens[at]], rate)
        salt = TaskContext.get().partitionId() % salts
        for k, x in enumerate(w):
            high = -(-len(x) // blocks)
            for b in range(blocks):
                own = np.flatnonzero(visits[k][b * high : (b + 1) * high]) + b * high
                if len(own):
                    yield pa.RecordBatch.from_pydict({"block": [k * blocks + b], "salt": pa.array([salt], pa.int64()), "at": [own.astype("<u4").tobytes()], "visits": [visits[k][own].tobytes()], "change": [(x[own] - start[k][own]).astype("<f2").tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        rows, wide = shapes[table.column("block")[0].as_py() // blocks]
        total, change = np.zeros(rows), np.zeros((rows, wide), dtype=np.float32)
        for at, n, x in zip(*(table.column(c).to_pylist() for c in ("at", "visits", "change")), strict=True):
            at, n = np.frombuffer(at, dtype="<u4"), np.frombuffer(n)
            change[at] += np.frombuffer(x, dtype="<f2").reshape(len(at), wide).astype(np.float32) * n[:, None].astype(np.float32)
            total[at] += n
        own = np.flatnonzero(total)
        mean = change[own] / total[own][:, None]
        return pa.table({"block": table.column("block")[:1], "salt": table.column("salt")[:1], "at": [own.astype("<u4").tobytes()], "visits": [total[own].tobytes()], "change": [mean.astype("<f2").tobytes()]})

    kinds = "block long, salt long, at binary, visits binary, change binary"
    tasks = max(tokens.sparkSession.sparkContext.defaultParallelism, plan_bytes(tokens) // TASK_BYTES)
    parts = tokens.select("batch", "keys", "trains", "counts", "hashes", "endings", "tokens").coalesce(tasks).mapInArrow(run, kinds).groupBy("block", "salt").applyInArrow(add, kinds)
    out = [(np.zeros_like(w), np.zeros(len(w))) for w in weights]
    for r in parts.withColumn("salt", F.lit(0).cast("long")).groupBy("block", "salt").applyInArrow(add, kinds).collect():  # as many numbers as there are weights
        change, visits = out[r.block // blocks]
        at = np.frombuffer(bytes(r.at), dtype="<u4")
        visits[at] = np.frombuffer(bytes(r.visits))
        change[at] = np.frombuffer(bytes(r.change), dtype="<f2").reshape(len(at), change.shape[1])
    sent.unpersist()
    return out


def train(tokens: DataFrame, counts: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> tuple[Tables, tuple[np.ndarray, ...]]:
    """Tables and weights from packed tokens and the counts of those that train."""
    t = tables(counts)
    weights = t.weights()
    for turn in range(rounds if t.total else 0):
        weights = tuple(w + change for w, (change, _) in zip(weights, _changed(tokens, t, weights, turn, rounds, rate), strict=True))
    return t, weights


def known_scores(c: Corpus, t: Tables, weights: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: whether it is in the head, log10(count + 1) of one in the head, and the model's log10 probability but for
    log10(count + 1) of a word that is not."""
    at, there = t.found(c.hashes)
    value = np.where(there, np.log10((t.head_counts[at] if len(t.head) else 0) + 1.0), 0.0)
    classes, places = t.class_of[c.endings], t.places(c.hashes)
    rest = np.where(places > 0, 0.0, value - t.in_place[classes])
    logs = sum(log_shares(w, rows, outcome[c.tokens]) for w, rows, outcome in zip(weights, contexts(c, classes), (classes, places), strict=True))
    return there[c.tokens], value[c.tokens], logs / math.log(10) + rest[c.tokens]


PARTS = "part long, batch long, at binary, hashes binary, times binary, keys array<long>, n_tokens array<long>, known array<long>, counted array<double>, own array<double>"


def score(tokens: DataFrame, counts: DataFrame, t: Tables, weights: tuple[np.ndarray, ...], ranges: int, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, base_score and score of each text of packed tokens."""
    sent = tokens.sparkSession.sparkContext.broadcast((t, weights))
    spare = math.log10(t.total + t.words + 1)
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, weights = sent.value
        for batch, keys, _, c in _corpora(batches):
            found, value, own = known_scores(c, t, weights)
            whole = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), x) for x in (keys, pa.array(c.counts), pa.array(sums(found, c.counts)), pa.array(sums(value, c.counts)), pa.array(sums(own, c.counts)))]
            none = pa.array([b""])
            yield pa.RecordBatch.from_arrays([pa.array([-1 - batch % ranges]), pa.array([batch], pa.int64()), none, none, none, *whole], names=names)
            rare = np.flatnonzero(~found)
            pairs, times = np.unique(c.doc[rare] * len(c.hashes) + c.tokens[rare], return_counts=True)
            doc, h = (pairs // len(c.hashes)).astype("<u4"), c.hashes[pairs % len(c.hashes)]
            part = (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            if len(part):
                n = len(cuts) - 1
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(np.full(n, batch)), binaries(doc[order], cuts), binaries(h[order], cuts), binaries(times[order].astype("<u4"), cuts), *(pa.nulls(n, x.type) for x in whole)], names=names)

    def look_up(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        names = ["batch", "at", "known", "counted"]
        h, n = (unpacked(theirs.column(c), k) for c, k in (("hashes", "<u8"), ("counts", "<i8")))
        got: dict[str, list] = {x: [] for x in names}
        for b, doc, own, times in zip(*(mine.column(c).to_pylist() for c in ("batch", "at", "hashes", "times")), strict=True):
            doc, own, times = np.frombuffer(doc, dtype="<u4"), np.frombuffer(own, dtype="<u8"), np.frombuffer(times, dtype="<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(h, own), max(len(h) - 1, 0))
            times = times * (h[at] == own) if len(h) else times * 0
            value = np.log10((n[at] if len(n) else 0) + 1.0) * times
            docs, which = np.unique(doc, return_inverse=True)
            known, value = np.bincount(which, weights=times, minlength=len(docs)), np.bincount(which, weights=value, minlength=len(docs))
            keep = known > 0
            for x, y in zip(names, (b, docs[keep].tobytes(), known[keep].astype("<u4").tobytes(), value[keep].tobytes()), strict=True):
                got[x].append(y)
        return pa.table({"batch": pa.array(got["batch"], pa.int64()), **{x: pa.array(got[x], pa.binary()) for x in names[1:]}})

    def add(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        own = mine.to_pylist()[0]
        n, known = (np.array(own[c], dtype=np.int64) for c in ("n_tokens", "known"))
        rare = np.zeros(len(n))
        for at, k, v in zip(*(theirs.column(c).to_pylist() for c in ("at", "known", "counted")), strict=True):
            at = np.frombuffer(at, dtype="<u4")
            known[at] += np.frombuffer(k, dtype="<u4")
            rare[at] += np.frombuffer(v)
        return pa.table({"key": pa.array(own["keys"], pa.int64()), "n_tokens": n, "n_known": known, "base_score": np.array(own["counted"]) + rare - n * spare, "score": np.array(own["own"]) + rare})

    dealt = written(tokens.drop("times").mapInArrow(run, PARTS), "scored")
    found = dealt.where("part >= 0").select("part", "batch", "at", "hashes", "times").groupBy("part").cogroup(counts.select("part", "hashes", "counts").groupBy("part")).applyInArrow(look_up, "batch long, at binary, known binary, counted binary")
    own = dealt.where("part < 0").select("batch", "keys", "n_tokens", "known", "counted", "own")
    out = written(own.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(add, "key long, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("key", key), "scores")
    discard(dealt)
    return out


def score_all(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from documents whose crc32(doc_id) modulo parts is not held.
    """
    configure(docs.sparkSession)
    ranges = min(max(8, plan_bytes(docs) // RANGE_BYTES), 1 << 26)
    tokens = written(tokenised(docs, "doc_id", "text", fold("doc_id", parts) != held), "tokens")
    counts = written(counted(tokens, ranges), "counts")
    t, weights = train(tokens, counts)
    out = score(tokens, counts, t, weights, ranges)
    discard(tokens, counts)
    return out.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "n_tokens", "n_known", F.lit(t.total).cast("long").alias("train_tokens"), "base_score", "score")
