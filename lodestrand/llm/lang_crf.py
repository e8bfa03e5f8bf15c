"""Language ID by a linear-chain conditional random field over words.

Each word of a text gets a language: affixes, character n-grams and a lexicon
of frequent words speak for it, learned transitions tie neighbours together,
and forward-backward gives each word's probabilities, so that text which
switches languages is told apart run by run.  A text's language is the one with
the largest mean probability over its words with a letter; that mean is the score.

Training sequences hold stretches of one text, whole short texts, and mixtures
of runs of several texts from which the cost of switching is learned.  Texts and
words are shared out evenly among languages, so a rare one is learned as well.

Defined results: a null or empty text, or one without a letter, is `und` with
score 0; very long texts are labelled whole; repeated rows each give their row;
equal languages go to the smaller name; an empty table gives an empty table;
where nothing can be learned from, every text is `und`; of other columns just
the key comes along, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, configure, fold, sums
from .textstats import Words

#: Texts that training uses at most, and the words that it takes of them, both shared out evenly among languages.
TRAINING_TEXTS = 1_600
TRAINING_WORDS = 320_000
#: Of longer texts training reads so many characters, in WINDOWS stretches spread evenly from the first to the last
#: (they are labelled whole all the same).
TRAINING_CHARS, WINDOWS = 20_000, 10
#: In place of one of these bounds: none.  The fit is the driver's, so then the table must be small enough for it.
ALL = 1 << 62
BUCKETS = 1 << 16
LEXICON = 4_000
#: Words whose features are worked out at once.
SLAB = 20_000
UNKNOWN = "und"


def word_features(words: list[bytes], lexicon: dict[bytes, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the features of words and the words that have them, in order: a pair of arrays for each kind.

    n-grams of one to four bytes, with marks at a word's ends so that those at
    an end are its affixes, a longer suffix, and the word itself if the lexicon has it.
    """
    text = [b"\x01" + w + b"\x02" for w in words]
    flat = np.frombuffer(b"".join(text), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, text), dtype=np.int64, count=len(text)))
    n = len(flat)
    out = []
    code = np.zeros(n, dtype=np.uint64)
    for k in range(5):
        if n <= k:
            break
        m = n - k
        code = code[:m] * np.uint64(257) + flat[k:] + np.uint64(1)
        inside = owner[:m] == owner[k:]
        if k == 4:
            inside &= flat[k:] == 2
        out.append((((code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32), owner[:m][inside]))
    known = np.fromiter((lexicon.get(w, -1) for w in words), dtype=np.int32, count=len(words))
    held = np.flatnonzero(known >= 0).astype(np.int32)
    out.append((known[held] + np.int32(BUCKETS), held))
    return out


def weighed(weights: np.ndarray, features: list[tuple[np.ndarray, np.ndarray]], words: int) -> np.ndarray:
    """The sum of the weights of each word's features."""
    out = np.zeros((words, weights.shape[1]), dtype=weights.dtype)
    for bucket, owner in features:
        if len(bucket):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[starts]] += np.add.reduceat(np.take(weights, bucket, axis=0), starts, axis=0)
    return out


def with_letter(words: list[bytes]) -> np.ndarray:
    """Whether a letter is in each word."""
    return np.array([any(map(str.isalpha, w.decode("utf-8", "replace"))) for w in words], dtype=bool)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + LEXICON, languages)
    moves: np.ndarray  # log weight of going from one language to another
    lexicon: dict[bytes, int]

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """What speaks for each language, for each word; nothing where a word has no letter."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        for a in range(0, len(words), SLAB):
            part = words[a : a + SLAB]
            out[a : a + SLAB] = weighed(self.weights, word_features(part, self.lexicon), len(part)) * with_letter(part)[:, None]
        return out


def marginals(e: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of each label at each place of sequences that lie one after another.

    e: scores (places, labels); counts: places of each sequence.  Sequences are
    cut into blocks whose transfer matrices are multiplied for all blocks at
    once; then each sequence's messages pass from block to block, and last
    through the places of all blocks at once.  It is exact, and the number of
    array operations goes with a block's places and the blocks of the longest
    sequence.  Blocks grow with the labels, so that the matrices take a bounded
    number of cells for each place.
    """
    k = e.shape[1]
    if not len(e):
        return np.zeros((0, k))
    block = max(32, k * k // 4)
    blocks = -(-counts // block)
    first = np.cumsum(blocks) - blocks
    n = int(blocks.sum())
    at = np.repeat(first * block - (np.cumsum(counts) - counts), counts) + np.arange(len(e))
    shown = np.ones((n * block, k))
    shown[at] = np.exp(e - e.max(axis=1, keepdims=True))
    shown = shown.reshape(n, block, k)
    here = np.zeros(n * block, dtype=bool)
    here[at] = True
    here = here.reshape(n, block)
    move = np.exp(moves - moves.max()).astype(float)
    start = np.zeros(n, dtype=bool)
    start[first[counts > 0]] = True

    transfer = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for c in range(block):
        live = here[:, c]
        moved = transfer @ move
        if c == 0:
            moved[start] = transfer[start]
        step = moved * shown[:, c, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        transfer = np.where(live[:, None, None], step, transfer)
    into, back = np.ones((n, k)), np.ones((n, k))
    order = np.argsort(-blocks, kind="stable")
    alive = np.searchsorted(-blocks[order], -np.arange(1, int(blocks.max()) + 1), side="right")
    for b in range(1, int(blocks.max())):
        i = first[order[: alive[b]]] + b
        v = np.einsum("nk,nkj->nj", into[i - 1], transfer[i - 1])
        into[i] = v / v.max(axis=1, keepdims=True)
    for b in range(int(blocks.max()) - 2, -1, -1):
        i = first[order[: alive[b + 1]]] + b
        v = np.einsum("nj,nkj->nk", back[i + 1], transfer[i + 1])
        back[i] = v / v.max(axis=1, keepdims=True)
    out = np.empty((n, block, k))
    v = into
    for c in range(block):
        moved = v @ move
        if c == 0:
            moved[start] = v[start]
        step = moved * shown[:, c]
        step /= step.max(axis=1, keepdims=True)
        v = np.where(here[:, c, None], step, v)
        out[:, c] = v
    v = back
    for c in range(block - 1, -1, -1):
        out[:, c] *= v
        step = (v * shown[:, c]) @ move.T
        step /= step.max(axis=1, keepdims=True)
        v = np.where(here[:, c, None], step, v)
    out = out.reshape(-1, k)[at]
    return out / out.sum(axis=1, keepdims=True)


def _sequences(words: list[np.ndarray], labels: np.ndarray, length: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and labels of training sequences, -1 after the end of shorter ones.

    Of full length, half are stretches of a text and half mixtures of runs of
    texts; what is shorter (a short text, the rest of a long one) is taken as it is.
    """
    seqs, golds = [], []
    mixed = [i for i, w in enumerate(words) if len(w) >= 4]
    for turn, i in enumerate(i for i, w in enumerate(words) if len(w)):
        for a in range(0, len(words[i]), length):
            own = words[i][a : a + length]
            if len(own) < length or (turn + a // length) % 2:
                seqs.append(own)
                golds.append(np.full(len(own), labels[i]))
            else:
                parts, marks, left = [own[: (run := int(rng.integers(4, length // 2)))]], [np.full(run, labels[i])], length - run
                while left > 0:
                    j = mixed[int(rng.integers(len(mixed)))]
                    b = int(rng.integers(max(1, len(words[j]) - length // 2)))
                    got = words[j][b : b + min(left, int(rng.integers(4, length // 2)))]
                    parts.append(got)
                    marks.append(np.full(len(got), labels[j]))
                    left -= len(got)
                seqs.append(np.concatenate(parts))
                golds.append(np.concatenate(marks))
    out = np.full((2, len(seqs), max(map(len, seqs), default=length)), -1, dtype=np.int64)
    for r, (x, y) in enumerate(zip(seqs, golds, strict=True)):
        out[0, r, : len(x)], out[1, r, : len(x)] = x, y
    return out[0], out[1]


@dataclass
class Sequences:
    """Training sequences, all of one length with -1 after the end of shorter ones."""

    words: np.ndarray  # (sequences, length): numbers of distinct words
    gold: np.ndarray
    distinct: list[bytes]
    lexicon: dict[bytes, int]
    labels: int

    def __post_init__(self) -> None:
        self.here = self.words >= 0
        self.flat = np.where(self.here, self.words, 0)
        self.features = word_features(self.distinct, self.lexicon)
        self.live = with_letter(self.distinct)
        self.truth = np.eye(self.labels)[self.gold]
        self.pairs = np.zeros((self.labels, self.labels))
        np.add.at(self.pairs, (self.gold[:, :-1][self.here[:, 1:]], self.gold[:, 1:][self.here[:, 1:]]), 1)

    def gradient(self, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the labels over all sequences, and its slopes by weights and moves, by forward-backward."""
        k, size = self.labels, len(weights)
        s, length = self.flat.shape
        here = self.here
        x = (weighed(weights, self.features, len(self.distinct)) * self.live[:, None]).astype(float)[self.flat]
        top = x.max(axis=2, keepdims=True)
        shown = np.exp(x - top)
        move = np.exp(moves)
        a, b = np.empty((length, s, k)), np.empty((length, s, k))
        norm = shown[:, 0].sum(axis=1, keepdims=True)
        v = shown[:, 0] / norm
        total = float((np.log(norm[:, 0]) * here[:, 0]).sum())
        a[0], b[-1] = v, 1.0
        for t in range(1, length):
            step = (v @ move) * shown[:, t]
            norm = step.sum(axis=1, keepdims=True)
            v = np.where(here[:, t, None], step / norm, v)
            total += float((np.log(norm[:, 0]) * here[:, t]).sum())
            a[t] = v
        v = b[-1]
        seen = np.zeros((k, k))
        for t in range(length - 1, 0, -1):
            right = v * shown[:, t]
            seen += a[t - 1].T @ (here[:, t, None] * right / ((a[t - 1] @ move) * right).sum(axis=1, keepdims=True)) * move
            step = right @ move.T
            v = np.where(here[:, t, None], step / step.sum(axis=1, keepdims=True), v)
            b[t - 1] = v
        p = a * b
        p = (p / p.sum(axis=2, keepdims=True)).transpose(1, 0, 2)
        miss = (self.truth - p) * here[:, :, None]
        n = len(self.distinct)
        by_word = np.stack([np.bincount(self.flat.ravel(), miss[:, :, j].ravel(), n) for j in range(k)], axis=1) * self.live[:, None]
        slope = np.zeros((size, k))
        for bucket, owner in self.features:
            slope += np.stack([np.bincount(bucket, by_word[owner, j], size) for j in range(k)], axis=1)
        loglik = float(((x * self.truth).sum(axis=2) * here).sum() + (self.pairs * moves).sum()) - total - float((top[:, :, 0] * here).sum())
        return loglik, slope, self.pairs - seen


def fit(texts: list[str], languages: list[str], rounds: int = 45, rate: float = 0.04, decay: float = 1e-3, length: int = 64) -> Model:
    """Maximise the conditional likelihood of the sequences' labels by Adam on all of them at once."""
    names = sorted(set(languages))
    w = Words([t.lower() for t in texts])
    ends = np.cumsum(w.counts)
    words = [w.numbers[a:z] for a, z in zip(ends - w.counts, ends, strict=True)]
    labels = np.array([names.index(x) for x in languages])
    times = Counter(dict(enumerate(np.bincount(w.numbers, minlength=len(w.distinct)).tolist())))
    lexicon = {w.distinct[i]: r for r, (i, n) in enumerate(sorted(times.items(), key=lambda x: (-x[1], w.distinct[x[0]]))[:LEXICON]) if n >= 3}
    k = len(names)
    model = Model(names, np.zeros((BUCKETS + LEXICON, k), dtype=np.float32), np.zeros((k, k)), lexicon)
    seqs, gold = _sequences(words, labels, length, np.random.default_rng(7))
    if k < 2 or not len(seqs):
        return model
    used, which = np.unique(seqs[seqs >= 0], return_inverse=True)
    seqs[seqs >= 0] = which
    data = Sequences(seqs, gold, [w.distinct[i] for i in used], lexicon, k)
    state = [np.zeros_like(p, dtype=float) for p in (model.weights, model.weights, model.moves, model.moves)]
    for r in range(1, rounds + 1):
        _, by_weight, by_move = data.gradient(model.weights, model.moves)
        grads = by_weight / len(seqs) - decay * model.weights, by_move / len(seqs) - decay * model.moves
        for n, (param, g) in enumerate(zip((model.weights, model.moves), grads, strict=True)):
            m, q = state[2 * n], state[2 * n + 1]
            m *= 0.9
            m += 0.1 * g
            q *= 0.99
            q += 0.01 * g * g
            param += (rate * (m / (1 - 0.9**r)) / (np.sqrt(q / (1 - 0.99**r)) + 1e-6)).astype(param.dtype)
    return model


def _pieces(texts: list[str], most: int, windows: int = WINDOWS) -> list[str]:
    """Texts with most words together at most: the longest are cut to the length at which that holds.

    What is kept of a text are runs of words, as many as windows, spread evenly from its first word to its last.
    """
    own = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    left, cap = most, 0
    for n, size in zip(range(len(own), 0, -1), sorted(map(len, own)), strict=True):
        cap = left // n
        if size > cap:
            break
        cap, left = size, left - size
    cap = max(cap, 1)
    runs = min(windows, cap)

    def cut(x: list[str]) -> list[str]:
        each = cap // runs
        starts = [round(i * (len(x) - each) / max(runs - 1, 1)) for i in range(runs)]
        return x if len(x) <= cap else [y for s in starts for y in x[s : s + each]]

    return [" ".join(cut(x)) for x in own]


def _windows(text: Column, most: int, windows: int) -> Column:
    """A text, or of one with more than so many characters stretches of whole words spread evenly over it."""
    size = most // windows
    start = lambda i: (i * (F.length(text) - size) / (windows - 1)).cast("int") + 1
    stretch = lambda i: F.regexp_replace(F.substr(text, start(i), F.lit(size)), r"^[^\x20\x09-\x0D]+(?=[\x20\x09-\x0D])|(?<=[\x20\x09-\x0D])[^\x20\x09-\x0D]+$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), stretch), " "))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", texts: int | None = None, words: int | None = None, chars: int | None = None, windows: int = WINDOWS) -> Model | None:
    """A model of the texts whose language is known: of at most texts of them, with at most words words together.

    Each language has an even share of the texts, its own of least hash, and an
    even share of the words; counts over the whole table say which part of the
    hash range holds that many.  Of texts of more than chars characters, windows
    stretches that are spread evenly over them are read.  None stands for
    TRAINING_TEXTS, TRAINING_WORDS and TRAINING_CHARS, ALL for no bound.
    """
    texts, words, chars = (bound if given is None else given for given, bound in ((texts, TRAINING_TEXTS), (words, TRAINING_WORDS), (chars, TRAINING_CHARS)))
    usable = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    count = {r.l: r.n for r in usable.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not count:
        return None
    quota = max(1, texts // len(count)) if texts < ALL else max(count.values())
    hashed = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    least = F.coalesce(*(F.when(F.col("l") == name, F.lit(int(min(1.0, (1.3 * quota + 20) / n) * (1 << 30)))) for name, n in count.items()))
    picked = usable.where(hashed < least).select("k", "l", hashed.alias("h"), (F.col("t") if chars >= ALL else _windows(F.col("t"), chars, windows)).alias("t"))
    rows = picked.groupBy("k", "l").agg(F.first("h").alias("h"), F.min("t").alias("t")).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.h, r.k or "")):
        by[r.l].append(r.t)
    taken = [(t, x) for x in sorted(by) for t in (_pieces(by[x][:quota], words // len(count), windows) if words < ALL else by[x][:quota])]
    return fit([t for t, _ in taken], [x for _, x in taken]) if taken else None


def _labelled(m: Model, texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Words of texts, each word's probabilities, its best language, and each text's language and score."""
    w = Words([t.lower() for t in texts])
    spoken = with_letter(w.distinct)[w.numbers] if w.total else np.zeros(0, dtype=bool)
    p = marginals(m.emissions(w.distinct)[w.numbers], w.counts, m.moves)
    n = sums(spoken, w.counts)
    share = np.stack([sums(p[:, j] * spoken, w.counts) for j in range(len(m.languages))], axis=1) / np.maximum(n, 1)[:, None]
    best = share.argmax(axis=1)
    lang = [m.languages[b] if x else UNKNOWN for b, x in zip(best.tolist(), n.tolist(), strict=True)]
    score = np.where(n > 0, np.clip(share[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
    return w, p, p.argmax(axis=1) if w.total else np.zeros(0, dtype=np.int64), lang, score


def label(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, lang_pred, score, and runs: the languages of the text's words, run by run (lang, words)."""
    spark = configure(docs.sparkSession)
    schema = T.StructType([docs.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType())])))])
    if model is None:
        return docs.select(key, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(schema["runs"].dataType).alias("runs"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = pa.array(m.languages)
        for batch, texts in chunks(batches, text):
            w, _, pick, lang, score = _labelled(m, texts)
            new = np.ones(w.total, dtype=bool)
            new[1:] = (pick[1:] != pick[:-1]) | (w.doc[1:] != w.doc[:-1])
            starts = np.flatnonzero(new)
            ends = np.concatenate(([0], np.cumsum(sums(new, w.counts)))).astype(np.int32)
            each = pa.StructArray.from_arrays([names.take(pa.array(pick[starts])), pa.array(np.diff(np.append(starts, w.total)).astype(np.int32))], names=["lang", "words"])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(lang, pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), each)], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model | None, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs in a learned language with that score at least, with all their columns; all rows if nothing was learned."""
    spark = configure(docs.sparkSession)
    if model is None:
        return docs
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            _, _, _, lang, score = _labelled(sent.value, texts)
            yield batch.filter(pa.array((score >= least) & np.array([x != UNKNOWN for x in lang])))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_runs; learns from documents whose crc32(doc_id) modulo parts is not held."""
    model = train(docs.where(fold("doc_id", parts) != held))
    return label(docs, model).select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "lang_pred", "score", F.size("runs").alias("n_runs"))
