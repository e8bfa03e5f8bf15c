"""Periodic runs of words in texts, found by minimizers on several scales.

A run of period q is a stretch of words in which words q apart are identical,
with no smaller period, that neither neighbour extends and that holds at least
REPEATS periods and LEAST words.

Periods up to SHORT are found by comparing the words with those q places on.
Beyond, each scale W = SHORT, 2 SHORT, ... looks for periods of W + 1 to 2 W
words: every stretch of 2 W words is hashed (hashes double from scale to
scale), and the least of each window of W successive hashes is a minimizer.
Inside a run of four periods there are always two such windows a period apart;
their minima are the same, and as a stretch no shorter than the period is met
in a run at multiples of it only, the two follow each other among the places of
that hash.  Pairs of successive equal minimizers at a distance that belongs to
the scale are seeds; seeds of one distance that overlap are one, and each is
extended word by word to both sides, by at most W words for a true run.  A
scale looks at texts long enough for it only, so the work is some array
operations a word and scale.

Each text is worked on whole, in the task that reads it; nothing is shuffled.

Defined results: a null text has no word and no run; very long texts are
searched whole; repeated rows each give their row; an empty table gives an
empty table; of other columns just the key comes along, so clashing names do no
harm.  Hashes only propose: every run is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, configure, ragged, sums
from .textstats import Words

#: Periods up to this are scanned for directly; a power of two.
SHORT = 8
#: Periods and words that a run holds at least.  Seeds rely on four periods.
REPEATS, LEAST = 4, 6
#: Words that extensions compare at once.
SLAB = 1 << 22
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def slid(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """The least (or the largest) of values[i : i + width], for each i; windows are cut at the end."""
    op, fill = (np.minimum, _TOP) if least else (np.maximum, np.uint64(0))
    n = len(values)
    padded = np.full(-(-n // width) * width + width, fill, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = op.accumulate(blocks, axis=1).ravel()
    after = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(after[:n], before[width - 1 : width - 1 + n])


def _lagged(numbers: np.ndarray, left: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the longest stretches in which words q apart are identical (the second word may lie beyond)."""
    if len(numbers) <= q:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    same = np.zeros(len(numbers) - q + 2, dtype=np.int8)
    same[1:-1] = (numbers[q:] == numbers[:-q]) & (left[:-q] > q)
    turns = np.flatnonzero(np.diff(same))
    return turns[::2], turns[1::2] - turns[::2]


def _extended(numbers: np.ndarray, at: np.ndarray, lag: np.ndarray, room: np.ndarray, step: int, width: int) -> np.ndarray:
    """How many places from at on, in the direction of step, words are identical to those lag on; room is the most."""
    out = np.zeros(len(at), dtype=np.int64)
    for low in range(0, len(at), max(1, SLAB // width)):
        open_ = np.arange(low, min(low + max(1, SLAB // width), len(at)))
        while len(open_):
            cols = np.arange(width)
            inside = cols < (room[open_] - out[open_])[:, None]
            i = np.where(inside, (at[open_] + step * out[open_])[:, None] + step * cols, 0)
            same = inside & (numbers[i] == numbers[np.where(inside, i + lag[open_][:, None], 0)])
            whole = same.all(axis=1)
            out[open_] += np.where(whole, width, np.argmin(same, axis=1))
            open_ = open_[whole]
    return out


def _seeds(hashes: np.ndarray, doc: np.ndarray, left: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of successive equal minimizers of stretches of span words, at distances of over half of it, up to it."""
    width = span // 2
    there = left >= span
    h = np.where(there, hashes, _TOP)
    least = slid(h, width)
    highest = slid(least[::-1], width, least=False)[::-1]  # over the windows that hold a place
    at = np.flatnonzero(there & (highest == h))
    at = at[np.lexsort((h[at], doc[at]))]  # stable: places of a hash stay in order
    far = at[1:] - at[:-1]
    good = (h[at[1:]] == h[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]]) & (far > width) & (far <= span)
    return at[:-1][good], far[good]


def runs_of(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of all runs in texts of counts words each, by start, then period; starts count all words."""
    place = np.arange(len(numbers))
    doc = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - place
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def scan(q: int) -> None:
        start, length = _lagged(numbers, left, q)
        found.append((start, length + q, np.full(len(start), q)))

    for q in range(1, SHORT + 1):
        scan(q)
    first = np.cumsum(counts) - counts
    hashes, reach = _mixed(numbers.astype(np.uint64) + np.uint64(1)), 1
    own = place  # of the words that the scale looks at
    width = SHORT
    while len(own) and (long := counts >= REPEATS * (width + 1)).any():
        keep = long[doc[own]]
        own, hashes = own[keep], hashes[keep]
        while reach < 2 * width:
            there = np.flatnonzero(left[own] >= 2 * reach)
            doubled = np.zeros_like(hashes)
            doubled[there] = _mixed(hashes[there] * _ODD[1] + hashes[there + reach])
            hashes, reach = doubled, 2 * reach
        at, lag = _seeds(hashes, doc[own], left[own], reach)
        at = own[at]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + reach)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at)) - 1
        if len(heads):
            begin, end, lag = at[heads], at[tails] + reach, lag[heads]
            begin = begin - _extended(numbers, begin - 1, lag, begin - first[doc[begin]], -1, width)
            end = end + _extended(numbers, end, lag, left[end - 1] - 1 - lag, 1, width)
            cells = ragged(begin, end - begin)
            same = sums(numbers[cells] == numbers[cells + np.repeat(lag, end - begin)], end - begin) == end - begin
            found.append((begin[same], (end - begin + lag)[same], lag[same]))
            for q in np.unique(lag[~same]).tolist():  # hashes of different words were equal
                scan(q)
        width *= 2
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    enough = np.flatnonzero(length >= np.maximum(LEAST, REPEATS * period))
    order = enough[np.lexsort((period[enough], length[enough], start[enough]))]
    start, length, period = start[order], length[order], period[order]
    once = np.ones(len(start), dtype=bool)
    once[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])  # the smallest period of a stretch
    start, length, period = start[once], length[once], period[once]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


FOUND = f"n_words long, runs {RUN}, collapsed string"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (start, length, period, by start, then period; starts count words from 0) and collapsed, of every row.

    collapsed: the words, joined by one space, without those that a run holds after its first period.
    """
    configure(docs.sparkSession)
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            w = Words(texts)
            start, length, period = runs_of(w.numbers, w.counts)
            ends = np.cumsum(w.counts)
            first = ends - w.counts
            owner = np.searchsorted(ends, start, side="right")
            dropped = np.zeros(w.total + 1, dtype=np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, start + length, -1)
            kept = np.cumsum(dropped)[:-1] == 0
            whole = sums(kept, w.counts) == w.counts
            collapsed = []
            for i in range(w.docs):
                at = w.numbers[first[i] : ends[i]]
                collapsed.append(b" ".join(map(w.distinct.__getitem__, (at if whole[i] else at[kept[first[i] : ends[i]]]).tolist())))
            cuts = np.searchsorted(owner, np.arange(w.docs + 1))
            spans = pa.StructArray.from_arrays([pa.array(start - first[owner]), pa.array(length), pa.array(period)], fields=list(struct))
            listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(w.counts), listed, pa.array(collapsed, pa.binary()).cast(pa.string())], names=[key, "n_words", "runs", "collapsed"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {FOUND}")


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a tenth of all documents, told by doc_id, the words from one on repeat a stretch of them until the text ends.

    Such a text's words come joined by one space; a row without doc_id or word stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("w"))
    n = F.size("w")
    a = (F.col("g") % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    looped = F.concat(F.slice("w", F.lit(1), a), F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int"))))
    return rows.select("doc_id", F.when(n > 0, F.array_join(F.slice(looped, F.lit(1), n), " ")).otherwise(F.col("text")).alias("text"))


def _strongest(runs: Column) -> Column:
    """The run of greatest length/period, compared exactly; the first of equal ones."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def described(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, digests of all runs and of the collapsed text, n_words."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    best = F.col("best")
    return found.withColumn("best", _strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


#: The same by comparing all equal words of a text up to a quarter of it apart.
ORACLE_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS b, 0 AS k, CAST(range AS BIGINT) AS c FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
  FROM documents, crc),
sized AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AS loops, h // 10 AS g FROM split),
dealt AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM sized),
texts AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN loops AND n > 0
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM dealt),
words AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM texts),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k),
runs AS MATERIALIZED (SELECT doc_id, s, len, min(q) AS q FROM stretches WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len),
digests AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256,
    first(struct_pack(s := s, len := len, q := q) ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) AS best FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.len),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words w ANTI JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS "start", best.len AS length, best.q AS period, 1000 * best.len // best.q AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256, n AS n_words
FROM texts t LEFT JOIN digests d USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
