"""Compression of vectors to codes of parts, with equal-average search for the nearest entry.

A vector's components become integers and are cut into parts; each part
position has a codebook, and a part's code is the index of its nearest entry
(squared Euclidean distance, ties to the lower index).

The search sorts a codebook's entries by the sum of their components.  As
(sum x - sum y)^2 / dimension is at most the squared distance of x and y, it
starts where a part's own sum falls and goes outward to both sides; a side ends
when the squared gap of sums over the dimension strictly exceeds the best
distance so far, so that ties are still met.  All parts of a batch go outward
together, in numpy, each until both of its sides have ended.

Codebooks begin with the parts of the vectors of smallest ids and are improved
in rounds: every task sums its parts by entry, Spark adds the sums, and what
reaches the driver is a row for each entry of each part, however many vectors
there are.  Everything is integer arithmetic, so results do not depend on how
rows are dealt out.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do empty ones and those of another length than most (of
equally many, the longest); repeated rows each get their row and count each;
a row without id is coded, but starts a codebook only after all others; where
the length is no multiple of the parts, parts differ by one component at most
and may be empty (code 0, error 0); with fewer vectors than entries, there are
as many entries as vectors; an empty table gives an empty table; other columns
but the label are left behind.  Components of 2^19 and more (for 64 in 16
parts; see LIMIT) are an error, as their squared distances leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, configure, written

#: Components are scaled by this and rounded down.
SCALE = 256
#: Squares of gaps of sums, and sums of squares, stay below this.
LIMIT = 1 << 62


def places(dims: int, parts: int) -> list[tuple[int, int]]:
    """First and last (exclusive) component of each part."""
    return [(i * dims // parts, (i + 1) * dims // parts) for i in range(parts)]


@dataclass
class Codebook:
    """Entries of a part position, and their order by sum."""

    entries: np.ndarray

    def __post_init__(self):
        total = self.entries.sum(axis=1)
        self.order = np.argsort(total, kind="stable")
        self.sums = total[self.order]
        self.sorted = self.entries[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry and squared distance to it, for each row of x; and how many distances were worked out."""
        n, dims = x.shape
        own = x.sum(axis=1)
        best, index, seen = np.full(n, LIMIT // max(dims, 1), dtype=np.int64), np.full(n, len(self.order), dtype=np.int64), 0
        above = np.searchsorted(self.sums, own)
        sides = [(above, 1), (above - 1, -1)]
        open_ = [np.arange(n), np.arange(n)]
        while len(open_[0]) or len(open_[1]):
            for k, (at, step) in enumerate(sides):
                rows = open_[k]
                i = at[rows]
                inside = (i >= 0) & (i < len(self.order))
                rows, i = rows[inside], i[inside]
                near = np.square(self.sums[i] - own[rows]) <= best[rows] * dims
                rows, i = rows[near], i[near]
                gap = x[rows] - self.sorted[i]
                d, entry = np.einsum("ij,ij->i", gap, gap), self.order[i]
                seen += len(rows)
                wins = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
                best[rows[wins]], index[rows[wins]] = d[wins], entry[wins]
                at[rows] += step
                open_[k] = rows
        return index, best, seen


def _finite(vector: str) -> Column:
    c = F.col(vector)
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & (F.size(c) > 0)


def _integers(column: pa.Array, dims: int, parts: int) -> np.ndarray:
    """floor(SCALE * x) of all components of a batch of vectors of one length."""
    x = np.floor(np.asarray(column.flatten(), dtype=np.float64) * SCALE).reshape(-1, dims)
    wide = -(-dims // parts)
    largest = float(np.abs(x).max(initial=0.0))
    if not (2 * largest + 2) ** 2 * max(wide * wide, dims) < LIMIT:
        raise ValueError(f"a component of {largest / SCALE:.3g} is too large: squared distances would leave 64 bits")
    return x.astype(np.int64)


class Coder:
    """Codebooks of all parts of vectors with dims components."""

    def __init__(self, dims: int, books: list[np.ndarray]):
        self.dims, self.books = dims, [Codebook(b) for b in books]
        self.cuts = places(dims, len(books))

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index by part and squared distance by part, of each row."""
        found = [b.nearest(x[:, low:high])[:2] for b, (low, high) in zip(self.books, self.cuts, strict=True)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def digest(self) -> str:
        """SHA-256 of all components of all entries, by part, entry and place within the part."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.entries.ravel().tolist()).encode()).hexdigest()

    def restored(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return np.concatenate([b.entries[codes[:, i]] for i, b in enumerate(self.books)], axis=1) / SCALE


def _first(vectors: DataFrame, dims: int, parts: int, entries: int) -> list[np.ndarray]:
    """The codebooks that training begins with: a row for each entry reaches the driver."""
    rows = vectors.orderBy(F.asc_nulls_last("key"), "vector").limit(entries).select("vector").toArrow()
    x = _integers(rows.column(0).combine_chunks(), dims, parts)
    return [x[:, low:high] for low, high in places(dims, parts)]


def _improved(vectors: DataFrame, coder: Coder) -> Coder:
    """The coder after a round: each entry becomes the mean of its parts, rounded down; an unused one stays."""
    sent = vectors.sparkSession.sparkContext.broadcast(coder)  # its size is that of the codebooks
    wide = max(high - low for low, high in coder.cuts)
    names = [f"s{i}" for i in range(wide)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        size = max(len(b.entries) for b in c.books)
        total, n = np.zeros((len(c.books), size, wide), dtype=np.int64), np.zeros((len(c.books), size), dtype=np.int64)

        def rows() -> pa.RecordBatch:
            part, entry = np.nonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), *(pa.array(total[part, entry, i]) for i in range(wide))], names=["part", "entry", "n", *names])

        for b in batches:
            x = _integers(b.column("vector"), c.dims, len(c.books))
            codes = c.codes(x)[0]
            for p, (low, high) in enumerate(c.cuts):
                np.add.at(total[p, :, : high - low], codes[:, p], x[:, low:high])
                n[p] += np.bincount(codes[:, p], minlength=size)
            if np.abs(total).max(initial=0) > 1 << 61:  # a long task gives its sums more than once
                yield rows()
                total[:], n[:] = 0, 0
        yield rows()

    summed = vectors.select("vector").mapInArrow(run, "part long, entry long, n long, " + ", ".join(f"{c} long" for c in names))
    wide_sums = (F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in names)
    found = summed.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide_sums).collect()  # a row for each entry of each part
    books = [b.entries.copy() for b in coder.books]
    for r in found:
        own = books[r["part"]][r["entry"]]
        own[:] = [int(r[c]) // r["n"] for c in names[: len(own)]]
    sent.destroy()
    return Coder(coder.dims, books)


def _taking_part(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """df without vectors that take no part, and how many components the others have."""
    good = df.where(_finite(vector))
    lengths = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dims = lengths[0]["d"] if lengths else 0
    return good.where(F.size(vector) == dims), dims


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> Coder:
    """Codebooks of the vectors of df after so many rounds; without a vector that takes part, empty ones."""
    configure(df.sparkSession)
    good, dims = _taking_part(df, vector)
    if not dims:
        return Coder(0, [np.zeros((0, 0), dtype=np.int64)] * parts)
    rows = good.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    coder = Coder(dims, _first(rows, dims, parts, entries))
    for _ in range(rounds):
        coder = _improved(rows, coder)
    return coder


def encode(df: DataFrame, coder: Coder, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label, code (two hex digits a part at 256 entries and less, else four) and error of every row that takes part and has the coder's length."""
    spark = configure(df.sparkSession).sparkContext
    digits = 2 if max((len(b.entries) for b in coder.books), default=0) <= 256 else 4
    sent = spark.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            x = _integers(b.column("vector"), c.dims, len(c.books))
            codes, errors = c.codes(x)
            raw = codes.astype(">u1" if digits == 2 else ">u2").tobytes().hex()
            step = digits * len(c.books)
            texts = [raw[i : i + step] for i in range(0, len(raw), step)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(label), pa.array(texts, pa.string()), pa.array(errors.sum(axis=1))], names=[key, label, "code", "error"])

    rows = df.where(_finite(vector) & (F.size(vector) == coder.dims)).select(key, label, F.col(vector).alias("vector"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, label))
    return rows.mapInArrow(run, f"{kinds}, code string, error long")


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every row that takes part.

    label_error adds up the errors of all rows of a label; rows without one are
    together.  The totals, a row a label, are sent along if they are few, and
    else joined by a shuffle that Spark may split where a label is frequent.
    """
    coder = train(df, key, vector, parts, entries, rounds)
    coded = written(encode(df, coder, key, vector, label), "codes")
    totals = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    few = totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = coded.join(F.broadcast(totals) if few else totals, coded[label].eqNullSafe(totals["_label"]))
    return joined.select(key, "code", "error", "label_error", F.lit(coder.digest()).alias("codebooks_sha256"))


#: The same for vectors of 64 components, by comparing with every entry.
ORACLE_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, v[4*p+1] AS a, v[4*p+2] AS b, v[4*p+3] AS c, v[4*p+4] AS d FROM v, range(16) t(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < 64),
b0 AS MATERIALIZED (SELECT p, e, a, b, c, d FROM x JOIN firsts USING (vec_id)),
{rounds}
f AS MATERIALIZED (
  SELECT x.vec_id, x.label, x.p, min({distance} * 64 + k.e) AS z FROM x JOIN b2 k ON x.p = k.p GROUP BY ALL),
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', z % 64)), '' ORDER BY p) AS code, CAST(sum(z // 64) AS BIGINT) AS error FROM f GROUP BY ALL),
digest AS (SELECT sha256(string_agg(a || ',' || b || ',' || c || ',' || d, ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""


def _sql() -> str:
    distance = "((x.a-k.a)*(x.a-k.a) + (x.b-k.b)*(x.b-k.b) + (x.c-k.c)*(x.c-k.c) + (x.d-k.d)*(x.d-k.d))"
    mean = ", ".join(f"coalesce(CAST((s{c} - ((s{c} % n) + n) % n) // n AS BIGINT), k.{c}) AS {c}" for c in "abcd")
    each = """
    a{i} AS (SELECT x.vec_id, x.p, x.a, x.b, x.c, x.d, min({distance} * 64 + k.e) % 64 AS e FROM x JOIN b{i} k ON x.p = k.p GROUP BY ALL),
    s{i} AS (SELECT p, e, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc, sum(d) AS sd FROM a{i} GROUP BY ALL),
    b{j} AS MATERIALIZED (SELECT k.p, k.e, {mean} FROM b{i} k LEFT JOIN s{i} s ON k.p = s.p AND k.e = s.e),"""
    rounds = "".join(each.format(i=i, j=i + 1, distance=distance, mean=mean) for i in range(2))
    return ORACLE_SQL.format(rounds=rounds, distance=distance)


ORACLE_SQL = _sql()
