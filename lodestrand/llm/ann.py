"""Approximate nearest neighbours by largest inner product, with balanced posting lists.

Vectors get one more component that puts them all on a sphere, so that the
nearest by distance is the one of largest inner product.  Halving a bounded
sample again and again, always into equal parts, gives the centroids; a graph
that links each to its neighbours is sent to every task and searched from a few
entries for many vectors at once.  A vector lies in the list of its nearest
centroid and, near a boundary, in those of further centroids too.  A query
reads the lists whose centroids are at most a ratio farther than its nearest.
Every vector is indexed, and scores are exact.  What a query finds in its lists
counts only from a score on that, by the sample, somewhat more vectors reach than
are asked for, so that few rows leave a list; a query that finds too little
above that floor has its neighbours elsewhere: it reads wider, without a floor.

Equal vectors are one class: it is indexed once, with as many of its smallest
ids as an answer can show, and equal queries are searched once.  Long lists and
lists that many queries read are split over tasks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do those without an id or of another length than
most; rows that repeat an id and its vector count once; equal scores go to the
smaller id; with fewer candidates than asked for, all are returned; an empty
table gives an empty table; other columns are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import configure, written

#: Vectors that the centroids are fitted on, at most, unless lists are so many that each needs PER_LIST of them.
SAMPLE, PER_LIST = 20_000, 4
#: Bytes of that sample on the driver, at most: with very long vectors it is smaller, and so are centroids fewer.
SAMPLE_BYTES = 128 << 20
#: Lists grow with the square root of the vectors: so many times that, but LIST_SIZE vectors a list at least are aimed at.
#: Their centroids are sent to every task, so no more than MOST_LISTS are made: reached at some 60 million vectors.
LISTS, LIST_SIZE, MOST_LISTS = 4, 256, 32_768
#: Neighbours of a centroid in the graph, entries, and centroids that a search keeps.
DEGREE, ENTRIES, BEAM = 16, 8, 64
#: The power of the ratio within which queries read that found too little.
WIDER = 2.0
#: The floor under a query's scores is that of so many times the vectors asked for, by the sample's share of all; of so many of the sample at least.
FLOOR, FLOOR_LEAST = 1.5, 8
#: Vectors that are searched for at once.
SEARCHED = 256
#: Lists that a vector may lie in, and how much farther than the nearest centroid (distance ratio).
REPLICAS, BOUNDARY = 6, 1.03
#: A further list needs a centroid at least so much (of its own distance) away from those chosen.
APART = 0.4
#: Queries of the sample by which the ratio for a query's lists is set, and the share of their neighbours that it must reach.
TRIALS, REACH, ALMOST_ALL = 300, 0.95, 0.99
#: Lists that are searched together, and the rows and the queries' readings of such a group that one task works on.
GROUP, BLOCKS = 8, (8_192, 32_768)


@dataclass
class Index:
    """Centroids and their graph; radius is that of the sphere."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    radius: float
    ratio: float = 1.0
    sample: np.ndarray | None = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors on the sphere."""
        rest = np.sqrt(np.maximum(self.radius**2 - (x * x).sum(axis=1), 0))
        return np.concatenate((x, rest[:, None]), axis=1)

    def aimed(self, q: np.ndarray) -> np.ndarray:
        """Queries on the sphere; their length does not matter to their order of candidates."""
        q = q * (self.radius / np.sqrt((q * q).sum(axis=1)))[:, None]
        return np.concatenate((q, np.zeros((len(q), 1))), axis=1)

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each row, nearest first, and their distances, by best-first steps through the graph."""
        parts = [self._search(x[a : a + SEARCHED], beam) for a in range(0, len(x), SEARCHED)] or [self._search(x, beam)]
        wide = max(p[0].shape[1] for p in parts)
        fill = lambda a, v: np.pad(a, ((0, 0), (0, wide - a.shape[1])), constant_values=v)
        return np.concatenate([fill(i, -1) for i, _ in parts]), np.concatenate([fill(d, np.inf) for _, d in parts])

    def floor(self, q: np.ndarray, k: int) -> np.ndarray:
        """A score that the k nearest of all reach: the k-th of the sample, or none if it is smaller than that."""
        if self.sample is None or len(self.sample) <= k:
            return np.full(len(q), -np.inf)
        scores = q @ self.sample.astype(np.float64).T
        return np.partition(scores, len(self.sample) - k, axis=1)[:, len(self.sample) - k] - 1e-9 * (np.abs(scores).max(axis=1) + 1)

    def _search(self, x: np.ndarray, beam: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        n, count = len(x), len(self.centroids)
        beam = min(beam, count)
        x, c = x.astype(np.float32), self.centroids.astype(np.float32)
        norms = (c * c).sum(axis=1)
        own = (x * x).sum(axis=1)
        seen = np.zeros((n, count + 1), dtype=bool)
        rows = np.arange(n)[:, None]
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        seen[rows, ids] = True
        dist = own[:, None] + norms[ids] - 2 * x @ c[self.entries].T
        done = np.zeros(ids.shape, dtype=bool)
        while True:
            wait = np.where(done | ~np.isfinite(dist), np.inf, dist)
            k = min(at_once, wait.shape[1])
            pick = np.argpartition(wait, k - 1, axis=1)[:, :k] if k < wait.shape[1] else np.broadcast_to(np.arange(k), (n, k))
            live = np.isfinite(np.take_along_axis(wait, pick, axis=1))
            if not live.any():
                break
            np.put_along_axis(done, pick, True, axis=1)
            near = np.where(live[:, :, None], self.graph[np.where(ids[rows, pick] < 0, 0, ids[rows, pick])], count).reshape(n, -1)
            near = np.where(near < 0, count, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = count
            near[seen[rows, near]] = count
            seen[rows, near] = True
            seen[:, count] = False
            far = near == count
            at = np.where(far, 0, near)
            d = own[:, None] + norms[at] - 2 * np.einsum("nd,nkd->nk", x, c[at])
            d[far] = np.inf
            ids, dist, done = np.concatenate((ids, np.where(far, -1, near)), axis=1), np.concatenate((dist, d), axis=1), np.concatenate((done, far), axis=1)
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, done = (np.take_along_axis(a, keep, axis=1) for a in (ids, dist, done))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.sqrt(np.maximum(np.take_along_axis(dist, order, axis=1), 0))


def balanced_centroids(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Means of the parts that equal halving leaves, the largest part first, until there are so many."""
    import heapq

    parts = [(-len(x), 0, np.arange(len(x)))]
    number = 1
    while len(parts) < lists and -parts[0][0] >= 2:
        _, _, own = heapq.heappop(parts)
        y = x[own]
        a, b = y[rng.choice(len(y), 2, replace=False)]
        for _ in range(6):
            side = (y - (a + b) / 2) @ (b - a)
            order = np.argsort(side, kind="stable")
            low, high = order[: len(y) // 2], order[len(y) // 2 :]
            a, b = y[low].mean(axis=0), y[high].mean(axis=0)
        for part in (low, high):
            heapq.heappush(parts, (-len(part), number, own[part]))
            number += 1
    return np.stack([x[own].mean(axis=0) for _, _, own in sorted(parts, key=lambda p: p[1])])


def centroid_graph(c: np.ndarray, degree: int) -> np.ndarray:
    """For each centroid, near ones that no nearer choice is closer to, then the nearest left, then links back; -1 fills."""
    n = len(c)
    out = np.full((n, 2 * degree), -1, dtype=np.int64)
    norms = (c * c).sum(axis=1)
    back: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        d = norms + norms[i] - 2 * c @ c[i]
        d[i] = np.inf
        near = np.argpartition(d, min(n - 1, 4 * degree) - 1)[: min(n - 1, 4 * degree)] if n > 1 else np.empty(0, dtype=np.int64)
        near = near[np.argsort(d[near], kind="stable")]
        chosen: list[int] = []
        for j in near.tolist():
            if len(chosen) < degree and all(norms[j] + norms[k] - 2 * c[j] @ c[k] >= d[j] for k in chosen):
                chosen.append(j)
        chosen += [j for j in near.tolist() if j not in chosen][: degree - len(chosen)]
        out[i, : len(chosen)] = chosen
        for j in chosen:
            back[j].append(i)
    for i, links in enumerate(back):
        extra = [j for j in links if j not in out[i]][:degree]
        out[i, degree : degree + len(extra)] = extra
    return out


def build(sample: np.ndarray, radius: float, lists: int, k: int = 20, seed: int = 11) -> Index:
    """An index fitted on a sample of vectors."""
    index = Index(np.zeros((1, sample.shape[1] + 1)), np.full((1, 1), -1), np.zeros(1, dtype=np.int64), radius)
    rng = np.random.default_rng(seed)
    x = index.lifted(sample)
    index.centroids = balanced_centroids(x, lists, rng)
    c = index.centroids
    index.graph = centroid_graph(c, min(DEGREE, max(len(c) - 1, 1)))
    chosen = [0]
    far = ((c - c[0]) ** 2).sum(axis=1)
    while len(chosen) < min(ENTRIES, len(c)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((c - c[chosen[-1]]) ** 2).sum(axis=1))
    index.entries = np.unique(chosen)
    index.ratio = calibrate(index, sample, k, rng)
    index.sample = sample[:SAMPLE].astype(np.float32)
    return index


def vector_lists(index: Index, x: np.ndarray, at_once: int = 16 * SEARCHED) -> tuple[np.ndarray, np.ndarray]:
    """Row and list of every place that vectors are put: the nearest centroid, and others across a boundary,
    but not in the direction of one that has it already.  Rows come in order."""
    parts = [_vector_lists(index, x[a : a + at_once]) for a in range(0, len(x), at_once)] or [_vector_lists(index, x)]
    return np.concatenate([row + i * at_once for i, (row, _) in enumerate(parts)]), np.concatenate([at for _, at in parts])


def _vector_lists(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, dist = index.search(index.lifted(x), beam=min(BEAM, 32))
    c = index.centroids
    took = np.zeros(ids.shape, dtype=bool)
    took[:, 0] = True
    for k in range(1, ids.shape[1]):
        fit = (ids[:, k] >= 0) & (dist[:, k] <= BOUNDARY * dist[:, 0] + 1e-9) & (took.sum(axis=1) < REPLICAS)
        rows = np.flatnonzero(fit)
        if not len(rows):
            break
        gap = np.sqrt(((c[ids[rows, :k]] - c[ids[rows, k]][:, None, :]) ** 2).sum(axis=2))
        took[rows[~((gap < APART * dist[rows, k][:, None]) & took[rows, :k]).any(axis=1)], k] = True
    row, k = np.nonzero(took)
    return row, ids[row, k]


def query_lists(index: Index, q: np.ndarray, sizes: np.ndarray, rows: int, wider: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Row and list of every list that queries read: all within the ratio (to the power wider), and on to at least rows vectors.

    A search that ends with its last centroid still within is made again with twice the room.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    left, room = np.arange(len(q)), BEAM
    while len(left):
        ids, dist = index.search(index.aimed(q[left]), beam=room)
        have = np.cumsum(np.where(ids >= 0, sizes[ids], 0), axis=1)
        fit = (dist <= index.ratio**wider * dist[:, :1] + 1e-9) | (np.concatenate((np.zeros((len(left), 1)), have[:, :-1]), axis=1) < rows)
        again = fit[:, -1] & (room < len(index.centroids))
        row, k = np.nonzero(fit & (ids >= 0) & ~again[:, None])
        found.append((left[row], ids[row, k]))
        left, room = left[again], 2 * room
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def calibrate(index: Index, sample: np.ndarray, k: int, rng: np.random.Generator) -> float:
    """The distance ratio within which lists must be read to meet REACH of the true neighbours of queries of the sample,
    and half of the neighbours of ALMOST_ALL of these queries."""
    own = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    row, at = vector_lists(index, sample)  # rows in order
    first = np.searchsorted(row, np.arange(len(sample) + 1))
    q = index.aimed(sample[own])
    dist = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (index.centroids**2).sum(axis=1) - 2 * q @ index.centroids.T, 0))
    dist /= np.maximum(dist.min(axis=1, keepdims=True), 1e-9)
    need: list[list[float]] = []
    for i, q in enumerate(own):
        scores = sample @ sample[q]
        scores[q] = -np.inf
        need.append([dist[i, at[first[x] : first[x + 1]]].min() for x in np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]])
    if len(sample) < 2:
        return 1.0
    return max(float(np.quantile(need, REACH)), float(np.quantile(np.median(need, axis=1), ALMOST_ALL)))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SEARCHED rows at most."""
    for b in batches:
        for a in range(0, b.num_rows, SEARCHED):
            yield b.slice(a, SEARCHED)


def nearest(vectors: DataFrame, queries: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), key and score of the k found nearest rows of each query, its own row apart.

    Queries are the rows whose key is divisible by queries.
    """
    spark = configure(vectors.sparkSession)
    good = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    kind = "array<float>" if vectors.schema[vector].dataType == T.ArrayType(T.FloatType()) else "array<double>"  # scores are of the vectors as they are
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    if dims is None:
        return empty
    dim = dims.d
    rows = rows.where(F.size("v") == dim)
    first = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(f"r <= {k + 1}")
    classes = written(first.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "ids", "v"), "classes")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, radius = classes.agg(F.count("*"), F.max(length)).first()
    wanted = max(1, min(MOST_LISTS, n // LIST_SIZE, int(LISTS * n**0.5)))
    size = min(max(SAMPLE, PER_LIST * wanted), max(1, SAMPLE_BYTES // (8 * dim)))
    wanted = min(wanted, max(1, size // PER_LIST))
    share = min(1.0, 1.1 * size / n + 200 / n)
    hashed = F.pmod(F.xxhash64("cls"), F.lit(1 << 30))
    got = classes.where(hashed < int(share * (1 << 30))).select(hashed.alias("h"), "cls", "v").toArrow()
    x, order = _matrix(got.column("v"), dim), np.lexsort((np.asarray(got.column("cls")), np.asarray(got.column("h"))))[:size]
    x = x[order[np.argsort(np.asarray(got.column("cls"))[order], kind="stable")]]
    index = build(x if len(x) else np.array([classes.first().v], dtype=np.float64), float(radius), wanted, k)
    sent = spark.sparkContext.broadcast(index)
    of_sample = max(FLOOR_LEAST, math.ceil(FLOOR * (k + 1) * len(index.sample) / n))  # neighbours of a query that the sample should hold

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            row, at = vector_lists(sent.value, _matrix(b.column("v"), dim))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(at), *(b.column(c).take(take) for c in ("cls", "ids", "v"))], names=["list", "cls", "ids", "v"])

    lists = written(classes.mapInArrow(put, f"list long, cls long, ids array<long>, v {kind}"), "lists")
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for r in lists.groupBy("list").count().collect():
        sizes[r.list] = r["count"]
    asking = rows.where(F.pmod("id", F.lit(queries)) == 0).select("id", "v").join(classes.select("v", "cls"), "v").select("id", "cls").distinct()
    asking = written(asking, "queries")
    own = classes.join(asking.select("cls").distinct(), "cls", "left_semi").select("cls", "v")

    def probed(asking: DataFrame, wider: float) -> DataFrame:
        """The lists that queries read; those that read wider do so without a floor."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                q = _matrix(b.column("v"), dim)
                row, at = query_lists(sent.value, q, sizes, REPLICAS * (k + 1), wider)
                take = pa.array(row)
                floor = sent.value.floor(q, of_sample)[row] if wider == 1 else np.full(len(row), -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(at), *(b.column(c).take(take) for c in ("cls", "v")), pa.array(floor)], names=["list", "cls", "v", "floor"])

        return written(asking.mapInArrow(probe, f"list long, cls long, v {kind}, floor double"), "probes").withColumn("grp", F.floor(F.col("list") / GROUP))

    lists = lists.withColumn("grp", F.floor(F.col("list") / GROUP))
    groups = -(-len(sizes) // GROUP)

    def parts(x: DataFrame, most: int) -> np.ndarray:
        """In how many blocks each group of lists is worked on."""
        out = np.ones(groups, dtype=np.int64)
        for r in x.groupBy("grp").count().collect():
            out[r.grp] = -(-r["count"] // most)
        return out

    row_parts = parts(lists, BLOCKS[0])

    def best(ask: pa.Table, have: pa.Table) -> pa.Table:
        heads, names = (np.asarray(x.column("cls").combine_chunks() if x.num_rows else [], dtype=np.int64) for x in (have, ask))
        pairs = [np.zeros((3, 0))]
        if len(heads) and len(names):
            q, v = _matrix(ask.column("v"), dim), _matrix(have.column("v"), dim)
            floor = np.asarray(ask.column("floor").combine_chunks())
            of_ask, of_have = (np.asarray(x.column("list").combine_chunks()) for x in (ask, have))
            for at in np.unique(of_ask):
                i, j = np.flatnonzero(of_ask == at), np.flatnonzero(of_have == at)
                if not len(j):
                    continue
                rough = q[i] @ v[j].T
                least = np.full(len(i), -np.inf)
                if len(j) > k + 1:
                    least = np.partition(rough, len(j) - k - 1, axis=1)[:, len(j) - k - 1] - 1e-12 * (np.abs(rough).max() + 1)
                a, b = np.nonzero(rough >= np.maximum(least, floor[i])[:, None])
                a, b = i[a], j[b]
                pairs.append(np.stack((a, b, (v[b] * q[a]).sum(axis=1))))
        a, b, exact = np.concatenate(pairs, axis=1)
        a, b = a.astype(np.int64), b.astype(np.int64)
        order = np.lexsort((heads[b], -exact, names[a]))
        a, b, exact = a[order], b[order], exact[order]
        fresh = np.ones(len(a), dtype=bool)
        fresh[1:] = (names[a[1:]] != names[a[:-1]]) | (heads[b[1:]] != heads[b[:-1]])  # a vector of several lists counts once
        a, b, exact = a[fresh], b[fresh], exact[fresh]
        first = np.flatnonzero(np.diff(names[a], prepend=names[a[0]] - 1)) if len(a) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        keep = place <= k
        ids = have.column("ids").take(pa.array(b[keep])) if have.num_rows else pa.array([], pa.list_(pa.int64()))
        return pa.table({"cls": names[a[keep]], "head": heads[b[keep]], "ids": ids, "score": exact[keep]})

    by = ("grp", "row_block", "ask_block")
    places = Window.partitionBy("cls").orderBy(F.desc("score"), "head")

    def searched(probes: DataFrame) -> DataFrame:
        """cls, id and score of the k + 1 nearest rows of each query's lists."""
        splits = spark.createDataFrame(list(zip(range(groups), row_parts.tolist(), parts(probes, BLOCKS[1]).tolist(), strict=True)), "grp long, rows int, asks int")
        splits = F.broadcast(splits)  # a row per GROUP centroids
        blocks = lists.join(splits, "grp").withColumns({"row_block": F.pmod(F.xxhash64("cls"), "rows").cast("int"), "ask_block": F.explode(F.sequence(F.lit(0), F.col("asks") - 1))})
        asks = probes.join(splits, "grp").withColumns({"ask_block": F.pmod(F.xxhash64("cls"), "asks").cast("int"), "row_block": F.explode(F.sequence(F.lit(0), F.col("rows") - 1))})
        got = asks.select(*by, "list", "cls", "v", "floor").groupBy(*by).cogroup(blocks.select(*by, "list", "cls", "ids", "v").groupBy(*by)).applyInArrow(best, "cls long, head long, ids array<long>, score double")
        got = got.withColumn("r", F.dense_rank().over(places)).where(f"r <= {k + 1}").select("cls", F.explode("ids").alias("id"), "score").distinct()
        return written(got, "found")

    found = searched(probed(own, 1.0))
    enough = found.groupBy("cls").count().where(F.col("count") > k).select("cls")
    short = own.join(enough, "cls", "left_anti")
    found = found.join(enough, "cls", "left_semi").unionByName(searched(probed(short, WIDER)))
    order = Window.partitionBy("cls").orderBy(F.desc("score"), "id")
    top = found.withColumn("r", F.dense_rank().over(order)).where(f"r <= {k + 1}").select("cls", "id", "score").distinct()
    each = asking.withColumnRenamed("id", "query_id").join(top, "cls").where("query_id <> id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(f"rank <= {k}")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
