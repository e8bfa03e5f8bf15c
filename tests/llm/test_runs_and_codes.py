"""Periodic runs and vector codes against brute force, and their odd cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import queries, runs, vector_codes

TABLES = {"op12_vector_codes": "embeddings", "op13_periodic_runs": "documents"}


@pytest.mark.parametrize("name", TABLES)
def test_same_as_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {TABLES[name]} AS SELECT * FROM read_parquet('{sf_dir}/{TABLES[name]}.parquet')")
    answer = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, answer.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


# -- runs


def plain_runs(w):
    """By the definition: every longest stretch of every period, if no smaller period fits it."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def invented(rng):
    words = []
    for _ in range(rng.randint(0, 5)):
        few = rng.choice([1, 2, 3, 60])
        block = [rng.randrange(few) for _ in range(rng.randint(1, 40))]
        words += (block * rng.randint(1, 8))[: rng.randint(1, 300)]
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = rng.randrange(few)
    return words


def test_runs_equal_plain_ones():
    rng = random.Random(3)
    for _ in range(150):
        texts = [invented(rng) for _ in range(rng.randint(0, 4))]
        counts = np.array([len(t) for t in texts], dtype=np.int64)
        got = list(zip(*(x.tolist() for x in runs.runs_of(np.array(sum(texts, []), dtype=np.int64), counts)), strict=True))
        first = np.cumsum(counts) - counts
        want = sorted((r for f, t in zip(first.tolist(), texts, strict=True) for r in ((s + f, n, q) for s, n, q in plain_runs(t))), key=lambda r: (r[0], r[2]))
        assert got == want


def test_runs_do_not_rely_on_hashes(monkeypatch):
    """With hashes that all texts share, seeds mislead; what they propose is compared word by word."""
    monkeypatch.setattr(runs, "_mixed", lambda h: h % np.uint64(3))
    words = np.array(list(range(30)) * 5 + [7, 8, 9], dtype=np.int64)
    got = list(zip(*(x.tolist() for x in runs.runs_of(words, np.array([len(words)]))), strict=True))
    assert all(words[s : s + n - q].tolist() == words[s + q : s + n].tolist() for s, n, q in got)


def test_seeds_are_few():
    """A scale keeps about two minimizers a window, however long the text."""
    g = np.random.default_rng(1)
    h = g.integers(1, 1 << 62, 100_000).astype(np.uint64)
    for width in (8, 64):
        least = runs.slid(h, width)
        assert (least[: len(h) - width] == np.lib.stride_tricks.sliding_window_view(h, width)[: len(h) - width].min(axis=1)).all()
        assert len(np.unique(np.flatnonzero(runs.slid(least[::-1], width, least=False)[::-1] == h))) < 2.3 * len(h) / width


def plain_row(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if w and key is not None:
        h = zlib.crc32(str(key).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    end = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(found), *end, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)), len(w))


def test_runs_query_on_odd_rows(spark):
    long = " ".join(f"w{i % 400}" for i in range(2_500))
    looped = [k for k in range(2_000) if zlib.crc32(str(k).encode()) % 10 == 0][:6]
    texts = [None, "", " \n\t ", "a " * 5, "a " * 6, "x y z " * 4, "a b a b a b a b a b c c c c c c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, long), (3, "a " * 5), (3, "a " * 5), (None, "b b b b b b"), (None, None)]
    rows += list(zip(looped, [None, "", "one", "one two", "one two three four five six seven", " ".join(f"v{i}" for i in range(300))], strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("clash"), "n_words": F.lit("clash"), "w": F.lit(1), "g": F.lit(2)})
    got = [tuple(r) for r in runs.described(runs.find(runs.with_loops(df))).collect()]
    assert sorted(map(repr, got)) == sorted(repr(plain_row(*r)) for r in rows)
    assert runs.find(df.where("1 = 0")).count() == 0


# -- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label) of those that take part; by comparing with every entry."""
    x = {n: [int(np.floor(256 * np.float64(v))) for v in r[1]] for n, r in enumerate(rows)}
    dims = len(rows[0][1])
    cuts = [(i * dims // parts, (i + 1) * dims // parts) for i in range(parts)]
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, rows[n][1]))[:entries]
    books = [[x[n][low:high] for n in order] for low, high in cuts]

    def near(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(e, part, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for book, (low, high) in zip(books, cuts, strict=True):
            members = {}
            for v in x.values():
                members.setdefault(near(book, v[low:high])[1], []).append(v[low:high])
            for i, m in members.items():
                book[i] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    found = [[near(b, x[n][low:high]) for b, (low, high) in zip(books, cuts, strict=True)] for n in range(len(rows))]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], sha) for r, f, e in zip(rows, found, errors, strict=True)]


VECTORS = "vec_id long, embedding array<double>, label int"


def test_search_finds_the_first_nearest_entry():
    g = np.random.default_rng(2)
    for _ in range(200):
        dims = int(g.integers(0, 6))
        entries, x = g.integers(-5, 5, (int(g.integers(1, 70)), dims)), g.integers(-7, 7, (50, dims))
        index, best, _ = vector_codes.Codebook(entries).nearest(x)
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_search_passes_entries_over():
    g = np.random.default_rng(4)
    entries, x = g.integers(-200, 200, (64, 4)), g.integers(-200, 200, (5_000, 4))
    assert vector_codes.Codebook(entries).nearest(x)[2] < 0.7 * 64 * len(x)


@pytest.mark.parametrize("dims", [16, 32, 20, 5])
def test_codes_equal_plain_ones(spark, dims):
    g = np.random.default_rng(dims)
    rows = [(int(k), v, None if n % 5 == 0 else int(n % 3)) for n, (k, v) in enumerate(zip(g.permutation(300), (g.integers(-40, 40, (300, dims)) / 64).tolist(), strict=True))]
    rows += rows[:3] + [(None, rows[0][1], 1)]
    got = [tuple(r) for r in vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_codes(rows)))


def test_codes_of_odd_rows(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), -0.5] * 8, i % 2) for i in range(20)]
    bad = [(30, None, 1), (31, [], 1), (32, [nan] + [0.0] * 15, 1), (33, [inf] + [0.0] * 15, 1), (34, [None] + [0.0] * 15, 1), (35, [1.0] * 15, 1)]
    df = spark.createDataFrame(good + bad, VECTORS).withColumns({"code": F.lit("clash"), "error": F.lit("clash"), "key": F.lit(1), "vector": F.lit(1), "part": F.lit(0)})
    assert sorted(map(repr, plain_codes(good))) == sorted(repr(tuple(r)) for r in vector_codes.compress(df).collect())
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 0)  # labels by a shuffle
    assert sorted(map(repr, plain_codes(good))) == sorted(repr(tuple(r)) for r in vector_codes.compress(df).collect())
    assert vector_codes.compress(df.where("1 = 0")).count() == 0 and vector_codes.compress(df.where("vec_id = 31")).count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 16, 1)], VECTORS)).count()


def test_codes_restore_vectors(spark):
    rows = [(i, [i / 256] * 16, 0) for i in range(10)]
    coder = vector_codes.train(spark.createDataFrame(rows, VECTORS))
    codes = np.array([list(bytes.fromhex(r.code)) for r in vector_codes.encode(spark.createDataFrame(rows, VECTORS), coder).orderBy("vec_id").collect()])
    assert np.array_equal(coder.restored(codes), np.array([r[1] for r in rows]))
