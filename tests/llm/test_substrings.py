"""Removal of repeated passages against brute force, and its odd cases."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import queries, substrings
from lodestrand.llm.textstats import Words


def test_same_as_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    answer = c.execute(queries.oracle_sql()["op11_substrings"])
    columns = [d[0] for d in answer.description]
    got = queries.queries()["op11_substrings"](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, answer.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def plain(rows, least):
    """rows: (key, text), one for each document, by order of documents; words that go, by document."""
    seen, out = set(), []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for i in range(len(w) - least + 1):
            x = tuple(w[i : i + least])
            if x in seen:
                gone |= set(range(i, i + least))
            seen.add(x)
        out.append((len(w), gone, " ".join(v for i, v in enumerate(w) if i not in gone)))
    return out


def compared(spark, rows, least, **more):
    """rows have different whole keys."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substrings.dedupe(df, least=least, **more).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for (k, _), (n, gone, kept) in zip(ordered, plain(ordered, least), strict=True):
        spans = [i for s in got[k].removed for i in range(s.start, s.end)]
        assert (got[k].n_words, spans, got[k].kept) == (n, sorted(gone), kept), k


def invented(rng, n, passages):
    words = []
    while len(words) < n:
        words += rng.choice(passages) if rng.random() < 0.5 else [f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, 30))]
    return " ".join(words[:n])


@pytest.mark.parametrize("words", [substrings.BROADCAST_WORDS, 0])
def test_equals_plain_removal(spark, monkeypatch, words):
    """With automata broadcast to all tasks, and with each sent to the tasks of its shard."""
    monkeypatch.setattr(substrings, "BROADCAST_WORDS", words)
    monkeypatch.setattr(substrings, "STREAM_WORDS", 2_000)
    monkeypatch.setattr(substrings, "BLOCK", 150)
    rng = random.Random(1)
    passages = [[f"p{i}-{rng.randrange(6)}" for _ in range(rng.randint(5, 60))] for i in range(12)]
    rows = [(i, invented(rng, rng.randint(0, 400), passages)) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(20)] + [(200, "a " * 300), (201, "a b " * 100), (202, "b a " * 9), (203, None), (204, "")]
    compared(spark, rows, 20)


def test_few_words_make_many_almost_equal_windows(spark, monkeypatch):
    """Stretches of two words group windows of many different continuations: more rounds find the rest."""
    monkeypatch.setattr(substrings, "FLUSH", 100)
    rng = random.Random(2)
    compared(spark, [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(40)], 6, anchor=2)


def test_hashes_decide_nothing(spark, monkeypatch):
    """Where windows that differ share a hash, what is not found at first is found in later rounds."""
    true, turns, places = substrings.window_groups, [], substrings._places

    def coarse(w, least, anchor, seed=0):
        h, at, n = true(w, least, anchor, seed)
        return (h % np.uint64(7) + np.uint64(1000 * seed + 1) if seed < 2 else h), at, n

    monkeypatch.setattr(substrings, "_places", lambda *a: turns.append(a[3]) or places(*a))
    monkeypatch.setattr(substrings, "window_groups", coarse)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(6)]
    compared(spark, [(i, f"{texts[i % 6]} {texts[(i * 5 + 1) % 6]}") for i in range(14)], 5)
    assert turns[:3] == [0, 1, 2]


def test_texts_are_cut_by_the_first_places_of_all_tasks(spark):
    """However many tasks hold copies, each copy is told of the first one, not of the first of its task."""
    body = " ".join(f"w{i}" for i in range(120))
    copies = spark.createDataFrame([(i, 0, 0, body) for i in range(40)], "key long, sig long, at long, body string").repartition(8)
    told = substrings._places(copies, 20, 8, 0, 4, 4).collect()
    keys, firsts = ([k for r in told for k in np.frombuffer(r[c], dtype="<i8").tolist()] for c in ("keys", "first_keys"))
    assert set(firsts) == {0} and set(keys) == set(range(40)) and len(keys) % 40 == 0


def test_groups_hold_each_window_once():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) for _ in range(20)]
    w = Words(texts)
    for anchor in (3, 20):
        hashes, at, n = substrings.window_groups(w, 20, anchor)
        covered = [i for a, m in zip(at.tolist(), n.tolist(), strict=True) for i in range(a, a + m)]
        first = (np.cumsum(w.counts) - w.counts).tolist()
        assert covered == [f + i for f, c in zip(first, w.counts.tolist(), strict=True) for i in range(c - 19)]
        by_window = {}
        flat = w.numbers.tolist()
        for h, a, m in zip(hashes.tolist(), at.tolist(), n.tolist(), strict=True):
            for i in range(a, a + m):
                assert by_window.setdefault(tuple(flat[i : i + 20]), h) == h


def test_automaton_tells_first_ends():
    rng = random.Random(5)
    for _ in range(60):
        sequences = [[b"%d" % rng.randrange(3) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 4))]
        a = substrings.Automaton(sequences)
        flat = [x for k, s in enumerate(sequences) for x in [*s, k]]
        words = [b"%d" % rng.randrange(4) for _ in range(40)] + [x for s in sequences for x in s]
        for least in (1, 3, 6):
            want = []
            for e in range(len(words)):
                x = words[e - least + 1 : e + 1] if e >= least - 1 else None
                want.append(next((i + least - 1 for i in range(len(flat) - least + 1) if flat[i : i + least] == x), -1) if x else -1)
            assert a.ends(words, least) == want
        assert len(a.link) <= 2 * len(flat) + 1


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(45_000))
    passage = " ".join(f"x{i}" for i in range(25))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, f"{passage}\n\tend"), (4, f"{passage}\n\tend"), (4, f"other {passage}"), (5, long), (6, f"start {long}"), (None, passage), (None, f"{passage} more"), (-7, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("clash"), "sig": F.lit("clash"), "kept": F.lit(1), "at": F.lit(2), "n": F.lit(3)})
    got = substrings.dedupe(df).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, []).append((r.n_words, r.kept))
    assert by_key[1] == by_key[2] == by_key[3] == [(0, "")] and by_key[-7] == [(1, "one")]
    assert sorted(by_key[4]) in ([(26, "end")] * 2 + [(26, f"other {passage}")], [(26, "other")] + [(26, f"{passage} end")] * 2)
    assert by_key[5] == [(45_000, long)] and by_key[6] == [(45_001, "start")]
    assert sorted(by_key[None]) == [(25, ""), (26, "more")]
    digests = {r.doc_id: r for r in substrings.described(substrings.dedupe(df.where("doc_id IN (5, 6)"))).collect()}
    assert digests[6].n_removed == 45_000 and digests[6].kept_sha256 == hashlib.sha256(b"start").hexdigest()
    assert substrings.dedupe(df.where("1 = 0")).count() == 0 and substrings.dedupe(df.where("doc_id < 4")).count() == 4


def test_a_period_of_which_references_hold_a_part_makes_few_rows(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(f"o{k}-{j}" for j in range(30 + k)) + f" a{p} b{p}" * 150) for p in range(8) for k in (2 * p, 2 * p + 1)]
    rows += [(100 + k, f"b{k % 8} a{k % 8} " * (15 + k) + " ".join(f"x{rng.randrange(9)}" for _ in range(60)) + f" a{k % 8} b{k % 8} c{k % 3}" * 20) for k in range(16)]
    compared(spark, rows, 20)
    docs = spark.createDataFrame(rows, "key long, text string").withColumn("sig", F.lit(0).cast("long"))
    words = sum(len(t.split()) for _, t in rows)
    assert substrings.removed_stretches(docs).count() < words / 20
