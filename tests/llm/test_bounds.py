"""Bounds as parameters, components by themselves, and choices that do not depend on the order of rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import ann, graph, lang_crf, ngram_join


def plain_components(edges):
    to = {}

    def root(x):
        while to.setdefault(x, x) != x:
            x = to[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((root(u), root(v)))
            to[b] = a
    return {x: root(x) for x in list(to)}


@pytest.mark.parametrize("name", ["chain", "star", "random", "odd"])
def test_components_equal_plain_ones(spark, name):
    g = random.Random(name)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(200)] + [(-4, 500)],
        "random": [(g.randrange(120), g.randrange(120)) for _ in range(70)],
        "odd": [(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5)],
    }[name]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == plain_components(edges)


def test_no_links_no_components(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_training_without_bounds_takes_everything(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(5_000 if i < 3 else 5)), "aa" if i % 2 else "bb") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(lang_crf, "fit", lambda t, x: (t, x))
    texts, names = lang_crf.train(df, texts=lang_crf.ALL, words=lang_crf.ALL, chars=lang_crf.ALL)
    assert sorted(texts) == sorted(r[1] for r in rows) and sorted(names) == sorted(r[2] for r in rows)
    fewer, _ = lang_crf.train(df, texts=10, words=100, chars=1_000, windows=4)
    assert len(fewer) <= 10 and sum(len(t.split()) for t in fewer) <= 100
    default, _ = lang_crf.train(df)
    assert len(default) == 40 and max(map(len, default)) < max(len(r[1]) for r in rows)


def test_one_of_rows_that_share_id_and_text_stays_the_same(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, f"s{i}") for i in range(12)] + [(2, text, "s"), (3, "another text of its own entirely", "s")]
    kept = set()
    for seed in range(3):
        mixed = random.Random(seed).sample(rows, len(rows))
        df = spark.createDataFrame(mixed, "doc_id long, text string, source string").repartition(1 + seed)
        kept.add(tuple(sorted(tuple(r) for r in ngram_join.keep_one(df).collect())))
    assert len(kept) == 1 and [r[0] for r in next(iter(kept))] == [1, 3]


def test_no_query_finds_next_to_nothing(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(4_000, 24)).astype(np.float32)  # without any structure
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in range(0, 4_000, 20):
        scores = x.astype(float) @ x[q].astype(float)
        scores[q] = -np.inf
        recall.append(len(got[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9 and min(recall) >= 0.5


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    seen = []
    true = ann.build
    monkeypatch.setattr(ann, "SAMPLE_BYTES", 8 * 16 * 200)
    monkeypatch.setattr(ann, "build", lambda sample, radius, lists, k: seen.append((len(sample), lists)) or true(sample, radius, lists, k))
    g = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g.normal(size=(3_000, 16)))], "vec_id long, embedding array<double>")
    assert ann.nearest(df).select("query_id").distinct().count() == 150
    assert seen[0][0] <= 200 and seen[0][1] <= 50


def test_rows_of_other_names_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f", {"k": 1}), (1, "a b c d e f", {"k": 2})], "doc_id long, text string, more map<string,int>").withColumn("_x", F.lit(1))
    assert ngram_join.keep_one(df).count() == 1
