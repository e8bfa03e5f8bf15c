"""The pipeline is its stages, one after another, and each does its own work."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrand.llm import gam, lang_crf
from lodestrand.llm.common import fold


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in gam.classify(docs, labels).collect()}
    first = corpus_pipeline.quality(spark, docs, sf_dir)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {k for k, v in scores.items() if v}
    first = first.persist()
    model = lang_crf.train(first.where(fold("doc_id", 4) != 2))
    fine = {r.doc_id for r in lang_crf.label(first, model).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    second = corpus_pipeline.language(spark, first, sf_dir).persist()
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == fine
    third = corpus_pipeline.near_copies(spark, second, sf_dir).persist()
    assert third.columns == docs.columns and 0 < third.count() <= second.count()
    plain = sorted(map(tuple, corpus_pipeline.packed(spark, third, sf_dir).drop("sequence_id").collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id").collect())) == plain


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def one_of_each(rows):
    """(doc_id, text) of what stays of rows, worked out pair by pair."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for held in holders.values() for k, b in enumerate(held) for a in held[:k]}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    return rows, group


def test_near_copies_stage_equals_pair_by_pair(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, group = one_of_each([(r.doc_id, r.text) for r in docs.collect()])
    firsts = {}
    for r, g in zip(rows, group, strict=True):  # by doc_id
        firsts.setdefault(g, r)
    kept = corpus_pipeline.near_copies(spark, docs, sf_dir)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(firsts.values())
    assert len(firsts) < len(rows)


def test_packed_stage_equals_the_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tk = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tk.encode_special_tokens = True
    expected = Counter()
    for r in docs.collect():
        ids, at = np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4"), 0
        while at < len(ids):
            size = min(2048, 1 << (len(ids) - at).bit_length() - 1)
            expected[r.doc_id, at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids)] += 1
            at += size
    got = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Documents with odd rows among them: null keys and texts, empty, blank, very long, repeated ones, and clashing columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = docs.where("text is not null AND length(text) > 400").orderBy("doc_id").first().text
    long = " ".join(f"{w}{i % 89}" for i in range(60) for w in clean.split())
    rows = [(900_001, None), (900_002, ""), (900_003, " \n"), (900_004, long), (900_005, clean), (900_005, clean), (None, clean), (None, None), (900_006, "12 34 56")]
    more = spark.createDataFrame([(k, t, None, "s", 0) for k, t in rows], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    return docs.unionByName(more).withColumns({c: F.lit("own") for c in ("score", "n_shingles", "component_id", "sig", "length", "_n")})


def test_stages_with_odd_rows(spark, sf_dir, odd):
    whole = Counter((r.doc_id, r.text) for r in odd.collect())
    for stage in (corpus_pipeline.quality, corpus_pipeline.language, corpus_pipeline.near_copies):
        got = stage(spark, odd, sf_dir)
        assert got.columns == odd.columns
        rows = got.collect()
        kept = Counter((r.doc_id, r.text) for r in rows)
        assert all(r.score == r.sig == "own" for r in rows) and set(kept) <= set(whole) and kept
        assert stage is corpus_pipeline.near_copies or all(kept[x] == whole[x] for x in kept)
        if stage is corpus_pipeline.language:
            assert not {900_001, 900_002, 900_003, 900_006} & {k for k, _ in kept} and (None, None) not in kept
        if stage is corpus_pipeline.near_copies:
            assert {900_001, 900_002, 900_003} <= {k for k, _ in kept} and kept[None, None] == 1 and sum(n for (k, _), n in kept.items() if k == 900_005) <= 1
    pieces = corpus_pipeline.packed(spark, odd, sf_dir)
    sizes = Counter()
    for r in pieces.collect():
        sizes[r.doc_id] += r.length
    assert sizes[900_001] == 1 and sizes[900_002] == 1 and sizes[900_005] % 2 == 0 and sizes[None] > 1


def test_stages_of_nothing(spark, sf_dir, odd):
    none = odd.where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
