"""The training-data operators against brute force, round trips and held-out accuracy, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import functions as F

from conftest import DATA
from lodestrand.llm import ann, bpe, chat, common, gam, lang_crf, lm, ngram_join, packing, quality_rules, queries, warc

RANKS, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))
SECOND = RANKS, public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, tiny, repeated, very long, strange texts; a null key; a clashing extra column."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"), (6, long), (7, "<s>[INST] \\ </s>"), (8, "漢字 Ünï 🙂 ñandú"), (None, "no key here at all"), (9, "ONE two three four five six")]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)
    return df.withColumns({"score": F.lit("x"), "ids": F.lit(0)})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def empty(df):
    return df.where("1 = 0")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("conversations", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    answer = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(map(repr, answer.fetchall())) == sorted(repr(tuple(r)) for r in queries.queries()[name](spark, sf_dir).select(*columns).collect())


# -- nearest neighbours


def brute_nearest(rows, q, k):
    own = dict(rows)[q]
    found = sorted((-float(np.dot(np.float64(own), np.float64(v))), i) for i, v in rows if i != q)
    return [i for _, i in found[:k]]


def test_nearest_reaches_recall(spark):
    g = np.random.default_rng(1)
    x = (g.normal(size=(40, 16))[g.integers(0, 40, 3000)] + 0.3 * g.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = [len(set(got[q]) & set(brute_nearest(rows, q, 20))) / 20 for q in range(0, 3000, 20)]
    assert np.mean(hits) >= 0.9 and all(len(v) == 20 for v in got.values())


def test_nearest_query_reaches_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").collect() if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    got = defaultdict(list)
    for r in queries.op1_nearest(spark, f"{DATA}/sf0.01").orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    hits = [len(set(got[q]) & set(brute_nearest(rows, q, 20))) / 20 for q in got]
    assert np.mean(hits) >= 0.9 and min(hits) >= 0.5


def test_nearest_keeps_doubles(spark):
    rows = [(i, [1.0 + i * 1e-12, 1.0]) for i in range(21)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20, 0, -1)) and got[0].score == 2.0 + 20 * 1e-12


def test_nearest_sample_reaches_the_largest_ids(spark, monkeypatch):
    class Seen(Exception):
        pass

    def build(sample, *_):
        raise Seen(sample)

    monkeypatch.setattr(ann, "SAMPLE", 500)
    monkeypatch.setattr(ann, "build", build)
    with pytest.raises(Seen) as seen:
        ann.nearest(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3000)], "vec_id long, embedding array<float>"))
    ids = seen.value.args[0][:, 0]
    assert len(ids) == 500 and 20 < (ids >= 2700).sum() < 90


def test_nearest_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [1.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [1.0, None]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 4, 1.0), (0, 2, 20, 1.0), (0, 3, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 4, 1.0), (20, 3, 3, 0.0)]
    assert ann.nearest(empty(df)).count() == 0


# -- chat


def test_chat_round_trip(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", "a</s>\\[INST]"), (1, 1, "assistant", None), (2, 0, None, ""), (2, 0, None, ""), (3, None, "assistant", "<\\s>🙂" * 3000), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", "a</s>\\[INST]"), ("assistant", ""), ("assistant", "b")] and out[1].n_blocks == 2
    assert list(out[1].learnt) == ["", "b"] and len(out[2].turns) == 2 and out[3].learnt == ["<\\s>🙂" * 3000]
    assert out[1].formatted.count("</s>") == 2 and set(out) == {1, 2, 3, None}
    assert chat.digests(empty(df)).count() == 0


def test_chat_prefix_sums(spark):
    a = list(range(1500))
    got = spark.createDataFrame([(a,), ([],)], "a array<bigint>").select(chat.prefix_sums(F.col("a")).alias("s")).collect()
    assert list(got[0].s) == [sum(a[:i]) for i in range(1500)] and list(got[1].s) == []


# -- language model


def plain_scores(rows):
    counts = Counter()
    for k, t in rows:
        if zlib.crc32(("" if k is None else str(k)).encode()) % 7 != 2:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    return n, sorted((k if k is not None else -1, len(w := [*words(t), None]), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for k, t in rows)


def test_lm_base_scores(odd, docs, texts):
    for df, rows in ((odd, [(r.doc_id, r.text) for r in odd.collect()]), (docs, list(texts.items()))):
        got = lm.score_all(df).collect()
        n, expected = plain_scores(rows)
        assert {r.train_tokens for r in got} == {n}
        shown = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
        assert [a[:3] for a in expected] == [a[:3] for a in shown]
        assert all(abs(a[3] - b[3]) < 1e-4 for a, b in zip(expected, shown, strict=True))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score_all(empty(odd)).count() == 0


def lm_model(spark, rows, rounds=lm.ROUNDS):
    df = common.configure(spark).createDataFrame(rows, "doc_id long, text string")
    tokens = common.written(lm.tokenised(df, "doc_id", "text", F.lit(True)), "tokens")
    counts = common.written(lm.counted(tokens, 8), "counts")
    return tokens, counts, *lm.train(tokens, counts, rounds)


def test_lm_trains_on_every_position(spark):
    rows = [(i, " ".join(f"w{(i * 3 + j) % 11}" for j in range(i % 4 or 30))) for i in range(200)]
    tokens, _, t, _ = lm_model(spark, rows, rounds=0)
    visits = [sum(lm._changed(tokens, t, t.weights(), turn)[k][1][: (1, lm.CLASSES)[k]].sum() for turn in range(lm.ROUNDS)) for k in (0, 1)]
    assert visits == [t.total] * 2 and t.total == sum(len(x.split()) + 1 for _, x in rows)


def plain_model(t, weights, text, counts):
    """log10 probability of a text, position by position, and for each position the sum over all words and an unknown one."""

    def parts(w):
        raw = b"" if w is None else w.encode()
        h = 1 if w is None else xxhash.xxh64_intdigest(raw)
        kind = int(t.class_of[0 if w is None else (raw[-2] if len(raw) > 1 else 0) * 256 + raw[-1]])
        at = int(np.searchsorted(t.head, np.uint64(h)))
        place = int(t.head_place[at]) if at < len(t.head) and t.head[at] == h else 0
        return h * 0x9E3779B97F4A7C15 % 2**64 >> 40, kind, place

    def soft(x):
        e = np.exp(x.astype(float) - x.max())
        return e / e.sum()

    w = [*words(text), None]
    got = [parts(x) for x in w]
    total, wholes = 0.0, []
    for i, word in enumerate(w):
        b = [got[i - k] if i >= k else (0, lm.CLASSES, 0) for k in (1, 2)]
        wide = lm.CLASSES + 1
        outer = (0, b[0][0] % lm.WORD_ROWS, b[1][0] % lm.SKIP_ROWS, b[1][1] * wide + b[0][1])
        of_class = soft(sum(weights[0][r + o] for r, o in zip(outer, lm.CLASS_OFFSETS, strict=True)))

        def chance(word, parts, outside=False):
            kind, place = parts[1], 0 if outside else parts[2]
            inner = (kind, (b[0][0] + kind * 40503) % lm.PLACE_WORDS, (b[1][0] + kind * 40503) % lm.PLACE_SKIPS)
            of_place = soft(sum(weights[1][r + o] for r, o in zip(inner, lm.PLACE_OFFSETS, strict=True)))
            return of_class[kind] * of_place[place] * (1.0 if place else (counts.get(word, 0) + 1) / 10 ** t.in_place[kind])

        total += math.log10(chance(word, got[i]))
        own = {k: [] for k in range(lm.CLASSES)}
        for x in counts:
            own[parts(x)[1]].append(x)
        wholes.append(sum(chance(x, parts(x)) for x in counts) + sum(chance("", (0, k, 0), True) for k in own))
    return total, wholes


def test_lm_scores_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 60)
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{min(rnd.randint(0, 40), rnd.randint(0, 90))}{rnd.choice('abc')}" for _ in range(rnd.randint(0, 25)))) for i in range(150)]
    tokens, counts, t, weights = lm_model(spark, rows)
    times = Counter(x for _, text in rows for x in [*words(text), None])
    assert 0 < len(t.head) < len(times) and t.head_place.max() > 0
    got = {r.doc_id: r for r in lm.score(tokens, counts, t, weights, 8).collect()}
    for k, text in rows[:12]:
        total, wholes = plain_model(t, weights, text, times)
        assert abs(got[k].score - total) < 1e-3 and all(abs(x - 1) < 1e-3 for x in wholes)


def test_lm_learns_context(spark):
    a, b = "red apple sweet", "blue berry sour"
    rows = [(i, " ".join(a if (i + j) % 2 else b for j in range(20))) for i in range(300)]
    tokens, counts, t, weights = lm_model(spark, rows)
    plain = {r.doc_id: r.score for r in lm.score(tokens, counts, t, t.weights(), 8).collect()}
    assert all(r.score > plain[r.doc_id] + 1 for r in lm.score(tokens, counts, t, weights, 8).collect())


def test_lm_shares_add_up():
    g = np.random.default_rng(2)
    rows, outcome = g.integers(0, 500, (6, 50)), g.integers(0, 48, 50)
    w = 40 * g.normal(size=(500, 48)).astype(np.float32)
    p = lm.shares(w, rows)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and np.allclose(lm.log_shares(w, rows, outcome)[p[np.arange(50), outcome] > 1e-30], np.log(p[np.arange(50), outcome][p[np.arange(50), outcome] > 1e-30]), atol=1e-3)


# -- packing


def test_packing_round_trip(spark, odd, docs, texts, tmp_path):
    tk = tokenizers.Tokenizer.from_file(WORDS)
    tk.encode_special_tokens = True
    for df, rows in ((odd, [(r.doc_id, r.text) for r in odd.collect()]), (docs, list(texts.items()))):
        packed = packing.pack(df, WORDS)
        got = packed.collect()
        assert len({r.sequence_id for r in got}) == len(got) and all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.length == 1 << r.bucket for r in got)
        whole = defaultdict(Counter)
        for r in got:
            whole[r.doc_id][r.start, r.length, bytes(r.tokens), r.doc_tokens] += 1
        for k, copies in Counter(rows).items():
            key, text = k
            ids = [*tk.encode(text or "", add_special_tokens=False).ids, 1]
            pieces = {p: n for p, n in whole[key].items() if p[3] == len(ids)}
            assert b"".join(p[2] for p in sorted(pieces)) == np.array(ids, dtype="<u4").tobytes() and set(pieces.values()) == {copies}
    packing.write_buckets(packed, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("bucket = 3").count() == packed.where("length = 8").count()
    assert packing.pack(empty(odd), WORDS).count() == 0


@pytest.mark.parametrize("n", [1, 7, 2048, 2049, 5000])
def test_binary_lengths(n):
    cuts = packing.binary_lengths(n, 2048)
    assert sum(cuts) == n and len(cuts) == n // 2048 + bin(n % 2048).count("1")


# -- WARC


def test_warc_odd_pages_and_damage(spark):
    big = "é" * 400_000
    rows = [(1, "http://a b", None), (2, None, "x" * 99), (3, "u", "x" * 99), (9, "u", big), (4, "u\n", big), (4, "u", big), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = sorted(((r.page_id is None, r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(warc.write_archives(df, archive_bytes=200)).collect()), key=repr)
    assert got == sorted([(False, 1, "response", None, 0), (False, 2, "response", None, 99), (False, 3, "response", None, 99), (False, 4, "response", None, 800_000), (False, 4, "response", None, 800_000), (False, 9, "revisit", 4, 800_000), (True, None, "revisit", 4, 800_000)], key=repr)
    assert warc.described(empty(df)).count() == 0
    data = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None, False)
    assert warc.parse(iter([data[:50], data[50:]]))["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(iter([data.replace(b"abc\r\n\r\n", b"abd\r\n\r\n")]))
    with pytest.raises(ValueError, match="bytes"):
        warc.parse(iter([data[:-4]]))


# -- near copies


def plain_components(rows, size, percent):
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = words(t)
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k is None, k or 0, len(sets[i]), low.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def test_near_copies(spark, odd):
    rnd = random.Random(4)
    base = [rnd.choice("abcdefghij") * rnd.randint(1, 5) + str(rnd.randint(0, 400)) for _ in range(150)]
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    for i in range(160):  # one large group around the threshold, and texts that share its first half
        w = base[:75] + [str(rnd.random()) for _ in range(75)] if i % 4 == 3 else list(base)
        for _ in range(i % 5):
            w[rnd.randrange(150)] = str(rnd.random())
        rows.append((100 + i, " ".join(w)))
    for size, percent in ((4, 85), (5, 80)):
        got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got), key=repr) == plain_components(rows, size, percent)
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert ngram_join.join(empty(odd)).count() == 0


def test_one_row_of_a_component_stays_whatever_its_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    near = lambda t: t + " more"
    rows = [(None, a), (None, near(a)), (None, a), (7, b), (None, near(b)), (3, c), (3, near(c)), (9, c), (None, "alone here")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text[0]) for r in kept) == [(-1, "a"), (-1, "a"), (3, "c"), (7, "b")]
    assert sum(r.text == "alone here" for r in kept) == 1


def test_matches_asked_is_the_cheapest():
    often = np.array([2, 2, 3, 50, 60, 70])
    cost = {a: (often[: 2 + a - 1] - 1).sum() * (1 + 0.05 * 40 / a) for a in range(1, 6)}
    assert cost[ngram_join.matches_asked(often, 40, 2)] == min(cost.values())


# -- quality rules


def plain_counts(text):
    w = words(text, lower=False)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(odd, docs):
    for df in (odd, docs):
        own = {(r.doc_id, r.text) for r in df.collect()}
        expected = Counter((k, *plain_counts(t)) for k, t in ((r.doc_id, r.text) for r in df.collect()))
        got = quality_rules.rate(df, PIECES).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected and own
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert sum(r.kept for r in got) > 0.8 * sum(not r.base_failed for r in got)
    assert quality_rules.rate(empty(odd), PIECES).count() == 0


#: The first article of the declaration of human rights.
ARTICLES = {
    "indic": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए",
    "georgian": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით",
    "armenian": "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով նրանք ունեն բանականություն ու խիղճ և միմյանց պետք է եղբայրաբար վերաբերվեն",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם כולם חוננו בתבונה ובמצפון לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء",
    "cjk": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα Είναι προικισμένοι με λογική και συνείδηση",
    "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства",
    "other": "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው የተፈጥሮ ማስተዋልና ሕሊና ስላለው አንዱ ሌላውን በወንድማማችነት መንፈስ መመልከት ይገባዋል",
}
BLOCKS = {"indic": (0x905, 0x939), "armenian": (0x561, 0x586), "hebrew": (0x5D0, 0x5EA), "arabic": (0x620, 0x64A), "cjk": (0x4E00, 0x9FFF), "greek": (0x3B1, 0x3C9), "cyrillic": (0x430, 0x44F), "other": (0xA000, 0xA48C)}


def test_rules_keep_scripts_and_reject_their_random_letters(spark):
    g = random.Random(5)
    rows = [(i, s, True, t) for i, (s, t) in enumerate(ARTICLES.items())]
    rows += [(100 + i, s, False, " ".join("".join(chr(g.randint(a, z)) for _ in range(8)) for _ in range(80))) for i, (s, (a, z)) in enumerate(BLOCKS.items())]
    got = {r.doc_id: r for r in quality_rules.rate(spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, text string"), PIECES, SECOND, min_words=5).collect()}
    assert {(i, got[i].script, got[i].kept) for i, *_ in rows} == {(i, s, k) for i, s, k, _ in rows}


def test_rules_measure_as_a_plain_count(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})
    rows = [(r.doc_id, r.text) for r in docs.limit(40).collect()] + [(10_000 + i, t) for i, t in enumerate(ARTICLES.values())]
    got = {r.doc_id: r for r in quality_rules.rate(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, SECOND).collect()}
    for k, text in rows:
        w = words(text, lower=False)
        pieces = [x for y in w for x in sp.encode(y)]
        r, n, b = got[k], max(len(pieces), 1), quality_rules.BANDS[got[k].script]
        chars, share = sum(map(len, w)) / n, sum(sp.is_byte(x) or "\ufffd" in sp.id_to_piece(x) for x in pieces) / n
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(pieces).values())
        assert r.n_tokens == len(pieces) and abs(r.chars_per_token - chars) < 1e-9 and abs(r.byte_share - share) < 1e-9 and abs(r.token_entropy - entropy) < 1e-9
        second = None
        if b.second:
            own = [y for y in w if quality_rules.top_letter(y) >= 0x370]  # no text here mixes two of the scripts asked
            second = sum(map(len, own)) / sum(len(enc.encode_ordinary(" " + y)) for y in own)
            assert abs(r.second_chars - second) < 1e-9
        fits = b.chars_per_token[0] <= chars <= b.chars_per_token[1] and share <= b.byte_share and entropy >= b.entropy * math.log2(max(min(n, b.entropy_tokens), 1)) and (second is None or second >= b.second)
        assert r.kept == (fits and not r.base_failed)


def test_rules_reject_what_no_vocabulary_knows(spark):
    g = random.Random(1)
    noise = " ".join("".join(chr(g.randint(0xE000, 0xE0FF)) for _ in range(8)) for _ in range(80))
    row = quality_rules.rate(spark.createDataFrame([(1, "a" + noise)], "doc_id long, text string"), PIECES, bands=quality_rules.BANDS | {"other": quality_rules.BANDS["latin"]}).first()
    assert not row.base_failed and row.byte_share > 0.5 and not row.kept


def test_rules_reject_noise_with_the_production_bands(spark):
    g = random.Random(1)
    noise = lambda a, z: " ".join("".join(chr(g.randint(a, z)) for _ in range(8)) for _ in range(80))
    latin = "The quick brown fox jumps over the lazy dog while many other people walk along the river and talk about the weather of the coming week and what it might bring them then".split()
    own = [f"{w}{g.choice('aeiou')}{g.choice('nrst')}" for w in latin * 3]
    broken = " ".join(w[:2] + "\ufffd" + w[2:] for w in own)
    real = ["\u201c" + w + "\u201d" for w in own]
    rows = [(1, noise(0xE000, 0xE0FF)), (2, noise(0x4E00, 0x9FFF)), (3, broken), (4, " ".join(real)), (5, " ".join(own))]
    got = {r.doc_id: r for r in quality_rules.rate(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()}
    assert not any(r.base_failed for r in got.values()) and [got[i].kept for i in (1, 2, 3)] == [False] * 3
    assert [got[i].script for i in (1, 2, 3, 4, 5)] == ["none", "cjk", "latin", "latin", "latin"] and got[5].kept


# -- language


def test_marginals_are_exact():
    g = np.random.default_rng(0)
    counts = np.array([5, 0, 1, 100, 33, 64])
    e, a = g.normal(size=(counts.sum(), 3)) * 3, g.normal(size=(3, 3))
    p, at = lang_crf.marginals(e, counts, a), 0
    for n in counts:
        x = e[at : at + n]
        left, right = x.copy(), np.zeros_like(x)
        for t in range(1, n):
            left[t] = np.logaddexp.reduce(left[t - 1][:, None] + a, axis=0) + x[t]
        for t in range(n - 2, -1, -1):
            right[t] = np.logaddexp.reduce(a + (x[t + 1] + right[t + 1])[None, :], axis=1)
        q = np.exp(left + right)
        assert np.allclose(q / q.sum(axis=1, keepdims=True), p[at : at + n], atol=1e-8)
        at += n


def test_crf_gradient_is_that_of_the_likelihood():
    g = np.random.default_rng(4)
    distinct = [b"abc", b"de", b"fgh", b"12"]
    seqs, gold = g.integers(0, 4, (5, 7)), g.integers(0, 3, (5, 7))
    seqs[1, 4:], gold[1, 4:], seqs[3, 1:], gold[3, 1:] = -1, -1, -1, -1
    data = lang_crf.Sequences(seqs, gold, distinct, {b"de": 0}, 3)
    weights, moves = 0.3 * g.normal(size=(lang_crf.BUCKETS + 1, 3)), 0.5 * g.normal(size=(3, 3))
    _, by_weight, by_move = data.gradient(weights, moves)
    step = 1e-5

    def slope(param, at):
        out = []
        for sign in (1, -1):
            param[at] += sign * step
            out.append(data.gradient(weights, moves)[0])
            param[at] -= sign * step
        return (out[0] - out[1]) / (2 * step)

    used = np.unique(np.concatenate([b for b, _ in data.features]))
    for at in [(int(r), j) for r in used[:6] for j in range(3)]:
        assert abs(slope(weights, at) - by_weight[at]) < 1e-4
    for at in np.ndindex(3, 3):
        assert abs(slope(moves, at) - by_move[at]) < 1e-4


def test_language_predictions_equal_a_plain_chain(docs):
    rows = [(r.text, r.lang) for r in docs.where("text is not null and lang is not null").limit(120).collect()]
    model = lang_crf.fit([t[:600] for t, _ in rows], [x for _, x in rows], rounds=8)
    for text, _ in rows[:10]:
        w = [x for x in text.lower().encode().split()]
        e, a = model.emissions(w).astype(float), model.moves
        left, right = e.copy(), np.zeros_like(e)
        for t in range(1, len(w)):
            left[t] = np.logaddexp.reduce(left[t - 1][:, None] + a, axis=0) + e[t]
        for t in range(len(w) - 2, -1, -1):
            right[t] = np.logaddexp.reduce(a + (e[t + 1] + right[t + 1])[None, :], axis=1)
        p = np.exp(left + right - np.logaddexp.reduce(left + right, axis=1, keepdims=True))
        spoken = lang_crf.with_letter(w)
        mean = p[spoken].mean(axis=0)
        _, _, _, lang, score = lang_crf._labelled(model, [text])
        assert lang[0] == model.languages[int(mean.argmax())] and abs(score[0] - mean.max()) < 1e-6


def test_training_reads_long_texts_from_first_to_last(spark):
    text = " ".join(f"word{i}" for i in range(9_000))
    got = spark.createDataFrame([(text,), ("short text",), ("x" * 50_000,)], "t string").select(lang_crf._windows(F.col("t"), 20_000, 10).alias("t")).collect()
    numbers = [int(w[4:]) for w in got[0].t.split()]
    assert numbers[0] < 10 and numbers[-1] > 8_990 and len(got[0].t) <= 20_010 and got[1].t == "short text" and len(got[2].t) == 20_009
    assert sum(y - x > 1 for x, y in zip(numbers, numbers[1:])) == 9 and all(w in text.split() for w in got[0].t.split())
    cut = lang_crf._pieces([" ".join(map(str, range(1000))), "a b c"], 103)
    assert cut[1] == "a b c" and cut[0].split()[0] == "0" and cut[0].split()[-1] == "999" and len(cut[0].split()) == 100


def test_languages_held_out_and_odd(spark, docs, odd):
    got = lang_crf.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    out = {r.doc_id: (r.lang_pred, r.score) for r in lang_crf.identify(odd).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[6][0] == "en" and 0 < out[6][1] <= 1
    assert lang_crf.identify(empty(odd)).count() == 0


def test_rare_language_has_its_share_of_training(spark, monkeypatch):
    rows = [(i, " ".join(f"often{(i * 7 + j) % 50}" for j in range(40)), "aa") for i in range(3000)]
    rows += [(5000 + i, " ".join(f"seldom{(i * 7 + j) % 50}" for j in range(40)), "bb") for i in range(60)]
    monkeypatch.setattr(lang_crf, "TRAINING_WORDS", 4_000)
    monkeypatch.setattr(lang_crf, "fit", lambda t, x: (t, x))
    texts, names = lang_crf.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert Counter(names)["bb"] == 60 and Counter(names)["aa"] >= 700
    size = Counter({x: sum(len(t.split()) for t, y in zip(texts, names, strict=True) if y == x) for x in ("aa", "bb")})
    assert 1_000 < size["aa"] <= 2_000 and 1_000 < size["bb"] <= 2_000


def test_long_and_short_texts_are_learned_from(spark):
    rows = [(i, " ".join(f"often{(i * 7 + j) % 50}" for j in range(4_000 if i % 2 else 100)), "aa") for i in range(20)]
    rows += [(100 + i, " ".join(f"long{(i * 7 + j) % 50}" for j in range(4_000)), "bb") for i in range(20)]
    rows += [(200 + i, " ".join(f"brief{(i * 7 + j) % 50}" for j in range(10)), "cc") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_crf.train(df)
    got = lang_crf.label(df, model).join(df, "doc_id").collect()
    assert model.languages == ["aa", "bb", "cc"] and all(r.lang_pred == r.lang for r in got)


def test_language_runs(spark, docs):
    model = lang_crf.train(docs)
    by = {x: docs.where((F.col("lang") == x) & F.length("text").between(400, 2000)).orderBy("doc_id").first().text.split()[:60] for x in ("de", "fr")}
    mixed = spark.createDataFrame([(1, " ".join(by["de"] + by["fr"]))], "doc_id long, text string")
    runs = lang_crf.label(mixed, model).first().runs
    assert {r.lang for r in runs} >= {"de", "fr"} and sum(r.words for r in runs) == 120


# -- encoding


def test_encoding_equals_the_library(odd, docs):
    v = bpe.vocabulary(RANKS, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    for df in (odd.drop("ids"), docs):
        for r in bpe.decode(bpe.encode(df.withColumn("own", F.col("text")), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect():
            assert list(r.ids) == enc.encode_ordinary(r.own or "") and bytes(r.decoded) == (r.own or "").encode()
    rnd = random.Random(6)
    hard = ["".join(rnd.choice("aab bc'sé漢\n ") for _ in range(rnd.randint(1, 60))) for _ in range(2000)] + ["a" * 5000]
    ids, counts = bpe.Encoder(v).encode(hard)
    for t, x in zip(hard, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert enc.encode_ordinary(t) == x.tolist()
    clash = bpe.decode(bpe.encode(odd.withColumn("decoded", F.lit("x")), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert clash.columns == ["doc_id", "lang", "source", "n_chars", "score", "ids", "decoded"]
    assert Counter((r.doc_id, bytes(r.decoded)) for r in clash.collect()) == Counter((r.doc_id, (r.text or "").encode()) for r in odd.collect())
    assert bpe.digests(empty(odd), RANKS, public_tokenizers.PATTERN).count() == 0


# -- quality classifier


def test_classifier_held_out_and_odd(spark, odd):
    rows = [(i, ("clean words flow on in plain sentences " + str(i * 7919 % 1000) + " here. ") * (1 + i % 3) if i % 3 else "JUNK!! || && JUNK!! " * (5 + i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = [r for r in gam.classify(df, labels).collect() if r.held_out]
    assert len(got) > 100 and all(r.predicted == int(r.doc_id % 3 > 0) for r in got)
    out = gam.classify(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in gam.classify(odd, empty(labels)).collect()} == {0.5}
    assert gam.classify(empty(odd), labels).count() == 0


def test_classifier_on_the_tables(spark):
    sf = f"{DATA}/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    quality = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [(r.score, quality[r.doc_id]) for r in gam.classify(docs, labels).collect() if r.held_out and r.doc_id in quality]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.97 and np.mean([(s >= 0.7) == (y == 1) for s, y in held]) > 0.9


def test_classifier_scores_are_sums_of_its_tables(spark, docs):
    g = np.random.default_rng(6)
    rows = docs.where("text is not null").limit(60).collect()
    x = gam.features([r.text for r in rows])
    model = gam.fit(x, (g.random(len(rows)) < 0.5).astype(float), rounds=20, pair_rounds=5)
    got = {r.doc_id: r.score for r in gam.score(docs.limit(60) if len(rows) < 60 else docs.where("text is not null").limit(60), model).collect()}
    for r, f in zip(rows, x, strict=True):
        b = [int((edges <= v).sum()) for edges, v in zip(model.edges, f, strict=True)]
        z = model.prior + sum(t[i] for t, i in zip(model.tables, b, strict=True)) + sum(t[b[p] // model.coarse, b[q] // model.coarse] for (p, q), t in zip(model.pairs, model.grids, strict=True))
        assert r.doc_id not in got or abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-9


def test_classifier_keeps_a_score_at_the_bound(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "doc_id long, text string")
    even = gam.Model(prior=float(np.log(0.7 / 0.3)))
    score = gam.score(df, even).first().score
    assert gam.keep(df, even, accept=score).count() == 3 and gam.keep(df, even, accept=np.nextafter(score, 1)).count() == 0
    tied = gam.fit(np.ones((40, 3)), np.tile([0.0, 1.0], 20))
    assert tied.pairs == [] and np.allclose(tied.score(np.ones((2, 3))), 0.5, atol=0.02)


def test_tables_add_up():
    g = np.random.default_rng(3)
    x = g.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair of features tells
    m = gam.fit(x, y, pairs=2)
    assert (1, 0) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9


# -- shared parts


def test_scratch_is_removed(spark):
    import os

    df = common.written(spark.range(3).toDF("x"), "kept")
    path = common._PATHS[df].removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 3
    common.discard(df, None)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                return type("X", (), {"getCheckpointDir": lambda self: type("Y", (), {"isDefined": lambda self: False})()})()

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_chunks_keep_order_and_bounds():
    import pyarrow as pa

    texts = ["a" * (i % 50) for i in range(1000)]
    batches = [pa.RecordBatch.from_pydict({"text": texts[i : i + 37], "i": list(range(i, min(i + 37, 1000)))}) for i in range(0, 1000, 37)]
    got = list(common.chunks(iter(batches), limit=300))
    assert [t for _, part in got for t in part] == texts and [i for b, _ in got for i in b.column("i").to_pylist()] == list(range(1000))
    assert all(sum(map(len, p)) <= 300 for _, p in got)
