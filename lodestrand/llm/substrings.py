"""Removal of repeated passages by suffix automata of reference shards.

Every word that lies in a window of `least` words goes whose word sequence also
starts earlier: in a document of smaller key, or further up in the same one.

References are chosen first, so that only text that may repeat is put into
automata.  Windows of a text are grouped by the least hash of their k-word
stretches, which equal windows share; the groups' hashes are dealt out by
range, and where one is met again, its first place is a reference and all others
are queries to the shard of that place.  (Of places of one hash that a task meets
itself the first one goes to the range, which so gets a hash once from each task,
however frequent it is; the others wait for what the range says of that place,
so that a text is cut by the first places of all, not by those of each task.)  A shard's references, in document order, become a suffix
automaton that knows the first end of each of its word sequences.  It is
broadcast: to all tasks while references are few altogether, and else to the
tasks of its shard, which are as many as its queries ask for.  The queries are
streamed through it for matching statistics, and a window of full length whose
first place lies earlier is removed.

A window that shares its hash but is not found at the first place of that hash
may still repeat one of the other places.  Those that are left and all
references are grouped once more, each window by a hash of all its words, and
streamed again, with another hash each time until none is left; so no result
rests on hashes.  Windows of a kind whose words touch go as one stretch, so rows
are bounded by the words, not by the windows: in a text with a period of which
the first place holds a part, every other window would be a row.

Defined results: a null or empty text has no word and loses none; very long
texts are worked on whole (their references lie in shards by blocks); rows equal
in key and text are one document, each of which gets its result; texts that
share a key are ordered by a hash; rows without key come after all others
(as if their key were the largest number); an empty table gives an empty table;
of other columns just the key comes along, so clashing names do no harm.  Keys
are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BROADCAST_ROWS, chunks, configure, discard, plan_bytes, ragged, unpacked, written
from .runs import slid
from .textstats import Words

#: Words of the stretches whose least hash groups windows.
ANCHOR = 8
#: Groups that a task deals out at once.
FLUSH = 1 << 20
#: Bytes of input for each range of hashes, bucket of documents and shard of references.
RANGE_BYTES, BUCKET_BYTES, SHARD_BYTES = 16 << 20, 8 << 20, 1 << 20
#: Words of a document whose references lie in one shard.
BLOCK = 20_000
#: Words of queries that one task streams through an automaton.
STREAM_WORDS = 500_000
#: Words of references that are broadcast to every task; beyond, an automaton goes to the tasks of its shard.
BROADCAST_WORDS = 50_000
NO_KEY = (1 << 63) - 1
_PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _PRIME[0]
    h = (h ^ (h >> np.uint64(29))) * _PRIME[1]
    return h ^ (h >> np.uint64(32))


class Automaton:
    """Suffix automaton of some sequences of words, with the first end of each state's sequences."""

    def __init__(self, sequences: list[list[bytes]]):
        numbers: dict[bytes, int] = {}
        follow: list[dict[int, int]] = [{}]
        link, length, first = [-1], [0], [-1]
        last, place = 0, 0
        for k, words in enumerate(sequences):
            for c in [*(numbers.setdefault(w, len(numbers)) for w in words), -1 - k]:  # a mark of its own ends each sequence
                new = len(link)
                follow.append({})
                length.append(length[last] + 1)
                first.append(place)
                link.append(0)
                at = last
                while at >= 0 and c not in follow[at]:
                    follow[at][c] = new
                    at = link[at]
                if at >= 0:
                    to = follow[at][c]
                    if length[to] == length[at] + 1:
                        link[new] = to
                    else:
                        twin = len(link)
                        follow.append(dict(follow[to]))
                        length.append(length[at] + 1)
                        first.append(first[to])
                        link.append(link[to])
                        link[to] = link[new] = twin
                        while at >= 0 and follow[at].get(c) == to:
                            follow[at][c] = twin
                            at = link[at]
                last, place = new, place + 1
        self.numbers, self.follow, self.link, self.length, self.first = numbers, follow, link, length, first

    def ends(self, words: list[bytes], least: int) -> list[int]:
        """For each word, where the `least` words up to it first end in the sequences (marks count a place), or -1."""
        numbers, follow, link, length, first = self.numbers, self.follow, self.link, self.length, self.first
        at, n, out = 0, 0, []
        for c in map(numbers.get, words):
            if c is None:
                at = n = 0
                out.append(-1)
                continue
            to = follow[at].get(c)
            while to is None and at:
                at = link[at]
                n = length[at]
                to = follow[at].get(c)
            if to is None:
                out.append(-1)
                continue
            at, n = to, n + 1
            while n > least and length[link[at]] >= least:
                at = link[at]
            n = min(n, least)
            out.append(first[at] if n == least else -1)
        return out


class Shard:
    """An automaton, and where its sequences come from."""

    def __init__(self, rows: list[tuple[int, int, int, str]]):
        """rows: key, signature and place in the document of each reference, and its words."""
        rows = sorted(rows)
        bodies = [r[3].encode("utf-8", "surrogatepass").split() for r in rows]
        self.automaton = Automaton(bodies)
        self.key, self.sig, self.at = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
        self.starts = np.cumsum([0, *(len(b) + 1 for b in bodies)])[:-1]

    def earlier(self, ends: np.ndarray, least: int, key: np.ndarray, sig: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether windows that first end at ends begin before the places given."""
        k = np.searchsorted(self.starts, ends, side="right") - 1
        own = self.at[k] + ends - self.starts[k] - least + 1
        before = (self.key[k] < key) | ((self.key[k] == key) & ((self.sig[k] < sig) | ((self.sig[k] == sig) & (own < start))))
        return before


PLACES = "part long, waits boolean, keys binary, sigs binary, ats binary, windows binary, first_keys binary, first_sigs binary, first_ats binary"


def window_groups(w: Words, least: int, anchor: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first window (a place among all words) and number of windows of each group: successive windows of a text with the same least stretch."""
    n, none = w.total, np.empty(0, dtype=np.int64)
    left = np.repeat(np.cumsum(w.counts), w.counts) - np.arange(n)
    inside = left >= least
    if not inside.any():
        return none.astype(np.uint64), none, none
    word = np.fromiter((xxhash.xxh64_intdigest(d, seed) for d in w.distinct), dtype=np.uint64, count=len(w.distinct))[w.numbers]
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(anchor):
        rolled[: n - k] = _mixed(rolled[: n - k] * _PRIME[1] + word[k:] + np.uint64(k + 1))
    rolled |= np.uint64(1)
    windows = np.flatnonzero(inside)
    low = slid(rolled, least - anchor + 1)[windows]
    at = windows.copy()  # goes on to the first stretch of the least hash
    todo = np.flatnonzero(rolled[at] != low)
    while len(todo):
        at[todo] += 1
        todo = todo[rolled[at[todo]] != low[todo]]
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1]
    heads = np.flatnonzero(new)
    return low[heads], windows[heads], np.diff(np.append(heads, len(at)))


def _cells(to: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Columns cut by where their values go."""
    order = np.argsort(to, kind="stable")
    cuts = np.append(np.flatnonzero(np.concatenate(([True], np.diff(to[order]) != 0))), len(to)) if len(to) else []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[low:high]
        yield int(to[at[0]]), [c[at].tobytes() for c in columns]


def _firsts(hashes: np.ndarray, key: np.ndarray, sig: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by hash and place without repeats; whether each is the first of its hash, and which is that."""
    order = np.lexsort((at, sig, key, hashes))
    h, k, s, a = hashes[order], key[order], sig[order], at[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = h[1:] != h[:-1]
    fresh = head.copy()
    fresh[1:] |= (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (a[1:] != a[:-1])
    order, head = order[fresh], head[fresh]
    return order, head, order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]


def _bucket(key: np.ndarray, sig: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(key.view(np.uint64) * _PRIME[1] + sig.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _places(pieces: DataFrame, least: int, anchor: int, seed: int, ranges: int, buckets: int) -> DataFrame:
    """Groups of windows whose hash is met more than once, with the first place of that hash."""
    names = [c.split()[0] for c in PLACES.split(", ")]

    def rows(cells: Iterator[tuple[int, list[bytes]]], waits: bool = False) -> Iterator[pa.RecordBatch]:
        got = list(cells)
        width = len(got[0][1]) if got else 0
        for i in range(0, len(got), 64):
            some = got[i : i + 64]
            columns = [pa.array([c[1][j] for c in some], pa.binary()) if j < width else pa.nulls(len(some), pa.binary()) for j in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in some], pa.int64()), pa.array([waits] * len(some)), *columns], names=names)

    def at_place(key: np.ndarray, sig: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a place is told its hash's first place."""
        return -1 - _bucket(key, _mixed(sig.view(np.uint64) + at.view(np.uint64)).view(np.int64), buckets)

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        hashes, key, sig, at, windows = (np.concatenate(x) for x in zip(*held, strict=True))
        order, head, first = _firsts(hashes, key, sig, at)
        own, others = order[head], (~np.append(head[1:], True)[head]).astype(np.int64)
        part = ((hashes[own] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        yield from rows(_cells(part, [key[own], sig[own], at[own], windows[own], hashes[own], others]))
        order, first = order[~head], first[~head]
        to = key[first], sig[first], at[first]
        yield from rows(_cells(at_place(*to), [key[order], sig[order], at[order], windows[order], *to]), True)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, texts in chunks(batches, "body"):
            w = Words(texts)
            hashes, at, windows = window_groups(w, least, anchor, seed)
            doc = w.doc[at]
            key, sig, base = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "sig", "at"))
            held.append((hashes, key[doc], sig[doc], base[doc] + at - (np.cumsum(w.counts) - w.counts)[doc], windows))
            size += len(hashes)
            if size >= FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    def meet(t: pa.Table) -> pa.Table:
        """Of hashes that are met more than once, here or within a task, the places with their first one."""
        if t.column("part")[0].as_py() < 0:
            return t
        key, sig, at, windows, others = (unpacked(t.column(c), "<i8") for c in ("keys", "sigs", "ats", "windows", "first_sigs"))
        hashes = unpacked(t.column("first_keys"), "<u8")
        order, head, first = _firsts(hashes, key, sig, at)
        alone = head & np.append(head[1:], True) & ~np.isin(hashes[order], hashes[others > 0])
        order, first = order[~alone], first[~alone]
        own = key[order], sig[order], at[order]
        got = list(rows(_cells(at_place(*own), [*own, windows[order], key[first], sig[first], at[first]])))
        return pa.Table.from_batches(got) if got else t.slice(0, 0)

    def tell(t: pa.Table) -> pa.Table:
        """Places that wait for another of their hash get the first place that it was told."""
        waits = t.column("waits")
        told, waiting = ([unpacked(x.column(c), "<i8") for c in names[2:]] for x in (t.filter(pc.invert(waits)), t.filter(waits)))
        n = len(told[0])
        asked = [np.concatenate((told[i], waiting[4 + i])) for i in range(3)]
        order = np.lexsort((np.arange(len(asked[0])) >= n, asked[2], asked[1], asked[0]))  # what was told goes before those that wait for it
        last = np.maximum.accumulate(np.where(order < n, np.arange(len(order)), 0))
        answer = np.empty(len(order), dtype=np.int64)
        answer[order] = order[last]
        firsts = [told[4 + i][answer] for i in range(3)]
        key, sig, at, windows = (np.concatenate((a, b)) for a, b in zip(told[:4], waiting[:4], strict=True))
        got = list(rows(_cells(-1 - _bucket(key, sig, buckets), [key, sig, at, windows, *firsts])))
        return pa.Table.from_batches(got) if got else t.slice(0, 0)

    met = pieces.select("key", "sig", "at", "body").mapInArrow(deal, PLACES).groupBy("part").applyInArrow(meet, PLACES)
    return met.groupBy("part").applyInArrow(tell, PLACES)


def _by_document(places: DataFrame) -> DataFrame:
    """All places of a document in one row: at, windows and the first place's key, signature and at, one array after another."""

    def run(t: pa.Table) -> pa.Table:
        key, sig, *rest = (unpacked(t.column(c), "<i8") for c in ("keys", "sigs", "ats", "windows", "first_keys", "first_sigs", "first_ats"))
        order = np.lexsort((rest[0], sig, key))
        key, sig, rest = key[order], sig[order], np.stack([r[order] for r in rest])
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        heads = np.flatnonzero(new)
        cuts = np.append(heads, len(key)).tolist()
        return pa.table({"key": key[heads], "sig": sig[heads], "places": pa.array([rest[:, i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return places.groupBy("part").applyInArrow(run, "key long, sig long, places binary")


PIECES = "shard long, reference boolean, key long, sig long, at long, n long, asked binary, body string"


def _cut(places: DataFrame, pieces: DataFrame, least: int, shards: int) -> DataFrame:
    """The references of every shard and the queries to it, as words of their documents.

    Queries whose words touch are one row, whose bits (asked, null for all) say
    which windows are its own: rows are bounded by the words, even where
    neighbouring windows ask different shards.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary(), pa.string()]

    def stretches(key: int, sig: int, base: int, body: str, places: bytes) -> Iterator[tuple]:
        at, windows, fk, fs, fa = np.frombuffer(places, dtype="<i8").reshape(5, -1)
        words = body.encode("utf-8", "surrogatepass").split()
        inside = (at >= base) & (at + windows + least - 1 <= base + len(words))
        if not inside.any():  # all are in other stretches of the document
            return
        at, windows, fk, fs, fa = at[inside], windows[inside], fk[inside], fs[inside], fa[inside]
        reference = (fk == key) & (fs == sig) & (fa == at)
        shard = (_mixed((_bucket(fk, fs, 1 << 62) + fa // BLOCK).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((at, shard, reference))
        at, reach, shard, reference = at[order], (at + windows)[order], shard[order], reference[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (shard[1:] != shard[:-1]) | (reference[1:] != reference[:-1]) | (at[1:] > reach[:-1] + np.where(reference[1:], 0, least - 1))
        heads = np.flatnonzero(new)
        stops = np.append(heads[1:], len(at))
        for h, stop in zip(heads.tolist(), stops.tolist(), strict=True):
            low, end = int(at[h]), int(reach[stop - 1]) + least - 1
            asked = np.zeros(end - low - least + 1, dtype=bool)
            for a, r in zip((at[h:stop] - low).tolist(), (reach[h:stop] - low).tolist(), strict=True):
                asked[a:r] = True
            bits = None if asked.all() else np.packbits(asked).tobytes()
            yield int(shard[h]), bool(reference[h]), key, sig, low, end - low, bits, b" ".join(words[low - base : end - base]).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for key, sig, base, body, places in zip(*(b.column(c).to_pylist() for c in ("key", "sig", "at", "body", "places")), strict=True):
                if (key, sig, base) in seen:  # rows that repeat a document are one
                    continue
                seen.add((key, sig, base))
                for r in stretches(key, sig, base, body or "", places):
                    rows.append(r)
                    size += len(r[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return pieces.join(_by_document(places), ["key", "sig"]).mapInArrow(run, PIECES)


FOUND = "removed boolean, key long, sig long, at long, n long, body string"


def _stretched(owner: np.ndarray, place: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, in order, as stretches of words: owner, first word and number of words; windows whose words touch are one."""
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + least)
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(owner)) - 1 if len(heads) else heads
    return owner[heads], place[heads], place[last] - place[heads] + least


def _answers(shard: Shard, queries: list[tuple[int, int, int, str, bytes | None]], least: int) -> pa.Table:
    """Stretches of the queries' words that are removed, and stretches with windows that were asked for and not found.

    Where found and missed windows alternate, as in a text with a period of which
    the references have a part, stretches of both kinds overlap: a window that
    was found is only found again.
    """
    bodies, ends, owner, asked = [], [], [], []
    for _, _, _, body, bits in queries:
        words = body.encode("utf-8", "surrogatepass").split()
        got = shard.automaton.ends(words, least)[least - 1 :]
        bodies.append(words)
        ends += got
        owner.append(len(got))
        asked.append(np.ones(len(got), dtype=bool) if bits is None else np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(got)).astype(bool))
    count = np.array(owner, dtype=np.int64)
    owner, place = np.repeat(np.arange(len(queries)), count), ragged(np.zeros(len(queries), dtype=np.int64), count)
    key, sig, at = (np.array([q[i] for q in queries], dtype=np.int64) for i in range(3))
    ends = np.array(ends, dtype=np.int64)
    gone = ends >= 0
    gone[gone] = shard.earlier(ends[gone], least, key[owner[gone]], sig[owner[gone]], at[owner[gone]] + place[gone])
    missed = np.concatenate([np.zeros(0, dtype=bool), *asked]) & ~gone
    (lost, from_, size), (who, low, n) = (_stretched(owner[x], place[x], least) for x in (gone, missed))
    left = [b" ".join(bodies[w][p : p + m]).decode("utf-8", "surrogatepass") for w, p, m in zip(who.tolist(), low.tolist(), n.tolist(), strict=True)]
    flags = pa.array(np.arange(len(lost) + len(who)) < len(lost))
    who, low, n = (np.concatenate(x) for x in ((lost, who), (from_, low), (size, n)))
    return pa.table({"removed": flags, "key": key[who], "sig": sig[who], "at": at[who] + low, "n": n, "body": pa.array([None] * len(lost) + left, pa.string())})


def _rows(t: pa.Table | pa.RecordBatch, *more: str) -> list[tuple]:
    return list(zip(*(t.column(c).to_pylist() for c in ("key", "sig", "at", "body", *more)), strict=True))


def _streamed(pieces: DataFrame, least: int) -> DataFrame:
    """What the queries' documents lose, and windows that their shards do not have earlier."""
    spark = pieces.sparkSession
    references = pieces.where("reference")
    words = references.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if words <= BROADCAST_WORDS:
        by_shard: dict[int, list[tuple[int, int, int, str]]] = {}
        for r in references.select("shard", "key", "sig", "at", "body").collect():  # of so many words at most
            by_shard.setdefault(r[0], []).append(tuple(r[1:]))
        sent = spark.sparkContext.broadcast(by_shard)
        made: dict[int, Shard] = {}

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shards = np.asarray(b.column("shard"))
                for k in np.unique(shards).tolist():
                    if k not in made:
                        made[k] = Shard(sent.value[k])
                    yield from _answers(made[k], _rows(b.filter(pa.array(shards == k)), "asked"), least).to_batches()

        return pieces.where("NOT reference").select("shard", "key", "sig", "at", "asked", "body").mapInArrow(stream, FOUND)

    counts = pieces.where("NOT reference").groupBy("shard").agg(F.ceil(F.sum("n") / STREAM_WORDS).cast("int").alias("tasks"))
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    dealt = pieces.join(counts, "shard")
    every = F.sequence(F.lit(0), F.col("tasks") - 1)
    one = F.array(F.pmod(F.hash("key", "sig", "at"), F.col("tasks")))
    dealt = dealt.withColumn("salt", F.explode(F.when(F.col("reference"), every).otherwise(one))).select("shard", "salt", "reference", "key", "sig", "at", "asked", "body")

    def work(t: pa.Table) -> pa.Table:
        is_reference = t.column("reference")
        queries = _rows(t.filter(pc.invert(is_reference)), "asked")
        if not queries:
            return pa.Table.from_pylist([], schema=pa.schema([("removed", pa.bool_()), *((c, pa.int64()) for c in ("key", "sig", "at", "n")), ("body", pa.string())]))
        return _answers(Shard(_rows(t.filter(is_reference))), queries, least)

    return dealt.groupBy("shard", "salt").applyInArrow(work, FOUND)


def removed_stretches(docs: DataFrame, least: int = 20, anchor: int = ANCHOR) -> DataFrame:
    """key, sig, at and n of stretches of words that go; docs: key, sig, text (of rows equal in key and sig, one counts)."""
    spark = docs.sparkSession
    size = plan_bytes(docs)
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges, buckets, shards = (max(dealt, size // b + 1) for b in (RANGE_BYTES, BUCKET_BYTES, SHARD_BYTES))
    pieces = docs.select("key", "sig", F.lit(0).cast("long").alias("at"), F.col("text").alias("body"))
    done: list[DataFrame] = []
    before = None
    while True:
        turn = len(done)
        places = _places(pieces, least, least if turn else min(anchor, least), turn, ranges, buckets)
        cut = written(_cut(places, pieces, least, shards), "pieces")
        found = written(_streamed(cut, least), "streamed")
        discard(before)
        before = cut
        done.append(found.where("removed").select("key", "sig", "at", "n"))
        left = found.where("NOT removed")
        if left.isEmpty():
            discard(cut)
            return reduce(DataFrame.unionByName, done)
        pieces = left.unionByName(cut.where("reference"), allowMissingColumns=True).select("key", "sig", "at", "body")


KEPT = "n_words long, removed array<struct<start: bigint, end: bigint>>, kept string"


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20, anchor: int = ANCHOR) -> DataFrame:
    """key, n_words, removed (stretches of words, start and end from 0, in order) and kept (the other words, joined by one space) of every row."""
    configure(docs.sparkSession)
    rows = docs.select(F.col(key).alias("own"), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.xxhash64(text).alias("sig"), F.col(text).alias("text"))
    gone = removed_stretches(rows.select("key", "sig", "text"), least, anchor).groupBy("key", "sig").agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, spans, kept = [], [], []
            for body, found in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                words = (body or "").encode("utf-8", "surrogatepass").split()
                own: list[list[int]] = []
                for at, end in sorted((g["at"], g["at"] + g["n"]) for g in found or ()):
                    if own and at <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], end)
                    else:
                        own.append([at, end])
                n.append(len(words))
                spans.append([{"start": at, "end": end} for at, end in own])
                cuts = [0, *(x for span in own for x in span), len(words)]
                kept.append(b" ".join(w for i in range(0, len(cuts), 2) for w in words[cuts[i] : cuts[i + 1]]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(struct)), pa.array(kept, pa.string())], names=[key, "n_words", "removed", "kept"])

    return rows.join(gone, ["key", "sig"], "left").select("own", "text", "gone").mapInArrow(run, f"`{key}` {rows.schema['own'].dataType.simpleString()}, {KEPT}")


def described(deduped: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and a digest of the words that stay."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return deduped.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same by comparing whole windows.
ORACLE_SQL = r"""
WITH texts AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS body FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM texts)),
later AS MATERIALIZED (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1),
words AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM texts),
marked AS (
  SELECT w.doc_id, w.i, word, coalesce(max(CASE WHEN l.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM words w LEFT JOIN later l ON w.doc_id = l.doc_id AND w.i = l.i),
kept AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS t FROM marked GROUP BY doc_id)
SELECT t.doc_id, len(t.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""
