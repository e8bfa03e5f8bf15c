"""N-gram Jaccard join with adaptive multi-match prefixes.

1. Each text becomes the set of its word shingles, as 48-bit hashes, and a
   64-bit signature of the set; equal sets are one class from here on.
2. Hashes are dealt out by range and counted: a shingle that just one class has
   links nothing.  A class of n shingles with fewer than threshold * n shared
   ones can have no partner and is out; that leaves the classes that are mostly
   made of what others have.
3. Rarest shingles first, a class keeps a prefix.  With l matches asked for, a
   prefix has n - ceil(threshold * n) + l shingles, and two classes that link
   share at least min(l, l') of them.  Each class takes the l for which the
   estimated cost (postings to scan, and candidates, at most postings / l, to
   verify) is least.
4. In rounds, the members of each posting list are held against a few pivots of
   it, those with the fewest shingles of their own; what either of a pair shares
   with anyone, and the bits in which their sketches differ, bound what they can
   have in common, and with their sizes tell whether they can link.  Candidates with enough matches are verified on all
   shingles.  Links join components, and lists whose members
   are all in one component need nothing more.  A last round holds what is left
   against each other, but for members of one component.  So a group of copies
   costs in proportion to its size, and no link between components is lost.

Nothing is dropped or capped; hashes are shuffled as packed arrays.

Defined results: a null text, or one without words, has no shingles, links with
nothing and is its own component; a text of fewer words than a shingle is one
shingle of them all; very long texts are taken whole; repeated rows fall into
one class; a null key counts for no component_id unless there is no other; an
empty table gives an empty table; of other columns just the key comes along.
Keys are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, chunks, configure, discard, plan_bytes, ragged, sums, unpacked, written
from .graph import components
from .textstats import Words

#: Bytes of input for each range that hashes are dealt out to; one task holds a range.
RANGE_BYTES = 3 << 20
#: Most matches that a prefix asks for.
MOST_MATCHES = 8
#: Bits of a set's sketch, by which pairs that differ in too much are left out.
BITS = 512
#: Rows of a list of pivots in each round before the last.
PIVOTS = (1, 4)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MASK = np.uint64((1 << 48) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit shingle hashes of each text, one text after another, and their counts."""
    w = Words(texts, lower=True)
    if not w.total:
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, w.distinct), dtype=np.uint64, count=len(w.distinct))[w.numbers]
    n = w.total
    rolled = np.zeros(n, dtype=np.uint64)
    left = np.repeat(np.cumsum(w.counts), w.counts) - np.arange(n)  # words from here to the text's end
    for k in range(size):
        there = np.flatnonzero(left > k)
        rolled[there] = _mixed(rolled[there] * _MIX[2] + word[there + k] + np.uint64(k + 1))
    whole = left >= np.minimum(size, np.repeat(w.counts, w.counts))
    keys = np.unique((w.doc[whole].astype(np.uint64) << np.uint64(48)) | (rolled[whole] & _MASK))
    return keys & _MASK, np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(texts))


def signatures(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, never 0 for one with members."""
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(flat + np.uint64(1)), dtype=np.uint64)))
    ends = np.cumsum(counts)
    out = _mixed((total[ends] - total[ends - counts]) * _MIX[2] + counts.astype(np.uint64)) | np.uint64(1)
    out[counts == 0] = 0
    return out


def _pack(hashes: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """48-bit hashes as two columns of binaries, a value for each stretch between cuts."""
    return binaries((hashes >> np.uint64(16)).astype("<u4"), cuts), binaries((hashes & np.uint64(0xFFFF)).astype("<u2"), cuts)


def _unpack(t: pa.Table) -> np.ndarray:
    out = unpacked(t.column("high"), "<u4").astype(np.uint64)
    out <<= np.uint64(16)
    out |= unpacked(t.column("low"), "<u2")
    return out


def _changes(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return new


SETS = "part long, high binary, low binary, counts binary, sigs binary, sizes binary, docs array<struct<key: long, sig: long, n: long>>"


def _deal(docs: DataFrame, key: str, text: str, size: int, ranges: int) -> DataFrame:
    """Packed hashes by range (part from 0 on), and the texts' own rows (part below 0)."""
    kinds = pa.struct([("key", pa.int64()), ("sig", pa.int64()), ("n", pa.int64())])
    names = ["part", "high", "low", "counts", "sigs", "sizes", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            flat, counts = shingle_sets(texts, size)
            sigs = signatures(flat, counts)
            own = pa.StructArray.from_arrays([batch.column(key).cast(pa.int64()), pa.array(sigs.view(np.int64)), pa.array(counts)], fields=list(kinds))
            listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - int(sigs[0] % np.uint64(ranges))]), *[pa.nulls(1, pa.binary())] * 5, listed], names=names)
            once = np.zeros(len(texts), dtype=bool)
            once[np.unique(sigs, return_index=True)[1]] = True
            once &= counts > 0
            flat = flat[np.repeat(once, counts)]
            if not len(flat):
                continue
            doc = np.repeat(np.arange(int(once.sum()), dtype=np.int32), counts[once])
            part = ((flat >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            flat, doc, part = flat[order], doc[order], part[order]
            first = _changes(part)
            runs = np.flatnonzero(first | _changes(doc))  # the hashes of a text in a range
            cuts = np.append(np.flatnonzero(first), len(flat))
            of_runs = np.append(np.searchsorted(runs, cuts[:-1]), len(runs))
            which = doc[runs]
            columns = [*_pack(flat, cuts), binaries(np.diff(np.append(runs, len(flat))).astype("<u4"), of_runs), binaries(sigs[once][which], of_runs), binaries(counts[once][which].astype("<u4"), of_runs)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), *columns, pa.nulls(len(cuts) - 1, pa.list_(kinds))], names=names)

    return docs.select(key, text).mapInArrow(run, SETS)


SHARED = "part long, high binary, low binary, often binary, counts binary, sigs binary, sizes binary, docs array<struct<key: long, sig: long, n: long>>"


def _count(sets: DataFrame, parts: int) -> DataFrame:
    """Of each range, the shingles that two classes or more have, dealt out by class."""

    def run(table: pa.Table) -> pa.Table:
        names = ["part", "high", "low", "often", "counts", "sigs", "sizes", "docs"]
        if table.column("part")[0].as_py() < 0:
            n = table.num_rows
            return pa.Table.from_arrays([table.column("part"), *[pa.nulls(n, pa.binary())] * 6, table.column("docs")], names=names)
        sigs, counts, sizes = unpacked(table.column("sigs"), "<u8"), unpacked(table.column("counts"), "<u4").astype(np.int64), unpacked(table.column("sizes"), "<u4")
        once = np.zeros(len(sigs), dtype=bool)
        once[np.unique(sigs, return_index=True)[1]] = True
        flat = _unpack(table)[np.repeat(once, counts)]
        sigs, counts, sizes = sigs[once], counts[once], sizes[once]
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(_changes(flat[order]))
        times = np.diff(np.append(starts, len(flat)))
        often = np.empty(len(flat), dtype=np.uint16)
        often[order] = np.repeat(np.minimum(times, 65535).astype(np.uint16), times)
        del order
        keep = often > 1
        counts = sums(keep, counts)
        flat, often = flat[keep], often[keep]
        held = counts > 0
        sigs, counts, sizes = sigs[held], counts[held], sizes[held]
        to = (sigs >> np.uint64(8)) % np.uint64(parts)
        order = np.argsort(to, kind="stable")
        at = ragged((np.cumsum(counts) - counts)[order], counts[order])
        sigs, counts, sizes, to = sigs[order], counts[order], sizes[order], to[order]
        runs = np.append(np.flatnonzero(_changes(to)), len(to)) if len(to) else np.zeros(1, dtype=np.int64)
        cuts = np.concatenate(([0], np.cumsum(counts)))[runs]
        columns = [*_pack(flat[at], cuts), binaries(often[at].astype("<u2"), cuts), binaries(counts.astype("<u4"), runs), binaries(sigs, runs), binaries(sizes, runs)]
        return pa.Table.from_arrays([pa.array(to[runs[:-1]].astype(np.int64)), *columns, pa.nulls(len(runs) - 1, table.schema.field("docs").type)], names=names)

    return sets.groupBy("part").applyInArrow(run, SHARED)


def matches_asked(often: np.ndarray, n: int, base: int, most: int = MOST_MATCHES) -> int:
    """The number of matches for which scanning and verifying cost least.

    often: classes that have each shared shingle, rarest first; base: how many
    of them a prefix has that asks for one match.
    """
    scan = np.cumsum(often.astype(np.int64) - 1)
    asked = np.arange(1, min(most, len(often) - base + 1) + 1)
    postings = scan[base + asked - 2]
    return int(asked[np.argmin(postings * (1 + 0.05 * n / asked))])


def parities(shingles: np.ndarray) -> np.ndarray:
    """BITS bits: for each, whether an odd number of shingles falls to it.  Two sets differ in at least as many members as bits."""
    odd = np.bincount((_mixed(shingles) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


CLASSES = "sig long, n long, shared long, asked int, prefix array<long>, bits array<long>, shingles binary"


def _prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """The classes that may have a partner, with prefix and all shared shingles, rarest first."""

    def run(table: pa.Table) -> pa.Table:
        sigs, counts, sizes = unpacked(table.column("sigs"), "<u8"), unpacked(table.column("counts"), "<u4").astype(np.int64), unpacked(table.column("sizes"), "<u4").astype(np.int64)
        flat, often = _unpack(table), unpacked(table.column("often"), "<u2")
        names, which = np.unique(sigs, return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(names)).astype(np.int64)
        size = np.zeros(len(names), dtype=np.int64)
        size[which] = sizes
        alive = 100 * total >= percent * size
        owner = np.repeat(which, counts)
        at = np.flatnonzero(alive[owner])
        at = at[np.lexsort((flat[at], often[at], owner[at]))]
        flat, often = flat[at], often[at]
        rows, begin = [], 0
        for i in np.flatnonzero(alive).tolist():
            n, m = int(size[i]), int(total[i])
            own, rare = flat[begin : begin + m], often[begin : begin + m]
            begin += m
            base = m + 1 - -(-percent * n // 100)  # those before it in the prefix are shared with no one
            asked = matches_asked(rare, n, base)
            rows.append((int(names[i : i + 1].view(np.int64)[0]), n, m, asked, own[: base + asked - 1].astype(np.int64), parities(own), own.astype("<u8").tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["sig", "n", "shared", "asked", "prefix", "bits", "shingles"])

    return shared.groupBy("part").applyInArrow(run, CLASSES)


def _verify(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links u, v (components) among candidate pairs a, b with components u, v."""
    own = classes.select("sig", "n", "asked", F.size("prefix").alias("p"), "shingles")
    side = lambda x: own.select(*(F.col(c).alias(f"{c}_{x}") for c in own.columns))
    joined = pairs.join(side("a"), F.col("a") == F.col("sig_a")).join(side("b"), F.col("b") == F.col("sig_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["shingles_a"], dtype="<u8"), np.frombuffer(r["shingles_b"], dtype="<u8")
                if len(np.intersect1d(x[: r["p_a"]], y[: r["p_b"]], assume_unique=True)) < min(r["asked_a"], r["asked_b"]):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (r["n_a"] + r["n_b"] - both):
                    got.append((r["u"], r["v"]))
            yield pa.RecordBatch.from_pydict({"u": pa.array([g[0] for g in got], pa.int64()), "v": pa.array([g[1] for g in got], pa.int64())})

    return joined.select("u", "v", "n_a", "n_b", "asked_a", "asked_b", "p_a", "p_b", "shingles_a", "shingles_b").mapInArrow(run, "u long, v long")


def _band(percent: int) -> Column:
    """Bands of set sizes such that sizes of two sets that link lie in one or in neighbouring bands."""
    wide = math.log(100 / percent) * (1 + 1e-6) if percent < 100 else 1e-9
    return F.floor(F.log("n") / wide)


def _lists(posts: DataFrame) -> DataFrame:
    """The postings of tokens whose members are not all of one component."""
    mixed = posts.groupBy("token").agg(F.min("own").alias("_low"), F.max("own").alias("_high")).where("_low < _high").select("token")
    return posts.join(mixed, "token", "left_semi")


def _renamed(posts: DataFrame, rest: list[str]) -> DataFrame:
    """Postings as the other side of a join: b and v for sig and own, the rest marked."""
    return posts.select("token", F.col("sig").alias("b"), *(F.col(c).alias(f"{c}_b") for c in rest), F.col("own").alias("v"))


def _merged(labels: DataFrame | None, moved: DataFrame) -> DataFrame:
    """Components of classes, after components have been linked: node and component of what moved."""
    if labels is None:
        return moved.select(F.col("node").alias("sig"), "component")
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    kept = labels.join(to, "component", "left").select("sig", F.coalesce("_to", "component").alias("component"))
    known = labels.select("component").distinct().select(F.col("component").alias("node"))
    return kept.unionByName(moved.join(known, "node", "left_anti").select(F.col("node").alias("sig"), "component"))


def _rounds(classes: DataFrame, percent: int) -> DataFrame:
    """sig and component of the classes that have a link; components are named by a signature.

    Each step is written, and what it was made from removed.
    """
    sizes = ["n", "shared", "asked"]
    pair = [F.least("sig", "b").alias("a"), F.greatest("sig", "b").alias("b"), F.least("own", "v").alias("u"), F.greatest("own", "v").alias("v"), F.least("asked", "asked_b").alias("asked")]

    def near(most: Column) -> Column:
        """Whether a pair of different components that has so much in common at most can link."""
        return (F.col("own") != F.col("v")) & (100 * most >= percent * (F.col("n") + F.col("n_b") - most))

    def linked(found: DataFrame, labels: DataFrame | None, whole: bool) -> DataFrame:
        pairs = found.select(*pair).groupBy("a", "b", "u", "v").agg(F.count("*").alias("_n"), F.min("asked").alias("asked"))
        pairs = pairs.where("_n >= asked") if whole else pairs
        out = written(_merged(labels, components(_verify(pairs.select("a", "b", "u", "v"), classes, percent))), "labels")
        discard(labels)
        return out

    labels: DataFrame | None = None
    used: list[DataFrame] = []
    rest = classes.select("sig", *sizes, F.col("sig").alias("own"), F.explode("prefix").alias("token"))
    for k in PIVOTS:
        posts = written(_lists(rest), "postings")
        discard(*used)
        if posts.isEmpty():
            break
        # what has least of its own is nearest to the others
        least = F.min(F.struct(F.col("n_b") - F.col("shared_b"), F.xxhash64("b"), "b", *(f"{c}_b" for c in sizes), "v"))
        group = F.pmod(F.xxhash64("b", F.lit(k)), F.lit(k))
        pivots = written(_renamed(posts, sizes).groupBy("token", group.alias("_g")).agg(least.alias("_p")).select("token", "_p.b", *(f"_p.{c}_b" for c in sizes), "_p.v"), "pivots")
        found = posts.withColumnRenamed("token", "_t").join(pivots, (F.col("_t") == F.col("token")) & near(F.least("shared", "shared_b")))
        labels = linked(found, labels, False)
        left = posts.join(pivots.select("token", F.col("b").alias("sig")), ["token", "sig"], "left_anti")
        rest = left.drop("own").join(labels, "sig", "left").select("sig", *sizes, F.coalesce("component", "sig").alias("own"), "token")
        used = [posts, pivots]
    else:  # sketches come along for what is left
        posts = written(_lists(rest).join(classes.select("sig", "bits"), "sig").withColumn("band", _band(percent)), "postings")
        discard(*used)
    if posts.isEmpty():
        discard(posts)
        return labels if labels is not None else classes.select("sig", F.col("sig").alias("component")).limit(0)
    # all shingles that two prefixes share are here, unless the pair was verified before
    other = _renamed(posts, [*sizes, "bits", "band"]).withColumn("_band", F.explode(F.array("band_b", F.col("band_b") - 1)))
    apart = sum((F.bit_count(F.get(F.col("bits"), F.lit(i)).bitwiseXOR(F.get(F.col("bits_b"), F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    most = F.least("shared", "shared_b", F.floor((F.col("shared") + F.col("shared_b") - apart) / 2))
    smaller = (F.col("n") < F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("sig") < F.col("b")))
    same = (F.col("_t") == F.col("token")) & (F.col("band") == F.col("_band"))
    labels = linked(posts.withColumnRenamed("token", "_t").join(other, same & smaller & near(most)), labels, True)
    discard(posts)
    return labels


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id (the smallest key that links reach) and class_id (texts of equal sets).

    Texts link when the Jaccard similarity of their sets of shingles of size
    words is percent / 100 or more.
    """
    configure(docs.sparkSession)
    ranges = min(max(8, plan_bytes(docs) // RANGE_BYTES), 1 << 26)
    shared = written(_count(_deal(docs, key, text, size, ranges), ranges), "shingles")
    rows = shared.where("part < 0").select(F.explode("docs").alias("d")).select("d.*")
    classes = written(_prefixes(shared.where("part >= 0").drop("docs"), percent), "classes")
    labels = _rounds(classes, percent)
    least = rows.where("sig <> 0").groupBy("sig").agg(F.min("key").alias("first"))
    named = least.join(labels, "sig", "left").select("sig", "first", F.coalesce("component", "sig").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(lowest, "component").select("sig", "component_id")
    out = rows.join(ids, "sig", "left").select(F.col("key").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"), F.when(F.col("sig") != 0, F.col("sig")).alias("class_id"))
    out = written(out, "joined")
    discard(shared, classes, labels)
    return out


def keep_one(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; columns stay.

    Rows are told apart by doc_id and text: of those that share both, the one
    whose columns together have the least hash stays; a component's rows without
    a doc_id come last, and a hash of doc_id and text decides among rows with
    the same doc_id.
    """
    hashable = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.withColumns({"_row": F.xxhash64("doc_id", F.lit("|"), "text"), "_all": F.xxhash64(*(F.col(f"`{c}`") for c in hashable))})
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "_all"))
    own = rows.select("_row", "_all", "doc_id").join(join(rows.select("_row", "text"), key="_row", size=size, percent=percent).select("_row", "component_id").distinct(), "_row")
    kept = own.groupBy("component_id").agg(least.alias("_first")).select(F.col("_first")["_row"].alias("_row"), F.col("_first")["_all"].alias("_all"))
    return rows.join(kept, ["_row", "_all"], "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
