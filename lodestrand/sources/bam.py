"""BAM files: read in splits or by index, written sorted, in parts with an index each.

spark.read.format("bam").load(path) cuts files into splits.  A split's first
record is found from its bytes: the first block that begins in it, then the
first place from which records follow each other; that the split before ends
there is checked, so a wrong guess is an error and never a changed row.  With a
region (option, or pushed filters) and an index beside the file (.bai), only
the chunks that its bins name are read.

df.write.format("bam") writes a file for each task.  Nothing is seen under its
name before all tasks have ended: attempts write to a hidden folder, which the
commit empties by renaming and an abort removes.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from . import bgzf, streams
from .parts import PartsWriter

COLUMNS = "qname string, flag int, chrom string, pos bigint, mapq int, cigar string, rnext string, mate_pos bigint, tlen bigint, seq string, qual string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
SCHEMA = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[t]) for n, t in (c.split() for c in COLUMNS.split(", "))])
#: Codes of BAM, which of its operations go along the reference, first bytes of a file and of its index, positions that an index reaches (fixed values).
BASES, OPERATIONS, ALONG = "=ACMGRSVTWYHKDBN", "MIDNSHP=X", "MDN=X"
MAGIC, INDEX_MAGIC, REACH, WINDOW = b"BAM\x01", b"BAI\x01", 1 << 29, 1 << 14
#: Bytes of a file for each split; inflated bytes that are decoded at once; records in a row that tell where records begin.
SPLIT_BYTES, BATCH_BYTES, IN_A_ROW = 32 << 20, 4 << 20, 12
#: Tasks from which on small splits that follow each other share one, up to SPLIT_BYTES.
TASKS = 256
_PAIRS = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], dtype=np.uint8)
_PHRED = np.minimum(np.arange(256) + 33, 126).astype(np.uint8)


# -- header and index


@dataclass
class Header:
    text: str
    names: list[str]
    lengths: list[int]
    first: int  # virtual offset of the first record

    def number(self, chrom: str) -> int | None:
        """Place of a chromosome, whose name may come with or without chr; the exact name goes first."""
        bare = chrom.removeprefix("chr")
        return next((self.names.index(n) for n in (chrom, bare, f"chr{bare}") if n in self.names), None)


def read_header(f: pa.NativeFile, size: int) -> Header:
    s = bgzf.Stream(f, 0, size)
    number = lambda: struct.unpack("<i", s.take(4))[0]
    if not s.fill(4) or s.take(4) != MAGIC:
        raise ValueError("not a BAM file")
    text = s.take(number()).rstrip(b"\0").decode()
    names, lengths = [], []
    for _ in range(number()):
        names.append(s.take(number())[:-1].decode())
        lengths.append(number())
    return Header(text, names, lengths, s.virtual())


def bin_of(begin: int, end: int) -> int:
    """The smallest bin that holds [begin, end), from 0."""
    for level in range(5, 0, -1):
        shift = 29 - 3 * level
        if begin >> shift == (end - 1) >> shift:
            return (8**level - 1) // 7 + (begin >> shift)
    return 0


def bins_over(begin: int, end: int) -> set[int]:
    """All bins that may hold what overlaps [begin, end)."""
    last = min(end, REACH) - 1
    return {(8**level - 1) // 7 + k for level in range(6) for k in range(begin >> 29 - 3 * level, (last >> 29 - 3 * level) + 1)}


@dataclass
class Index:
    """Of each chromosome: chunks (begin and end, virtual offsets) by bin, and the first offset for each window."""

    bins: list[dict[int, list[tuple[int, int]]]]
    windows: list[list[int]]

    def chunks(self, number: int, begin: int, end: int) -> list[tuple[int, int]]:
        """Chunks that may hold what overlaps [begin, end), merged, in order."""
        if number >= len(self.bins) or begin >= end:
            return []
        linear = self.windows[number]
        k = begin // WINDOW
        least = linear[k] if k < len(linear) else linear[-1] if linear else 0
        out: list[tuple[int, int]] = []
        for b, e in sorted(c for x in bins_over(begin, end) for c in self.bins[number].get(x, ()) if c[1] > least):
            b = max(b, least)
            if out and b >> 16 <= out[-1][1] >> 16:
                out[-1] = out[-1][0], max(out[-1][1], e)
            else:
                out.append((b, e))
        return out

    def packed(self) -> bytes:
        parts = [INDEX_MAGIC, struct.pack("<i", len(self.bins))]
        for bins, windows in zip(self.bins, self.windows, strict=True):
            parts.append(struct.pack("<i", len(bins)))
            for k, chunks in sorted(bins.items()):
                parts.append(struct.pack("<Ii", k, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            parts.append(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
        return b"".join(parts)


def parse_index(data: bytes) -> Index:
    if data[:4] != INDEX_MAGIC:
        raise ValueError("not an index of a BAM file")
    at, bins, windows = 8, [], []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        own: dict[int, list[tuple[int, int]]] = {}
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(n):
            k, m = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * m}Q", data, at + 8)
            at += 8 + 16 * m
            if k < 37450:  # what lies beyond counts reads
                own[k] = list(zip(flat[::2], flat[1::2], strict=True))
        (n,) = struct.unpack_from("<i", data, at)
        windows.append(list(struct.unpack_from(f"<{n}Q", data, at + 4)))
        at += 4 + 8 * n
        bins.append(own)
    return Index(bins, windows)


def read_index(path: str) -> Index | None:
    """The index beside a file, or None."""
    for name in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
        fs, at = bgzf.opened(name)
        if fs.get_file_info(at).type == pafs.FileType.File:
            with fs.open_input_file(at) as f:
                return parse_index(f.read())
    return None


# -- records


def _is_record(data: bytes, at: int, n_ref: int) -> int:
    """Where a record that begins here would end; 0 if none does, -1 if data ends before this can be told."""
    if at + 36 > len(data):
        return -1
    n, ref, pos, l_name, _, _, n_ops, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    fits = 32 <= n and -1 <= ref < n_ref and -1 <= pos and -1 <= next_ref < n_ref and -1 <= next_pos and l_name >= 1 and 0 <= l_seq
    if not fits or 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq > n:
        return 0
    name = data[at + 36 : at + 36 + l_name]
    if len(name) < l_name:
        return -1
    return at + 4 + n if name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else 0


def first_record(f: pa.NativeFile, size: int, start: int, header: Header) -> int:
    """Virtual offset of the first record that begins in a block at start or later; the file's end if there is none."""
    if start <= header.first >> 16:
        return header.first
    start = bgzf.next_block(f, start, size)
    wanted = 4 * bgzf.MOST
    while start < size:
        s = bgzf.Stream(f, start << 16, size)
        s.fill(wanted)
        for u in range(len(s.data)):
            at, good = u, 0
            while good < IN_A_ROW and (to := _is_record(s.data, at, len(header.names))) > 0 and to <= len(s.data):
                at, good = to, good + 1
            runs_out = to < 0 or to > len(s.data)
            if good == IN_A_ROW or (s.ended and good and at == len(s.data)) or (not s.ended and good and runs_out):
                s.at = u
                return s.virtual()
        if s.ended:
            return size << 16
        wanted *= 4  # one record is longer than all that
    return size << 16


class Split:
    """Records of a file between two virtual offsets, as inflated bytes and the places of the records in them."""

    def __init__(self, f: pa.NativeFile, size: int, begin: int, end: int):
        self.f, self.size, self.begin, self.end = f, size, begin, end
        self.next = begin  # virtual offset of the first record beyond

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        if self.begin >= self.end:
            return
        source = bgzf.blocks(self.f, self.begin >> 16, self.size)
        data, at, starts, over = b"", self.begin & 0xFFFF, [], False
        while True:
            parts, have = [data], len(data)
            while have < BATCH_BYTES or have < at + 4:
                got = next(source, None)
                if got is None:
                    over = True
                    break
                starts.append((have, got[0]))
                parts.append(got[1])
                have += len(got[1])
                if got[0] > self.end >> 16 and have >= at + 4:
                    break
            data = b"".join(parts)
            limit = next((p + (self.end & 0xFFFF if c == self.end >> 16 else 0) for p, c in starts if c >= self.end >> 16), len(data) + 1)
            places, short = [], False
            while at < limit and at + 4 <= len(data):
                n = struct.unpack_from("<i", data, at)[0]
                if n < 32:
                    raise ValueError("a record of the file is damaged")
                if at + 4 + n > len(data):
                    short = True
                    break
                places.append(at)
                at += 4 + n
            if places:
                yield data, np.array(places, dtype=np.int64)
            if at >= limit or (over and not short and at >= len(data)):
                place = [(p, c) for p, c in starts if p <= at]
                self.next = self.size << 16 if at >= len(data) and over else (place[-1][1] << 16 | at - place[-1][0] if at < len(data) else None)
                return
            if over:
                raise ValueError("the file ends within a record")
            data, starts, at = data[at:], [(p - at, c) for p, c in starts if p > at or c == [x for x in starts if x[0] <= at][-1][1]], 0
            if short and len(data) >= 4 and 4 + struct.unpack_from("<i", data, 0)[0] > BATCH_BYTES:  # a record longer than what is decoded at once
                parts, have = [data], len(data)
                while have < 4 + struct.unpack_from("<i", data, 0)[0] and (got := next(source, None)) is not None:
                    starts.append((have, got[0]))
                    parts.append(got[1])
                    have += len(got[1])
                data = b"".join(parts)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def _texts(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


@dataclass
class Decoder:
    """Rows of COLUMNS from records; CIGARs are spelled out once each."""

    header: Header
    cigars: dict[bytes, tuple[str, int]] = field(default_factory=dict)

    def cigar(self, raw: bytes) -> tuple[str, int]:
        """Text of a CIGAR, and how far it goes along the reference."""
        if (got := self.cigars.get(raw)) is None:
            ops = [(o >> 4, OPERATIONS[o & 15]) for o in struct.unpack(f"<{len(raw) // 4}I", raw)]
            got = self.cigars[raw] = "".join(f"{n}{o}" for n, o in ops) or "*", sum(n for n, o in ops if o in ALONG)
        return got

    def rows(self, data: bytes, at: np.ndarray, region: tuple[int, int, int] | None = None) -> pa.RecordBatch:
        """region: number of a chromosome, begin and end (from 0); what does not overlap it is left out."""
        flat = np.frombuffer(data, dtype=np.uint8)
        fixed = np.ascontiguousarray(flat[at[:, None] + np.arange(36)])
        if region:
            numbers = fixed.view("<i4")
            near = (numbers[:, 1] == region[0]) & (numbers[:, 2] < region[2])
            at, fixed = at[near], np.ascontiguousarray(fixed[near])
        numbers, shorts = fixed.view("<i4").reshape(-1, 9).astype(np.int64), fixed.view("<u2").reshape(-1, 18).astype(np.int64)
        ref, pos, l_seq, next_ref, next_pos, tlen = (numbers[:, i] for i in (1, 2, 5, 6, 7, 8))
        l_name, mapq, n_ops, flag = fixed[:, 12].astype(np.int64), fixed[:, 13], shorts[:, 8], shorts[:, 9]
        ops = at + 36 + l_name
        cigars = [self.cigar(data[p : p + 4 * n]) for p, n in zip(ops.tolist(), n_ops.tolist(), strict=True)]
        if region:
            over = pos + np.maximum([c[1] for c in cigars], 1) > region[1] if cigars else np.zeros(0, dtype=bool)
            keep = np.flatnonzero(over)
            at, ref, pos, l_seq, next_ref, next_pos, tlen, l_name, mapq, n_ops, flag, ops = (x[keep] for x in (at, ref, pos, l_seq, next_ref, next_pos, tlen, l_name, mapq, n_ops, flag, ops))
            cigars = [cigars[i] for i in keep.tolist()]
        packed = (l_seq + 1) // 2
        bases = ops + 4 * n_ops
        both = _PAIRS[flat[_ragged(bases, packed)]].reshape(-1)
        seq = _texts(both[_ragged(2 * (np.cumsum(packed) - packed), l_seq)], l_seq)
        quals = _texts(_PHRED[flat[_ragged(bases + packed, l_seq)]], l_seq)
        none = pa.scalar("*")
        missing = (l_seq == 0) | (flat[np.minimum(bases + packed, len(flat) - 1)] == 255)
        names = pa.array([*self.header.names, "*"])
        chrom = names.take(pa.array(np.where(ref < 0, len(names) - 1, ref)))
        rnext = pc.if_else(pa.array((next_ref == ref) & (ref >= 0)), "=", names.take(pa.array(np.where(next_ref < 0, len(names) - 1, next_ref))))
        columns = [
            _texts(flat[_ragged(at + 36, l_name - 1)], l_name - 1), pa.array(flag, pa.int32()), chrom, pa.array(pos + 1), pa.array(mapq.astype(np.int32)),
            pa.array([c[0] for c in cigars], pa.string()), rnext, pa.array(next_pos + 1), pa.array(tlen), pc.if_else(pa.array(l_seq == 0), none, seq), pc.if_else(pa.array(missing), none, quals),
        ]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=SCHEMA)


class _Window:
    """The bytes of a stream of which those used up are let go."""

    def __init__(self, stream: Iterator[bytes]):
        self.stream, self.data, self.at = stream, b"", 0

    def take(self, n: int) -> bytes | None:
        """The next n bytes, or None at the end."""
        if len(self.data) - self.at < n:
            parts = [self.data[self.at :]]
            have = len(parts[0])
            while have < n and (more := next(self.stream, None)) is not None:
                parts.append(more)
                have += len(more)
            self.data, self.at = b"".join(parts), 0
            if have < n:
                if have:
                    raise ValueError("the file ends within a record")
                return None
        self.at += n
        return self.data[self.at - n : self.at]


def parse_bam(stream: Iterator[bytes]) -> Iterator[tuple]:
    """Rows of COLUMNS from the inflated bytes of a BAM file, piece by piece: for files that are not in blocks."""
    w = _Window(stream)

    def number() -> int:
        got = w.take(4)
        if got is None:
            raise ValueError("the file ends within its header")
        return struct.unpack("<i", got)[0]

    if w.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    w.take(number())
    names = []
    for _ in range(number()):
        names.append((w.take(number()) or b"")[:-1].decode())
        number()
    while (head := w.take(4)) is not None:
        raw = w.take(struct.unpack("<i", head)[0]) or b""
        ref, pos, l_name, mapq, _, n_ops, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
        p = 32 + l_name
        ops = struct.unpack_from(f"<{n_ops}I", raw, p)
        q = p + 4 * n_ops
        seq = _PAIRS[np.frombuffer(raw, np.uint8, (l_seq + 1) // 2, q)].tobytes().decode()[:l_seq]
        q += (l_seq + 1) // 2
        qual = raw[q : q + l_seq]
        text = "*" if not l_seq or qual[0] == 255 else qual.translate(_PHRED.tobytes()).decode()
        chrom = names[ref] if ref >= 0 else "*"
        rnext = "*" if next_ref < 0 else "=" if next_ref == ref else names[next_ref]
        yield raw[32 : 31 + l_name].decode(), flag, chrom, pos + 1, mapq, "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops) or "*", rnext, next_pos + 1, tlen, seq or "*", text


# -- reading


@dataclass
class Part(InputPartition):
    """Records of a file from one place to another: virtual offsets, or (exact is False) bytes at which to look for a block."""

    path: str
    begin: int
    end: int
    exact: bool
    region: tuple[int, int, int] | None = None
    in_blocks: bool = True
    step: int = 0  # bytes of each split, where the part is several that follow each other

    def __post_init__(self):
        super().__init__(None)


def found_files(path: str) -> list[tuple[str, int]]:
    """The BAM files that a path names (a file, a folder or a pattern's last part), with their sizes."""
    fs, at = bgzf.opened(path)
    prefix = path.removesuffix(at) if "://" in path else ""
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    folder, _, pattern = (at, "", "*.bam") if info.type == pafs.FileType.Directory else at.rpartition("/")
    from fnmatch import fnmatch

    got = [x for x in fs.get_file_info(pafs.FileSelector(folder or "/", allow_not_found=True)) if x.type == pafs.FileType.File and fnmatch(x.base_name, pattern) and not x.base_name.startswith(("_", "."))]
    if not got and info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(prefix + x.path, x.size) for x in sorted(got, key=lambda x: x.path)]


def parse_region(text: str) -> tuple[str, int, int]:
    """Name, begin and end (from 0) of a region such as chr3, 3:500 (from there on) or chr3:500-900, counted from 1 with its end."""
    name, _, span = text.partition(":")
    low, _, high = span.replace(",", "").partition("-")
    begin, end = int(low or 1) - 1, int(high) if high else REACH
    if begin < 0 or end <= begin:
        raise ValueError(f"{text}: not a region")
    return name, begin, end


class BamSource(DataSource):
    """spark.read.format("bam"), with options path (several in JSON: paths), region, splitBytes and pushFilters; df.write.format("bam") with chroms.

    pushFilters lets filters on chrom and pos choose chunks by the index, where
    the session allows it (spark.sql.python.filterPushdown.enabled).
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return COLUMNS

    def _paths(self) -> list[str]:
        return json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = FilteredBamReader if self.options.get("pushFilters", "").lower() == "true" else BamReader
        return kind(self._paths(), self.options.get("region"), int(self.options.get("splitBytes") or SPLIT_BYTES))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BamWriter(self.options["path"], json.loads(self.options["chroms"]), overwrite)


class BamReader(DataSourceReader):
    def __init__(self, paths: list[str], region: str | None, split_bytes: int):
        self.paths, self.split_bytes = paths, split_bytes
        self.region = parse_region(region) if region else None
        self.pushed: dict[str, int | str] = {}

    def partitions(self) -> list[InputPartition]:
        files = [x for path in self.paths for x in found_files(path)]
        together = max(1, min(sum(size for _, size in files) // TASKS, SPLIT_BYTES) // self.split_bytes)
        return [p for file, size in files for p in self._of(file, size, together)]

    def _of(self, path: str, size: int, together: int = 1) -> list[Part]:
        if not bgzf.is_block_gzip(path):
            return [Part(path, 0, size, True, None, False)]
        pushed = (self.pushed["chrom"], self.pushed.get("low", 1) - 1, self.pushed.get("high", REACH)) if self.pushed.get("chrom") not in (None, "*") else None
        asked = [r for r in (self.region, pushed) if r]
        inside = None
        if asked:
            with bgzf.open_file(path) as f:
                header = read_header(f, size)
            spans = [(header.names.index(r[0]) if r is pushed and r[0] in header.names else None if r is pushed else header.number(r[0]), r[1], r[2]) for r in asked]
            if any(s[0] is None for s in spans):
                return []
            index = read_index(path)
            if self.region:
                inside = spans[0]
            if index:
                found = [index.chunks(*s) for s in spans]
                chunks = min(found, key=lambda c: sum((e >> 16) - (b >> 16) for b, e in c))
                return [Part(path, b, e, True, inside) for b, e in self._dealt(chunks)]
        cuts = [*range(0, size, self.split_bytes * together), size]
        return [Part(path, b, e, False, inside, step=self.split_bytes) for b, e in zip(cuts[:-1], cuts[1:], strict=True)]

    def _dealt(self, chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Chunks that lie close go to one task, up to the size of a split."""
        out: list[tuple[int, int]] = []
        for b, e in chunks:
            if out and (b >> 16) - (out[-1][1] >> 16) < bgzf.MOST and (e >> 16) - (out[-1][0] >> 16) < self.split_bytes:
                out[-1] = out[-1][0], e
            else:
                out.append((b, e))
        return out

    def _streamed(self, path: str) -> Iterator[pa.RecordBatch]:
        """A file that cannot be entered but at its begin."""
        rows = parse_bam(streams.pieces(path if "://" in path else f"file://{path}"))
        while some := list(itertools.islice(rows, 20_000)):
            if self.region:
                name, begin, end = self.region
                names = {name, name.removeprefix("chr"), f"chr{name.removeprefix('chr')}"}
                along = lambda cigar: max(1, sum(int(n) for n, o in re.findall(r"(\d+)(\D)", cigar) if o in ALONG))
                some = [r for r in some if r[2] in names and r[3] <= end and r[3] - 1 + along(r[5]) > begin]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.in_blocks:
            yield from self._streamed(partition.path)
            return
        with bgzf.open_file(partition.path) as f:
            size = f.size()
            header = read_header(f, size)
            decoder = Decoder(header)
            if partition.exact:
                yield from self._rows(Split(f, size, partition.begin, partition.end), decoder, partition.region)
                return
            begin = first_record(f, size, partition.begin, header)
            for low in range(partition.begin, partition.end, partition.step or partition.end - partition.begin):
                end = min(low + (partition.step or partition.end), partition.end)
                split = Split(f, size, begin, end << 16)
                yield from self._rows(split, decoder, partition.region)
                if end == size:
                    return
                following = first_record(f, size, end, header)
                if begin < end << 16 and (split.next is not None and split.next != following or split.next is None and following & 0xFFFF):
                    raise ValueError(f"{partition.path}: records go on at {split.next}, not at {following} as bytes from {end} on look; read it with larger splits")
                begin = following

    def _rows(self, split: Split, decoder: Decoder, region: tuple[int, int, int] | None) -> Iterator[pa.RecordBatch]:
        for data, at in split:
            rows = decoder.rows(data, at, region)
            if rows.num_rows:
                yield rows


class FilteredBamReader(BamReader):
    """A reader to which Spark tells filters: only where the session has spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on chrom and pos choose what is read; Spark applies them all the same."""
        for x in filters:
            column = x.attribute[0] if hasattr(x, "attribute") and len(x.attribute) == 1 else None
            if isinstance(x, EqualTo) and column == "chrom":
                self.pushed["chrom"] = x.value
            elif column == "pos" and isinstance(x, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(x, LessThan | LessThanOrEqual):
                    self.pushed["low"] = max(self.pushed.get("low", 1), x.value + isinstance(x, GreaterThan))
                if not isinstance(x, GreaterThan | GreaterThanOrEqual):
                    self.pushed["high"] = min(self.pushed.get("high", REACH), x.value - isinstance(x, LessThan))
            yield x


def read_bam(spark: SparkSession, paths: str | list[str], region: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads of BAM files (or folders of them), with mate_chrom.

    Files in blocks are read in splits, others by a task each.  region (chr3, 3:500-900): only reads that overlap
    it; where a file has an index, only the chunks that it names are read.
    """
    spark.dataSource.register(BamSource)
    options = {"paths": json.dumps([paths] if isinstance(paths, str) else paths), "splitBytes": str(split_bytes)} | ({"region": region} if region else {})
    rows = spark.read.format("bam").options(**options).load()
    return with_mate_chrom(rows)


def with_mate_chrom(reads: DataFrame) -> DataFrame:
    return reads.withColumn("mate_chrom", F.when(F.col("rnext") == "=", F.col("chrom")).otherwise(F.col("rnext")))


# -- writing


class _Hex(dict):
    """The code of each base as a hexadecimal digit; what is no base is N."""

    def __missing__(self, c: int) -> str:
        return "f"


_CODES = _Hex({ord(x): f"{i:x}" for i, c in enumerate(BASES) for x in (c, c.lower())})
_SCORES = bytes((i - 33) % 256 for i in range(256))


class Encoder:
    """Records of BAM from rows, in blocks, with their index."""

    def __init__(self, out: pa.NativeFile, chroms: list[tuple[str, int]]):
        self.out, self.held, self.at = out, bytearray(), 0
        self.numbers = {n: i for i, (n, _) in enumerate(chroms)}
        self.bins: list[dict[int, list[tuple[int, int]]]] = [{} for _ in chroms]
        self.windows: list[dict[int, int]] = [{} for _ in chroms]
        self.spelled: dict[str, tuple[bytes, int]] = {"*": (b"", 0)}
        text = ("@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{length}\n" for n, length in chroms)).encode()
        names = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", length) for n, length in chroms)
        self.put(MAGIC + struct.pack("<i", len(text)) + text + struct.pack("<i", len(chroms)) + names)
        self.flush()

    def flush(self) -> None:
        while self.held:
            block = bgzf.deflated(bytes(self.held[: bgzf.FILL]))
            self.out.write(block)
            self.at += len(block)
            del self.held[: bgzf.FILL]

    def put(self, data: bytes) -> None:
        """A record that still fits goes to the block that is being filled."""
        if self.held and len(self.held) + len(data) > bgzf.FILL:
            self.flush()
        self.held += data

    def cigar(self, text: str) -> tuple[bytes, int]:
        if (got := self.spelled.get(text)) is None:
            ops, n = [], ""
            for c in text:
                if c.isdigit():
                    n += c
                else:
                    ops.append((int(n), c))
                    n = ""
            got = self.spelled[text] = b"".join(struct.pack("<I", m << 4 | OPERATIONS.index(o)) for m, o in ops), sum(m for m, o in ops if o in ALONG)
        return got

    def number(self, name: str | None) -> int:
        if name in (None, "*"):
            return -1
        if name not in self.numbers:
            raise ValueError(f"{name}: not a chromosome of the header")
        return self.numbers[name]

    def scores(self, qual: str) -> bytes:
        if qual.isascii() and (not qual or min(qual) >= "!"):
            return qual.encode().translate(_SCORES)
        return bytes(ord(c) - 33 for c in qual)

    def add(self, qname: str, flag: int, chrom: str | None, pos: int | None, mapq: int, cigar: str | None, rnext: str | None, mate_pos: int | None, tlen: int | None, seq: str | None, qual: str | None) -> None:
        ref, begin = self.number(chrom), (pos or 0) - 1
        next_ref = ref if rnext == "=" else self.number(rnext)
        ops, along = self.cigar(cigar or "*")
        bases = "" if seq in (None, "*") else seq
        quals = bytes([255]) * len(bases) if qual in (None, "*") else self.scores(qual)
        if len(quals) != len(bases):
            raise ValueError(f"{qname}: bases and qualities are not equally many")
        end = begin + max(along, 1)
        kind = bin_of(max(begin, 0), max(end, 1))
        name = (qname or "*").encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", ref, begin, len(name), mapq or 0, kind, len(ops) // 4, flag, len(bases), next_ref, (mate_pos or 0) - 1, tlen or 0) + name + ops
        body += bytes.fromhex(bases.translate(_CODES) + "0" * (len(bases) % 2)) + quals
        data = struct.pack("<i", len(body)) + body
        if self.held and len(self.held) + len(data) > bgzf.FILL:
            self.flush()
        place = self.at << 16 | len(self.held)
        self.put(data)
        while len(self.held) >= bgzf.FILL:
            block = bgzf.deflated(bytes(self.held[: bgzf.FILL]))
            self.out.write(block)
            self.at += len(block)
            del self.held[: bgzf.FILL]
        after = self.at << 16 | len(self.held)
        if ref >= 0 and begin >= 0:
            if end > REACH:
                raise ValueError(f"{qname}: beyond the {REACH} bases that an index reaches")
            chunks = self.bins[ref].setdefault(kind, [])
            if chunks and chunks[-1][1] == place:
                chunks[-1] = chunks[-1][0], after
            else:
                chunks.append((place, after))
            for k in range(begin // WINDOW, (end - 1) // WINDOW + 1):
                self.windows[ref].setdefault(k, place)

    def close(self) -> Index:
        self.flush()
        self.out.write(bgzf.END)
        windows = []
        for own in self.windows:
            filled, last = [], 0
            for k in range(max(own, default=-1) + 1):
                last = own.get(k, last)
                filled.append(last)
            windows.append(filled)
        return Index(self.bins, windows)


class BamWriter(PartsWriter):
    """A BAM file and its index for each task."""

    ending = ".bam"

    def __init__(self, path: str, chroms: list[tuple[str, int]], overwrite: bool):
        super().__init__(path, overwrite)
        self.chroms = chroms

    def put(self, out: pa.NativeFile, batches: Iterator[pa.RecordBatch]) -> tuple[int, dict[str, bytes]]:
        e, rows = Encoder(out, self.chroms), 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
                e.add(*r)
            rows += batch.num_rows
        return rows, {".bai": e.close().packed()}


def in_order(reads: DataFrame, chroms: DataFrame, parts: int | None = None) -> DataFrame:
    """reads dealt out by ranges of place and sorted: by chromosome as chroms (chrom, length) lists them, then position; unplaced ones last.

    Reads of one place may go to several tasks, as a hash of the name is part of the order.
    """
    names = [r[0] for r in chroms.select("chrom").collect()]  # a chromosome table is small
    number = F.array_position(F.array(*map(F.lit, names)), F.coalesce("chrom", F.lit("*")))
    keyed = reads.withColumns({"_ref": F.when(F.col("chrom").isNull() | (F.col("chrom") == "*"), len(names) + 1).otherwise(number), "_h": F.xxhash64("qname", "flag")})
    key = ("_ref", "pos", "_h")
    dealt = keyed.repartitionByRange(parts, *key) if parts else keyed.repartitionByRange(*key)
    return dealt.sortWithinPartitions(*key, "qname", "flag").drop("_ref", "_h")


def write_bam(reads: DataFrame, path: str, chroms: DataFrame, parts: int | None = None, mode: str = "append") -> None:
    """reads (the columns of COLUMNS) as BAM files sorted by place, each with an index; the files' names follow the order."""
    spark = reads.sparkSession
    spark.dataSource.register(BamSource)
    header = json.dumps([tuple(r) for r in chroms.select("chrom", "length").collect()])  # a chromosome table is small
    typed = in_order(reads, chroms, parts).select(*(F.col(n).cast(t) for n, t in (c.split() for c in COLUMNS.split(", "))))
    typed.write.format("bam").option("chroms", header).mode(mode).save(path)
