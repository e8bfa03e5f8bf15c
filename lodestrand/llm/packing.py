"""Packing by power-of-two decomposition.

A document's ids are cut into full windows and then into pieces whose lengths
are the binary digits of what is left, so each piece fills a sequence of its
own power-of-two length: no sequence crosses documents, none is padded, and
sequences of equal length form a bucket that is batched by itself.

Defined results: a null text is an empty text, of which just the end id is
packed; very long texts are packed whole; rows that repeat, or share a key,
are each packed; a null key stays null; an empty table gives an empty table;
of other columns just the named keys come along.  A tokenizer file that does
not prepare texts word by word as known here gets them whole.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbering, chunks, configure, ragged, release, sums

#: Words kept with their ids by a task before it starts afresh.
CACHE_WORDS = 300_000
#: Texts of these characters only are the same to every Unicode version; others go to the tokenizer as they are.
_PLAIN = regex.compile(r"[\t-\r\x20-\x7e\xa1-įı-ɏ]*")
#: The word pattern of the tokenizer file (a fixed value).
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level tokenizers write bytes: printable ones as they are, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: How a tokenizer file prepares texts if words may be found by _WORD in lower-cased text (fixed values).
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def word_wise(path: str) -> bool:
    """Whether a tokenizer file prepares texts as above and marks where words end; texts of others go to the tokenizer whole."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    prepared = [(parts.get(k) or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    return prepared == [_NORMAL, _CUT] and parts["model"].get("type") == "BPE" and parts["model"].get("end_of_word_suffix") == "</w>"


class WordEncoder:
    """Ids of texts by a word-wise BPE tokenizer file; each distinct word is merged once."""

    def __init__(self, path: str):
        import tokenizers

        self.by_word = word_wise(path)
        self.full = tokenizers.Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        self.words = tokenizers.Tokenizer(self.full.model)
        self.words.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        vocab = self.full.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbering()
        self.ids = np.empty(0, dtype=np.uint32)
        self.count = np.empty(0, dtype=np.int64)
        self.at = np.empty(0, dtype=np.int64)

    def _learn(self, new: list[str]) -> None:
        line = " ".join(w.encode().decode("latin-1") for w in new).translate({b: c for b, c in self.letters.items() if b != 32})
        ids = np.array(self.words.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=np.uint32)
        stops = np.flatnonzero(self.ends[ids])
        if len(stops) != len(new) or stops[-1] != len(ids) - 1:
            raise ValueError("the tokenizer does not mark where words end")
        count = np.diff(stops, prepend=-1)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(count) - count])
        self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.numbers) > CACHE_WORDS:
            self.clear()
        find, number, old = _WORD.findall, self.numbers.__getitem__, len(self.numbers)
        found: list[np.ndarray | None] = []
        for t in texts:
            found.append(np.fromiter(map(number, find(t.lower())), dtype=np.int64) if self.by_word and _PLAIN.fullmatch(t) else None)
        if len(self.numbers) > old:
            self._learn(list(itertools.islice(self.numbers, old, None)))
        plain = [f for f in found if f is not None]
        words = np.concatenate(plain) if plain else np.empty(0, dtype=np.int64)
        each = self.count[words]
        ids = self.ids[ragged(self.at[words], each)]
        parts = iter(np.split(ids, np.cumsum(sums(each, np.array([len(f) for f in plain], dtype=np.int64)))[:-1])) if plain else iter(())
        return [next(parts) if f is not None else np.array(self.full.encode(t.encode("utf-8", "replace").decode(), add_special_tokens=False).ids, dtype=np.uint32) for t, f in zip(texts, found, strict=True)]


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """A worker's encoder; each task empties it when it ends."""
    return WordEncoder(path)


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as full windows and then falling powers of two."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), text: str = "text", longest: int = 2048, end_id: int = 1) -> DataFrame:
    """A row per piece: the keys, start, length, tokens (unsigned 32-bit little-endian),
    doc_tokens, bucket (log2 of length), sequence_id and offset.

    path: tokenizer file, readable on every executor.  longest: a power of two.
    sequence_id is the piece's place in the scan, so it is unique, and the same
    when a lost task is run again over the same files.
    """
    configure(df.sparkSession)
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    keys = list(keys)
    names = [*keys, "start", "length", "tokens", "doc_tokens"]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, T.BinaryType() if n == "tokens" else T.LongType()) for n in names[len(keys) :]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([end_id], dtype=np.uint32)
        for batch, texts in chunks(batches, text):
            ids = encoder.encode(texts)
            flat = np.concatenate([x for one in ids for x in (one, end)]).astype("<u4")
            total = np.array([len(x) + 1 for x in ids], dtype=np.int64)
            cuts = [binary_lengths(n, longest) for n in total.tolist()]
            count = np.array([len(c) for c in cuts], dtype=np.int64)
            length = np.fromiter(itertools.chain.from_iterable(cuts), dtype=np.int64)
            row = np.repeat(np.arange(len(texts)), count)
            at = np.cumsum(length) - length
            start = at - np.repeat(np.cumsum(total) - total, count)
            ends = np.concatenate(([0], np.cumsum(length) * 4)).astype(np.int32)
            tokens = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])
            which = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(which) for k in keys), pa.array(start), pa.array(length), tokens, pa.array(total[row])], names=names)
        encoder.clear()
        release()

    pieces = df.select(*keys, text).mapInArrow(run, schema)
    return pieces.withColumns({"bucket": F.round(F.log2("length")).cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces with a folder for each length, from which batches of equal lengths are read."""
    pieces.write.partitionBy("bucket").parquet(path)


def described(pieces: DataFrame) -> DataFrame:
    """Pieces without their ids but with a checksum of them."""
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
