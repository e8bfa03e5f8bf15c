"""What the operators of this package share: settings, scratch tables, word arrays."""

from __future__ import annotations

import ctypes
import os
import uuid
import weakref
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch sent to Python, at most (but for a single longer row).
BATCH_BYTES = 4 << 20
#: Characters that are worked on at once inside a Python worker.
CHUNK_CHARS = 2_000_000
#: Texts that are worked on at once; their places fit 16 bits.
CHUNK_TEXTS = 50_000
#: Rows of a table that is broadcast, at most; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def configure(spark: SparkSession) -> SparkSession:
    """Set what every Python-side operator here needs; safe to repeat.

    Arrow batches are bounded by bytes, so that a worker's memory does not
    depend on text lengths, and the folder of this library is named to the
    Python workers.  A smaller bound of the session's own stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names.

    Where that is unset, a session on this machine alone (master local[...])
    gets a local folder; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at and (java := sc._jsc.sc().getCheckpointDir()).isDefined():
        at = java.get()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file:///tmp/lodestrand-{os.getpid()}"
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/lodestrand-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """A path as Spark resolves it (against the default file system if it names none), and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(at), fs


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read back: it cuts the
    lineage and outlives the loss of executors.

    Row groups are small, so that packed rows are read a few at a time.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("parquet.block.size", 8 << 20).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that written() made, once nothing that is still to be worked out reads them."""
    for t in tables:
        if t is not None and (path := _PATHS.pop(t, None)):
            at, fs = hadoop_path(t.sparkSession, path)
            fs.delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this application has written to the shared folder; results not yet written elsewhere go with it."""
    at, fs = hadoop_path(spark, session_dir(spark))
    fs.delete(at, True)


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system, before other work comes."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def plan_bytes(df: DataFrame) -> int:
    """Bytes that df reads, as Spark's planner estimates them from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fold(key: str, parts: int) -> Column:
    """crc32 of the key's text modulo parts; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def fold_of(keys: list, parts: int) -> np.ndarray:
    """What fold() gives, for Python values."""
    return np.array([zlib.crc32(b"" if k is None else str(k).encode()) % parts for k in keys], dtype=np.int64)


def row_key(df: DataFrame) -> DataFrame:
    """Keep doc_id as it is; clashing column names are left behind by selecting."""
    return df.select("doc_id", "text")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Record batches joined up to about limit characters, with texts as str (null: empty).

    A text longer than the limit is a chunk by itself, whole.
    """
    held: list[pa.RecordBatch] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        got = [t if t is not None else "" for t in batch.column(text).to_pylist()]
        first = 0
        for i, t in enumerate(got):
            if size + len(t) > limit and size or len(texts) + i - first >= CHUNK_TEXTS:
                if i > first:
                    held.append(batch.slice(first, i - first))
                    texts += got[first:i]
                yield joined(held), texts
                held, texts, size, first = [], [], 0, i
            size += len(t)
        if len(got) > first:
            held.append(batch.slice(first))
            texts += got[first:]
    if texts:
        yield joined(held), texts
    held, texts, got = [], [], []
    release()


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One record batch out of several."""
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary value for each stretch between cuts: the bytes of its values."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((np.asarray(cuts) * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def unpacked(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """All values of a column of binaries, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


class Numbering(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... for lengths[i] places, for all i in turn."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    out = np.arange(total, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return out + np.repeat(starts - before, lengths)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of values; runs may be empty."""
    c = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(lengths)
    return c[ends] - c[ends - lengths]


def words_of(texts: list[str], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts as UTF-8 bytes, one after another,
    and how many each text has.  bytes.split() and bytes.lower() know just ASCII."""
    out: list[bytes] = []
    counts = np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass")
        w = (b.lower() if lower else b).split()
        counts[i] = len(w)
        out += w
    return out, counts
