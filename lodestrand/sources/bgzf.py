"""Block gzip: gzip members of at most 64 KiB that carry their own length, so that a file can be entered anywhere.

A virtual offset is a block's place in the file times 65,536 plus a place in
its inflated bytes.  Files are opened by pyarrow, on executors too.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs

#: Fixed values of the format: the start of a member with extra fields, the most bytes of a block, inflated bytes that one is filled with, the empty last block.
MAGIC, MOST, FILL = b"\x1f\x8b\x08\x04", 1 << 16, 0xFF00
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    if "://" not in path:
        path = path.removeprefix("file:")
        return pafs.LocalFileSystem(), str(PurePosixPath(path))
    return pafs.FileSystem.from_uri(path)


def open_file(path: str) -> pa.NativeFile:
    fs, at = opened(path)
    return fs.open_input_file(at)


def block_size(data: bytes | memoryview, at: int = 0) -> int | None:
    """Bytes of the block that begins at a place of data; None if none does, or if data ends within its header."""
    if len(data) - at < 18 or bytes(data[at : at + 4]) != MAGIC:
        return None
    extra = struct.unpack_from("<H", data, at + 10)[0]
    p, end = at + 12, at + 12 + extra
    while p + 4 <= end and p + 6 <= len(data):
        kind, size = bytes(data[p : p + 2]), struct.unpack_from("<H", data, p + 2)[0]
        if kind == b"BC" and size == 2:
            return struct.unpack_from("<H", data, p + 4)[0] + 1
        p += 4 + size
    return None


def inflated(block: bytes | memoryview) -> bytes:
    """A block's bytes, their sum checked."""
    d = zlib.decompressobj(31)
    out = d.decompress(block)
    if not d.eof:
        raise ValueError("a block of the file is damaged or cut short")
    return out


def deflated(data: bytes, level: int = 6) -> bytes:
    """One block of at most 65,280 bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    if len(body) + 26 > MOST:  # what does not shrink is stored
        c = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
    head = MAGIC + bytes(5) + b"\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def is_block_gzip(path: str) -> bool:
    """Whether a file begins with a block of this kind, whatever it is called."""
    with open_file(path) as f:
        return block_size(f.read(MOST)) is not None


def next_block(f: pa.NativeFile, at: int, size: int) -> int:
    """Place of the first block that begins at `at` or later: its header and those of the blocks after it fit together.

    Three blocks in a row, or as many as there are, tell a block from bytes that look like one; size is the file's.
    """
    while at < size:
        f.seek(at)
        data = f.read(4 * MOST)
        hit = data.find(MAGIC)
        while 0 <= hit < MOST:
            p, good = hit, 0
            while good < 3 and at + p < size:
                n = block_size(data, p)
                if n is None or at + p + n > size:
                    good = -1
                    break
                p, good = p + n, good + 1
            if good > 0:
                return at + hit
            hit = data.find(MAGIC, hit + 1)
        at += MOST
    return size


def blocks(f: pa.NativeFile, at: int, size: int, read_bytes: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Place and inflated bytes of each block from one on."""
    f.seek(at)
    data, p = b"", 0
    while at < size:
        n = block_size(data, p)
        if n is None or p + n > len(data):
            more = f.read(read_bytes)
            if not more:
                raise ValueError("the file ends within a block, or is no block gzip")
            data, p = data[p:] + more, 0
            if n is None and block_size(data) is None and len(data) >= MOST:
                raise ValueError(f"no block begins at {at}")
            continue
        yield at, inflated(memoryview(data)[p : p + n])
        at, p = at + n, p + n


class Stream:
    """Inflated bytes from a virtual offset on, with the virtual offset of each place."""

    def __init__(self, f: pa.NativeFile, virtual: int, size: int):
        self.source = blocks(f, virtual >> 16, size)
        self.data, self.at = b"", 0
        self.starts: list[tuple[int, int]] = []  # place in data, place of the block in the file
        self.size = size
        self.ended = False
        if virtual & 0xFFFF:
            self.fill((virtual & 0xFFFF) + 1)
            self.at = virtual & 0xFFFF

    def fill(self, n: int) -> bool:
        """Have n bytes from here on, if there are so many."""
        if len(self.data) - self.at >= n:
            return True
        parts = [self.data[self.at :]]
        have = len(parts[0])
        self.starts = [(max(p - self.at, 0), c) if p >= self.at else (p - self.at, c) for p, c in self.starts]
        while len(self.starts) > 1 and self.starts[1][0] <= 0:
            self.starts.pop(0)
        while have < n:
            got = next(self.source, None)
            if got is None:
                self.ended = True
                break
            self.starts.append((have, got[0]))
            parts.append(got[1])
            have += len(got[1])
        self.data, self.at = b"".join(parts), 0
        return have >= n

    def virtual(self) -> int:
        """Virtual offset of the next byte; at a block's end, that of the next block's begin."""
        if self.at >= len(self.data) and not self.fill(1):
            return self.size << 16
        place, block = next((p, c) for p, c in reversed(self.starts) if p <= self.at)
        return block << 16 | self.at - place

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("the file ends within a record")
        self.at += n
        return self.data[self.at - n : self.at]
