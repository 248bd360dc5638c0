"""Texts as numpy arrays: words, their hashes and shingles for many documents at once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that are worked on at a time; a longer document is worked on alone.
CHUNK = 1 << 20
LONG_WORD = 2048

PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of several texts: start and end in buf (lower-cased), the first word of each text in at, and a hash each."""

    def __init__(self, blobs: list[bytes], kind: np.ndarray = PLAIN, lower: bool = True):
        raw = np.frombuffer(b" ".join(blobs) + b" " * 9, np.uint8)
        self.buf = LOWER[raw] if lower else raw
        inside = kind[self.buf]
        inside[len(raw) - 9 :] = False
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) + 1
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        self.start, self.end = edge[0::2], edge[1::2]
        self.at = np.searchsorted(self.start, self.offset)
        self._eight = np.lib.stride_tricks.as_strided(self.buf, (len(raw) - 8, 8), (1, 1))

    def eight(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place as an integer."""
        return np.ascontiguousarray(self._eight[at]).view("<u8").ravel()

    def prefix(self, n: int) -> np.ndarray:
        """The first n (up to 7) bytes of each word as an integer; 0 for shorter words."""
        return np.where(self.end - self.start >= n, self.eight(self.start) & _MASK[n], np.uint64(0))

    def hashes(self) -> np.ndarray:
        left = self.end - self.start
        h = left.astype(np.uint64) * M1
        todo, at, rest = np.arange(len(left)), self.start, left
        for i in np.flatnonzero(left > LONG_WORD):
            h[i] ^= np.uint64(xxhash.xxh64_intdigest(self.buf[self.start[i] : self.end[i]].tobytes()))
        if len(left) and left.max() > LONG_WORD:
            todo = np.flatnonzero(left <= LONG_WORD)
            at, rest = at[todo], rest[todo]
        while len(todo):
            v = (h[todo] ^ (self.eight(at) & _MASK[np.minimum(rest, 8)])) * M2
            h[todo] = v ^ (v >> np.uint64(32))
            more = rest > 8
            todo, at, rest = todo[more], at[more] + 8, rest[more] - 8
        return mixed(h)

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text, given its words' hashes; of the whole sequence if it is shorter, of nothing for no words."""
    k = min(k, len(h))
    if not k:
        return h[:0]
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64) * M3
    for j in range(k):
        s = (s ^ h[j : j + n]) * M1
        s ^= s >> np.uint64(29)
    return mixed(s)


def blobs(column: pa.Array) -> list[bytes]:
    """Bytes of each text; none for null."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def hold() -> None:
    """From now on this process keeps freed memory until release(): arrays that come and go by the thousand needn't be mapped anew each time."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)  # only some C libraries have it
    if mallopt is not None:
        mallopt(-1, 1 << 28)  # fixed values of the C library: what is trimmed from, and what is mapped apart from
        mallopt(-3, 1 << 25)


def release() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task, or its neighbours on the executor, shouldn't hold what the last one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def pieces(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in slices of about limit bytes of text and so many rows at most, whole documents each."""
    length = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
    begin = size = 0
    for i, n in enumerate([*length, 0]):
        if i > begin and (size + n > limit or i - begin == rows or i == len(length)):
            part = batch.slice(begin, i - begin)
            yield part, blobs(part.column(name))
            begin, size = i, 0
        size += n
    release()
