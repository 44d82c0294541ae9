"""Vectorised text kernels over Arrow batches, used by the operators that run in Arrow-batched Python.

A chunk of texts is one UTF-8 byte buffer; words, lines and shingles are arrays of offsets and 64-bit hashes into
it. Words are ``[^\\x20\\x09-\\x0D]+``. No loop runs over words or documents in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
BASE2 = _U(0xC2B2AE3D27D4EB4F)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: One random 64-bit value for each byte value; fixed, so that all executors agree.
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        full = np.full(size, base, np.uint64)
        full[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(full, dtype=np.uint64)
        if size <= 1 << 22:
            _POWERS[int(base)] = have
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 1 << 64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text; a longer text is a slice of its own."""
    _, at = utf8(batch.column(batch.schema.get_field_index(text)))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(at, at[start] + most, "right")) - 1
        end = min(n, max(start + 1, end))
        yield batch.slice(start, end - start)
        start = end


class Words:
    """The words of a chunk of texts: ``start``/``end`` byte offsets, ``doc`` row of each word, ``first`` word of each row."""

    def __init__(self, column: pa.Array):
        self.raw, self.at = utf8(column)
        self.n_docs = len(self.at) - 1
        raw = self.raw
        inside = ~WHITE[raw]
        left = np.empty(len(raw), bool)
        right = np.empty(len(raw), bool)
        if len(raw):
            left[0] = right[-1] = True
            left[1:] = ~inside[:-1]
            right[:-1] = ~inside[1:]
            bounds = self.at[(self.at > 0) & (self.at < len(raw))]
            left[bounds] = True
            right[bounds - 1] = True
        self.start = np.flatnonzero(inside & left)
        self.end = np.flatnonzero(inside & right) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        self.inside = inside

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.raw, self.start, self.end)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """The number of set bytes in each row."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are ascending and don't overlap."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    begin = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=begin[1:])
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    with np.errstate(over="ignore"):
        values = BYTE_VALUES[raw[place + np.repeat(start, size)]] * powers(BASE, int(size.max()))[place]
        # Empty spans would make reduceat read the next span's first byte.
        sums = np.zeros(len(size), np.uint64)
        full = size > 0
        sums[full] = np.add.reduceat(values, begin[full]) if len(values) else 0
        return mix(sums ^ mix(size.astype(np.uint64)))


def prefix(values: np.ndarray, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash over a sequence, and the inverse powers that ranges need."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=sums[1:])
        return sums, powers(inverse(base), len(values) + 1)


def ranges(sums: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of ``values[start:end]`` for each pair, from ``prefix``."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def shingles(words: Words, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words within a row, and the row of each; a shorter non-empty row is one window."""
    hashes = words.hashes() if hashes is None else hashes
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    last = words.first[1:][words.doc]
    start = np.arange(n)
    whole = (start == words.first[:-1][words.doc]) & (last - start < size)
    keep = (start + size <= last) | whole
    start = start[keep]
    end = np.minimum(start + size, last[keep])
    sums, back = prefix(hashes)
    return ranges(sums, back, start, end), words.doc[start]


class WordIds:
    """Token ids of words, remembered in a worker in flat arrays under the words' 64-bit hashes.

    A full memory is emptied and filled again, so ``most`` bounds a worker's memory and never changes results.
    """

    #: The one memory that is filled in this worker; another vocabulary's is emptied before a new one is used.
    _active: WordIds | None = None

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 1_500_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.begin, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _add(self, keys: np.ndarray, words: list[bytes]) -> None:
        size, begin = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        for k in range(0, len(words), 20_000):
            found = self.encode([w.decode("utf-8", "replace") for w in words[k : k + 20_000]])
            part = np.fromiter(map(len, found), np.int32, len(found))
            n = int(part.sum())
            while len(self.flat) < self.used + n:
                self.flat = np.append(self.flat, np.zeros_like(self.flat))
            self.flat[self.used : self.used + n] = np.fromiter((i for ids in found for i in ids), np.int32, n)
            size[k : k + len(part)] = part
            begin[k : k + len(part)] = self.used + np.cumsum(part) - part
            self.used += n
        place = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = np.insert(self.keys, place, keys), np.insert(self.begin, place, begin), np.insert(self.size, place, size)

    def _missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys

    def of(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin in ``flat`` and how many they are; valid until the next call."""
        if WordIds._active is not self:
            if WordIds._active is not None:
                WordIds._active._clear()
            WordIds._active = self
        keys, at, index = np.unique(hashes, return_index=True, return_inverse=True)
        missing = self._missing(keys)
        if len(self.keys) and len(self.keys) + missing.sum() > self.most:
            self._clear()
            missing = self._missing(keys)
        if missing.any():
            raw, at = words.raw, at[missing]
            self._add(keys[missing], [raw[s:e].tobytes() for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])
        place = np.searchsorted(self.keys, keys)[index]
        return self.begin[place], self.size[place].astype(np.int64)


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[b : b + n]`` over all pairs."""
    ahead = np.cumsum(size) - size
    return flat[np.arange(int(size.sum())) + np.repeat(begin - ahead, size)]
