"""Token ids of byte spans, remembered in a worker, and lists of ids as decimal text; flat arrays throughout."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from quantspark.llm.words import gather, span_hashes

#: Bytes of text whose spans are looked up at once; a longer text takes several rounds.
SLICE_BYTES = 1 << 21


def grown(flat: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``flat`` with ``more`` written from ``used`` on, enlarged by doubling."""
    while len(flat) < used + len(more):
        flat = np.append(flat, np.zeros_like(flat))
    flat[used : used + len(more)] = more
    return flat


class SpanIds:
    """Ids of spans of text, kept under 64-bit hashes; a span's bytes are compared with the kept ones on every hit.

    ``encode`` takes the concatenated bytes of spans and their offsets and gives all ids and their number for each span.
    A full memory is emptied and filled again, so ``most`` bounds a worker's memory and never changes results.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most: int = 250_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.id_at = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)
        self.raw, self.raw_at = np.zeros(1 << 16, np.uint8), np.zeros(1, np.int64)

    def _add(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        """New entries; their numbers."""
        at = np.concatenate([[0], np.cumsum(size)])
        ids, count = self.encode(raw, at)
        n = len(self.id_at) - 1
        self.ids = grown(self.ids, int(self.id_at[-1]), ids)
        self.raw = grown(self.raw, int(self.raw_at[-1]), raw)
        self.id_at = np.append(self.id_at, self.id_at[-1] + np.cumsum(count))
        self.raw_at = np.append(self.raw_at, self.raw_at[-1] + at[1:])
        return np.arange(n, n + len(size))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return place, self.keys[place] == keys

    def _entries(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        keys, first, index = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        place, known = self._places(keys)
        if len(self.id_at) > self.most and not known.all():
            self._clear()
            place, known = self._places(keys)
        if not known.all():
            at = first[~known]
            new = self._add(gather(raw, start[at], size[at]), size[at])
            where = np.searchsorted(self.keys, keys[~known])
            self.keys, self.entry = np.insert(self.keys, where, keys[~known]), np.insert(self.entry, where, new)
            place, _ = self._places(keys)
        entry = self.entry[place][index]
        same = self.raw_at[entry + 1] - self.raw_at[entry] == size
        checked = np.flatnonzero(same)
        equal = gather(self.raw, self.raw_at[entry[checked]], size[checked]) == gather(raw, start[checked], size[checked])
        same[checked] = np.add.reduceat(equal, np.cumsum(size[checked]) - size[checked]) == size[checked] if len(checked) else True
        other = np.flatnonzero(~same)
        if len(other):  # equal hashes of different bytes
            entry[other] = self._add(gather(raw, start[other], size[other]), size[other])
        return entry

    def of(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans in order, and their number for each span. Spans ascend, don't overlap and aren't empty."""
        ids, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + SLICE_BYTES)))
            entry = self._entries(raw, start[lo:hi], end[lo:hi])
            count = self.id_at[entry + 1] - self.id_at[entry]
            ids.append(gather(self.ids, self.id_at[entry], count))
            counts.append(count)
            lo = hi
        return np.concatenate(ids), np.concatenate(counts)


class Table:
    """Byte strings by number, gathered into one buffer."""

    def __init__(self, entries: list[bytes]):
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ``numbers`` one after another, and the offsets of each (and the last end)."""
        size = self.size[numbers]
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        return gather(self.flat, self.begin[numbers], size), at


def spans(raw: np.ndarray, at: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the spans of a chunk: rows ``at``, parted also before every byte where ``cut`` holds."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[:-1] = cut
    edge[at] = True
    edge = np.flatnonzero(edge)
    return (edge[:-1], edge[1:]) if len(raw) else (np.empty(0, np.int64), np.empty(0, np.int64))


def spaced(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a space before each that isn't empty, and their offsets."""
    full = np.diff(at) > 0
    out = np.insert(raw, at[:-1][full], 0x20)
    moved = np.zeros(len(at), np.int64)
    np.cumsum(full, out=moved[1:])
    return out, at + moved
