"""Packing of tokenised documents into sequences of fixed length by bounded-space online best fit.

Each partition keeps ``windows`` open windows. A document gives whole windows of its own first; what is left goes
into the open window that it fills best. When it fits none and all windows are open, the fullest is emitted: a gap of
at least ``least_cut`` tokens is filled with a cut of the piece at hand, a smaller one is padded. Windows that are open
at the end of a partition carry their ids to a merge: tree-wise, ``fan_in`` partitions at a time, leftovers are laid
end to end and cut into whole windows, until one window that may be part full is left. A task of the merge thus sees
at most ``fan_in * windows`` windows, whatever the size of the corpus.

No text is shuffled: the scan tokenises and packs, and only leftovers and row-sized placements leave it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.store import cut
from quantspark.llm.words import WordIds, Words, chunks, gather
from quantspark.session import ship

LENGTH = 2048
END_ID = 1
WINDOWS = 32
LEAST_CUT = 8
FAN_IN = 16

PIECE = pa.schema(
    [pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [pa.field("part", pa.int64()), pa.field("place", pa.int64()), pa.field("ids", pa.binary())]
)
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, place long, ids binary"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_MODELS: dict[str, WordIds] = {}


def _model(path: str) -> WordIds:
    """The tokeniser at ``path``. Its words never merge over white space, so a text's ids are those of its words."""
    if path not in _MODELS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        _MODELS[path] = WordIds(lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)])
    return _MODELS[path]


def token_ids(column: pa.Array, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a chunk with END_ID after each, and where each text's ids begin (and the last end)."""
    words = Words(column)
    model = _model(vocabulary)
    begin, size = model.of(words, words.hashes())
    n = np.bincount(words.doc, size, words.n_docs).astype(np.int64)
    at = np.zeros(words.n_docs + 1, np.int64)
    np.cumsum(n + 1, out=at[1:])
    ids = np.full(int(at[-1]), END_ID, np.int32)
    inner = np.ones(len(ids), bool)
    inner[at[1:] - 1] = False
    ids[inner] = gather(model.flat, begin, size)
    return ids, at


@dataclass
class _Window:
    sequence: int
    used: int = 0
    pieces: list[tuple] = field(default_factory=list)


class Packer:
    """Open windows of one partition. ``done`` gathers placed pieces (columns of PIECE without part, place, ids)."""

    def __init__(self, first_sequence: int, length: int = LENGTH, windows: int = WINDOWS, least_cut: int = LEAST_CUT):
        self.next, self.length, self.most, self.least_cut = first_sequence, length, windows, least_cut
        self.open: list[_Window] = []
        self.done: list[tuple] = []

    def _window(self) -> _Window:
        self.next += 1
        return _Window(self.next - 1)

    def _put(self, window: _Window, doc, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        window.pieces.append((doc, start, ids, doc_tokens, window.used))
        window.used += len(ids)

    def _emit(self, window: _Window) -> None:
        for doc, start, ids, doc_tokens, offset in window.pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, window.sequence, offset))

    def add(self, doc, ids: np.ndarray, start: int = 0, doc_tokens: int | None = None) -> None:
        doc_tokens = len(ids) if doc_tokens is None else doc_tokens
        while len(ids) >= self.length:
            window = self._window()
            self._put(window, doc, start, ids[: self.length], doc_tokens)
            self._emit(window)
            ids, start = ids[self.length :], start + self.length
        while len(ids):
            fit = [w for w in self.open if self.length - w.used >= len(ids)]
            if fit:
                window, n = max(fit, key=lambda w: w.used), len(ids)
            elif len(self.open) < self.most:
                window, n = self._window(), len(ids)
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w.used)
                n = self.length - window.used
                if n < self.least_cut:
                    self._close(window)
                    continue
            # Copied, so that an open window doesn't hold its chunk's ids.
            self._put(window, doc, start, ids[:n].copy(), doc_tokens)
            ids, start = ids[n:], start + n
            if window.used == self.length:
                self._close(window)

    def _close(self, window: _Window) -> None:
        self._emit(window)
        self.open.remove(window)

    def taken(self) -> list[tuple]:
        done, self.done = self.done, []
        return done

    def left(self) -> list[tuple]:
        """What is in open windows: doc, start, ids, doc_tokens."""
        return [p[:4] for w in self.open for p in w.pieces]


def _rows(placed: list[tuple], left: list[tuple], part: int) -> pa.RecordBatch:
    columns = list(zip(*placed, strict=True)) or [()] * 7
    n = len(placed)
    out = [list(c) for c in columns] + [[part] * n, [None] * n, [None] * n]
    for place, (doc, start, ids, doc_tokens) in enumerate(left):
        for column, value in zip(out, (doc, start, len(ids), None, doc_tokens, None, None, part, place, ids.astype("<u4").tobytes()), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECE, strict=True)], schema=PIECE)


def _pack_partition(vocabulary: str, length: int, windows: int, least_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(part << 32, length, windows, least_cut)
        for batch in batches:
            for chunk in chunks(batch):
                ids, at = token_ids(chunk.column(1), vocabulary)
                for doc, a, b in zip(chunk.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    packer.add(doc, ids[a:b])
                yield _rows(packer.taken(), [], part)
        yield _rows([], packer.left(), part)

    return run


def _merge(level: int, length: int, last: bool):
    """The leftovers of a group of partitions laid end to end; what doesn't fill a window is left over again."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        packer = Packer((level << 56) | (part << 24), length, windows=1, least_cut=1)
        for row in table.sort_by([("part", "ascending"), ("place", "ascending")]).to_pylist():
            packer.add(row["doc_id"], np.frombuffer(row["ids"], "<u4"), row["start"], row["doc_tokens"])
        left = packer.left()
        if last:
            for window in list(packer.open):
                packer._close(window)
            left = []
        return pa.Table.from_batches([_rows(packer.taken(), left, part)])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, windows: int = WINDOWS, least_cut: int = LEAST_CUT, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Needs doc_id and text; other columns are ignored. Null text counts as empty and is packed as its end token alone.
    Rows that share a doc_id (null too) are packed as documents of their own. An empty table gives an empty result.
    A longest text is cut as often as it needs.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = docs.mapInArrow(_pack_partition(vocabulary or default_vocabulary(), length, windows, least_cut), PIECE_DDL)
    packed = cut(packed)
    out, level, parts = [packed], 0, (packed.agg(F.max("part")).first()[0] or 0) + 1
    left = packed.where("ids IS NOT NULL")
    while True:
        level, parts = level + 1, -(-parts // fan_in)
        last = parts <= 1
        grouped = left.groupBy(F.expr(f"part DIV {fan_in}").alias("group"))
        merged = cut(grouped.applyInArrow(_merge(level, length, last), PIECE_DDL))
        out.append(merged)
        left = merged.where("ids IS NOT NULL")
        if last:
            break
    placed = [df.where("ids IS NULL").drop("ids", "part", "place") for df in out]
    result = placed[0]
    for df in placed[1:]:
        result = result.unionByName(df)
    return result

