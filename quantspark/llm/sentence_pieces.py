"""SentencePiece encoding and decoding by vectorised merge rounds.

A chunk of texts is one buffer. It is cut wherever no piece of the vocabulary holds the two bytes at the border, as no
merge can cross there; the resulting words are encoded once each and remembered in the worker. For all words that are
new, symbols are one flat array. Each round looks for the best pair of every word (a segmented minimum of ranks), merges
the leftmost one of each at the same time, and compacts the array, until no pair is left.

A word of more than ``LONG`` symbols would take a round for each of its merges. In such words a pair is merged once it is
the best within as many symbols to either side as the longest piece has letters: nothing farther away can reach it.
"Best" is the time at which the library would get to it: the rank of the pair, or if that is better than the merge that
made one of its symbols, that merge's time and place. So results are the library's also where a merge gives rise to a
better pair.

Decoding joins the pieces' bytes by table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.pieces import SpanIds, Table, spaced, spans
from quantspark.llm.words import chunks, gather, utf8
from quantspark.session import ship

SPACE = "▁"
LONG = 32
_NONE = np.iinfo(np.int64).max
_POINTS = 0x110000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """A BPE model with byte fallback, without normalisation; a space stands for ``SPACE`` in all byte strings here."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = model.SentencePiece
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are known here")
        normal = {p.piece.replace(SPACE, " "): i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.n_pieces = len(model.pieces)
        self.byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.is_control = np.array([p.type == kinds.CONTROL for p in model.pieces])
        self.starts_spaced = np.array([p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        shown = {kinds.CONTROL: lambda p: b"", kinds.UNKNOWN: lambda p: model.trainer_spec.unk_surface.encode(), kinds.BYTE: lambda p: bytes([int(p.piece[1:-1], 16)]), kinds.NORMAL: lambda p: p.piece.replace(SPACE, " ").encode()}
        self.bytes = Table([shown[p.type](p) for p in model.pieces])
        self.decimal = Table([b"%d," % i for i in range(self.n_pieces)])
        # Symbols are pieces by id, then letters of pieces that are none themselves, then all other code points.
        symbols = dict(normal)
        for piece in normal:
            for c in piece:
                symbols.setdefault(c, self.n_pieces + len(symbols) - len(normal))
        self.n_symbols = self.n_pieces + len(symbols) - len(normal)
        self.of_point = np.arange(_POINTS, dtype=np.int64) + self.n_symbols
        self.point_of = np.zeros(self.n_symbols, np.int64)
        self.length = np.ones(self.n_symbols, np.int64)
        for text, i in symbols.items():
            self.length[i] = len(text)
            if len(text) == 1:
                self.of_point[ord(text)], self.point_of[i] = i, ord(text)
        scores = -np.unique([-p.score for p in model.pieces if p.type == kinds.NORMAL])
        rank = {float(s): r for r, s in enumerate(scores)}
        self.n_ranks, self.longest = len(scores), max(map(len, normal))
        pairs = sorted((symbols[text[:k]] * self.n_symbols + symbols[text[k:]], i, rank[model.pieces[i].score]) for text, i in normal.items() for k in range(1, len(text)) if text[:k] in symbols and text[k:] in symbols)
        self.pair_keys, self.pair_merged, self.pair_ranks = np.array(pairs, np.int64).reshape(-1, 3).T.copy()
        self.mergeable = np.zeros((256, 256), bool)
        for text in normal:
            for k in range(1, len(text)):
                self.mergeable[text[:k].encode()[-1], text[k:].encode()[0]] = True

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``_NONE`` where the vocabulary has no such piece."""
        key = np.where((left < self.n_symbols) & (right < self.n_symbols), left * self.n_symbols + right, -1)
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = self.pair_keys[place] == key
        return np.where(found, self.pair_ranks[place], _NONE), self.pair_merged[place]

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Bytes that begin a letter before which no merge can take place."""
        out = np.ones(len(raw), bool)
        out[1:] = ~self.mergeable[raw[:-1], raw[1:]]
        return out & ((raw & 0xC0) != 0x80)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words whose bytes are ``raw`` from ``at``: all ids, and how many each word has."""
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
        word = np.repeat(np.arange(len(at) - 1), np.diff(first))
        # A gap of one between words, so that symbols of different words never touch.
        place = np.arange(len(points)) + word
        symbols = self.of_point[points]
        long = (np.diff(first) > LONG)[word]
        done = [_merged(self, symbols[part], place[part], word[part], wide) for part, wide in ((~long, False), (long, True)) if part.any()]
        symbols, place, word = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (symbols, place, word)
        order = np.argsort(place, kind="stable")
        return self._ids(symbols[order], word[order], len(at) - 1)

    def _ids(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters that are no piece become bytes."""
        strange = symbols >= self.n_pieces
        if not strange.any():
            return symbols.astype(np.int32), np.bincount(word, minlength=n)
        points, index = np.unique(np.where(symbols[strange] < self.n_symbols, self.point_of[np.minimum(symbols[strange], self.n_symbols - 1)], symbols[strange] - self.n_symbols), return_inverse=True)
        letters = Table([chr(p).encode("utf-8", "replace") for p in points.tolist()])
        size = np.ones(len(symbols), np.int64)
        size[strange] = letters.size[index]
        begin = np.arange(len(symbols))
        begin[strange] = len(symbols) + letters.begin[index]
        return gather(np.concatenate([symbols, self.byte_ids[letters.flat]]), begin, size).astype(np.int32), np.bincount(np.repeat(word, size), minlength=n)


def _merged(model: PieceModel, symbols: np.ndarray, place: np.ndarray, word: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, places and words once no pair is left. ``wide``: pairs are chosen by what is near, not by word."""
    bits = model.n_ranks.bit_length()
    end = place + model.length[np.minimum(symbols, model.n_symbols - 1)]
    birth = np.zeros(len(symbols), np.int64)
    key, merged = _keys(model, symbols, place, end, birth, np.arange(len(symbols) - 1), bits, wide)
    key, merged = np.append(key, _NONE), np.append(merged, 0)
    settled = []
    while True:
        # Symbols are final once their word has no pair, or none so near that what it becomes could reach them.
        active = _within(key < _NONE, model.longest) if wide else _in_open_words(key < _NONE, word)
        if not active.all():
            settled.append((symbols[~active], place[~active], word[~active]))
            symbols, place, word, end, birth, key, merged = (x[active] for x in (symbols, place, word, end, birth, key, merged))
        if not len(symbols):
            return tuple(np.concatenate(x) for x in zip(*settled, strict=True))
        chosen = np.flatnonzero(_nearest(key, model.longest) if wide else _first_of_word(key, word))
        if wide:
            # The time of a merge and its root: all but the lowest bits.
            birth[chosen] = key[chosen] >> bits
        symbols[chosen], end[chosen] = merged[chosen], end[chosen + 1]
        kept = np.ones(len(symbols), bool)
        kept[chosen + 1] = False
        key[chosen] = key[chosen + 1]
        at = (np.cumsum(kept) - 1)[chosen]
        symbols, place, word, end, birth, key, merged = (x[kept] for x in (symbols, place, word, end, birth, key, merged))
        changed = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
        changed = changed[changed < len(symbols) - 1]
        key[changed], merged[changed] = _keys(model, symbols, place, end, birth, changed, bits, wide)
        key[-1] = _NONE


def _keys(model: PieceModel, symbols: np.ndarray, place: np.ndarray, end: np.ndarray, birth: np.ndarray, at: np.ndarray, bits: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """When the pairs that begin at ``at`` are due, and what they become."""
    rank, merged = model.pairs(symbols[at], symbols[at + 1])
    rank[end[at] != place[at + 1]] = _NONE
    if not wide:
        return rank, merged
    # Time, root and rank in one number: (rank, own place, rank), unless a symbol was made later than that.
    due = np.maximum(np.where(rank < _NONE, (rank << (63 - 2 * bits)) | place[at], 0), np.maximum(birth[at], birth[at + 1]))
    return np.where(rank < _NONE, (due << bits) | np.where(rank < _NONE, rank, 0), _NONE), merged


def _first_of_word(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The first pair of each word that has the word's least key."""
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    least = np.minimum.reduceat(key, start)
    n = np.diff(np.append(start, len(key)))
    hits = np.flatnonzero((key == np.repeat(least, n)) & (key < _NONE))
    out = np.zeros(len(key), bool)
    out[hits[np.concatenate([[True], word[hits][1:] != word[hits][:-1]])] if len(hits) else hits] = True
    return out


def _in_open_words(open_: np.ndarray, word: np.ndarray) -> np.ndarray:
    """All symbols of words that have a pair."""
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
    return np.repeat(np.logical_or.reduceat(open_, start), np.diff(np.append(start, len(word)))) if len(word) else open_


def _within(open_: np.ndarray, reach: int) -> np.ndarray:
    """Symbols with a pair at ``reach`` symbols to either side, or nearer."""
    ahead = np.concatenate([[0], np.cumsum(open_)])
    i = np.arange(len(open_))
    return ahead[np.minimum(i + reach + 1, len(open_))] > ahead[np.maximum(i - reach - 1, 0)]


def _nearest(key: np.ndarray, reach: int) -> np.ndarray:
    """Pairs that are the best within ``reach`` pairs to either side, the left one of equals."""
    before = np.append(np.full(1, _NONE), key[:-1])
    after = np.append(key[1:], np.full(1, _NONE))
    width = 1
    while width < reach:
        step = min(width, reach - width)
        before[step:] = np.minimum(before[step:], before[:-step].copy())
        after[:-step] = np.minimum(after[:-step], after[step:].copy())
        width += step
    return (key < before) & (key <= after) & (key < _NONE)


_MODELS: dict[str, tuple[PieceModel, SpanIds]] = {}


def model(path: str) -> tuple[PieceModel, SpanIds]:
    """The model at ``path`` and its memory of words; loaded once for each worker."""
    if path not in _MODELS:
        found = PieceModel(path)
        _MODELS[path] = found, SpanIds(found.encode)
    return _MODELS[path]


def encoded(raw: np.ndarray, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a chunk, and where each text's ids begin (and the last end)."""
    found, memory = model(path)
    raw, at = spaced(*_plain(raw, at))
    start, end = spans(raw, at, found.cuts(raw))
    ids, count = memory.of(raw, start, end)
    ahead = np.concatenate([[0], np.cumsum(count)])
    return ids, ahead[np.searchsorted(start, at)]


def marks(raw: np.ndarray) -> np.ndarray:
    """Where the three bytes of ``SPACE`` begin."""
    a, b, c = SPACE.encode()
    return np.flatnonzero((raw[:-2] == a) & (raw[1:-1] == b) & (raw[2:] == c)) if len(raw) > 2 else np.empty(0, np.int64)


def _plain(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space for every ``SPACE``, as the library makes no difference between them."""
    found = marks(raw)
    if not len(found):
        return raw, at
    raw = raw.copy()
    raw[found] = 0x20
    kept = np.ones(len(raw), bool)
    kept[found + 1] = kept[found + 2] = False
    return raw[kept], np.concatenate([[0], np.cumsum(kept)])[at]


def decoded(ids: np.ndarray, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts of all lists of ids: their bytes, and where each begins (and the last ends).

    A leading space is dropped once; bytes that are no letter become U+FFFD each.
    """
    found, _ = model(path)
    raw, ends = found.bytes.joined(ids)
    out = ends[at]
    spoken = np.flatnonzero(~found.is_control[ids])
    first = spoken[np.minimum(np.searchsorted(spoken, at[:-1]), len(spoken) - 1)] if len(spoken) else at[:-1]
    lead = first[(first >= at[:-1]) & (first < at[1:])]
    lead = ends[lead[found.starts_spaced[ids[lead]]]]
    kept = np.ones(len(raw), bool)
    kept[lead] = False
    moved = np.concatenate([[0], np.cumsum(kept)])
    if found.is_byte[ids].any():
        return _letters(raw[kept], moved[out], moved[ends[:-1][found.is_control[ids]]])
    return raw[kept], moved[out]


def _letters(raw: np.ndarray, at: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes as letters; a letter lies within a row, and doesn't go on past a place of ``apart``."""
    edges = np.unique(np.concatenate([at, apart]))
    try:
        raw.tobytes().decode()
        if not ((raw[edges[edges < len(raw)]] & 0xC0) == 0x80).any():
            return raw, at
    except UnicodeDecodeError:
        pass
    parts = [_repaired(raw[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)[np.searchsorted(edges, at)]


def _repaired(row: bytes) -> bytes:
    out, at = [], 0
    while at < len(row):
        try:
            out.append(row[at:].decode().encode())
            break
        except UnicodeDecodeError as e:
            out += [row[at : at + e.start], "�".encode()]
            at += e.start + 1
    return b"".join(out)


def _column(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw.tobytes())) if at[-1] < 1 << 31 else pa.array([raw[a:b].tobytes().decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.large_string())


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                ids, at = encoded(*utf8(chunk.column(1)), path)
                yield pa.RecordBatch.from_arrays([chunk.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (a list of int) for each row of ``docs``, as the library encodes the whole text.

    Needs doc_id and text; other columns are ignored, whatever their names. A null or empty text has no ids. Rows that
    share a doc_id (null too) are rows of their own; an empty table gives an empty result. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path or default_vocabulary()), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), _column(*decoded(lists.flatten().to_numpy(zero_copy_only=False), at, path))], ["doc_id", "text"])

    return run


def decode(lists: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text for each row of ``lists`` (doc_id, ids), as the library decodes the ids; null is an empty list."""
    ship(lists.sparkSession)
    return lists.select("doc_id", "ids").mapInArrow(_decode(path or default_vocabulary()), "doc_id long, text string")


def _digests(path: str):
    found, _ = model(path)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                ids, at = encoded(*utf8(chunk.column(1)), path)
                decimal, ends = found.decimal.joined(ids)
                decimal, ends = decimal.tobytes(), ends[at]
                raw, text_at = decoded(ids, at, path)
                raw = raw.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0), pa.array(np.diff(at), pa.int64()), pa.array([sha(decimal[a : max(a, b - 1)]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()), pa.array([sha(raw[a:b]) for a, b in zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _digest_rows(path: str):
    return lambda batches: _digests(path)(batches)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 for each row of ``docs``.

    The ids of ``encode`` and the text of ``decode``, digested where they are made; rules for odd rows as for ``encode``.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digest_rows(path or default_vocabulary()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
