"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how often their ids do.

All texts of a chunk, each after a space, lie in one buffer. The ends of both tokenizers' tokens are counted there once
each by offset; where both have one, a group of tokens ends, and the two tokens that end there are linked. Prefix sums
over the buffer give each text's share.

Counts of linked ids over the corpus come back to the texts by blocks: a task numbers the id pairs of about
``BLOCK_BYTES`` of text and keeps its texts' links as such numbers. Only a row for each pair of a block is summed and
joined with the sums; then a block's texts and its pairs meet in one group. So no row for each link is ever made,
nothing is broadcast or collected, and a frequent pair has as many rows as there are blocks.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm import sentence_pieces
from quantspark.llm.pieces import SpanIds, Table, spaced, spans
from quantspark.llm.store import cut, discard, fresh_path, stored
from quantspark.llm.words import chunks, gather, utf8
from quantspark.session import ship

BLOCK_BYTES = 16 << 20
#: Text of one chunk: several arrays of numbers as long as it are held at once.
CHUNK_BYTES = 1 << 18

#: Last bytes of letters that may be white space, and first ones: next to these a text isn't parted.
_PLAIN_END = np.ones(256, bool)
_PLAIN_END[[*range(0x21), 0x7F, *range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
_PLAIN_START = np.ones(256, bool)
_PLAIN_START[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _letter_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible bytes are themselves, others follow 255."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteModel:
    """A byte-level BPE tokenizer file; its pattern never joins what stands on either side of a lone space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = _letter_bytes()
        entries = [b""] * self.tokenizer.get_vocab_size()
        for text, i in vocabulary.items():
            if all(c in letters for c in text):
                entries[i] = bytes(letters[c] for c in text)
        self.bytes = Table(entries)
        self.memory = SpanIds(self._encode)

    def _encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = raw.tobytes()
        words = [text[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        ids, count = [np.empty(0, np.int32)], np.zeros(len(words), np.int64)
        for k in range(0, len(words), 4_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + 4_000], add_special_tokens=False)]
            count[k : k + len(found)] = np.fromiter(map(len, found), np.int64, len(found))
            ids.append(np.fromiter((i for x in found for i in x), np.int32, int(count[k : k + len(found)].sum())))
        return np.concatenate(ids), count

    def ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin (and the last end)."""
        lone = np.zeros(len(raw), bool)
        if len(raw) > 2:
            lone[1:-1] = (raw[1:-1] == 0x20) & _PLAIN_END[raw[:-2]] & _PLAIN_START[raw[2:]]
        start, end = spans(raw, at, lone)
        ids, count = self.memory.of(raw, start, end)
        ahead = np.concatenate([[0], np.cumsum(count)])
        return ids, ahead[np.searchsorted(start, at)]


_MODELS: dict[str, ByteModel] = {}


def _byte_model(path: str) -> ByteModel:
    if path not in _MODELS:
        _MODELS[path] = ByteModel(path)
    return _MODELS[path]


def _faithful(ids: np.ndarray, at: np.ndarray, bytes_: Table, raw: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Whether each text's tokens join to its bytes."""
    size = np.diff(text_at)
    out = np.diff(np.concatenate([[0], np.cumsum(bytes_.size[ids])])[at]) == size
    if out.all():
        same, where = bytes_.joined(ids)[0] == raw, text_at
    else:
        tokens = gather(ids, at[:-1][out], np.diff(at)[out])
        same, where = bytes_.joined(tokens)[0] == gather(raw, text_at[:-1][out], size[out]), np.concatenate([[0], np.cumsum(np.where(out, size, 0))])
    right = np.concatenate([[0], np.cumsum(same)])[where]
    return out & (np.diff(right) == np.diff(where))


class Aligned:
    """The tokens of a chunk's texts and the groups that they share.

    ``a``/``b``: ids of all texts, ``a_at``/``b_at``: where each text's begin; ``a_group``/``b_group``: the group of
    each token, counted through the chunk; ``group_at``: where each text's groups begin; ``ends``: the byte offset at
    which each group ends in its text after a space; ``left``/``right``: the ids linked at the end of each group.
    """

    def __init__(self, column: pa.Array, a_path: str, b_path: str):
        raw, at = utf8(column)
        size = np.diff(at)
        # The library writes a space for its own mark, so texts with that mark can't be joined again.
        size[np.searchsorted(at, sentence_pieces.marks(raw), "right") - 1] = 0
        raw, at = gather(raw, at[:-1], size), np.concatenate([[0], np.cumsum(size)])
        a_model, (b_model, _) = _byte_model(a_path), sentence_pieces.model(b_path)
        text, text_at = spaced(raw, at)
        self.n_bytes = len(text)
        a, a_at = a_model.ids(text, text_at)
        b, b_at = sentence_pieces.encoded(raw, at, b_path)
        good = _faithful(a, a_at, a_model.bytes, text, text_at) & _faithful(b, b_at, b_model.bytes, text, text_at) & (size > 0)
        if not good[size > 0].all():
            a, b = gather(a, a_at[:-1][good], np.diff(a_at)[good]), gather(b, b_at[:-1][good], np.diff(b_at)[good])
            a_at, b_at, text_at = (np.concatenate([[0], np.cumsum(np.where(good, np.diff(x), 0))]) for x in (a_at, b_at, text_at))
        self.a, self.b, self.a_at, self.b_at = a, b, a_at, b_at
        a_end, b_end = np.cumsum(a_model.bytes.size[a]), np.cumsum(b_model.bytes.size[b])
        n = int(text_at[-1]) + 1
        both = (np.bincount(a_end, minlength=n) > 0) & (np.bincount(b_end, minlength=n) > 0)
        groups = np.concatenate([[0], np.cumsum(both)])
        self.a_group, self.b_group = groups[a_end], groups[b_end]
        self.group_at = groups[text_at + 1]
        self.group_at[0] = 0
        cuts = np.flatnonzero(both)
        self.ends = cuts - np.repeat(text_at[:-1], np.diff(self.group_at))
        self.left, self.right = a[both[a_end]], b[both[b_end]]

    def written(self) -> tuple[bytes, np.ndarray]:
        """All texts' groups as ``a1,a2|b1;a3|b2,b3``, and where each text's begins and (less the last sign) ends."""
        n = int(self.group_at[-1])
        a_before = np.concatenate([[0], np.cumsum(np.bincount(self.a_group, minlength=n))])
        b_before = np.concatenate([[0], np.cumsum(np.bincount(self.b_group, minlength=n))])
        a_place = np.arange(len(self.a)) + b_before[self.a_group]
        b_place = np.arange(len(self.b)) + a_before[self.b_group + 1]
        order, sign = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        order[a_place], order[b_place] = self.a, self.b
        sign[a_place[a_before[1:] - 1]] = ord("|")
        sign[b_place[b_before[1:] - 1]] = ord(";")
        raw, at = _decimals(int(order.max(initial=0)) + 1).joined(order)
        raw[at[1:] - 1] = sign
        return raw.tobytes(), at[self.a_at + self.b_at]

    def digests(self) -> list[str]:
        raw, at = self.written()
        return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_DECIMALS: list[Table] = []


def _decimals(n: int) -> Table:
    """Decimal numbers below ``n`` at least, each with a sign after it."""
    if not _DECIMALS or len(_DECIMALS[0].size) < n:
        _DECIMALS[:] = [Table([b"%d," % i for i in range(max(n, 1 << 16))])]
    return _DECIMALS[0]


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))


def _group_rows(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, most=CHUNK_BYTES):
                x = Aligned(chunk.column(1), a_path, b_path)
                groups = np.repeat(np.arange(len(x.a_at) - 1), np.diff(x.group_at))
                a_ends = np.cumsum(np.bincount(x.a_group, minlength=int(x.group_at[-1]))) - x.a_at[groups]
                b_ends = np.cumsum(np.bincount(x.b_group, minlength=int(x.group_at[-1]))) - x.b_at[groups]
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0), _lists(x.a, x.a_at), _lists(x.b, x.b_at), *(_lists(v, x.group_at) for v in (a_ends, b_ends, x.ends))], ["doc_id", "a", "b", "a_ends", "b_ends", "byte_ends"]
                )

    return run


def groups(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, ``a`` and ``b`` (ids), and for each group where it ends in ``a``, in ``b`` and in the bytes of space+text.

    Rules for odd rows as for ``alignment``; nothing is shuffled.
    """
    ship(docs.sparkSession)
    kinds = "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>, byte_ends array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_group_rows(*(vocabularies or default_vocabularies())), kinds)


_BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("place", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
_BLOCKS_DDL = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, place int, a int, b int, n long"
_RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _filled(schema: pa.Schema, columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


class _Pairs:
    """The id pairs of a block, numbered as they come."""

    def __init__(self):
        self.keys, self.numbers, self.counts = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def numbered(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, index, count = np.unique(left.astype(np.int64) << 32 | right.astype(np.int64), return_inverse=True, return_counts=True)
        place = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = len(self.counts) + np.arange(int((~known).sum()))
        self.keys, self.numbers = np.insert(self.keys, place[~known], keys[~known]), np.insert(self.numbers, place[~known], new)
        self.counts = np.append(self.counts, np.zeros(len(new), np.int64))
        numbers = self.numbers[np.searchsorted(self.keys, keys)]
        self.counts[numbers] += count
        return numbers[index]

    def rows(self, block: int) -> pa.RecordBatch:
        keys, n = self.keys[np.argsort(self.numbers)], len(self.keys)
        columns = {"block": np.full(n, block), "place": np.arange(n, dtype=np.int32), "a": (keys >> 32).astype(np.int32), "b": (keys & 0xFFFFFFFF).astype(np.int32), "n": self.counts}
        return _filled(_BLOCKS, {k: pa.array(v) for k, v in columns.items()}, n)


def _blocks(a_path: str, b_path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pairs, held = TaskContext.get().partitionId() << 32, _Pairs(), 0
        for batch in batches:
            for chunk in chunks(batch, most=CHUNK_BYTES):
                x = Aligned(chunk.column(1), a_path, b_path)
                n = chunk.num_rows
                columns = {
                    "block": pa.array(np.full(n, block)), "doc_id": chunk.column(0), "n_a": pa.array(np.diff(x.a_at)), "n_b": pa.array(np.diff(x.b_at)), "n_groups": pa.array(np.diff(x.group_at)),
                    "groups_sha256": pa.array(x.digests(), pa.string()), "links": _packed(pairs.numbered(x.left, x.right), x.group_at, len(pairs.counts)),
                }
                yield _filled(_BLOCKS, columns, n)
                held += x.n_bytes
                if held >= block_bytes:
                    yield pairs.rows(block)
                    block, pairs, held = block + 1, _Pairs(), 0
        yield pairs.rows(block)

    return run


def _packed(numbers: np.ndarray, at: np.ndarray, known: int) -> pa.Array:
    """Each text's pair numbers as bytes: two for a number while a block knows few enough pairs, else four."""
    kind = np.dtype("<u2" if known <= 1 << 16 else "<u4")
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * kind.itemsize).astype(np.int32)), pa.py_buffer(numbers.astype(kind).tobytes())])


def _unpacked(links: pa.Array, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts, and where each text's begin; a text's width follows from its ``count`` of numbers."""
    raw, ends = utf8(links)
    size, at = np.diff(ends), np.concatenate([[0], np.cumsum(count)])
    out, owner = np.empty(int(at[-1]), np.int64), np.repeat(size > 2 * count, count)
    for wide, kind in ((False, "<u2"), (True, "<u4")):
        rows = (size > 2 * count) == wide
        out[owner == wide] = gather(raw, ends[:-1][rows], size[rows]).view(kind)
    return out, at


def _counted(key: tuple[pa.Scalar, ...], docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's texts with the corpus-wide counts of its pairs."""
    place = pairs["place"].to_numpy()
    total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    total[place], best[place] = pairs["total"].to_numpy(), pairs["best"].to_numpy()
    numbers, at = _unpacked(docs["links"].combine_chunks(), docs["n_groups"].to_numpy())
    sums = [np.diff(np.concatenate([[0], np.cumsum(v[numbers])])[at]) for v in (best, total)]
    return pa.Table.from_arrays([*(docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups")), pa.array(np.diff(at)), *map(pa.array, sums), docs["groups_sha256"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, total (how many links of the corpus hold the pair) and best (1 if no other a has more with this b, else 0)."""
    totals = cut(pairs.groupBy("a", "b").agg(F.sum("n").alias("total")))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).cast("int").alias("best"))


def alignment(docs: DataFrame, vocabularies: tuple[str, str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of ``docs``.

    ``vocabularies``: a byte-level BPE file, read as space+text, and a SentencePiece model, which adds the space itself.
    Needs doc_id and text; other columns are ignored, whatever their names. Null and empty texts, and those that don't
    come back from the tokens of either (U+2581 in the text), have no tokens: zeros and an empty groups_sha256. Rows
    that share a doc_id (null too) are rows of their own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    path = fresh_path(spark, "alignment")
    stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks(*(vocabularies or default_vocabularies()), block_bytes), _BLOCKS_DDL), path)
    rows = lambda: spark.read.schema(_BLOCKS_DDL).parquet(path)
    pairs = rows().where("place IS NOT NULL").select("block", "place", "a", "b", "n")
    counted = pairs.join(pair_counts(pairs), ["a", "b"]).select("block", "place", "total", "best")
    texts = rows().where("place IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    result = cut(texts.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_counted, _RESULT_DDL))
    discard(spark, path)
    return result
