"""A Merkle manifest of a dataset: one tree for each group of leaves, one over the groups' roots, and proofs for all leaves.

Leaves are numbered within their group by a range partitioning and prefix counts of its partitions. Nodes then combine
as events: a node is given to its parent; a parent that holds as many children as its place in a tree of that size
demands (``arity``, or fewer at the end of a level) is hashed at once and given to its own parent. What stays open in a
task, as its other children lie elsewhere, and what has risen ``height`` levels leaves as the frontier. The frontier
is shuffled by the ancestor that its nodes have ``height`` levels up, and the same is done again, until each group has
one node. So no task ever holds more than the nodes below one such ancestor: the first round sends about one row for
each ``arity ** height`` leaves and a few for each partition.

Each round keeps reverse links: from a node that came in to the node of the frontier that it is part of, with the
siblings on the way. Followed from the roots down they give the proofs; those of leaves are made by combining a
partition's leaves once more, so nothing of the size of all proofs is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.store import cut
from quantspark.llm.words import gather, utf8
from quantspark.session import ship

ARITY = 2
#: Nodes below an ancestor that one task may hold.
BLOCK = 4096
#: Frontier rows, and runs of a group in a partition, up to which they are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 8_000
_HEX = 64

_STEP = "struct<before:string,after:string>"
_STEP_ARROW = pa.struct([("before", pa.string()), ("after", pa.string())])


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value (integers decimal)."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values' fields, one after another."""
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that ``digest`` leads to over the siblings of ``proof``."""
    return F.aggregate(proof, digest, lambda acc, step: F.sha2(F.concat(step["before"], acc, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Hash of the siblings of ``proof``, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _numbered(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """``rows`` sorted by ``group`` (nulls first) and ``order``, with ``index`` within its group and ``n``, its size.

    The result's partitions are ranges of the order, and rows lie sorted in them. Equal rows get different indexes.
    """
    names = rows.columns
    # Kept before ranges are sampled, so that rows are made once, and numbered, so that equal rows can be parted.
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    keys = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order + ["__row"]]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row").withColumn("__place", F.monotonically_increasing_id()))
    run = F.shiftright("__place", 33)
    by = [F.col(group)] if group else [F.lit(0)]
    runs = placed.groupBy(*(c.alias("__group") for c in by), run.alias("__part")).agg(F.count(F.lit(1)).alias("__size"), F.min("__place").alias("__first"))
    # A row for each group and partition that it has rows in: at most as many for a group as there are partitions.
    whole = Window.partitionBy("__group")
    before = F.coalesce(F.sum("__size").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("__group", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__size").over(whole).alias("n")))
    right = F.broadcast(runs) if runs.count() <= MAX_BROADCAST else runs
    joined = placed.join(right, by[0].eqNullSafe(F.col("__group")) & (run == F.col("__part")))
    numbered = joined.select(*names, (F.col("__place") + F.col("__shift")).alias("index"), "n")
    if right is not runs:
        # A broadcast leaves rows where they are.
        return numbered
    keys = [*([F.col(group).asc_nulls_first()] if group else []), "index"]
    return cut(numbered.repartitionByRange(*keys).sortWithinPartitions(*keys))


class _Forest:
    """Nodes of several trees and all parents that they complete below ``cap``.

    ``tree`` numbers trees, ``n`` is the leaves of each node's tree; level, index and digest (64 bytes) are the node's own.
    """

    def __init__(self, tree: np.ndarray, n: np.ndarray, level: np.ndarray, index: np.ndarray, digest: np.ndarray, arity: int, cap: int):
        self.n_given = len(tree)
        self.tree, self.n, self.level, self.index, self.digest = tree, n, level, index, digest
        self.up = np.full(len(tree), -1)
        # Where a node and its siblings lie in the buffer of digests.
        self.place, self.run_start, self.run_end = (np.zeros(len(tree), np.int64) for _ in range(3))
        flat, used, at = [], 0, int(level.min()) if len(level) else cap
        while at < cap and (self.level >= at).any():
            here = np.flatnonzero(self.level == at)
            here = here[np.lexsort((self.index[here], self.tree[here]))]
            if len(here):
                used += self._rise(here, at, used, arity, flat)
            at += 1
        self.flat = np.concatenate(flat) if flat else np.empty(0, np.uint8)

    def _rise(self, here: np.ndarray, at: int, used: int, arity: int, flat: list[np.ndarray]) -> int:
        size = self.n[here]
        for _ in range(at):
            size = -(-size // arity)
        parent, tree = self.index[here] // arity, self.tree[here]
        start = np.flatnonzero(np.concatenate([[True], (parent[1:] != parent[:-1]) | (tree[1:] != tree[:-1])]))
        have = np.diff(np.append(start, len(here)))
        full = (have == np.minimum(arity, size[start] - parent[start] * arity)) & (size[start] > 1)
        self.place[here] = used + np.arange(len(here))
        self.run_start[here], self.run_end[here] = used + np.repeat(start, have), used + np.repeat(start + have, have)
        digests = self.digest[here]
        flat.append(np.frombuffer(digests.tobytes(), np.uint8))
        text = digests.tobytes()
        sha = hashlib.sha256
        made = [sha(text[a * _HEX : (a + k) * _HEX]).hexdigest().encode() for a, k in zip(start[full].tolist(), have[full].tolist(), strict=True)]
        # Nodes that have come so far, then their parents.
        number = np.full(len(start), -1)
        number[full] = len(self.up) + np.arange(len(made))
        self.up[here] = np.repeat(number, have)
        first = here[start[full]]
        self.tree, self.n = np.append(self.tree, self.tree[first]), np.append(self.n, self.n[first])
        self.level, self.index = np.append(self.level, np.full(len(made), at + 1)), np.append(self.index, parent[start[full]])
        self.digest = np.append(self.digest, np.array(made, f"S{_HEX}")) if made else self.digest
        self.up = np.append(self.up, np.full(len(made), -1))
        self.place, self.run_start, self.run_end = (np.append(x, np.zeros(len(made), np.int64)) for x in (self.place, self.run_start, self.run_end))
        return len(here)

    def open(self) -> np.ndarray:
        """Nodes without a parent here."""
        return np.flatnonzero(self.up < 0)

    def links(self) -> tuple[np.ndarray, pa.Array]:
        """For each node that was given: the open node above it (or itself), and the siblings on the way."""
        at, owners, places, starts, ends = np.arange(self.n_given), [], [], [], []
        while True:
            rising = np.flatnonzero(self.up[at] >= 0)
            if not len(rising):
                break
            owners.append(rising)
            for out, value in ((places, self.place), (starts, self.run_start), (ends, self.run_end)):
                out.append(value[at[rising]])
            at[rising] = self.up[at[rising]]
        owner, place, start, end = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (owners, places, starts, ends))
        order = np.argsort(owner, kind="stable")
        place, start, end = place[order], start[order], end[order]
        steps = pa.StructArray.from_arrays([_strings(self.flat, start, place), _strings(self.flat, place + 1, end)], fields=list(_STEP_ARROW))
        count = np.bincount(owner, minlength=self.n_given)
        return at, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), steps)


def _strings(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = (end - start) * _HEX
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(gather(flat, start * _HEX, size).tobytes()))


def _height(arity: int) -> int:
    height = 1
    while arity ** (height + 1) <= BLOCK:
        height += 1
    return height


def _fixed(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw, at = utf8(column)
    if (np.diff(at) != _HEX).any():
        raise ValueError("digests must be 64 hexadecimal letters")
    return raw.view(f"S{_HEX}")


def _text(digests: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(digests), pa.py_buffer((np.arange(len(digests) + 1) * _HEX).astype(np.int32)), pa.py_buffer(digests.tobytes()))


def _tree_numbers(column: pa.Array) -> np.ndarray:
    codes = column.dictionary_encode(null_encoding="encode").indices
    return codes.to_numpy(zero_copy_only=False).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], group: int, index: int, height_size: int) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a block of leaves ends, or with the partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(index).to_numpy() // height_size
        trees = _tree_numbers(batch.column(group))
        ends = np.flatnonzero((block[1:] != block[:-1]) | (trees[1:] != trees[:-1])) + 1
        cut_at = int(ends[-1]) if len(ends) else 0
        if held and cut_at == 0:
            last = held[-1].slice(held[-1].num_rows - 1)
            same = last.column(index)[0].as_py() // height_size == int(block[0]) and last.column(group)[0].as_py() == batch.column(group)[0].as_py()
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        if cut_at:
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held = []
        held.append(batch.slice(cut_at))
    if held:
        yield pa.Table.from_batches(held)


def _forest_of(table: pa.Table, arity: int, cap: int) -> _Forest:
    level = table["level"].to_numpy() if "level" in table.column_names else np.zeros(len(table), np.int64)
    return _Forest(_tree_numbers(table["group"].combine_chunks()), table["n"].to_numpy(), level.astype(np.int64), table["index"].to_numpy(), _fixed(table["digest"]), arity, cap)


def _take(column: pa.ChunkedArray, forest: _Forest, nodes: np.ndarray) -> pa.Array:
    """The group names of ``nodes``: those of any given node of the same tree."""
    trees, first = np.unique(forest.tree[: forest.n_given], return_index=True)
    return column.combine_chunks().take(pa.array(first[np.searchsorted(trees, forest.tree[nodes])]))


def _frontier(arity: int, height: int):
    """Leaves of a partition combined; the open nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pieces(batches, 0, 1, arity**height):
            forest = _forest_of(table, arity, height)
            nodes = forest.open()
            yield pa.RecordBatch.from_arrays(
                [_take(table["group"], forest, nodes), pa.array(forest.n[nodes]), pa.array(forest.level[nodes]), pa.array(forest.index[nodes]), _text(forest.digest[nodes])], ["group", "n", "level", "index", "digest"]
            )

    return run


_NODE_DDL = "group string, n long, level long, index long, digest string"


def _linked(table: pa.Table, arity: int, cap: int) -> tuple[_Forest, np.ndarray, pa.Array]:
    forest = _forest_of(table, arity, cap)
    return forest, *forest.links()


def _round(arity: int, cap: int):
    """Open nodes below one ancestor combined: a link for each, and the nodes that are then open (without links)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        forest, above, steps = _linked(table, arity, cap)
        nodes = forest.open()
        n = len(nodes)
        given = {"group": table["group"].combine_chunks(), "n": forest.n[: forest.n_given], "level": forest.level[: forest.n_given], "index": forest.index[: forest.n_given], "digest": pa.nulls(forest.n_given, pa.string()), "above_level": forest.level[above], "above_index": forest.index[above], "steps": steps}
        left = {"group": _take(table["group"], forest, nodes), "n": forest.n[nodes], "level": forest.level[nodes], "index": forest.index[nodes], "digest": _text(forest.digest[nodes]), "above_level": pa.nulls(n, pa.int64()), "above_index": pa.nulls(n, pa.int64()), "steps": pa.nulls(n, pa.list_(_STEP_ARROW))}
        return pa.concat_tables([pa.table(x) for x in (given, left)])

    return run


_ROUND_DDL = f"group string, n long, level long, index long, digest string, above_level long, above_index long, steps array<{_STEP}>"


def _proofs(arity: int, height: int):
    """Leaves of a partition with the open node above each and the siblings up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pieces(batches, 0, 1, arity**height):
            forest, above, steps = _linked(table, arity, height)
            out = table.append_column("above_level", pa.array(forest.level[above])).append_column("above_index", pa.array(forest.index[above])).append_column("steps", steps)
            yield from out.combine_chunks().to_batches()

    return run


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["group"].eqNullSafe(right["__g"]) & (left["above_level"] == right["__l"]) & (left["above_index"] == right["__i"])


def _grown_proofs(links: DataFrame, above: DataFrame, few: bool) -> DataFrame:
    """``links`` with the proofs of the nodes above them appended to their own, and the root."""
    right = above.select(F.col("group").alias("__g"), F.col("level").alias("__l"), F.col("index").alias("__i"), F.col("proof").alias("__p"), "root")
    joined = links.join(F.broadcast(right) if few else right, _same(links, right))
    return joined.withColumn("proof", F.concat("steps", "__p")).drop("__g", "__l", "__i", "__p", "steps", "above_level", "above_index")


def _combined(leaves: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """Sorted ``leaves`` (group, index, n, digest, kept) with ``proof`` and ``root`` of their tree; group and root of all trees."""
    height = _height(arity)
    nodes = cut(leaves.select("group", "index", "n", "digest").mapInArrow(_frontier(arity, height), _NODE_DDL))
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds, cap = [], height
    while True:
        cap += height
        ancestor = F.expr(f"index DIV CAST(pow({arity}, {cap} - level) AS BIGINT)")
        linked = cut(nodes.groupBy("group", ancestor.alias("__ancestor")).applyInArrow(_round(arity, cap), _ROUND_DDL))
        rounds.append(linked.where("digest IS NULL"))
        nodes = linked.where("digest IS NOT NULL").select("group", "n", "level", "index", "digest")
        if arity**cap >= most:
            break
    roots = nodes.select("group", F.col("digest").alias("root"))
    above = nodes.select("group", "level", "index", F.from_json(F.lit("[]"), f"array<{_STEP}>").alias("proof"), F.col("digest").alias("root"))
    for linked in reversed(rounds):
        above = cut(_grown_proofs(linked.select("group", "level", "index", "above_level", "above_index", "steps"), above, False))
    names = [f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema]
    own = leaves.mapInArrow(_proofs(arity, height), ", ".join([*names, "above_level long", "above_index long", f"steps array<{_STEP}>"]))
    return _grown_proofs(own, above, above.count() <= MAX_BROADCAST), roots


def manifest(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``proof``: the siblings on the way from the leaf to ``root``.

    ``leaves`` has ``group`` (string), ``key`` (of any type with an order), ``digest`` (lowercase hex sha256) and a struct
    ``kept``, which is passed on. Leaves ascend by key within their group, nulls first, equal keys by digest; equal rows
    are leaves of their own. A level's nodes are parted into runs of ``arity``; the last may be shorter, and a lone node
    is hashed as well. Groups' roots are ordered by group, null first and then by bytes, and combined in the same way. A
    step of ``proof`` is what stands before the node in its run and what stands after it. An empty table gives no rows.
    """
    ship(leaves.sparkSession)
    ranked = _numbered(leaves.select("group", "key", "digest", "kept"), "group", ["key", "digest"])
    within, roots = _combined(ranked.select("group", "index", "n", "digest", "kept"), arity)
    ordered = _numbered(roots, None, ["group"])
    ordered = ordered.select(F.lit(None).cast("string").alias("group"), "index", "n", F.col("root").alias("digest"), F.struct("group").alias("kept"))
    tops = cut(_combined(ordered, arity)[0].select(F.col("kept.group").alias("__name"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("__top")))
    right = F.broadcast(tops) if tops.count() <= MAX_BROADCAST else tops
    joined = within.drop("root").join(right, F.col("group").eqNullSafe(F.col("__name")))
    return joined.select("group", "digest", "kept", "subroot", "root", F.concat("proof", "__top").alias("proof"))
