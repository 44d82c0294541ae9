"""Near-duplicate groups: BagMinHash signatures of word shingles, banding, and verified multiset overlap.

Two documents are linked when the weighted Jaccard similarity of their bags of ``SIZE``-word shingles is at least
``NUMERATOR / DENOMINATOR``, decided in whole numbers on their full texts. A group is a connected component of links.

* Equal word sequences are one node from the start (combined before any shuffle), so copies never meet in a bucket.
* Signatures are banded. With 28 bands of 5 places, two bags of similarity 0.8 share a bucket with probability
  0.99998, and all that share one are compared unless they are connected already.
* A bucket is never expanded into all its pairs. First the smallest member (hub) of each bucket of a few bands is
  compared with the others, then, with what this connects as components, the hubs of all bands with members of other
  components; so a bucket of n near copies costs about n comparisons, however many bands they share. What is still in
  several components is compared in full, so that no candidate pair is left out: buckets of up to ``SMALL`` members as
  pairs, larger ones in blocks: first narrow rows, ``NARROW`` at a time, which tell who can have a partner in another
  component at all, then the texts of these, ``BLOCK`` at a time, whose overlaps are one matrix product and whose rows
  are links.
* Pairs are listed only if their lengths and ``BITS`` one-bit hashes allow the threshold; a pair at the threshold
  fails this once in 10**8. Sharing a passage isn't enough, however many texts share it.
* Texts are shuffled once, for nodes that share a bucket only after a narrow join, and kept for all rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.bagminhash import bags, signatures
from quantspark.llm.store import cut, discard, fresh_path, stored
from quantspark.llm.words import BASE, BASE2, Words, chunks, mix, prefix, ranges, shingles
from quantspark.session import ship

SIZE = 5
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 28, 5
SMALL, BLOCK, NARROW = 16, 256, 2048
#: The first round looks at so many bands alone; what they connect needs no pairs in the others.
FIRST_BANDS = 3

#: Places of a signature of which one bit each is kept for a bound on similarity, and how many standard deviations
#: below its expectation a pair at the threshold may lie (one in 10**8 lies lower).
BITS, SIGMAS = 128, 5.6

_SKETCH = "doc_id long, text_hash long, content long, content2 long, n_shingles long, bands array<long>, bits long, bits2 long"


def _sketches(size: int, bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column(2))
                hashes = words.hashes()
                keys, owner = shingles(words, size, hashes)
                n = np.bincount(owner, minlength=words.n_docs)
                names = signatures(*bags(keys, owner), words.n_docs, m).reshape(-1, bands, rows)
                bits = _bits(names.reshape(-1, m))
                band = np.broadcast_to(np.arange(bands, dtype=np.uint64), names.shape[:2])
                for k in range(rows):
                    band = mix(band ^ names[:, :, k])
                band = band.reshape(-1)
                content = [ranges(*prefix(hashes, base), words.first[:-1], words.first[1:]).view(np.int64) for base in (BASE, BASE2)]
                has = np.repeat(n > 0, bands)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[has].view(np.int64)))
                columns = [part.column(0), part.column(1), pa.array(content[0]), pa.array(content[1]), pa.array(n, pa.int64()), lists, pa.array(bits[:, 0]), pa.array(bits[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "content", "content2", "n_shingles", "bands", "bits", "bits2"])

    return run


def _bits(names: np.ndarray) -> np.ndarray:
    """The lowest bit of up to BITS places of each signature, as two numbers."""
    low = np.zeros((len(names), BITS), np.uint8)
    low[:, : min(BITS, names.shape[1])] = (names[:, :BITS] & np.uint64(1)).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(low, axis=1)).view(np.int64).reshape(len(names), 2)


def most_differing_bits(m: int, similarity: float) -> int:
    """The most bits in which signatures of a pair at the threshold differ; other places differ in half of their bits."""
    n, p = min(BITS, m), (1 - similarity) / 2
    return int(np.ceil(n * p + SIGMAS * np.sqrt(n * p * (1 - p))))


def overlap(left: pa.Array, right: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts the size of the intersection and of the union of their bags of shingles."""
    keys, owner, side = [], [], []
    for k, column in enumerate((left, right)):
        found, row = shingles(Words(column), size)
        keys.append(found ^ mix(row.astype(np.uint64)))
        owner.append(row)
        side.append(np.full(len(row), k))
    keys, owner, side = map(np.concatenate, (keys, owner, side))
    _, at, index = np.unique(keys, return_index=True, return_inverse=True)
    a = np.bincount(index[side == 0], minlength=len(at))
    b = np.bincount(index[side == 1], minlength=len(at))
    both = np.bincount(owner[at], np.minimum(a, b), len(left)).astype(np.int64)
    either = np.bincount(owner[at], np.maximum(a, b), len(left)).astype(np.int64)
    return both, either


def _verify(size: int, numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_b"):
                both, either = overlap(part.column(2), part.column(3), size)
                ok = pa.array(both * denominator >= either * numerator)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links connect each node with; only for nodes that have a link.

    Labels spread to neighbours and then jump to the label of their label, so long chains halve in every step. Each
    step is two joins and a partial aggregate over links, which are cut from their lineage once.
    """
    both = cut(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy("node").agg(F.min(F.least("node", "other")).alias("component")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other", "component": "near"}), "other").groupBy("node").agg(F.min("near").alias("near"))
        spread = cut(labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before")))
        if spread.where("component < before").isEmpty():
            return labels
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = cut(spread.join(jump, "component").select("node", F.least("component", "further").alias("component")))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` after more links; only what the links touch is labelled anew, as a graph of components."""
    if labels is None:
        return components(links)
    for side in ("a", "b"):
        known = labels.withColumnsRenamed({"node": side, "component": f"{side}_component"})
        links = links.join(known, side, "left").withColumn(side, F.coalesce(f"{side}_component", side)).drop(f"{side}_component")
    merged = components(cut(links.where("a <> b")))
    renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("further"))
    old = labels.join(renamed, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    return cut(old.unionByName(merged.join(labels, "node", "left_anti")))


def _hubs(members: DataFrame, after: int, upto: int) -> DataFrame:
    """The members of each bucket from place ``after`` to ``upto`` in the order of nodes.

    One hub is a partial aggregate, whatever a bucket's size; more are asked of small buckets alone.
    """
    fields = ["node", "n", "bits", "bits2", "component"]
    if (after, upto) == (0, 1):
        found = members.groupBy("bucket").agg(F.min_by(F.struct(*fields), "node").alias("hub")).select("bucket", "hub.*")
    else:
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("node"))
        found = members.withColumn("place", place).where((F.col("place") > after) & (F.col("place") <= upto)).select("bucket", *fields)
    named = {f: f"hub_{f}" for f in fields if f != "node"} | {"node": "hub"}
    # Cut, so that both sides of the join with members are shuffled for it and a large bucket can be split.
    return cut(found.withColumnsRenamed(named))


def _links(docs: DataFrame, nodes: DataFrame, size: int, numerator: int, denominator: int, most_bits: int) -> DataFrame | None:
    """(node, component) for all nodes that verified links connect with others; None when there are none."""
    spark = docs.sparkSession
    exploded = nodes.select("node", "n_shingles", "bits", "bits2", F.posexplode("bands").alias("band", "bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    members = cut(exploded.join(shared, "bucket").select("bucket", "node", F.col("n_shingles").alias("n"), "bits", "bits2", "band"))
    if members.isEmpty():
        return None
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node")
    keyed = docs.select(F.col("doc_id").alias("d"), F.xxhash64("doc_id", "text").alias("h"), "text")
    path = fresh_path(spark, "near-texts")
    found = wanted.join(keyed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    stored(found.select("node", "text"), path)
    texts = spark.read.schema("node long, text string").parquet(path).dropDuplicates(["node"]) if _repeats(wanted, path) else spark.read.schema("node long, text string").parquet(path)
    def compare(live: DataFrame, used: int, upto: int, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Verified links, and all pairs that were compared, of hubs from place ``used`` to ``upto``."""
        hubs = _hubs(live, used, upto)
        differing = F.bit_count(F.col("bits").bitwiseXOR(F.col("hub_bits"))) + F.bit_count(F.col("bits2").bitwiseXOR(F.col("hub_bits2")))
        close = (F.least("n", "hub_n") * denominator >= F.greatest("n", "hub_n") * numerator) & (differing <= most_bits)
        apart = (F.col("node") > F.col("hub")) & (F.col("component") != F.col("hub_component"))
        pairs = live.alias("x").join(hubs.alias("h"), (F.col("x.bucket") == F.col("h.bucket")) & apart & close).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        new = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify(size, numerator, denominator), "a long, b long")
        return cut(new), pairs if tried is None else tried.union(pairs)

    def current(labels: DataFrame | None) -> DataFrame:
        """Members with their components, of buckets with more than one, and the bucket's size."""
        if labels is None:
            found = members.withColumn("component", F.col("node"))
        else:
            found = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = found.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
        return found.join(mixed.where("low <> high").select("bucket", "size"), "bucket")

    few = members.where(F.col("band") < FIRST_BANDS).withColumn("component", F.col("node"))
    links, tried = compare(few, 0, 1, None)
    labels = None if links.isEmpty() else _joined(None, links)
    links, tried = compare(cut(current(labels)), 0, 1, tried)
    labels = labels if links.isEmpty() else _joined(labels, links)
    live = cut(current(labels).where("size > 2"))
    small, _ = compare(live.where(F.col("size") <= SMALL), 1, SMALL, tried)
    large = _block_links(live.where(F.col("size") > SMALL), texts, size, numerator, denominator, most_bits)
    links = small.unionByName(large)
    labels = labels if links.isEmpty() else _joined(labels, links)
    discard(spark, path)
    return labels


def _cells(members: DataFrame, block: int, fields: list[str]) -> DataFrame:
    """Members dealt into blocks of about ``block``, once for each pair of blocks (low, high) that their own is in."""
    dealt = members.withColumn("n_blocks", F.ceil(F.col("size") / block).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    return dealt.withColumn("other", other).select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *fields)


def _block_links(live: DataFrame, texts: DataFrame, size: int, numerator: int, denominator: int, most_bits: int) -> DataFrame:
    """(a, b) links of large buckets: all members of different components compared, block by block.

    Lengths and one-bit hashes first: a member that no other component's member comes near in them needs no text. A
    task then holds the texts of two blocks and counts all overlaps at once as a product of incidence matrices. Of the
    links it finds, those of a spanning forest are rows.
    """
    narrow = _cells(live, NARROW, ["node", "component", "n", "bits", "bits2"])
    some = narrow.groupBy("bucket", "low", "high").applyInArrow(_with_partners(numerator, denominator, most_bits), "bucket long, node long, component long").distinct()
    some = cut(some)
    sizes = some.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    cells = _cells(some.join(sizes, "bucket"), BLOCK, ["node", "component"]).join(texts, "node")
    return cut(cells.groupBy("bucket", "low", "high").applyInArrow(_verify_block(size, numerator, denominator), "a long, b long"))


def _with_partners(numerator: int, denominator: int, most_bits: int, rows_at_once: int = 256):
    """Of a cell's members those with a partner in another component that lengths and bits allow."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        n, component = column("n"), column("component")
        bits = [column(name).view(np.uint64) for name in ("bits", "bits2")]
        found = np.zeros(len(n), bool)
        for k in range(0, len(n), rows_at_once):
            own = slice(k, k + rows_at_once)
            near = component[own, None] != component[None, :]
            near &= np.minimum(n[own, None], n[None, :]) * denominator >= np.maximum(n[own, None], n[None, :]) * numerator
            near &= sum(np.bitwise_count(b[own, None] ^ b[None, :]).astype(np.int64) for b in bits) <= most_bits
            found[own] |= near.any(1)
        return table.select(["bucket", "node", "component"]).filter(pa.array(found))

    return run


def _verify_block(size: int, numerator: int, denominator: int):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        component = table.column("component").to_numpy()
        both, total = _block_overlaps(table.column("text").combine_chunks(), size)
        either = total[:, None] + total[None, :] - both
        a, b = np.nonzero(np.triu(both * denominator >= either * numerator, 1) & (component[:, None] != component[None, :]))
        owner = {int(c): int(c) for c in component}

        def root(x: int) -> int:
            while owner[x] != x:
                owner[x] = owner[owner[x]]
                x = owner[x]
            return x

        kept = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(int(component[i])), root(int(component[j]))
            if x != y:
                owner[max(x, y)] = min(x, y)
                kept.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
        return pa.table({"a": pa.array([k[0] for k in kept], pa.int64()), "b": pa.array([k[1] for k in kept], pa.int64())})

    return run


def _block_overlaps(column: pa.Array, size: int, columns_at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections of all pairs of bags of shingles, and the size of each bag.

    The n-th copy of a shingle is an element of its own, so that a bag is a set; elements of one bag alone count for
    its size only. The incidence matrix is multiplied a few columns at a time.
    """
    n = len(column)
    keys, owner = shingles(Words(column), size)
    total = np.bincount(owner, minlength=n).astype(np.int64)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))
    start = np.flatnonzero(first)
    copy = np.arange(len(keys)) - np.repeat(start, np.diff(np.append(start, len(keys))))
    distinct, index, count = np.unique(mix(keys ^ mix(copy.astype(np.uint64))), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[index]
    owner, at = owner[keep], place[index[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((n, n), np.float64)
    for low in range(0, int(shared.sum()), columns_at_once):
        a, b = np.searchsorted(at, [low, low + columns_at_once])
        part = np.zeros((n, columns_at_once), np.float32)
        part[owner[a:b], at[a:b] - low] = 1
        both += part @ part.T
    return np.rint(both).astype(np.int64), total


def _repeats(wanted: DataFrame, path: str) -> bool:
    """Whether rows with equal doc_id and equal text gave a node's text more than once."""
    return wanted.sparkSession.read.parquet(path).select("node").count() > wanted.count()


def near_groups(docs: DataFrame, size: int = SIZE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, bands: int = BANDS, rows: int = ROWS, bit_filter: bool = True) -> DataFrame:
    """For each document row doc_id, text_hash, n_shingles, class_id and kept (one row of each class).

    Needs doc_id and text; other columns are ignored. class_id is the smallest doc_id of the class, nulls last. Null
    and blank texts have no shingles and form one class (their word sequences are equal); a text of fewer than
    ``size`` words is one shingle. Rows that share a doc_id are told apart by their texts. An empty table gives an
    empty result. Without ``bit_filter`` no candidate pair is left out for its one-bit hashes.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("text_hash"), "text")
    sketches = cut(keyed.mapInArrow(_sketches(size, bands, rows), _SKETCH)).withColumn("row", F.monotonically_increasing_id())
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row")
    nodes = sketches.groupBy("content", "content2").agg(F.min(order).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("bits2").alias("bits2"))
    nodes = nodes.select("content", "content2", "n_shingles", "bands", "bits", "bits2", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), F.col("first.row").alias("node"))
    nodes = cut(nodes)
    most_bits = most_differing_bits(bands * rows, numerator / denominator) if bit_filter else BITS
    labels = _links(docs, nodes, size, numerator, denominator, most_bits)
    named = nodes.select("content", "content2", "node", F.col("doc_id").alias("first_id"))
    if labels is None:
        named = named.select("content", "content2", F.col("first_id").alias("class_id"), F.col("node").alias("keep_row"))
    else:
        joined = cut(named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
        best = F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "node")).alias("best")
        classes = cut(joined.groupBy("component").agg(best).select("component", F.col("best.first_id").alias("class_id"), F.col("best.node").alias("keep_row")))
        named = joined.join(classes, "component").select("content", "content2", "class_id", "keep_row")
    out = sketches.drop("bands", "bits", "bits2").join(cut(named), ["content", "content2"])
    return out.select("doc_id", "text_hash", "n_shingles", "class_id", (F.col("row") == F.col("keep_row")).alias("kept"))


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with its columns as they were.

    Null doc_ids come last; null and blank texts are one class; of rows with equal doc_id and equal text one stays; an
    empty table gives an empty result. Columns of any name are kept.
    """
    stay = cut(near_groups(docs, **options).where("kept").select("doc_id", "text_hash"))
    doc_id = F.col("doc_id").cast("long")
    # The row as one struct, so that no column of it clashes with the keys.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), doc_id.alias("id"), F.xxhash64(doc_id, "text").alias("hash"))
    joined = packed.join(stay.distinct(), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_semi")
    if not joined.groupBy("id", "hash").count().where("count > 1").isEmpty():
        joined = joined.dropDuplicates(["id", "hash"])
    return joined.select("doc.*")
