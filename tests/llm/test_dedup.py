"""Substring, exact and near deduplication against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantspark.llm import bagminhash, exact_dedup, near_dedup, substring_dedup
from quantspark.llm.words import Words, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def removed(rows, window=20):
    """Contract of op1 by brute force; rows that share a doc_id count as one document."""
    first = {}
    order = lambda i: (0, 0) if i is None else (1, i)
    for i, text in rows:
        w = words(text)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, ((2, 0), 0)), (order(i), s))
    out = []
    for i, text in rows:
        w = words(text)
        drop = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (order(i), s):
                drop[s : s + window] = [True] * window
        kept = " ".join(x for x, d in zip(w, drop) if not d)
        out.append((i, len(w), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_against_brute_force(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = [tuple(r) for r in substring_dedup.substring_dedup(odd).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(removed(rows), key=key)


def test_substring_random_passages(spark):
    r = random.Random(5)
    passages = [[f"p{k}_{j}" if r.random() < 0.9 else "the" for j in range(r.randint(15, 70))] for k in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            w += p[a : a + r.randint(10, 60)] + [f"x{r.randint(0, 5)}"] * r.randint(0, 2)
        rows.append((i, " ".join(w)))
    got = [tuple(x) for x in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    assert sorted(got) == sorted(removed(rows))


def test_substring_with_hot_anchors(spark, monkeypatch):
    """A phrase in ever new surroundings: its anchor is dealt out, and repeats are found as where all or no anchors are."""
    r = random.Random(6)
    phrase = " ".join(f"q{k}" for k in range(12))
    shared = [" ".join(f"s{k}_{j}" for j in range(40)) for k in range(3)]
    rows = []
    for i in range(120):
        own = lambda k: " ".join(f"u{i}_{k}_{j}" for j in range(15))  # noqa: B023, E731
        rows.append((i, " ".join([own(0), phrase, own(1), r.choice(shared) if i % 3 == 0 else "", phrase, own(2)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (0, 8, 1e9):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        assert sorted(tuple(x) for x in substring_dedup.substring_dedup(df).collect()) == sorted(removed(rows)), hot
    monkeypatch.setattr(substring_dedup, "HOT", 8)
    listed = spark.range(3000).selectExpr("if(id % 3 = 0, 5L, id) AS anchor", "if(id < 6, NULL, id) AS words")
    dealt = substring_dedup._dealt(listed)
    assert dealt.count() == 3000
    assert dealt.where("hot AND words IS NOT NULL").agg({"anchor": "count"}).first()[0] in range(998, 1100)
    assert dealt.groupBy("anchor").count().agg({"count": "max"}).first()[0] <= 3


def test_factors_against_a_greedy_parse(spark):
    """Factors copy their source's words, begin earlier, go on as far as both agree or to the next one, and hold all repeated windows but for those across their ends."""
    r = random.Random(11)
    passages = [[f"p{k}_{j}" for j in range(r.randint(25, 90))] for k in range(5)]
    rows = []
    for i in range(50):
        w = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            w += p[a : a + r.randint(10, 80)] + [f"x{i}_{r.randint(0, 9)}"] * r.randint(0, 2)
        rows.append((i, " ".join(w)))
    own = {i: t.split() for i, t in rows}
    found = sorted(tuple(x) for x in substring_dedup.factors(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert len(found) > 50
    starts = {f[:2] for f in found}
    inside = collections.defaultdict(set)
    ends = collections.defaultdict(set)
    reach, full = {}, 0
    for i, start, n, j, at in found:
        assert n >= 20 and (j, at) < (i, start) and own[i][start : start + n] == own[j][at : at + n]
        assert start >= reach.get(i, 0)
        reach[i] = start + n
        after = own[i][start + n : start + n + 1], own[j][at + n : at + n + 1]
        full += after[0] != after[1] or not after[0] or not after[1] or (i, start + n) in starts
        inside[i] |= set(range(start, start + n - 19))
        ends[i] |= set(range(start + n - 19, start + n))
    # The others end MARGIN words beyond their seeds, where an earlier source holds the windows across the border.
    assert full > 0.9 * len(found)
    first = {}
    for i in sorted(own):
        for k in range(len(own[i]) - 19):
            key = tuple(own[i][k : k + 20])
            if key in first:
                assert k in inside[i] or k in ends[i]
            else:
                assert k not in inside[i]
                first[key] = (i, k)


def test_extension_and_factors():
    own, source = [b"a", b"b", b"c", b"d", b"x"], [b"z", b"b", b"c", b"d", b"y"]
    # From two words in the middle to either side, as far as words agree; the source's words are known from place 10 on.
    assert substring_dedup.extended(own, source, 2, 1, 12, 10) == (1, 3, 11)
    assert substring_dedup.extended(own, [b"q"] * 5, 2, 2, 12, 10) == (2, 0, 12)
    assert substring_dedup.extended(own, [b"q", b"q", b"c", b"q"], 2, 2, 12, 10) == (2, 1, 12)
    found, repeats = substring_dedup.greedy_factors([(0, 30, 5, 1, 1), (20, 40, 7, 2, 2), (25, 10, 0, 3, 3)], 20)
    assert [f[:2] for f in found] == [(0, 30), (30, 30)] and found[1][2:] == (17, 2, 2)
    assert sorted({k for a, b in repeats for k in range(a, b + 1)}) == [*range(11), *range(20, 41)]


def test_substring_text_and_empty(spark, empty):
    df = spark.createDataFrame([(1, "a b c " * 30)], "doc_id long, text string")
    row = substring_dedup.substring_dedup(df, with_text=True).first()
    assert hashlib.sha256(row.kept_text.encode()).hexdigest() == row.kept_sha256
    assert substring_dedup.substring_dedup(empty).count() == 0


def exact_truth(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    return groups


def test_exact_against_brute_force(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    groups = exact_truth(rows)
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r.text_sha256]
        some = [i for i in ids if i is not None]
        assert (r.group_size, r.keep_id) == (len(ids), min(some) if some else None)
    assert sum(r.kept for r in got) == len(groups)


def test_exact_with_colliding_digests(odd):
    """A digest of one hexadecimal digit: full bytes keep texts apart."""
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    pick = lambda df: sorted(map(str, df.select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert pick(exact_dedup.exact_dedup(odd, weak)) == pick(exact_dedup.exact_dedup(odd))


def test_exact_keep_first(odd, empty):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert kept.count() == len(exact_truth(rows))
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_first(empty).count() == 0


def test_state_goes_on(spark, tmp_path):
    """Later calls on the same folder see the first one's digests, first rows and contents; colliding digests are told apart."""
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    batches = [[(5, "a b"), (3, "c"), (None, "c")], [(1, "a  b"), (7, "d"), (3, "c")], [(2, "d"), (9, None)]]
    for name, digest in (("strong", exact_dedup.sha256), ("weak", weak)):
        seen = []
        for k, rows in enumerate(batches):
            seen += rows
            df = spark.createDataFrame(rows, "doc_id long, text string")
            if k == 1:
                # A batch that lies in a file already is read where it is.
                df.write.parquet(f"file://{tmp_path}/{name}-batch")
                df = spark.read.parquet(f"file://{tmp_path}/{name}-batch")
            found = exact_dedup.continued(df, f"file://{tmp_path}/{name}", digest)
            truth = exact_truth(seen)
            want = sorted((str(i), str(min([x for x in ids if x is not None], default=None)), len(ids)) for ids in truth.values() for i in ids)
            assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in found.collect()) == want
            assert found.where("file = keep_file AND row = keep_row").count() == len(truth)
    assert found.select("file", "row").distinct().count() == found.count() == 8


def bag(text, size=5):
    w = words(text)
    return collections.Counter(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else collections.Counter()


def classes(rows):
    keys = list({tuple(words(t)): None for _, t in rows})
    at = {k: n for n, k in enumerate(keys)}
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(" ".join(k)) for k in keys]
    for a in range(len(keys)):
        for b in range(a):
            both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if either and both * 5 >= either * 4:
                parent[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[find(at[tuple(words(t))])].append(i)
    return sorted(sorted(map(str, v)) for v in ids.values())


def grouped(df):
    ids = collections.defaultdict(list)
    for r in df.collect():
        ids[r.class_id].append(r.doc_id)
    return sorted(sorted(map(str, v)) for v in ids.values())


def test_near_on_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    found = near_dedup.near_groups(odd)
    assert grouped(found) == classes(rows)
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(classes(rows))
    assert near_dedup.near_groups(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


def test_near_chains_and_rounds(spark):
    """Chains of edits whose ends aren't similar, with bands so loose that buckets need several rounds."""
    r = random.Random(3)
    rows, i = [], 0
    for g in range(4):
        base = [f"w{g}_{k}" for k in range(60)]
        cur = base
        for c in range(20):
            rows.append((i, " ".join(cur)))
            i += 1
            cur = list(cur if c % 2 else base)
            cur[r.randrange(60)] = f"x{i}"
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert grouped(near_dedup.near_groups(df, bands=6, rows=1)) == classes(rows)
    assert grouped(near_dedup.near_groups(df, bands=6, rows=1, bit_filter=False)) == classes(rows)


def test_near_in_many_blocks(spark, monkeypatch):
    """Buckets larger than a block: all pairs of blocks meet."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "NARROW", 16)
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    base = [f"b{k}" for k in range(80)]
    r = random.Random(9)
    rows = []
    for i in range(60):
        w = list(base)
        for k in r.sample(range(80), r.randint(0, 4)):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert grouped(near_dedup.near_groups(df, bands=3, rows=1)) == classes(rows)


def test_block_overlaps():
    texts = ["a b c d e f a b c d e", "a b c d e f", "x", "", "a b c d e"]
    both, total = near_dedup._block_overlaps(pa.array(texts), 5, columns_at_once=3)
    bags = [bag(t) for t in texts]
    assert total.tolist() == [sum(b.values()) for b in bags]
    for i in range(5):
        for j in range(5):
            if i != j:
                assert both[i, j] == sum((bags[i] & bags[j]).values())


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(0)
    z = []
    for _ in range(40):
        n = int(rng.integers(1, 300))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a = rng.integers(1, 6, n)
        b = np.where(rng.random(n) < 0.7, a, rng.integers(0, 40, n))
        keys = np.concatenate([base, base[b > 0]])
        owner = np.concatenate([np.zeros(n, int), np.ones((b > 0).sum(), int)])
        s = bagminhash.signatures(keys, owner, np.concatenate([a, b[b > 0]]), 2, 512)
        j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        z.append(((s[0] == s[1]).mean() - j) / np.sqrt(max(j * (1 - j), 1e-9) / 512))
    assert abs(np.mean(z)) < 0.6 and np.std(z) < 1.6


def test_overlap_counts_multisets():
    both, either = near_dedup.overlap(pa.array(["a b c d e f", "x y"]), pa.array(["a b c d e f a b c d e", "x y"]))
    assert both.tolist() == [2, 1] and either.tolist() == [7, 1]


@pytest.mark.parametrize("text", ["a bb  ccc\n", "", "x", "\t\x0b\x0c y z w", None])
def test_words(text):
    w = Words(pa.array([text, "end"]))
    got = [bytes(w.raw[s:e]).decode() for s, e in zip(w.start[: w.first[1]], w.end[: w.first[1]])]
    assert got == words(text)
    assert len(shingles(w, 5)[0]) == (1 if got else 0) + 1
