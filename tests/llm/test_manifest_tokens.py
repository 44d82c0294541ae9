"""The Merkle manifest, SentencePiece and the alignment of tokenizers against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantspark.llm import alignment, merkle, queries, sentence_pieces
from quantspark.llm.words import utf8

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = ["", " ", "  a", "a\x00b", "▁▁x", "　x y", "é\n\t☃😀 z", "<s> </s>", "<0x41>", "﻿x", "<unk>", "ａ", "a" * 700, " " * 300, "ab" * 900, "<|endoftext|> x", "it's  they'll\xa0 don't", "x  y　 z", "Привет, мир", "日本語 テキスト", "x " * 50 + "▁"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def tree(digests: list[str], arity: int) -> list[list[str]]:
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels: list[list[str]], index: int, arity: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        start = index // arity * arity
        out.append(("".join(level[start:index]), "".join(level[index + 1 : start + arity])))
        index //= arity
    return out


def brute_manifest(rows: list[tuple], arity: int) -> list[tuple]:
    """(group, key, digest) rows: (group, key, digest, subroot, root, proof), sorted."""
    groups = defaultdict(list)
    for group, key, digest in rows:
        groups[group].append((key is not None, key or 0, digest))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])], arity) for g in names}
    top = tree([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for i, (has, key, digest) in enumerate(sorted(groups[g])):
            out.append((g, key if has else None, digest, trees[g][-1][0], top[-1][0], siblings(trees[g], i, arity) + siblings(top, k, arity)))
    return sorted(out, key=str)


def manifest_rows(df) -> list[tuple]:
    return sorted(((r.group, r.kept.key, r.digest, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in df.collect()), key=str)


def leaves_of(spark, rows, parts):
    df = spark.createDataFrame(rows, "group string, key long, digest string").repartition(parts)
    return df.withColumn("kept", F.struct("key"))


@pytest.mark.parametrize("arity,block,parts", [(2, 8, 3), (2, 4096, 1), (3, 9, 4), (5, 5, 2)])
def test_manifest_against_brute_force(spark, monkeypatch, arity, block, parts):
    monkeypatch.setattr(merkle, "BLOCK", block)
    r = random.Random(arity)
    groups = ["en"] * 6 + ["de", "fr", None, "é", ""]
    rows = [(r.choice(groups), r.choice([None, r.randrange(40), r.randrange(10**6)]), sha(str(r.randrange(300)))) for _ in range(400)] + [("lone", 1, sha("x"))] + [("same", 7, sha("y"))] * 37
    assert manifest_rows(merkle.manifest(leaves_of(spark, rows, parts), arity)) == brute_manifest(rows, arity)


def test_manifest_with_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MAX_BROADCAST", 0)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(random.Random(i).choice("abc"), i, sha(str(i))) for i in range(300)]
    assert manifest_rows(merkle.manifest(leaves_of(spark, rows, 3))) == brute_manifest(rows, 2)


def test_manifest_of_little(spark):
    assert merkle.manifest(leaves_of(spark, [], 1)).count() == 0
    assert manifest_rows(merkle.manifest(leaves_of(spark, [(None, None, sha("a"))], 1))) == [(None, None, sha("a"), sha("a"), sha("a"), [])]


def test_op11_on_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n: sha("".join(map(part, (i, source, lang, n, text))))
    rows = [tuple(r)[:5] for r in odd.collect()]
    want = {(digest, root) for _, _, digest, _, root, _ in brute_manifest([(r[2], r[0], leaf(*r)) for r in rows], 2)}
    assert {(r.leaf, r.root) for r in found} == want and len(found) == len(rows)
    chosen = {r[0] for r in rows if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert chosen and {r.doc_id for r in found if not r.verified} == chosen
    assert all(r.verified == (r.folded_root == r.root) for r in found)


# SentencePiece


def check_texts(texts: list[str]) -> None:
    library = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    want = library.encode(texts, num_threads=1)
    ids, at = sentence_pieces.encoded(*utf8(pa.array(texts, pa.string())), B_PATH)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    raw, text_at = sentence_pieces.decoded(ids, at, B_PATH)
    assert [raw[a:b].tobytes().decode() for a, b in zip(text_at[:-1], text_at[1:], strict=True)] == [library.decode(x) for x in want]


def test_pieces_of_odd_texts():
    check_texts(ODD_TEXTS)
    check_texts([])


@pytest.mark.parametrize("letters", ["abcdeinrst", "ainthe", "ACGT", "aA-_=/. ", "▁ a\n", "абвгоенит ", "ab☃é日 "])
def test_pieces_of_random_texts(letters):
    r = random.Random(letters)
    check_texts(["".join(r.choice(letters) for _ in range(r.choice([3, 30, 34, 300, 2000]))) for _ in range(150)])


def test_pieces_of_joined_pieces():
    r, library = random.Random(5), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    check_texts(["".join(library.id_to_piece(r.randrange(259, 32000)).replace("▁", r.choice(["", " "])) for _ in range(r.randint(1, 80))) for _ in range(500)])


def test_long_words():
    r = random.Random(6)
    check_texts(["".join(r.choice("etaoinshrdlu") for _ in range(40_000)), "=" * 30_000, "".join(r.choice(["in", "ing", "tion", "the"]) for _ in range(9_000))])


def test_decoding_of_any_ids():
    r, library = random.Random(7), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    lists = [[r.choice([r.randrange(32000), r.randrange(3, 259), 0, 1, 2]) for _ in range(r.randint(0, 9))] for _ in range(400)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    raw, text_at = sentence_pieces.decoded(np.array([i for x in lists for i in x], np.int32), at, B_PATH)
    assert [raw[a:b].tobytes().decode() for a, b in zip(text_at[:-1], text_at[1:], strict=True)] == [library.decode(x) for x in lists]


def test_full_memory_and_equal_hashes(monkeypatch):
    from quantspark.llm import pieces

    found = sentence_pieces.PieceModel(B_PATH)
    monkeypatch.setattr(pieces, "span_hashes", lambda raw, start, end: (end - start).astype(np.uint64))
    memory = pieces.SpanIds(found.encode, most=5)
    monkeypatch.setitem(sentence_pieces._MODELS, B_PATH, (found, memory))
    for _ in range(3):
        check_texts(["one two six ten", "few bar baz one", "longer words here", "zwölf"])


def test_tables_of_ids(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    lists = sentence_pieces.encode(odd)
    want = sorted((str(r[0]), library.encode(r[1] or "")) for r in odd.collect())
    assert sorted((str(r.doc_id), r.ids) for r in lists.collect()) == want
    assert sorted((str(r.doc_id), r.text) for r in sentence_pieces.decode(lists).collect()) == [(i, library.decode(x)) for i, x in want]
    got = sorted(map(str, (tuple(r) for r in sentence_pieces.digests(odd).collect())))
    assert got == sorted(str((None if i == "None" else int(i), len(x), sha(",".join(map(str, x))), sha(library.decode(x)))) for i, x in want)


def test_tables_of_nothing(spark, empty):
    assert sentence_pieces.digests(empty).count() == sentence_pieces.encode(empty).count() == alignment.alignment(empty).count() == alignment.groups(empty).count() == 0


# Alignment


def brute_alignment(texts: list[str | None]) -> list[tuple]:
    a_model, b_model = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    rows = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_model.id_to_piece(i)]]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b, a_bytes, b_bytes = [], [], [], []
        groups, i, j, x, y = [], 0, 0, 0, 0
        now = ([], [])
        while i < len(a) or j < len(b):
            if x <= y:
                x, i = x + len(a_bytes[i]), i + 1
                now[0].append(a[i - 1])
            else:
                y, j = y + len(b_bytes[j]), j + 1
                now[1].append(b[j - 1])
            if x == y:
                groups.append(now)
                now = ([], [])
        rows.append((len(a), len(b), groups))
    count = Counter((g[0][-1], g[1][-1]) for _, _, groups in rows for g in groups)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for n_a, n_b, groups in rows:
        counts = [(count[g[0][-1], g[1][-1]], most[g[1][-1]]) for g in groups]
        written = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((n_a, n_b, len(groups), len(groups), sum(c == m for c, m in counts), sum(c for c, _ in counts), sha(written) if groups else ""))
    return out


def aligned(df) -> list[tuple]:
    return sorted(tuple(r)[1:] for r in df.collect())


@pytest.mark.parametrize("block_bytes", [1, alignment.BLOCK_BYTES])
def test_alignment_against_brute_force(spark, block_bytes):
    r = random.Random(8)
    texts = [*ODD_TEXTS, None, *("".join(r.choice(["the ", "in", "’", " é", "\n", "日", "123", " 's", "x", "  "]) for _ in range(60)) for _ in range(60)), *["on there inst " * 90] * 2]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block long").repartition(3)
    assert aligned(alignment.alignment(df, block_bytes=block_bytes)) == sorted(brute_alignment(texts))


def test_alignment_of_odd_rows(spark, odd):
    assert aligned(alignment.alignment(odd)) == sorted(brute_alignment([r[1] for r in odd.collect()]))


def test_groups_end_together(spark):
    text = "Über  the naïve re-encoding of 12345 tokens\n"
    row = alignment.groups(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    a_model, b_model = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    whole, at = (" " + text).encode(), (0, 0, 0)
    assert row.byte_ends[-1] == len(whole) and row.a_ends[-1] == len(row.a) and row.b_ends[-1] == len(row.b)
    for end in zip(row.a_ends, row.b_ends, row.byte_ends, strict=True):
        piece = whole[at[2] : end[2]]
        assert a_model.decode(row.a[at[0] : end[0]]).encode() in (piece, piece.decode("utf-8", "replace").encode())
        assert b_model.decode([b_model.piece_to_id("▁")] + row.b[at[1] : end[1]]).strip().encode() in (piece.strip(), piece.decode("utf-8", "replace").strip().encode())
        at = end


def test_links_of_two_widths():
    from quantspark.llm.alignment import _packed, _unpacked

    numbers, at = np.array([1, 65535, 0, 70_000, 3]), np.array([0, 2, 2, 3])
    narrow = _packed(numbers[:3], at, 1 << 16)
    wide = _packed(numbers[3:], np.array([0, 0, 2]), (1 << 16) + 1)
    got, ends = _unpacked(pa.concat_arrays([narrow, wide]), np.array([2, 0, 1, 0, 2]))
    assert got.tolist() == numbers.tolist() and ends.tolist() == [0, 2, 2, 3, 3, 5]
