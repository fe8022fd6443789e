"""Tokenizers, packing and token counts against the libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from paperglass.llm import bpe, packing, token_count  # noqa: E402
from paperglass.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
AWKWARD = ["", " ", "  ", "a", "\n \n x", "a" * 3000, "漢字かな " * 20, "▁▁ a   b", "tail  ", "\x00<s></s><0x0A>", "I'm 12,345.67 — né 😀͸", "<|endoftext|>a<|endoftext|>", "=" * 700, "  x y"]


def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("abthein é \n\t漢😀1$  .,s'") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    return AWKWARD + made


def documents(spark, extra=()):
    rows = [(i, t, "n", 1.0) for i, t in enumerate(texts())] + [(None, "no id", "n", 1.0), (3, "a", "n", 1.0), (900, None, "n", 1.0), *extra]
    return spark.createDataFrame(rows, "doc_id long, text string, _id string, n_tokens double")


@pytest.fixture(scope="module")
def libraries():
    import base64

    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return (
        tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}),
        Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")),
        sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")),
    )


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_digests_like_the_library(spark, libraries):
    docs = documents(spark)
    got = bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    expected = []
    for r in docs.collect():
        ids = libraries[0].encode_ordinary(r["text"] or "")
        expected.append((r["doc_id"], len(ids), digest(",".join(map(str, ids)).encode()), digest((r["text"] or "").encode())))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark).where("doc_id is not null")
    back = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    got = sorted((r["doc_id"], bytes(r["bytes"])) for r in back.collect())
    assert got == sorted((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())


def plain_merges(vocab, piece):
    """The leftmost pair of least rank, one at a time."""
    if piece in vocab.whole:
        return [vocab.whole[piece]]
    ids = vocab.byte_ids[list(piece)].tolist()
    while len(ids) > 1:
        slot = vocab.pairs.find(np.array(ids[:-1]), np.array(ids[1:]))
        rank = vocab.pairs.rank[slot]
        k = int(rank.argmin())
        if rank[k] == bpe.NONE:
            break
        ids[k : k + 2] = [int(vocab.pairs.merged[slot[k]])]
    return ids


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"])
def test_long_pieces_merge_like_short_ones(name):
    vocab = bpe.vocabulary(public_tokenizers.path(name))
    rng = random.Random(6)
    alphabets = ["ab", "a", "the in", "=-", "漢字かな", "etaoinshr", "0123456789", "é à"]
    pieces = ["".join(rng.choice(x) for _ in range(rng.randint(257, 700))).encode() for x in alphabets for _ in range(4)] + [b"a" * 1000, b"=" * 999, b"ab" * 400, b"aab" * 300]
    flat, bounds = vocab.encode([*pieces, b"short"])
    for k, p in enumerate(pieces):
        assert flat[bounds[k] : bounds[k + 1]].tolist() == plain_merges(vocab, p), p


def test_unassigned_characters_like_the_library(spark, libraries):
    rng = random.Random(7)
    odd = [chr(c) for c in (0x0378, 0x1C89, 0x10D40, 0x10D4A, 0x1CCF0, 0x1E5D0, 0x1E5F1, 0x2FFFF, 0xE0FFF, 0x16D70, 0x1FAE9, 0x0C5C, 0x20C1)]
    rows = [(k, "".join(rng.choice([*odd, "a", "1", "!", " ", "\n", "s", "'", "é"]) for _ in range(rng.randint(1, 40)))) for k in range(400)]
    got = bpe.encode_digests(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in got} == {k: digest(",".join(map(str, libraries[0].encode_ordinary(t))).encode()) for k, t in rows}


def test_very_long_texts(spark, libraries):
    """Long runs without a place to cut, long words and long plain texts, through Spark."""
    long = ["a" * 60_000, "ab" * 20_000, "漢字" * 15_000, "thethe" * 9_000, "some plain words, and more. " * 20_000, "x" * 5_000 + " " * 5_000 + "yz" * 3_000, "\u0301" * 3_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    counts = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert counts == {k: len(libraries[2].encode(t)) for k, t in enumerate(long)}
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert got == {k: digest(",".join(map(str, libraries[0].encode_ordinary(t))).encode()) for k, t in enumerate(long)}


def test_maps_compose_over_chunks(libraries, monkeypatch):
    """Short chunks, most of them without a reset: entries come from composed maps."""
    monkeypatch.setattr(token_count, "CHUNK", 3)
    machine = token_count.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    made = ["".join(rng.choice(x) for _ in range(rng.randint(0, 90))) for x in ("ab", "the in", "etaoinshr", "漢字かな", "a", "ing er") for _ in range(60)]
    assert machine.counts(made).tolist() == [len(libraries[2].encode(t)) for t in made]


def test_counts_like_the_library(spark, libraries):
    docs = documents(spark)
    got = token_count.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    expected = [(r["doc_id"], len((r["text"] or "").encode()), n := len(libraries[2].encode(r["text"] or "")), n > 4096) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_token(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(n): int(c) for n, c in zip(rng.integers(1, 64, 20), rng.integers(1, 50, 20), strict=True)}
    rows = packing.plan(histogram, 64)
    total = sum(n * c for n, c in histogram.items())
    assert sum(int(k * part) for _, _, k, _, part, _, _ in rows) == total
    cells = defaultdict(set)
    for _, _, k, _, part, base, fill in rows.tolist():
        for p in range(base, base + k):
            new = set(range(fill, fill + part))
            assert not cells[p] & new
            cells[p] |= new
    assert all(c == set(range(len(c))) and len(c) <= 64 for c in cells.values())
    assert len(cells) == -(-total // 64)


def test_packing_holds_every_id_once(spark, libraries):
    docs = documents(spark, [(1000 + k, "word " * (200 * k), "n", 1.0) for k in range(12)])
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, special=("<|endoftext|>", 50256)).collect()
    ids_of = defaultdict(list)
    for r in docs.collect():
        ids_of[r["doc_id"]].append([*libraries[1].encode(r["text"] or "", add_special_tokens=False).ids, 0])
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids_of)
    for doc, lists in ids_of.items():
        if len(lists) == 1:
            at = 0
            for r in sorted(by_doc[doc], key=lambda r: r["start"]):
                part = np.array(lists[0][r["start"] : r["start"] + r["length"]], "<u4")
                assert r["start"] == at and r["doc_tokens"] == len(lists[0]) and r["ids_crc32"] == zlib.crc32(part.tobytes())
                at += r["length"]
            assert at == len(lists[0])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert total == sum(len(x) for lists in ids_of.values() for x in lists)
    assert len(sequences) * 1024 - total < 1024


@pytest.mark.parametrize("op", ["pack", "count", "digest"])
def test_empty_table(spark, op):
    docs = documents(spark).where("false")
    path = public_tokenizers.path
    run = {
        "pack": lambda: packing.pack(docs, path("byte_bpe_50k.json"), public_tokenizers.PATTERN),
        "count": lambda: token_count.token_counts(docs, path("piece_bpe_32k.model")),
        "digest": lambda: bpe.encode_digests(docs, path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    }
    assert run[op]().count() == 0


@pytest.mark.parametrize("name", ["op4_token_counts", "op7_packing", "op8_byte_bpe"])
def test_query_covers_all_documents(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert QUERIES[name](spark, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
