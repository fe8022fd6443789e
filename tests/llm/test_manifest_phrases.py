"""Manifest, phrase mining and SentencePiece digests against brute force, the library and SQL."""

import hashlib
import random
import re
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from paperglass.llm import merkle, phrases, piece_bpe  # noqa: E402
from paperglass.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from tests.conftest import rows_of  # noqa: E402
from tests.llm.test_tokens import texts  # noqa: E402

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, _ID string, Tree int, `a.b` int, Rank string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(levels, i):
    """Siblings of leaf i, from below, as (left, digest or None)."""
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append((j < i, level[j] if j < len(level) else None))
        i //= 2
    return out


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_audit(rows, bump):
    """The manifest one node at a time; `bump` tells whose n_chars a holder has altered."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {}
    for lang in langs:
        own = [(r[0], sha(*map(field, r[:5])), sha(*map(field, (*r[:3], r[3] + 1 if r[3] is not None and bump(r[0]) else r[3], r[4])))) for r in rows if r[2] == lang]
        groups[lang] = sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {lang: levels_of([x[1] for x in own]) for lang, own in groups.items()}
    top = levels_of([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (doc, leaf, held) in enumerate(groups[lang]):
            path = climb(trees[lang], i) + climb(top, k)
            acc = held
            for left, d in path:
                acc = sha(acc) if d is None else sha(d, acc) if left else sha(acc, d)
            out.append((doc, leaf, trees[lang][-1][0], top[-1][0], sha(*(d for _, d in path if d)), acc, acc == top[-1][0]))
    return sorted(map(repr, out))


def audit_of(docs):
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return sorted(repr(tuple(r)) for r in merkle.audit(docs, presented={"n_chars": altered}).collect())


def bumped(doc):
    import zlib

    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 1}, {"en": 3, "de": 5, "": 1, None: 4}, {"en": 700, "é": 255, "fr": 256, "z": 257, None: 17}])
def test_manifest_like_one_node_at_a_time(spark, sizes):
    rng = random.Random(5)
    rows = [(rng.randrange(-50, 10**6), rng.choice(["a", None, "é"]), lang, rng.choice([None, 3, 70000]), rng.choice(["", None, "tæxt 漢", "x" * 3000]), None, 1, 2, "r") for lang, n in sizes.items() for _ in range(n)]
    if len(rows) > 5:
        rows += [rows[0], rows[0], (None, None, None, None, None, None, None, None, None), (None, "s", "en", 1, "t", "i", 1, 1, "r")]
    assert audit_of(spark.createDataFrame(rows, SCHEMA)) == plain_audit(rows, bumped)


def test_manifest_of_nothing(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_proofs_catch_any_change(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert merkle.audit(docs).where("not verified").count() == 0
    assert merkle.audit(docs, presented={"text": F.concat("text", F.lit(" "))}).where("verified").count() == 0


def test_many_groups_and_shallow_trees(spark):
    """Every row its own group: the upper tree has two bands."""
    rows = [(k, "s", f"g{k}", 1, "t", None, 1, 2, "r") for k in range(600)]
    assert audit_of(spark.createDataFrame(rows, SCHEMA)) == plain_audit(rows, bumped)


def plain_collocations(rows, least, first):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts[lang or "und", tuple(words[i : i + n])] += 1
    often = {k: f for k, f in counts.items() if f >= least}
    found = []
    for (lang, p), a in often.items():
        inside = any(x == lang and len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), f in often.items())
        if len(p) > 1 and not inside:
            cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= first:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(map(repr, out))


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["a", "B", "ab", "é", "Éa", "c'd", "-", " x", "zz"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" "] * 9 + ["  ", "\t", ". ", ",", "\n", ":", "\x0b"]) for _ in range(rng.randint(0, 120)))) for _ in range(60)]
    return rows + [("en", None), ("en", ""), (None, " . , "), ("fr", "a a a a a a a a"), ("en", "to be or not " * 500)] + rows[:10]


@pytest.mark.parametrize("least,first", [(5, 2000), (2, 7)])
def test_phrases_like_brute_force(spark, least, first):
    rows = phrase_rows(least)
    docs = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "lang string, text string, phrase string, N int, `a.b` int")
    got = phrases.collocations(docs, least=least, first=first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_collocations(rows, least, first)


def test_no_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", " ,")], "lang string, text string"), least=1).count() == 0


@pytest.mark.parametrize("modulus", [1, 2, 5])
def test_overlaps_count_once(monkeypatch, modulus):
    """Every word starts in the own part of one chunk, and every phrase lies within the chunk that it starts in."""
    monkeypatch.setattr(phrases, "MODULUS", modulus)
    for _, text in phrase_rows(9):
        words, _, piece_of = phrases._words(pa.array([text or ""]))
        chunk, own, _ = phrases.chunks_of(pa.array([text or ""]))
        found = Counter(tuple(c.split(" ")[i : i + 5]) for c, n in zip(chunk.to_pylist(), own.tolist(), strict=True) for i in range(n))
        flat, last = words.to_pylist(), {p: i + 1 for i, p in enumerate(piece_of.tolist())}
        assert found == Counter(tuple(flat[i : min(i + 5, last[p])]) for i, p in enumerate(piece_of.tolist()))


def test_a_full_bitmap_prunes_nothing_and_counts_the_same():
    full = SimpleNamespace(value=b"\xff" * (phrases.FILTER_BITS // 8))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array(["a b a b a", "a b"]), pa.array([3, 2]), pa.array([4, 1])], names=["lang", "chunk", "own", "n"])
    (got,) = phrases._counter(2, full)([batch])
    assert sorted(map(tuple, (r.values() for r in got.to_pylist()))) == [("de", "a b", 1), ("en", "a b", 8), ("en", "b a", 4)]


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_phrase_mining"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert len(ours) and sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_like_the_library(spark, library):
    rng = random.Random(8)
    wide = ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0x10000, 0x1FFFF), 32, 0x2581])) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    long = ["a" * 60_000, "ab" * 20_000, "漢字" * 15_000, "thethe" * 9_000, "x" * 5_000 + " " * 5_000 + "yz" * 3_000, "́" * 3_000, "plain words " * 20_000]
    rows = [(k, t, "n", 1.0, 2) for k, t in enumerate([*texts(), *wide, *long])] + [(None, "no id", "n", 1.0, 2), (3, "a", "n", 1.0, 2), (900, None, "n", 1.0, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ID string, n_tokens double, `a.b` int")
    got = sorted(repr(tuple(r)) for r in piece_bpe.digests(docs, MODEL).collect())
    expected = []
    for r in rows:
        ids = library.encode(r[1] or "", add_eos=True)
        expected.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(map(repr, expected))
    back = piece_bpe.decode(piece_bpe.encode(docs, MODEL), MODEL)
    assert sorted(repr(tuple(r)) for r in back.collect()) == sorted(repr((r[0], library.decode(library.encode(r[1] or "")))) for r in rows)
    assert piece_bpe.differences(docs, MODEL).count() == 0
    assert piece_bpe.digests(docs.where("false"), MODEL).count() == 0


def test_no_document_differs_from_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert piece_bpe.differences(docs, MODEL).count() == 0
    assert QUERIES["op13_sentencepiece"](spark, SF).select("doc_id").distinct().count() == 200


def test_any_ids_decode_like_the_library(library):
    words, rng = piece_bpe.vocabulary(MODEL), random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31999), rng.randint(0, 5), words.id_of["▁"], words.id_of["▁▁"]]) for _ in range(rng.randint(0, 12))]
        assert words.decode(ids) == library.decode(ids), ids
    with pytest.raises(ValueError):
        words.decode([32000])


def test_both_agendas_agree():
    words, rng = piece_bpe.PieceVocabulary(MODEL), random.Random(3)
    made = ["".join(rng.choice(x) for _ in range(rng.randint(0, 60))) for x in ("ab", "the in", "etaoinshr", "漢字かな", "a", "é😀 x") for _ in range(80)]
    made = [m.replace(" ", piece_bpe.SPACE) for m in made]
    assert [np.frombuffer(x, "<i4").tolist() for x in words._side_by_side(made)] == [words._by_heap(m) for m in made]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    for change in ("kind", "user"):
        model = sentencepiece_model_pb2.ModelProto()
        with open(MODEL, "rb") as file:
            model.ParseFromString(file.read())
        if change == "kind":
            model.trainer_spec.model_type = 1
        else:
            model.pieces[500].type = 4
        (tmp_path / change).write_bytes(model.SerializeToString())
        with pytest.raises(ValueError):
            piece_bpe.PieceVocabulary(str(tmp_path / change))
