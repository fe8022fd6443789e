"""Searches, toxicity, chat formatting and the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperglass.llm import ann_tree, chat_format, topk, toxicity
from paperglass.llm.queries import QUERIES
from paperglass.llm.vectors import valid

SF = "/root/testdata/sf0.01"


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)]
    rows += [(1000, None), (1001, [1.0, float("nan")]), (1002, [1.0, None]), (1003, [float("inf")] * 6), (1004, [0.0] * 6), (1005, []), (1006, [2.0, 1.0]), (50, rows[50][1]), (7, [9.0] * 6), (None, [1.0] * 6)]
    return rows, spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")


def plain_best(rows, queries, k, score):
    out = []
    for q, x in queries.items():
        found = sorted((-score(x, y), i) for i, y in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def usable(rows, zero):
    return [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]


def inner(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def test_top_k_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    rows, df = vectors(spark)
    v = topk.quantised(valid(df, "vec_id", "embedding"), 256)
    got = sorted(tuple(r) for r in topk.top_k(v.where("id % 50 = 0"), v, 5).collect())
    own = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in usable(rows, True)]
    queries = {i: min(y for j, y in own if j == i) for i, _ in own if i % 50 == 0}
    assert got == plain_best(own, queries, 5, inner)
    assert topk.top_k(v.where("false"), v, 5).count() == 0 and topk.top_k(v, v.where("false"), 5).count() == 0


@pytest.mark.parametrize("cell", [16, 16_384])
def test_all_leaves_give_the_exact_answer(spark, monkeypatch, cell):
    """Ties of small whole components, repeated rows, and leaves over several cells."""
    monkeypatch.setattr(ann_tree, "CELL", cell)
    rows, df = vectors(spark)
    rows = [*rows, *[(2000 + k % 3, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]) for k in range(60)]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    v = valid(df, "vec_id", "embedding", nonzero=True)
    got = sorted(tuple(r) for r in ann_tree.nearest(v.where("id % 20 = 0"), v, 5, target=1.0).collect())
    own = usable(rows, False)
    queries = {i: min(y for j, y in own if j == i) for i, _ in own if i % 20 == 0}
    assert got == plain_best(own, queries, 5, inner)
    assert ann_tree.nearest(v.where("false"), v.where("false")).count() == 0


def test_few_rows_are_all_found(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted(tuple(r) for r in ann_tree.nearest(v, v, 20).collect())
    assert got == plain_best(rows, dict(rows), 20, inner)


def test_recall_on_the_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = QUERIES["op3_ann_tree"](spark, "/root/testdata/sf0.1").toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]]) & set(part["vec_id"]))
        assert len(part) == 20
    assert hits / len(got) >= 0.9


def test_gradients_by_differences():
    model = toxicity.Model()
    words, size = sorted(["idiot", "and", "a", "clown"], key=len), np.array([3, 2])
    at, labels = np.array([[0, 2], [3, 1], [1, 0]]), np.array([1.0, 0.0])
    mask = np.arange(3)[:, None] < size
    back = np.where(mask, np.take_along_axis(at, np.where(mask, size - 1 - np.arange(3)[:, None], 0), 0), 0)

    def loss():
        xf, xb = model.project(model.vectors(words))
        z = model.logits(xf[at], xb[back], size).astype(float)
        return float(np.sum(np.log1p(np.exp(z)) - labels * z))

    kv, kl, g = {}, {}, {k: np.zeros_like(v) for k, v in model.p.items()}
    v = model.vectors(words, kv)
    xf, xb = model.project(v)
    z = model.logits(xf[at], xb[back], size, kl)
    dxf, dxb = model.logits_back((toxicity.sigmoid(z) - labels).astype(np.float32), kl, g)
    dv = np.zeros_like(v)
    for side, dx, where in (("f", dxf, at), ("b", dxb, back)):
        total = np.zeros((len(words), dx.shape[2]), np.float32)
        np.add.at(total, where.reshape(-1), dx.reshape(-1, dx.shape[2]))
        g[f"w{side}"], g[f"b{side}"] = v.T @ total, total.sum(0)
        dv += total @ model.p[f"w{side}"].T
    model.vectors_back(dv, kv, g)
    for name in ("av", "aw", "uf", "ub", "wf", "bb", "cuf", "cub", "cwf", "ow"):
        p, i = model.p[name].reshape(-1), int(np.argmax(np.abs(g[name].reshape(-1))))
        kept, step = p[i], np.float32(1e-2)
        p[i] = kept + step
        up = loss()
        p[i] = kept - step
        down = loss()
        p[i] = kept
        assert (up - down) / 0.02 == pytest.approx(float(g[name].reshape(-1)[i]), rel=0.08, abs=2e-3), name


def plain_score(model, text):
    """The highest window's probability, window by window, word by word and letter by letter."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def gru(inputs, w, u, b):
        n = len(u)
        h, out = np.zeros(n), []
        for x in inputs:
            xs, hu = x @ w + b, h @ u
            z, r = sig(xs[:n] + hu[:n]), sig(xs[n : 2 * n] + hu[n : 2 * n])
            new = np.tanh(xs[2 * n :] + r * hu[2 * n :])
            h = new + z * (h - new)
            out.append(h)
        return out

    def vector(word):
        codes = [p["char"][ord(c) % 509 + 1] for c in word]
        ends = [gru(c, p[f"cw{s}"], p[f"cu{s}"], p[f"cb{s}"])[-1] for s, c in (("f", codes), ("b", codes[::-1]))]
        return np.concatenate([p["embed"][toxicity.bucket(word)], p["stem"][toxicity.bucket(word[: toxicity.STEM])], *ends])

    words = toxicity.words_of(text)
    vectors = {w: vector(w) for w in set(words)}
    best = -np.inf
    for start in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        x = [vectors[w] for w in words[start : start + toxicity.WINDOW]]
        pooled = np.zeros(2 * toxicity.H_WORD)
        if x:
            f, b = gru(x, p["wf"], p["uf"], p["bf"]), gru(x[::-1], p["wb"], p["ub"], p["bb"])[::-1]
            h = np.concatenate([np.array(f), np.array(b)], 1)
            a = np.exp(np.tanh(h @ p["aw"] + p["ab"]) @ p["av"])
            pooled = (a / a.sum()) @ h
        best = max(best, pooled @ p["ow"] + p["ob"][0])
    return sig(best)


def test_scores_by_brute_force():
    """Texts of no, few, 64, 65 and many words, long words, and repeated ones, batched and one by one."""
    model = toxicity.Model(seed=3)
    rng = np.random.default_rng(4)
    model.p = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in model.p.items()}
    vocabulary = ["".join(rng.choice(list("abcdeé漢x1"), rng.integers(1, 12))) for _ in range(80)]
    texts = ["", "!!", "one", "Ab " * 64, "q" * 60, *(" ".join(rng.choice(vocabulary, n)) for n in (3, 47, 48, 49, 63, 64, 65, 112, 113, 400))]
    expected = [plain_score(model, t) for t in texts]
    assert toxicity.Scorer(model).scores(texts) == pytest.approx(expected, abs=2e-5)
    assert [toxicity.Scorer(model).scores([t])[0] for t in texts] == pytest.approx(expected, abs=2e-5)


def test_toxicity_is_learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).toPandas().merge(labels.toPandas()).query("held_out")
    toxic = found["toxic"] == 1
    assert len(found) > 900 and found["predicted"][toxic].mean() > 0.8 and found["predicted"][~toxic].mean() < 0.02
    assert found["score"].between(0, 1).all()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "idiot", 0), (2, "x " * 30000 + "y" * 500, 0), (3, "!!", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def plain_viterbi(chain, seen):
    best, back = chain.first + chain.emit[:, seen[0]], []
    for s in seen[1:]:
        all_ = best[:, None] + chain.move
        back.append(all_.argmax(0))
        best = all_.max(0) + chain.emit[:, s]
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1], float(best.max())


@pytest.mark.parametrize("cut", [3, 20_000])
def test_cuts_decode_like_one_pass(spark, monkeypatch, cut):
    """Conversations in one task, over several tasks, and cut within a task decode as in one pass."""
    monkeypatch.setattr(chat_format, "CUT", cut)
    rows = chat_format.raw_transcripts(spark.read.parquet(f"{SF}/conversations.parquet")).repartition(7)
    rows = rows.withColumn("conv_id", F.when(F.col("conv_id") % 3 == 0, 9).otherwise(F.col("conv_id"))).withColumn("turn", F.when(F.col("conv_id") == 9, F.xxhash64("text") % 1000).otherwise(F.col("turn")))
    role = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2)
    chain = chat_format.fit(rows.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), "text"))
    got = chat_format.format_chats(rows, chain=chain).toPandas()
    for conv, part in rows.withColumn("h", F.xxhash64("text")).toPandas().drop_duplicates(["conv_id", "turn", "text"]).groupby("conv_id"):
        part = part.sort_values(["turn", "h"])
        seen = np.concatenate([chat_format.symbols(t) for t in part["text"]])
        states, _ = plain_viterbi(chain, seen)
        own = got[got["conv_id"] == conv].sort_values(["turn", "part"])
        if part["turn"].is_unique:
            roles = [r for r, n in zip(own["role"], own["n_lines"], strict=True) for _ in range(n)]
            assert roles == [chat_format.ROLES[s // 2] for s in states]
            assert own["opens"].sum() == sum(s % 2 == 0 or k == 0 or states[k - 1] // 2 != s // 2 for k, s in enumerate(states))
        assert own["n_lines"].sum() == len(states)


def test_roles_are_recovered_from_raw_transcripts(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    got = QUERIES["op1_chat_format"](spark, SF).where("part = 0").select("conv_id", "turn", F.col("role").alias("found"))
    assert rows.join(got, ["conv_id", "turn"]).select(F.avg(F.when(F.col("role") == F.col("found"), 1.0).otherwise(0.0)).alias("a")).first()["a"] > 0.9
    raw = chat_format.raw_transcripts(rows)
    marked = raw.where(F.col("text").rlike("^(?:User|Human|Q|<.im_start|###)"))
    assert marked.count() > 0.3 * rows.count()


def test_markers_split_a_raw_transcript(spark):
    raw = "System: be brief\nUser: hello there\nhow are you?\nAssistant: fine\nUser: ok"
    rows = [(1, 0, "user", raw, 1), (1, 0, "user", raw, 1), (2, 0, None, None, 1), (None, 1, "user", "x", 1), (3, None, "user", "x", 1), (4, 0, "tool", "User: a\n" + "long line\n" * 50_000, 1), (5, 1, "user", "User: b", 1), (5, 1, "user", "User: a", 1), (5, 1, "user", "", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    got = chat_format.format_chats(df, role_col=None).orderBy("conv_id", "turn", "part").collect()
    assert [r["role"] for r in got if r["conv_id"] == 1] == ["system", "user", "assistant", "user"]
    assert got[1]["rendered"] == "<|user|>\nhello there\nhow are you?"
    assert sum(r["n_lines"] for r in got if r["conv_id"] == 4) == 50_002 and {r["conv_id"] for r in got} == {1, 2, 4, 5}
    assert chat_format.format_chats(df.where("false")).count() == 0


def test_a_repeated_id_adds_one_text_to_the_sample(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(300)] + [(None, "x"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3)], "doc_id long, toxic int")
    texts, y, _ = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 10, 10)
    assert len(texts) == len(set(texts)) <= 3 and len(y) == len(texts)


def test_the_driver_does_not_train(spark, monkeypatch):
    """Texts and training stay in a task: the driver collects weights only, and they are those of a fit of the sample."""
    words = [["good", "kind", "mild", "calm"], ["foul", "vile", "nasty", "rude"]]
    rows = [(k, " ".join(words[k % 2][(k // 2 + j) % 4] for j in range(5))) for k in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    names = ("doc_id", "text", "toxic", 20, 20)
    expected = toxicity.fit(*toxicity.training_sample(docs, labels, *names)).p
    real, driver = toxicity.fit, os.getpid()

    def elsewhere(*args):
        assert os.getpid() != driver
        return real(*args)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    monkeypatch.setattr(toxicity, "training_sample", None)
    got = toxicity.fitted(docs, labels, *names).p
    assert list(got) == list(expected) and all(np.array_equal(got[k], expected[k]) and got[k].shape == expected[k].shape for k in got)
    assert toxicity.without_toxic(docs, labels).count() <= 60 and toxicity.toxicity(docs, labels).count() == 60


FIT_TWICE = """
import hashlib, numpy as np
from paperglass.llm import toxicity
rng = np.random.default_rng(1)
words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(300)]
texts = [" ".join(rng.choice(words[: 150 + 150 * (k % 2)], 90)) for k in range(60)]
model = toxicity.fit(texts, np.arange(60) % 2, np.ones(60, np.float32), rounds=2)
print(hashlib.sha256(toxicity.Scorer(model).scores(texts).tobytes()).hexdigest())
"""


def test_scores_are_the_same_in_every_process():
    import os
    import subprocess
    import sys

    run = lambda seed: subprocess.run([sys.executable, "-c", FIT_TWICE], env={**os.environ, "PYTHONHASHSEED": seed, "PYTHONPATH": os.getcwd()}, capture_output=True, text=True, check=True).stdout
    assert len(run("1")) == 65 and len({run(seed) for seed in ("1", "2", "3")}) == 1


OWN_NAMES = ("spans string, base string, _score double, _h long, _KEY int, stays boolean, node long", "_SPANS string, `a.b` string, _SCORE double, Score long, c0 int, _STAYS boolean, B long", "C1 string, kept string, score double, _ID long, `_score.x` int, Digest boolean, component_id long")


@pytest.mark.parametrize("own", OWN_NAMES)
def test_stages_on_awkward_rows(spark, own):
    """Null texts and ids, repeated rows, one id with two texts, and columns whose names the stages use themselves."""
    import corpus_pipeline

    rows = [(1, "plain words of one text"), (1, "plain words of one text"), (1, "other words altogether here"), (None, "no id"), (None, None), (2, None), (3, ""), (4, "key password = abcdefghijklmnop end")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + own
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "sp", "ba", 0.5, 7, 8, True, 9) for i, t in rows], schema)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.schema.names == docs.schema.names and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()), key=repr)
    clean = "key [SECRET] end"
    assert got == sorted([(1, "plain words of one text", 23), (1, "other words altogether here", 27), (None, "no id", 5), (None, None, 0), (2, None, 0), (4, clean, len(clean))], key=repr)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).count() == 6


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        assert 0.5 * before.count() <= kept.count() <= before.count()
    assert kept.where(F.col("text").contains("[SECRET]")).count() > 0
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert out.select("doc_id").distinct().count() == kept.count()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
