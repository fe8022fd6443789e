"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is its hashed embedding, that of its first letters and the end states of a character network over all. A second network reads
overlapping windows of words in both directions, attention pools its states, and a document scores its highest window.
The networks are trained in numpy on a bounded sample of labelled documents, in one task, window by window: of each document that
window counts which scores highest so far.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperglass.llm.common import text_slices

#: Words of a window and from one window to the next.
WINDOW, STRIDE = 64, 48
#: Hashed words, word embedding, embedding of first letters, character embedding, states of the character and word networks.
BUCKETS, D_WORD, D_STEM, D_CHAR, H_CHAR, H_WORD = 1 << 15, 8, 4, 6, 6, 8
#: First letters that share an embedding.
STEM = 5
#: Longer words are read as several.
LETTERS = 24
#: Labelled documents of each class that the model is fitted on, at most.
POSITIVE, NEGATIVE = 900, 1_600
#: Words that a worker keeps; beyond them it starts anew.
WORDS = 200_000
WORD = re.compile(r"[^\W_]+")
f32 = np.float32


def words_of(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if found and len(max(found, key=len)) > LETTERS:
        found = [w[i : i + LETTERS] for w in found for i in range(0, len(w), LETTERS)]
    return found


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes (letters x words) and lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % 509 + 1
    out = np.zeros((len(words), int(size.max(initial=1))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out.T, size


def sigmoid(x: np.ndarray) -> np.ndarray:
    return f32(0.5) * (np.tanh(x * f32(0.5)) + f32(1))


def recur(x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """States (steps x lanes x H) of a gated unit over projected inputs (steps x lanes x 3H)."""
    steps, lanes, h3 = x.shape
    n = h3 // 3
    h = np.zeros((lanes, n), f32)
    out = np.empty((steps, lanes, n), f32)
    for t in range(steps):
        hu = h @ u
        gates = sigmoid(x[t, :, : 2 * n] + hu[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[t, :, 2 * n :] + r * hu[:, 2 * n :])
        step = new + z * (h - new)
        if mask is not None:
            step = np.where(mask[t][:, None], step, h)
        if keep is not None:
            keep.append((h, hu[:, 2 * n :], z, r, new))
        h = step
        out[t] = h
    return out


def recur_back(dout: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    steps, lanes, n = dout.shape
    dx, du, dh = np.zeros((steps, lanes, 3 * n), f32), np.zeros_like(u), np.zeros((lanes, n), f32)
    for t in reversed(range(steps)):
        h, hn, z, r, new = keep[t]
        m = mask[t][:, None]
        dh = dh + dout[t]
        d = np.where(m, dh, 0)
        dn = d * (1 - z) * (1 - new * new)
        dz = d * (h - new) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], 1)
        dhu = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ dhu
        dh = np.where(m, d * z, dh) + dhu @ u.T
    return dx, du


class Model:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def weights(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(f32)

        d = D_WORD + D_STEM + 2 * H_CHAR
        self.p = {"embed": (rng.standard_normal((BUCKETS, D_WORD)) * 0.05).astype(f32), "stem": (rng.standard_normal((BUCKETS, D_STEM)) * 0.05).astype(f32), "char": (rng.standard_normal((510, D_CHAR)) * 0.3).astype(f32)}
        for side in "fb":
            self.p |= {f"cw{side}": weights(D_CHAR, 3 * H_CHAR), f"cu{side}": weights(H_CHAR, 3 * H_CHAR), f"cb{side}": np.zeros(3 * H_CHAR, f32)}
            self.p |= {f"w{side}": weights(d, 3 * H_WORD), f"u{side}": weights(H_WORD, 3 * H_WORD), f"b{side}": np.zeros(3 * H_WORD, f32)}
        self.p |= {"aw": weights(2 * H_WORD, H_WORD), "ab": np.zeros(H_WORD, f32), "av": weights(H_WORD, 1)[:, 0], "ow": weights(2 * H_WORD, 1)[:, 0], "ob": np.full(1, -2, f32)}

    # words
    def vectors(self, words: list[str], keep: dict | None = None) -> np.ndarray:
        """Input vectors of words: embedding, and end states of the character network from either end."""
        p = self.p
        code, size = letters(words)
        steps = np.arange(len(code))[:, None]
        mask = steps < size
        back = np.where(mask, np.maximum(size - 1 - steps, 0), 0)
        code_back = np.take_along_axis(code, back, 0)
        at = np.fromiter(map(bucket, words), np.int64, len(words))
        stem = np.fromiter((bucket(w[:STEM]) for w in words), np.int64, len(words))
        ends, kept = [], {}
        for side, c in (("f", code), ("b", code_back)):
            k: list | None = [] if keep is not None else None
            states = recur(p["char"][c] @ p[f"cw{side}"] + p[f"cb{side}"], p[f"cu{side}"], mask, k)
            ends.append(states[-1])
            kept[side] = (c, k)
        if keep is not None:
            keep |= {"at": at, "stem": stem, "mask": mask, "sides": kept}
        return np.concatenate([p["embed"][at], p["stem"][stem], *ends], 1)

    def vectors_back(self, d: np.ndarray, keep: dict, g: dict) -> None:
        np.add.at(g["embed"], keep["at"], d[:, :D_WORD])
        np.add.at(g["stem"], keep["stem"], d[:, D_WORD : D_WORD + D_STEM])
        first = D_WORD + D_STEM
        for n, side in enumerate("fb"):
            c, k = keep["sides"][side]
            dout = np.zeros((*c.shape, H_CHAR), f32)
            dout[-1] = d[:, first + n * H_CHAR : first + (n + 1) * H_CHAR]
            dx, g[f"cu{side}"] = recur_back(dout, self.p[f"cu{side}"], keep["mask"], k)
            flat, x = dx.reshape(-1, 3 * H_CHAR), self.p["char"][c].reshape(-1, D_CHAR)
            g[f"cw{side}"], g[f"cb{side}"] = x.T @ flat, flat.sum(0)
            np.add.at(g["char"], c.reshape(-1), flat @ self.p[f"cw{side}"].T)

    # windows
    def project(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(vectors @ self.p[f"w{s}"] + self.p[f"b{s}"] for s in "fb")

    def logits(self, xf: np.ndarray, xb: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows from projected inputs (steps x windows x 3H); xb is read from the last word on."""
        p, steps = self.p, np.arange(len(xf))[:, None]
        mask = steps < size
        kf, kb = ([], []) if keep is not None else (None, None)
        even = None if keep is None and mask.all() else mask
        back = np.where(mask, size - 1 - steps, 0)
        hf, hb = recur(xf, p["uf"], even, kf), recur(xb, p["ub"], even, kb)
        h = np.concatenate([hf, np.take_along_axis(hb, back[:, :, None], 0)], 2)
        seen = np.tanh(h @ p["aw"] + p["ab"])
        score = np.where(mask, seen @ p["av"], f32(-1e9))
        a = np.exp(score - score.max(0, initial=-1e9)) * mask
        a /= np.maximum(a.sum(0), f32(1e-9))
        pooled = np.einsum("tn,tnh->nh", a, h)
        if keep is not None:
            keep |= {"mask": mask, "back": back, "kf": kf, "kb": kb, "h": h, "seen": seen, "a": a, "pooled": pooled}
        return pooled @ p["ow"] + p["ob"][0]

    def logits_back(self, d: np.ndarray, keep: dict, g: dict) -> tuple[np.ndarray, np.ndarray]:
        p, h, a, seen = self.p, keep["h"], keep["a"], keep["seen"]
        g["ow"], g["ob"] = keep["pooled"].T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["ow"]
        da = np.einsum("nh,tnh->tn", dp, h)
        ds = a * (da - (a * da).sum(0))
        dseen = ds[:, :, None] * p["av"] * (1 - seen * seen)
        g["av"] = np.einsum("tn,tnk->k", ds, seen)
        g["aw"], g["ab"] = np.einsum("tnh,tnk->hk", h, dseen), dseen.sum((0, 1))
        dh = a[:, :, None] * dp + dseen @ p["aw"].T
        hf, hb = dh[:, :, :H_WORD], dh[:, :, H_WORD:]
        dhb = np.where(keep["mask"][:, :, None], np.take_along_axis(hb, keep["back"][:, :, None], 0), 0).astype(f32)
        dxf, g["uf"] = recur_back(hf, p["uf"], keep["mask"], keep["kf"])
        dxb, g["ub"] = recur_back(dhb, p["ub"], keep["mask"], keep["kb"])
        return dxf, dxb


def by_length(words: set[str]) -> list[str]:
    """Words from short to long, those of one length in order: the same in every process."""
    return sorted(words, key=lambda w: (len(w), w))


class Scorer:
    """Window and document scores of texts, with the words' projected inputs kept in a table."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        n = 3 * H_WORD
        self.table = [np.zeros((1 << 12, n), f32), np.zeros((1 << 12, n), f32)]

    def _learn(self, lists: list[list[str]]) -> None:
        if len(self.number) > WORDS:
            self._clear()
        new = by_length(set().union(*lists).difference(self.number))
        for lo in range(0, len(new), 8192):
            part = new[lo : lo + 8192]
            at = len(self.number)
            self.number.update(zip(part, range(at, at + len(part)), strict=True))
            while at + len(part) > len(self.table[0]):
                self.table = [np.concatenate([t, np.zeros_like(t)]) for t in self.table]
            for sub in range(0, len(part), 1024):
                for t, x in zip(self.table, self.model.project(self.model.vectors(part[sub : sub + 1024])), strict=True):
                    t[at + sub : at + sub + len(x)] = x

    def windows(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word, size and logit of every window."""
        self._learn(lists)
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((n for w in lists for n in map(self.number.__getitem__, w)), np.int64, int(count.sum()))
        base = np.cumsum(count) - count
        n = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
        doc = np.repeat(np.arange(len(lists)), n)
        start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        size = np.minimum(WINDOW, count[doc] - start)
        logit = np.empty(len(doc), f32)
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(order), 2048):
            own = order[lo : lo + 2048]
            s, at = size[own], base[doc[own]] + start[own]
            steps = np.arange(int(s.max(initial=0)))[:, None]
            if not len(steps):
                logit[own] = self.model.p["ob"][0]
                continue
            end = len(flat) - 1  # an empty last document points behind the words; its window is masked
            f = flat[np.minimum(at + np.minimum(steps, np.maximum(s - 1, 0)), end)]
            b = flat[np.minimum(at + np.maximum(s - 1 - steps, 0), end)]
            logit[own] = self.model.logits(self.table[0][f], self.table[1][b], s)
        return doc, start, size, logit

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest window's probability of each text."""
        doc, _, _, logit = self.windows([words_of(t) for t in texts])
        best = np.full(len(texts), -np.inf, f32)
        np.maximum.at(best, doc, logit)
        return sigmoid(best).astype(np.float64)


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray, rounds: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Model:
    """A model of labelled texts. Embeddings start from the words' shrunken log odds; without both classes the model is untrained.
    The rate falls from round to round, and the model is the mean over the last one."""
    model, rng = Model(), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        return model
    one: dict[str, str] = {}  # equal words share one object
    lists = [[one.setdefault(w, w) for w in words_of(t)] for t in texts]
    n = np.bincount(labels, minlength=2)
    for name, cut in (("embed", LETTERS), ("stem", STEM)):
        hits = np.zeros((2, BUCKETS))
        for w, y in zip(lists, labels.tolist(), strict=True):
            hits[y, list({bucket(x) for x in {x[:cut] for x in w}})] += 1
        odds = np.log((hits[1] + 1.5) / (n[1] + 3)) - np.log((hits[0] + 1.5 * n[0] / n[1]) / (n[0] + 3 * n[0] / n[1]))
        model.p[name][:, 0] = np.clip(odds, -4, 4) * (hits.sum(0) > 2)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step, taken = 0, 0
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    for turn in range(rounds):
        if turn:
            doc, start, size, logit = Scorer(model).windows(lists)
        else:  # by the odds of words and stems alone
            odd_of = {x: max(model.p["embed"][bucket(x), 0] - 1, 0) + max(model.p["stem"][bucket(x[:STEM]), 0] - 1, 0) for x in set().union(*lists)}
            value = [np.concatenate([[0.0], np.cumsum([odd_of[x] for x in w])]) for w in lists]
            spans = [(i, s) for i, w in enumerate(lists) for s in range(0, max(1, len(w) - STRIDE), STRIDE)]
            doc, start = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
            size = np.minimum(WINDOW, np.array([len(lists[i]) for i in doc]) - start)
            logit = np.array([value[i][s + k] - value[i][s] for i, s, k in zip(doc, start, size, strict=True)])
        order = np.lexsort((rng.random(len(doc)), -logit, doc))
        chosen = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
        more = rng.permutation(np.flatnonzero(labels[doc] == 0))[: len(chosen) // 2]
        chosen = rng.permutation(np.concatenate([chosen, more]))
        for lo in range(0, len(chosen), batch):
            own = chosen[lo : lo + batch]
            own = own[size[own] > 0]
            if not len(own):
                continue
            cut = [lists[doc[k]][start[k] : start[k] + size[k]] for k in own]
            kinds = by_length(set().union(*cut))
            number = {w: i for i, w in enumerate(kinds)}
            s = size[own]
            steps = np.arange(int(s.max()))
            at = np.zeros((len(steps), len(own)), np.int64)
            for k, w in enumerate(cut):
                at[: len(w), k] = [number[x] for x in w]
            mask = steps[:, None] < s
            at_back = np.where(mask, np.take_along_axis(at, np.where(mask, s - 1 - steps[:, None], 0), 0), 0)
            kv: dict = {}
            kl: dict = {}
            g = {k: np.zeros_like(v) for k, v in model.p.items()}
            vectors = model.vectors(kinds, kv)
            xf, xb = model.project(vectors)
            out = model.logits(xf[at], xb[at_back], s, kl)
            d = ((sigmoid(out) - labels[doc[own]]) * weight[doc[own]] / len(own)).astype(f32)
            dxf, dxb = model.logits_back(d, kl, g)
            dv = np.zeros_like(vectors)
            for side, dx, where in (("f", dxf, at), ("b", dxb, at_back)):
                total = np.zeros((len(kinds), 3 * H_WORD), f32)
                np.add.at(total, where.reshape(-1), dx.reshape(-1, 3 * H_WORD))
                g[f"w{side}"], g[f"b{side}"] = vectors.T @ total, total.sum(0)
                dv += total @ model.p[f"w{side}"].T
            model.vectors_back(dv, kv, g)
            step += 1
            for k, v in model.p.items():
                m, q = moment[k]
                m += (g[k] - m) * f32(0.1)
                q += (g[k] * g[k] - q) * f32(0.01)
                v -= f32(rate * (1 - turn / rounds)) * (m / f32(1 - 0.9**step)) / (np.sqrt(q / f32(1 - 0.99**step)) + f32(1e-6))
            if turn + 1 == rounds:
                taken += 1
                for k, v in model.p.items():
                    mean[k] += v
    # the mean of the last round's steps: single steps of a small batch move the scores of rare words by much
    if taken:
        model.p = {k: v / f32(taken) for k, v in mean.items()}
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(scorer.scores(texts))], names=["_id", "score"])

    return run


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, positive: int, negative: int) -> tuple[DataFrame, dict[int, int]]:
    """(_id, y, text) of the sample, at most positive + negative rows, and how many labelled ids each class has."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and _id is not null")
    known = known.groupBy("_id").agg(F.max("y").alias("y")).where(F.crc32(F.col("_id").cast("string")) % 4 != 2)
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    some = None
    for y, n in ((0, negative), (1, positive)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
        some = part if some is None else some.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null")
    return texts.join(F.broadcast(some), "_id").groupBy("_id", "y").agg(F.min("text").alias("text")), share  # of an id with several texts the least


def _weights(y: np.ndarray, share: dict[int, int]) -> np.ndarray:
    got = np.maximum(1, np.bincount(y, minlength=2))
    weight = np.array([share.get(k, 0) / got[k] for k in (0, 1)]) / max(1, sum(share.values())) * got.sum()
    return weight[y].astype(f32)


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, positive: int, negative: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most so many labelled documents of each class, those with the least hash of the id, one
    text for each id; weights restore the classes' shares. Rows without id, text or label are left out."""
    one, share = _labelled(docs, labels, id_col, text_col, label_col, positive, negative)
    rows = one.orderBy("_id").collect()  # at most positive + negative rows
    y = np.array([r["y"] for r in rows], np.int64)
    return [r["text"] for r in rows], y, _weights(y, share)


def _fit_task(share: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            y += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        labels = np.array(y, np.int64)
        p = fit(texts, labels, _weights(labels, share)).p
        yield pa.RecordBatch.from_arrays([pa.array(list(p)), pa.array([list(v.shape) for v in p.values()], pa.list_(pa.int64())), pa.array([v.astype(f32).tobytes() for v in p.values()], pa.binary())], names=["name", "shape", "data"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, positive: int, negative: int) -> Model:
    """The model of training_sample(), fitted in one task: the driver holds neither texts nor the training's arrays, only the weights."""
    one, share = _labelled(docs, labels, id_col, text_col, label_col, positive, negative)
    own = one.repartition(1).sortWithinPartitions("_id").select("y", "text")
    model = Model()
    for r in own.mapInArrow(_fit_task(share), "name string, shape array<long>, data binary").collect():
        model.p[r["name"]] = np.frombuffer(bytes(r["data"]), f32).reshape(r["shape"]).copy()
    return model


def _appended(model: Model, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            score = [scorer.scores(texts) for _, _, texts in text_slices(batch, batch.schema.names[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(score) if score else [], pa.float64())], names=[*batch.schema.names, name])

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, positive: int = POSITIVE, negative: int = NEGATIVE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores under the threshold; fitted as in toxicity(). Columns may have any names."""
    model = fitted(docs, labels, id_col, text_col, label_col, positive, negative)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    kept = plain.mapInArrow(_appended(model, docs.columns.index(text_col), "score"), schema).where(F.col("score") < threshold)
    return kept.drop("score").toDF(*docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, positive: int = POSITIVE, negative: int = NEGATIVE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: Model | None = None) -> DataFrame:
    """(id, held_out, score, predicted) of every whole text, a row for each input row.

    Fitted on labelled rows whose crc32(id as text) mod 4 is not 2; the others are held out. The fit takes at most
    `positive` and `negative` documents; scoring reads only the text. Null and empty texts have one empty window and its
    score. A null id is not held out. Without labels of both classes all scores are those of the untrained network.
    """
    if model is None:
        model = fitted(docs, labels, id_col, text_col, label_col, positive, negative)
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    scored = narrow.mapInArrow(_scored(model), "_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select(F.col("_id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
