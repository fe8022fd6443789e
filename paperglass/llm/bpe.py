"""Byte-level BPE on padded numpy matrices.

Pieces of text are bucketed by byte length, each bucket is one padded matrix of token ids, and in each round every row
merges its leftmost pair of least rank. Pair ranks come from an open-addressing hash table in numpy; finished rows are
compacted away. Pieces beyond the last bucket are rows of their own width, which merge all places of their least pair at
once, as far as no pair that arises would come before the next of them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperglass.llm.common import text_slices

NONE = np.int32(2**31 - 1)
#: Upper byte lengths of the buckets.
BUCKETS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
#: Words that a worker keeps encoded; beyond them it starts anew.
WORDS = 1_500_000


class PairTable:
    """Hashed lookup of (left id, right id) -> (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NONE, dtype=np.int32)
        self.merged = np.full(size, -1, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            winners, first = np.unique(slot[free], return_index=True)
            rows = todo[free][first]
            self.keys[winners], self.rank[winners], self.merged[winners] = keys[rows], rank[rows], merged[rows]
            left_over = np.ones(len(todo), dtype=bool)
            left_over[np.flatnonzero(free)[first]] = False
            todo, slot = todo[left_over], (slot[left_over] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a slot whose key differs stands for an absent pair and has rank NONE."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        got = self.keys[slot]
        open_ = np.flatnonzero((got != keys) & (got != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[open_]]
            open_ = open_[(got != keys[open_]) & (got != np.uint64(2**64 - 1))]
        return slot


class Vocabulary:
    """Token bytes, whole-piece ids, single-byte ids and the pair table of one vocabulary file."""

    def __init__(self, token_bytes: dict[int, bytes], pairs: tuple[np.ndarray, ...], whole: dict[bytes, int]):
        self.bytes_of, self.whole = token_bytes, whole
        ids = {b: i for i, b in token_bytes.items()}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int32)
        self.n_ids = max(token_bytes) + 1
        self.pairs = PairTable(*pairs)

    @classmethod
    def of_ranks(cls, path: str) -> Vocabulary:
        """A rank file: any two tokens whose joined bytes are a token merge, in the order of its rank."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        pairs = [(ranks[t[:k]], ranks[t[k:]], r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        columns = tuple(np.array(pairs, dtype=np.int64).T)
        return cls({r: t for t, r in ranks.items()}, columns, ranks)

    @classmethod
    def of_json(cls, path: str) -> Vocabulary:
        """A merge-list file: the pairs of its list merge, in the order of the list."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        back = {c: b for b, c in printable_bytes().items()}
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(merges)], dtype=np.int64)
        return cls({i: bytes(back[c] for c in t) for t, i in vocab.items()}, tuple(pairs.T), {})

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces, each merged by itself, end to end, and where each piece's ids begin and end."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        bucket = np.searchsorted(BUCKETS, lengths)
        ids, rows, sizes = [], [], []
        for k in np.unique(bucket[lengths > 0]):
            own = np.flatnonzero((bucket == k) & (lengths > 0))
            if k == len(BUCKETS):
                for i in own:
                    ids.append(self._by_row(pieces[i]))
                    rows.append(np.array([i]))
                    sizes.append(np.array([len(ids[-1])]))
            else:
                step = max(1, (1 << 20) // BUCKETS[k])
                for at in range(0, len(own), step):
                    for flat, done, n in self._by_matrix(pieces, own[at : at + step], lengths):
                        ids.append(flat)
                        rows.append(done)
                        sizes.append(n)
        count = np.zeros(len(pieces) + 1, dtype=np.int64)
        if not rows:
            return np.zeros(0, np.int32), count
        flat, row, size = np.concatenate(ids), np.concatenate(rows), np.concatenate(sizes)
        count[row + 1] = size
        bounds = np.cumsum(count)
        out = np.empty(len(flat), dtype=np.int32)
        begin = np.cumsum(size) - size
        out[np.repeat(bounds[row] - begin, size) + np.arange(len(flat))] = flat
        return out, bounds

    def _by_matrix(self, pieces: list[bytes], rows: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        n = lengths[rows].copy()
        width = int(n.max())
        flat = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in rows.tolist()]), dtype=np.uint8)]
        ids = np.full((len(rows), width + 1), -1, dtype=np.int32)
        ids[:, :width][np.arange(width) < n[:, None]] = flat
        rank = np.full((len(rows), width), NONE, dtype=np.int32)
        at = np.full((len(rows), width), -1, dtype=np.int32)
        paired = np.arange(width) < (n - 1)[:, None]
        found = self.pairs.find(ids[:, :width][paired], ids[:, 1:][paired])
        rank[paired], at[paired] = self.pairs.rank[found], found
        if self.whole:  # a piece that is a token is that token
            token = np.array([self.whole.get(pieces[i], -1) for i in rows.tolist()], dtype=np.int32)
            hit = token >= 0
            ids[hit, 0], n[hit] = token[hit], 1
            rank[hit] = NONE
        while len(rows):
            best = rank.argmin(1)
            line = np.arange(len(rows))
            live = rank[line, best] != NONE
            if not live.all():
                done = np.flatnonzero(~live)
                yield ids[done, :width][np.arange(width) < n[done, None]], rows[done], n[done]
                rows, n, best = rows[live], n[live], best[live]
                if not len(rows):
                    return
                width = int(n.max())
                ids, rank, at = ids[live, : width + 1], rank[live, :width], at[live, :width]
                line = np.arange(len(rows))
            ids[line, best] = self.pairs.merged[at[line, best]]
            shift = np.arange(width) > best[:, None]  # what stands right of the merged pair moves left by one
            np.copyto(ids[:, :width], ids[:, 1:].copy(), where=shift)
            ids[:, width] = -1
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=shift[:, :-1])
            np.copyto(at[:, :-1], at[:, 1:].copy(), where=shift[:, :-1])
            n -= 1
            rank[line, n] = NONE
            for side in (best - 1, best):
                real = np.flatnonzero((side >= 0) & (side + 1 < n))
                where = side[real]
                found = self.pairs.find(ids[real, where], ids[real, where + 1])
                rank[real, where], at[real, where] = self.pairs.rank[found], found
            rank[line, n - 1] = NONE

    def _by_row(self, piece: bytes) -> np.ndarray:
        if piece in self.whole:
            return np.array([self.whole[piece]], np.int32)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        none = np.full(1, NONE)
        at = self.pairs.find(ids[:-1], ids[1:])
        rank, at = np.concatenate([self.pairs.rank[at], none]), np.concatenate([at, [-1]])

        def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            real = (left >= 0) & (right >= 0)
            out = np.full(len(left), NONE)
            out[real] = self.pairs.rank[self.pairs.find(left[real], right[real])]
            return out

        while (least := rank.min()) != NONE:
            own = np.flatnonzero(rank == least)
            opens = np.concatenate([[True], np.diff(own) > 1])  # of places that overlap every other one merges
            own = own[(own - own[opens][np.cumsum(opens) - 1]) % 2 == 0]
            new = self.pairs.merged[at[own]]
            padded = np.concatenate([[-1], ids, [-1, -1]])
            left = np.where(np.concatenate([[False], np.diff(own) == 2]), np.concatenate([[-1], new[:-1]]), padded[own])
            early = np.flatnonzero((rank_of(left, new) <= least) | (rank_of(new, padded[own + 3]) <= least))
            if len(early):
                own, new = own[: early[0] + 1], new[: early[0] + 1]
            ids[own] = new
            keep = np.ones(len(ids), bool)
            keep[own + 1] = False
            ids, rank, at = ids[keep], rank[keep], at[keep]
            place = own - np.arange(len(own))
            redo = np.unique(np.concatenate([place - 1, place]))
            redo = redo[redo >= 0]
            rank[-1], redo = NONE, redo[redo + 1 < len(ids)]
            at[redo] = self.pairs.find(ids[redo], ids[redo + 1])
            rank[redo] = self.pairs.rank[at[redo]]
        return ids


def printable_bytes() -> dict[int, str]:
    """The character that stands for each byte in merge-list files: itself where printable, else the next from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once in each worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary.of_json(path) if path.endswith(".json") else Vocabulary.of_ranks(path)
    return _VOCABULARIES[path]


_UNSETTLED: list = []


def unsettled(text: str) -> bool:
    """Whether a text has characters that this Python's Unicode tables do not assign, whose class is a matter of version."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        pass
    if not _UNSETTLED:
        spans, start = [], None
        for cp in range(0x110001):
            free = cp < 0x110000 and unicodedata.category(chr(cp)) == "Cn"
            if free and start is None:
                start = cp
            elif not free and start is not None:
                spans.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
                start = None
        _UNSETTLED.append(regex.compile(f"[{''.join(spans)}]"))
    return _UNSETTLED[0].search(text) is not None


class Settled:
    """Stand-ins for characters that this Python's Unicode tables do not assign: a letter, digit or sign of the class that
    the library gives them. The library tells by whether it keeps a character in one piece with a letter, digit or sign."""

    def __init__(self, pattern: str):
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)}
        for sign in "x1!":
            for lead in range(0xC2, 0xF5):
                ranks[sign.encode() + bytes([lead])] = len(ranks)
        self.library = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, str] = {}

    def __call__(self, text: str) -> str:
        for c in set(text):
            if c not in self.known:
                free = unicodedata.category(c) == "Cn"
                self.known[c] = next((sign for sign in "x1!" if self.library.encode_ordinary(sign + c)[0] > 255), c) if free else c
        return "".join(map(self.known.__getitem__, text))


def ragged(store: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs store[start : start + size], end to end."""
    ends = np.cumsum(sizes)
    return store[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Runs:
    """A growing list of runs in one flat array."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.start, self.size, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) > len(self.size):
            self.start, self.size = np.concatenate([self.start, self.start * 0]), np.concatenate([self.size, self.size * 0])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(sizes)] = sizes
        self.used, self.n = self.used + len(flat), self.n + len(sizes)


class TextEncoder:
    """Ids of whole texts, put together from the ids of the words between single spaces.

    A space before a character that is not white space always starts a piece, so such words can be encoded by
    themselves; texts with other spaces are split whole. Words are found by a hash in a numpy table, compared byte by
    byte, and kept up to WORDS.
    """

    FIRST = np.uint64(0x5851F42D4C957F2D)
    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.split, self.pattern, self.stand_in = vocab, regex.compile(pattern).findall, pattern, None
        self.powers = self.inverse = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.word_at = np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int32)
        self.ids, self.text = Runs(np.int32), Runs(np.uint8)

    def _hashes(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(raw):
            step = np.ones(len(raw) * 2, np.uint64)
            step[1:] = np.uint64(self.BASE)
            self.powers = np.cumprod(step, dtype=np.uint64)
            step[1:] = np.uint64(pow(self.BASE, -1, 2**64))
            self.inverse = np.cumprod(step, dtype=np.uint64)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start]
        h ^= (end - start).astype(np.uint64) << np.uint64(40)
        h[first] ^= self.FIRST
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.maximum(h, np.uint64(1))  # 0 marks a free slot

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        got = self.keys[slot]
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            got = self.keys[slot[open_]]
            open_ = open_[(got != h[open_]) & (got != 0)]
        return np.where(self.keys[slot] == h, self.word_at[slot], -1)

    def _insert(self, h: np.ndarray, words: np.ndarray) -> None:
        size = len(self.keys)
        todo, slot = np.arange(len(h)), (h & np.uint64(size - 1)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            taken, winner = np.unique(slot[free], return_index=True)
            rows = todo[free[winner]]
            self.keys[taken], self.word_at[taken] = h[rows], words[rows]
            left = np.ones(len(todo), bool)
            left[free[winner]] = False
            todo, slot = todo[left], (slot[left] + 1) & (size - 1)

    def _learn(self, h: np.ndarray, words: list[tuple[bool, bytes]]) -> np.ndarray:
        """Adds words and returns which of them can stand by themselves."""
        shown = [w.decode() for _, w in words]
        fits = np.array([first or not (w == "" or w[0].isspace()) for (first, _), w in zip(words, shown, strict=True)], dtype=bool)
        keep = np.flatnonzero(fits).tolist()
        lists = [self._pieces(shown[i], words[i][0]) for i in keep]
        pieces = list(set().union(*lists))
        flat, bounds = self.vocab.encode([p.encode() for p in pieces])
        number = {p: k for k, p in enumerate(pieces)}
        order = np.array([number[p] for found in lists for p in found], dtype=np.int64)
        n_pieces = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        sizes = (bounds[1:] - bounds[:-1])[order]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        last = np.cumsum(n_pieces)
        if len(keep):
            known = self.ids.n
            self.ids.append(ragged(flat, bounds[:-1][order], sizes), upto[last] - upto[last - n_pieces])
            own = [words[i][1] for i in keep]
            self.text.append(np.frombuffer(b"".join(own), np.uint8), np.fromiter(map(len, own), np.int64, len(own)))
            if self.ids.n * 4 > len(self.keys):
                full = self.keys != 0
                old, at = self.keys[full], self.word_at[full]
                size = 1 << int(np.ceil(np.log2(self.ids.n * 8)))
                self.keys, self.word_at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
                self._insert(old, at)
            self._insert(h[keep], np.arange(known, self.ids.n, dtype=np.int32))
        return fits

    def _pieces(self, word: str, first: bool) -> list[str]:
        if first:
            return self.split(word)
        if word.isalpha():
            return [" " + word]
        if word[:-1].isalpha() and word[-1] in ",.":
            return [" " + word[:-1], word[-1]]
        return self.split(" " + word)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, end to end, and the bounds of each text in them."""
        if self.ids.n > WORDS:
            self._clear()
        coded = [t.encode() for t in texts]
        raw = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        text_end = np.cumsum(length + 1) - 1
        end = np.flatnonzero(raw == 32)
        start = np.concatenate([[0], end[:-1] + 1])
        last = np.searchsorted(end, text_end)  # the last word of each text
        first = np.zeros(len(end), bool)
        first[np.concatenate([[0], last[:-1] + 1])] = True
        h = self._hashes(raw, start, end, first)
        word = self._find(h)
        new_h, at = np.unique(h[word < 0], return_index=True)
        at = np.flatnonzero(word < 0)[at]
        if len(new_h):
            whole = raw.tobytes()
            self._learn(new_h, [(f, whole[a:b]) for f, a, b in zip(first[at].tolist(), start[at].tolist(), end[at].tolist(), strict=True)])
            word = self._find(h)
        good = word >= 0
        good[good] = self.text.size[word[good]] == (end - start)[good]
        same = ragged(self.text.flat, self.text.start[word[good]], self.text.size[word[good]]) == ragged(raw, start[good], (end - start)[good])
        if not same.all():
            good[np.flatnonzero(good)[np.searchsorted(np.cumsum(self.text.size[word[good]]), np.flatnonzero(~same), side="right")]] = False
        size = np.where(good, self.ids.size[word], 0)
        flat = ragged(self.ids.flat, np.where(good, self.ids.start[word], 0), size)
        bounds = np.concatenate([[0], np.cumsum(size)[last]])
        odd = np.unique(np.searchsorted(last, np.flatnonzero(~good)))
        if len(odd):
            parts = [flat[a:b] for a, b in pairwise(bounds.tolist())]
            for i in odd.tolist():
                parts[i] = self._whole(texts[i], texts[i])
            flat, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return flat, bounds


    def _whole(self, text: str, shown: str) -> np.ndarray:
        """The ids of a text that is split as `shown`, of the same length, is."""
        ends = np.cumsum([len(p) for p in self.split(shown)]).tolist()
        found = [text[a:b] for a, b in pairwise([0, *ends])]
        pieces = list(dict.fromkeys(found))
        own, cut = self.vocab.encode([p.encode() for p in pieces])
        number = {p: k for k, p in enumerate(pieces)}
        order = np.array([number[p] for p in found], dtype=np.int64)
        return ragged(own, cut[:-1][order], (cut[1:] - cut[:-1])[order])

    def settled(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As a call, but texts with unassigned characters are split by the classes that the library gives these."""
        odd = [i for i, t in enumerate(texts) if unsettled(t)]
        if not odd:
            return self(texts)
        self.stand_in = self.stand_in or Settled(self.pattern)
        skip = set(odd)
        flat, bounds = self(["" if i in skip else t for i, t in enumerate(texts)])
        parts = [flat[a:b] for a, b in pairwise(bounds.tolist())]
        for i in odd:
            parts[i] = self._whole(texts[i], self.stand_in(texts[i]))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


class Shown:
    """Byte strings of ids, joined by gathering."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        upto = np.concatenate([[0], np.cumsum(self.size[ids])])[bounds].tolist()
        raw = ragged(self.flat, self.start[ids], self.size[ids]).tobytes()
        return [raw[a:b] for a, b in pairwise(upto)]


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = TextEncoder(vocab, pattern)
        ids_shown, bytes_shown = Shown([b",%d" % i for i in range(vocab.n_ids)]), Shown([vocab.bytes_of.get(i, b"") for i in range(vocab.n_ids)])
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text"):
                ids, bounds = encoder.settled(texts)
                ids_hash = [hashlib.sha256(x[1:]).hexdigest() for x in ids_shown.join(ids, bounds)]
                text_hash = [hashlib.sha256(x).hexdigest() for x in bytes_shown.join(ids, bounds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(ids_hash), pa.array(text_hash)], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: (id, n_tokens, ids_sha256, decoded_sha256), a row for each input row.

    A null text counts as empty: no tokens and the digests of the empty string. Repeated rows and null ids give a row
    each; other columns are ignored, whatever their names. Texts of any length are encoded whole. Characters unknown to this
    Python's Unicode tables count as letters, digits or signs as in the library.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    out = narrow.mapInArrow(_digests(path, pattern), "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col)


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(vocabulary(path), pattern)
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text"):
                ids, bounds = encoder.settled(texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text; a null text has no ids."""
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_ids(path, pattern), "_id long, ids array<int>").withColumnRenamed("_id", id_col)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            raw = [None if ids is None else b"".join(vocab.bytes_of.get(i, b"") for i in ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["_id", "bytes"])

    return run


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) of id lists; null lists stay null and ids outside the vocabulary give no bytes."""
    narrow = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("ids"))
    return narrow.mapInArrow(_decoded(path), "_id long, bytes binary").withColumnRenamed("_id", id_col)
