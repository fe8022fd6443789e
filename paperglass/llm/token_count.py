"""Token counts by a compiled finite-state transducer.

The vocabulary of a score-ordered BPE is compiled into a deterministic transducer over characters. A state holds, for the
longest suffix that may still grow into a token, the last token and the relative count at each of its positions; a
transition is annotated with the tokens it emits, which may be negative where a new character merges earlier tokens.
Transitions are compiled when first needed and kept in a numpy hash table. Texts run in chunks, all chunks in step. A
place that no token spans resets the state, so behind its first reset a chunk's state map is constant. Before it, a chunk
has a map from the states that can enter it to an exit state: it is run from each of them, which are the exits of the maps
before it, until all exits are known as entries. The maps compose by a parallel prefix scan, in steps that
double, to the state that each chunk is really entered with; its head then emits its counts, all heads in step.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperglass.llm.common import text_slices

SPACE = "▁"
CHUNK = 64
#: Compiled transitions that a worker keeps; beyond them it starts anew.
TRANSITIONS = 3_000_000


def merges(text: str, score: dict[str, float]) -> list[str]:
    """BPE of a short string: the pair of highest score first, of equals the leftmost."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def run_tokens(length: int, sizes: set[int]) -> int:
    """Tokens of a run of spaces, all of whose merges score the same: the leftmost pair first."""
    size, after, before = [1] * length, list(range(1, length + 1)), list(range(-1, length - 1))
    heap = [(i, 1, 1) for i in range(length - 1)] if 2 in sizes else []
    heapq.heapify(heap)
    left = length
    while heap:
        i, a, b = heapq.heappop(heap)
        j = after[i]
        if size[i] != a or j >= length or size[j] != b:
            continue
        size[i], size[j], left = a + b, 0, left - 1
        after[i] = after[j]
        if after[j] < length:
            before[after[j]] = i
            if size[i] + size[after[j]] in sizes:
                heapq.heappush(heap, (i, size[i], size[after[j]]))
        if before[i] >= 0 and size[before[i]] + size[i] in sizes:
            heapq.heappush(heap, (before[i], size[before[i]], size[i]))
    return left


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and model.trainer_spec.byte_fallback):
            raise ValueError("only models with byte fallback, a dummy prefix and no normalization are compiled")
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        spaces = {p: s for p, s in pieces.items() if len(p) > 1 and not p.strip(SPACE)}
        self.score = {p: s for p, s in pieces.items() if p not in spaces}
        self.run_sizes = {len(p) for p in spaces}
        if len(set(spaces.values())) > 1 or (spaces and max(spaces.values()) >= min(s for p, s in self.score.items() if len(p) > 1)):
            raise ValueError("runs of spaces must merge last and alike")
        self.starts = {p[:k] for p in self.score for k in range(1, len(p))}
        chars = sorted({c for p in self.score for c in p if c in self.score})
        self.symbol = np.zeros(0x110000, np.int32)  # 0: outside the vocabulary, one token for each byte
        self.symbol[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        self.char = ["", *chars]
        joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.score:
            codes = self.symbol[[ord(c) for c in p]]
            joined[codes[:-1], codes[1:]] = True
        self.width = joined.shape[1]
        self.joined = np.packbits(joined.reshape(-1), bitorder="little")
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.runs: dict[int, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [("", (None,), (0,), (False,))]
        self.number = {self.states[0]: 0}
        self.alone = [False]
        self.keys = np.zeros(1 << 18, np.uint64)
        self.to, self.emits = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int16)
        self.n = 0

    def _is_token(self, t: str) -> bool:
        """Whether a piece is what its own string becomes; others never come out."""
        if t not in self.whole:
            self.whole[t] = t in self.score and merges(t, self.score) == [t]
        return self.whole[t]

    def _fit(self, a: str, b: str) -> bool:
        if (a, b) not in self.fits:
            self.fits[a, b] = merges(a + b, self.score) == [a, b]
        return self.fits[a, b]

    def _step(self, state: int, c: str) -> tuple[int, int]:
        suffix, last, count, alone = self.states[state]
        grown = suffix + c
        for k in range(len(grown)):
            t = grown[k:]
            if self._is_token(t) and (last[k] is None or self._fit(last[k], t)):
                emitted, bit = count[k] + 1, t == SPACE if last[k] is None else alone[k]
                break
        keep = next(k for k in range(len(grown) + 1) if grown[k:] in self.starts or k == len(grown))
        new = (grown[keep:], (*last, t)[keep:], tuple(x - emitted for x in (*count, emitted)[keep:]), (*alone, bit)[keep:])
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
            self.alone.append(bit)
        return self.number[new], emitted

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        size = len(self.keys)
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
        got = self.keys[slot]
        open_ = np.flatnonzero((got != keys) & (got != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (size - 1)
            got = self.keys[slot[open_]]
            open_ = open_[(got != keys[open_]) & (got != 0)]
        return slot

    def _compile(self, keys: np.ndarray) -> None:
        if (self.n + len(keys)) * 3 > len(self.keys):
            full = self.keys != 0
            old = self.keys[full], self.to[full], self.emits[full]
            size = 1 << int((self.n + len(keys)) * 6).bit_length()
            self.keys, self.to, self.emits = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, np.int16)
            self._put_all(*old)
        made = [self._step(int(k) >> 20, self.char[int(k) & 0xFFFFF]) for k in keys.tolist()]
        self._put_all(keys, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int16))
        self.n += len(keys)

    def _put_all(self, keys: np.ndarray, to: np.ndarray, emits: np.ndarray) -> None:
        """Inserts new keys; those that meet in a slot take turns."""
        while len(keys):
            slot = self._slots(keys)
            taken, winner = np.unique(slot, return_index=True)
            self.keys[taken], self.to[taken], self.emits[taken] = keys[winner], to[winner], emits[winner]
            left = np.ones(len(keys), bool)
            left[winner] = False
            keys, to, emits = keys[left], to[left], emits[left]

    def _run(self, begin: np.ndarray, end: np.ndarray, state: np.ndarray, symbol: np.ndarray, reset: np.ndarray, states: np.ndarray | None = None, emitted: np.ndarray | None = None) -> np.ndarray:
        """Moves all lanes in step from begin to end, from their entry states, and returns their exit states; writes states
        and counts by position, if asked for."""
        order = np.argsort(begin - end, kind="stable")
        begin, length, state = begin[order], (end - begin)[order], state[order].astype(np.int32)
        longest = int(length.max(initial=0))
        live = len(length) - np.searchsorted(length[::-1], np.arange(longest), side="right")
        for k in range(longest):
            n = live[k]
            at = begin[:n] + k
            c = symbol[at]
            s = np.where(reset[at], 0, state[:n])
            keys = (s.astype(np.uint64) << np.uint64(20)) | c.astype(np.uint64)
            slot = self._slots(keys)
            missing = (self.keys[slot] != keys) & (c > 0)
            if missing.any():
                self._compile(np.unique(keys[missing]))
                slot = self._slots(keys)
            known = c > 0
            s = np.where(known, self.to[slot], 0)
            state[:n] = s
            if states is not None:
                states[at] = s
                emitted[at[known]] = self.emits[slot[known]]
        out = np.empty_like(state)
        out[order] = state
        return out

    def _entries(self, begin: np.ndarray, end: np.ndarray, constant: np.ndarray, states: np.ndarray, symbol: np.ndarray, reset: np.ndarray) -> np.ndarray:
        """The state that each chunk is entered with. A chunk without a reset has a map, as pairs (chunk, entry) with an exit:
        of the exit before it, or of a guess, and then of every exit of the maps before it that is no entry yet."""
        before = np.concatenate([[0], states[end[:-1] - 1]])  # right where the chunk before has a reset
        open_ = np.flatnonzero(~constant)
        if not len(open_):
            return before
        follows = ~constant[open_ - 1]  # chunk 0 begins with a reset
        j, e = open_, np.where(follows, 0, before[open_]).astype(np.int64)
        keys, exits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(j):
            x = self._run(begin[j], end[j], e, symbol, reset).astype(np.int64)
            keys, exits = np.concatenate([keys, (j << 32) | e]), np.concatenate([exits, x])
            on = j + 1 < len(begin)
            on[on] = ~constant[j[on] + 1]
            new = np.setdiff1d(((j[on] + 1) << 32) | x[on], keys)
            j, e = new >> 32, new & 0xFFFFFFFF
        order = np.argsort(keys)
        keys, exits = keys[order], exits[order]
        onward = np.minimum(np.searchsorted(keys, (((keys >> 32) + 1) << 32) | exits), len(keys) - 1)  # the next chunk's pair
        start = np.maximum.accumulate(np.where(follows, 0, open_))
        at = np.searchsorted(keys, (start << 32) | before[start])
        steps = open_ - start
        while steps.any():  # maps of 1, 2, 4, ... chunks
            odd = (steps & 1).astype(bool)
            at[odd] = onward[at[odd]]
            onward, steps = onward[onward], steps >> 1
        inside = open_[open_ + 1 < len(begin)] + 1
        before[inside] = exits[at[: len(inside)]]
        return before

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if self.n > TRANSITIONS:
            self._clear()
        marked = [SPACE + t if t else "" for t in texts]
        length = np.fromiter(map(len, marked), np.int64, len(marked))
        code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        total = len(code)
        out = np.zeros(len(texts), np.int64)
        if not total:
            return out
        symbol = self.symbol[code]
        reset = np.ones(total, bool)
        pair = symbol[:-1].astype(np.int64) * self.width + symbol[1:]
        reset[1:] = ~((self.joined[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1).astype(bool)
        text_at = np.cumsum(length) - length
        reset[text_at[length > 0]] = True
        states, emitted = np.zeros(total, np.int32), np.zeros(total, np.int16)
        outside = symbol == 0
        cp = code[outside]
        emitted[outside] = 1 + (cp > 0x7F) + (cp > 0x7FF).astype(np.int16) + (cp > 0xFFFF)
        begin = np.arange(0, total, CHUNK)
        end = np.minimum(begin + CHUNK, total)
        places = np.flatnonzero(reset)
        first = places[np.minimum(np.searchsorted(places, begin), len(places) - 1)]
        first = np.where((first >= begin) & (first < end), first, end)
        # behind its first reset a chunk's map is constant
        self._run(first, end, np.zeros(len(begin), np.int32), symbol, reset, states, emitted)
        entry = self._entries(begin, end, first < end, states, symbol, reset)
        heads = np.flatnonzero(first > begin)
        self._run(begin[heads], first[heads], entry[heads], symbol, reset, states, emitted)
        upto = np.concatenate([[0], np.cumsum(emitted, dtype=np.int64)])
        out = upto[text_at + length] - upto[text_at]
        return out + self._space_runs(symbol, text_at, length, places, states, total)

    def _space_runs(self, symbol: np.ndarray, text_at: np.ndarray, length: np.ndarray, places: np.ndarray, states: np.ndarray, total: int) -> np.ndarray:
        """What runs of spaces save: their tokens merge last, with the one before a word only if it stands alone there."""
        space = np.concatenate([[False], symbol == self.symbol[ord(SPACE)], [False]])
        opens = np.concatenate([text_at[length > 0], [total]])
        begin = np.flatnonzero(space[1:-1] & ~space[:-2])
        begin = np.union1d(begin, opens[:-1][space[1:-1][opens[:-1]]])
        ends = np.flatnonzero(space[1:-1] & ~space[2:]) + 1
        end = np.minimum(ends[np.searchsorted(ends, begin, side="right")], opens[np.searchsorted(opens, begin, side="right")])
        size = end - begin
        begin, end, size = begin[size > 1], end[size > 1], size[size > 1]
        saved = np.zeros(len(text_at), np.int64)
        if len(size):
            after = np.searchsorted(places, end)
            stop = np.where(after < len(places), places[np.minimum(after, len(places) - 1)], total) - 1
            size = size - 1 + np.array(self.alone)[states[stop]]
            for r in np.unique(size).tolist():
                if r not in self.runs:
                    self.runs[r] = run_tokens(r, self.run_sizes)
            gain = np.array([self.runs[r] - r for r in size.tolist()])
            np.add.at(saved, np.searchsorted(text_at, begin, side="right") - 1, gain)
        return saved


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a model file, compiled once in each worker."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(machine.counts(texts), pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, a row for each input row.

    A null text counts as empty: no bytes and no tokens. Null ids and repeated rows give a row each.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = narrow.mapInArrow(_counted(path), "_id long, n_bytes long, n_tokens long")
    return out.withColumnRenamed("_id", id_col).withColumn("over_limit", F.col("n_tokens") > limit)
