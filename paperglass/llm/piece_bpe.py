"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes one symbol for each character, spaces as their mark. An agenda holds the adjacent pairs that form a
piece, highest score first and the leftmost of equals; the pair that comes up is merged, and the pairs with
its new neighbours join the agenda. Symbols that are no piece at the end come out as their bytes. No piece holds the space mark
behind another character, so a text is encoded in stretches that begin with a run of spaces, and stretches that
repeat are encoded once. The agendas of short stretches stand side by side in one array, that of a long one is a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, filterfalse, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperglass.llm.bpe import PairTable
from paperglass.llm.common import text_slices

SPACE = "▁"
#: Stretches that a worker keeps encoded, and the longest of them; beyond the count it starts anew.
STRETCHES, KEPT_LENGTH = 1_000_000, 64
_STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")
_NONE, _OUTSIDE = (1 << 31) - 1, 1 << 28
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def decoded_run(raw: bytes) -> str:
    """The text of neighbouring byte pieces; each byte that begins no whole character is a replacement mark of its own."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        size = next((n for n in range(1, 5) if _is_character(raw[at : at + n])), 0)
        out.append(raw[at : at + size].decode() if size else "�")
        at += size or 1
    return "".join(out)


def _stretches(text: str) -> list[str]:
    """The stretches of a text, each without its first space mark; the first has the dummy prefix."""
    if not text:
        return []
    if "  " not in text and SPACE not in text and text[0] != " ":
        return text.split(" ")
    return [s[1:] for s in _STRETCH.findall(SPACE + text.replace(" ", SPACE))]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


class PieceVocabulary:
    """Scores, ids and surfaces of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and model.trainer_spec.byte_fallback):
            raise ValueError("only merge-type models with byte fallback, a dummy prefix and no normalization are read")
        if not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with user-defined or unused pieces or with spaces as suffixes are not read")
        score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in score):
            raise ValueError("the space mark may stand at the beginning of a piece only")
        order = {x: k for k, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in score.items()}.get  # equal scores share a rank
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.n_ids = len(model.pieces)
        # symbols are the ids of pieces, then characters that only stand inside pieces; any other is _OUTSIDE and its code
        self.loose = sorted({c for p in self.id_of for c in p} - self.id_of.keys())
        symbol = self.id_of | {c: self.n_ids + k for k, c in enumerate(self.loose)}
        self.symbol = np.full(0x110000, -1, np.int64)
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        splits = [(symbol[p[:k]], symbol[p[k:]], self.rank(p), i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.pairs = PairTable(*np.array(splits, np.int64).reshape(-1, 4).T)
        self.bytes_id = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.surface: list[str] = []
        self.mark = [False] * len(model.pieces)  # pieces whose first space mark is the dummy prefix at the beginning
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.byte_of[i] = int(p.piece[1:-1], 16)
                self.bytes_id[self.byte_of[i]] = i
            self.mark[i] = p.type == _NORMAL and p.piece.startswith(SPACE)
            self.surface.append({_CONTROL: "", _UNKNOWN: model.trainer_spec.unk_surface}.get(p.type, p.piece.replace(SPACE, " ")))
        if len(self.byte_of) != 256:
            raise ValueError("every byte needs a piece")
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.type == _CONTROL and p.piece == (model.trainer_spec.eos_piece or "</s>"))
        self.decimal = [str(i) for i in range(len(model.pieces))].__getitem__
        self.kept: dict[str, bytes] = {}

    def _by_heap(self, stretch: str) -> list[int]:
        """The ids of one stretch, its agenda a heap."""
        rank = self.rank
        symbol, n = [SPACE, *stretch], len(stretch) + 1
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(r, i, p) for i, p in enumerate(map("".join, pairwise(symbol))) if (r := rank(p)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            # a symbol that has gone is empty; one that has grown since gives a longer pair
            if not symbol[i] or j < 0 or len(symbol[i]) + len(symbol[j]) != len(pair):
                continue
            symbol[i], symbol[j] = pair, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(p := pair + symbol[k])) is not None:
                    heapq.heappush(agenda, (r, i, p))
            h = before[i]
            if h >= 0 and (r := rank(p := symbol[h] + pair)) is not None:
                heapq.heappush(agenda, (r, h, p))
        out: list[int] = []
        for piece in symbol:
            if piece:
                i = self.id_of.get(piece)
                out += [i] if i is not None else [self.bytes_id[b] for b in piece.encode()]
        return out

    def _side_by_side(self, stretches: list[str]) -> list[bytes]:
        """The ids of many short stretches, their agendas side by side in one array: each round takes every stretch's best pair, the
        leftmost of equals, and puts the pairs with its new neighbours in. Stretches without a pair leave."""
        size = np.fromiter(map(len, stretches), np.int64, len(stretches)) + 1
        code = np.frombuffer((SPACE + SPACE.join(stretches)).encode("utf-32-le"), np.uint32)
        symbol = self.symbol[code]
        symbol = np.where(symbol < 0, _OUTSIDE + code.astype(np.int64), symbol)
        owner = np.arange(len(stretches))
        rank = np.append(self._ranks(symbol[:-1], symbol[1:]), _NONE)
        rank[np.cumsum(size) - 1] = _NONE
        done = [b""] * len(stretches)
        while len(owner):
            begin = np.cumsum(size) - size
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), begin)
            on = best >> 32 != _NONE
            if not on.all():
                self._put(done, owner[~on], symbol, begin[~on], size[~on])
                stay = np.repeat(on, size)
                kept_at = np.cumsum(stay) - 1
                symbol, rank, owner, size = symbol[stay], rank[stay], owner[on], size[on]
                at = kept_at[best[on] & 0xFFFFFFFF]
            else:
                at = best & 0xFFFFFFFF
            if not len(owner):
                break
            symbol[at] = self.pairs.merged[self.pairs.find(symbol[at], symbol[at + 1])]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one symbol of every stretch before has gone
            symbol, rank, size = symbol[keep], rank[keep], size - 1
            first = np.cumsum(size) - size
            left, right = at > first, at < first + size - 1
            rank[at[left] - 1] = self._ranks(symbol[at[left] - 1], symbol[at[left]])
            rank[at] = _NONE
            rank[at[right]] = self._ranks(symbol[at[right]], symbol[at[right] + 1])
        return done

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, table = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), self.pairs
        slot = table.find(left, right)
        return np.where(table.keys[slot] == keys, table.rank[slot].astype(np.int64), _NONE)

    def _put(self, done: list[bytes], owner: np.ndarray, symbol: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        raw = symbol.astype("<i4").tobytes()
        for k, a, n in zip(owner.tolist(), (4 * begin).tolist(), (4 * size).tolist(), strict=True):
            done[k] = raw[a : a + n]
        for k in np.flatnonzero(np.maximum.reduceat(symbol, begin) >= self.n_ids).tolist():
            ids: list[int] = []
            for i in symbol[begin[k] : begin[k] + size[k]].tolist():
                ids += [i] if i < self.n_ids else [self.bytes_id[b] for b in (self.loose[i - self.n_ids] if i < _OUTSIDE else chr(i - _OUTSIDE)).encode()]
            done[owner[k]] = _packed(ids)

    def encode_all(self, texts: list[str], end: bool = True) -> list[np.ndarray]:
        """The ids of whole texts."""
        kept, parts = self.kept, [_stretches(t) for t in texts]
        missing = set(chain.from_iterable(filterfalse(kept.__contains__, p) for p in parts))
        if len(kept) + len(missing) > STRETCHES:
            kept.clear()
            missing = set(chain.from_iterable(parts))
        short = [s for s in missing if len(s) < KEPT_LENGTH]
        if short:
            kept.update(zip(short, self._side_by_side(short), strict=True))
        long = {s: _packed(self._by_heap(s)) for s in missing if len(s) >= KEPT_LENGTH}
        found = kept.__getitem__ if not long else lambda s: long[s] if s in long else kept[s]
        tail = [_packed([self.end_id])] if end else []
        return [np.frombuffer(b"".join([*map(found, p), *tail]), "<i4") for p in parts]

    def encode(self, text: str, end: bool = True) -> list[int]:
        return self.encode_all([text], end)[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: the first piece loses its dummy prefix, byte pieces that follow one another are read as UTF-8.

        Ids outside the vocabulary raise an error."""
        if ids and not 0 <= min(ids) <= max(ids) < self.n_ids:
            raise ValueError("an id is outside the vocabulary")
        surface, byte_of = self.surface, self.byte_of
        start, gone = 0, False
        opening: list[str] = []
        # until something is written, a piece may begin with the dummy prefix
        while start < len(ids) and not gone and ids[start] not in byte_of:
            i = ids[start]
            opening.append(surface[i][1:] if self.mark[i] else surface[i])
            gone = self.mark[i] or bool(opening[-1])
            start += 1
        rest = ids[start:]
        if byte_of.keys().isdisjoint(rest):
            return "".join([*opening, *map(surface.__getitem__, rest)])
        out, run = opening, bytearray()
        for i in rest:
            b = byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(decoded_run(bytes(run)))
                run.clear()
            out.append(surface[i])
        return "".join(out) + decoded_run(bytes(run))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)))


_LOADED: dict[str, PieceVocabulary] = {}


def vocabulary(path: str) -> PieceVocabulary:
    """The vocabulary of a model file, read once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceVocabulary(path)
    return _LOADED[path]


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(_id, text) and the type of the id."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow, narrow.schema["_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every whole text, a row for each input row.

    A null text counts as empty: the end id only. Null ids and repeated rows give a row each, very long texts are whole, an
    empty table gives no rows. Other columns are not read, and their names do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text"):
                ids = _lists(words.encode_all(texts, end))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], names=["_id", "ids"])

    narrow, kind = _narrow(docs, id_col, text_col)
    return narrow.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every list of ids. Null lists give null texts, empty ones empty texts; an id outside the vocabulary fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = [None if ids is None else words.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    narrow, kind = _narrow(rows, id_col, ids_col)
    return narrow.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded with the end id and decoded again.

    Nulls, empty texts, repeats and an empty table are handled as in `encode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text"):
                n, of_ids, of_text = [], [], []
                for ids in map(np.ndarray.tolist, words.encode_all(texts)):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(words.decimal, ids)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(words.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    narrow, kind = _narrow(docs, id_col, text_col)
    return narrow.mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)


def differences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, library_ids, text, library_text) of the texts that the sentencepiece library encodes or decodes in another way.

    The library runs beside the agenda over the same Arrow batches. It is expected to find none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        words, library = vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            for lo, _, texts in text_slices(batch, "text"):
                told = library.encode(texts, add_eos=True, num_threads=1)
                ours = [x.tolist() for x in words.encode_all(texts)]
                found = [(ids, told[k], words.decode(ids), library.decode(told[k])) for k, ids in enumerate(ours)]
                at = [k for k, (a, b, c, d) in enumerate(found) if a != b or c != d]
                columns = list(zip(*(found[k] for k in at), strict=True)) if at else [[]] * 4
                kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([lo + k for k in at], pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["_id", "ids", "library_ids", "text", "library_text"]
                )

    narrow, kind = _narrow(docs, id_col, text_col)
    return narrow.mapInArrow(run, f"_id {kind}, ids array<int>, library_ids array<int>, text string, library_text string").withColumnRenamed("_id", id_col)
