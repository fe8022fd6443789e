"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Windows are as long as the templates of a length class and overlap so far that one of them holds nearly all of any
template that occurs. A window and a template that share all minima of a band meet; the bands of a class make that all
but certain at the containment asked for. A template is found if at least that share of its word shingles occurs in the
window with a margin on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperglass.llm.common import text_slices
from paperglass.llm.license_texts import TEMPLATES

SHINGLE = 5
CONTAINED = 0.8
#: Bands of two minima each. A template that a text holds to 0.8 and the window that lies in it have a Jaccard similarity of
#: 0.47 or more; they meet with probability 1 - (1 - 0.22)^16 > 0.98, and an occurrence has several such windows.
BANDS, ROWS = 16, 2
#: Window sizes in shingles, further ones as 64 and 96 doubled; a template takes the largest that it fills.
WINDOWS = (1, 3, 7, 12, 16, 24, 32, 48, 64, 96)
WORDS = 500_000
WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def window_sizes(longest: int) -> list[int]:
    """All window sizes up to a number of shingles."""
    sizes, last = list(WINDOWS), WINDOWS[-2:]
    while last[0] <= longest:
        last = (2 * last[0], 2 * last[1])
        sizes += last
    return [s for s in sizes if s <= longest]
def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the word shingles of texts."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > WORDS:
            self.known = {}
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w.encode(), 7)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.words + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(self.words):
            out = mix(out + h[k : k + n] + np.uint64(k + 1))
        return out


def minima(h: np.ndarray, seed: int, places: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """The least permuted hash of h[start : start + size] for the starts of each (size, starts), sizes ascending."""
    p = (h ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
    p ^= p >> np.uint64(32)
    p *= np.uint64(0xD6E8FEB86659FD93)
    width, out = 1, []
    for size, starts in places:
        while width * 2 <= size:  # minima of runs of powers of two
            p = np.minimum(p[:-width], p[width:])
            width *= 2
        out.append(p[starts] if size == width else np.minimum(p[starts], p[starts + size - width]))
    return out


class Index:
    """Templates by the size of their windows, in shingles, with the keys of their bands."""

    def __init__(self, templates: dict[str, str], contained: float, words: int):
        self.names, self.contained, self.shingler = list(templates), contained, Shingler(words)
        lists = [self.shingler(words_of(t)) for t in templates.values()]
        self.sets = [np.unique(x) for x in lists]
        sizes = window_sizes(max(map(len, lists), default=0))
        size_of = np.array([max(s for s in sizes if s <= len(x)) for x in lists], np.int64)
        self.sizes = [int(s) for s in np.unique(size_of)]
        self.members = [np.flatnonzero(size_of == s) for s in self.sizes]
        self.bands: list[list[tuple[np.ndarray, np.ndarray]]] = []  # keys in order and their templates, by class and band
        for s, own in zip(self.sizes, self.members, strict=True):
            flat = np.concatenate([lists[t] for t in own])
            ends = np.cumsum([len(lists[t]) for t in own])
            places = [[(len(lists[t]), np.array([e - len(lists[t])]))] for t, e in zip(own, ends, strict=True)]
            keys = [np.concatenate([self._keys(flat, b, pl)[0] for pl in places]) for b in range(self.n_bands(s))]
            self.bands.append([(np.sort(k), own[np.argsort(k)]) for k in keys])

    @staticmethod
    def n_bands(size: int) -> int:
        """One shingle has itself for all minima, so one band is enough."""
        return 1 if size == 1 else BANDS

    @staticmethod
    def _keys(h: np.ndarray, band: int, places: list) -> list[np.ndarray]:
        keys = minima(h, band * ROWS, places)
        for r in range(1, ROWS):
            keys = [k * np.uint64(0x9E3779B97F4A7C15) + m for k, m in zip(keys, minima(h, band * ROWS + r, places), strict=True)]
        return keys

    def find(self, texts: list[str]) -> list[tuple[int, int, float, int]]:
        """(text, template, share of the template's shingles in its best window, word where it begins)."""
        lists = [self.shingler(words_of(t)) for t in texts]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        first = np.cumsum(size) - size
        h = np.concatenate([*lists, np.zeros(max(self.sizes, default=1), np.uint64)])
        places = []
        for s in self.sizes:  # windows of a text that is shorter than they are reach into the next; the exact check does not
            step = max(1, s // 8)
            n = np.where(size > 0, np.maximum(1, -(-(size - s) // step) + 1), 0)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            last = np.repeat(np.maximum(size - s, 0), n)
            places.append((s, np.repeat(first, n) + np.minimum(k * step, last)))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        hits: list[set] = [set() for _ in self.sizes]
        for b in range(BANDS):
            keys = self._keys(h, b, places) if b == 0 or self.sizes[-1:] != [1] else []
            for c, key in enumerate(keys):
                if b < self.n_bands(self.sizes[c]):
                    known, of = self.bands[c][b]
                    low = np.searchsorted(known, key)
                    met = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == key)
                    for x, k, lo in zip(places[c][1][met].tolist(), key[met], low[met].tolist(), strict=True):
                        hits[c].update((t, x) for t in of[lo : np.searchsorted(known, k, side="right")].tolist())
        for c, s in enumerate(self.sizes):
            for t, start in sorted(hits[c]):
                i = int(np.searchsorted(first + size, start, side="right"))
                reach = max(s, len(self.sets[t])) + max(1, s // 8)
                a, e = max(first[i], start - max(reach - s, 1)), min(first[i] + size[i], start + reach)
                share = float(np.isin(self.sets[t], h[a:e]).mean())
                if share >= self.contained and share > best.get((i, t), (0.0, 0))[0]:
                    best[i, t] = (share, int(start - first[i]))
        return [(i, t, *best[i, t]) for i, t in sorted(best)]


def _found(templates: dict[str, str], contained: float, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, contained, words)
        for batch in batches:
            for lo, _, texts in text_slices(batch, "text"):
                found = index.find(texts) if templates else []
                at = pa.array([lo + f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array([index.names[f[1]] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())],
                    names=["_id", "license", "containment", "word"],
                )

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, word): the templates found in every whole text, a row for each text and template.

    Null, empty and short texts have none. Texts and templates of any length are scanned whole. Repeated rows and null ids
    are scanned row by row; other columns are ignored. Of windows with the same containment the first counts. Templates
    shorter than a shingle are never found.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    chosen = {k: t for k, t in (TEMPLATES if templates is None else templates).items() if len(words_of(t)) >= words}
    return narrow.mapInArrow(_found(chosen, contained, words), "_id long, license string, containment double, word long").withColumnRenamed("_id", id_col)
