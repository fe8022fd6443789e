"""Many literal phrases looked for in one pass over each text, with an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of one automaton. Larger tables are looked for block by block, a pass over the texts for each.
BLOCK = 100_000


def automaton(phrases: Sequence[str]) -> ahocorasick.Automaton:
    """An automaton that knows each phrase by its first place in `phrases`; empty ones are left out."""
    found = ahocorasick.Automaton()
    for k, p in enumerate(phrases):
        if p and p not in found:
            found.add_word(p, k)
    found.make_automaton()
    return found


def spans(machine: ahocorasick.Automaton, phrases: Sequence[str], text: str) -> list[tuple[int, int, int]]:
    """(start, end, phrase) of all occurrences, overlapping ones too."""
    if not len(machine):
        return []
    return [(end + 1 - len(phrases[k]), end + 1, k) for end, k in machine.iter(text)]


def longest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of occurrences those that a reader from the left takes: the longest at each place, none inside another."""
    out, free = [], 0
    for s in sorted(found, key=lambda s: (s[0], -s[1])):
        if s[0] >= free:
            out.append(s)
            free = s[1]
    return out


def first_by_order(text: Column, order: Sequence[tuple[str, str]]) -> Column:
    """The value of the first alias of `order`, pairs of alias and value, that stands anywhere in the text; null without one."""
    aliases, values = [a for a, _ in order], [v for _, v in order]

    @F.pandas_udf("string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(aliases)
        for texts in batches:
            best = [min((k for _, _, k in spans(machine, aliases, t)), default=None) if isinstance(t, str) else None for t in texts]
            yield pd.Series([None if k is None else values[k] for k in best], dtype=object)

    return find(text)


def _marked(phrases: list[str], whole: Callable[[str, int, int], bool] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(phrases)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text:
                    met = {k for a, b, k in spans(machine, phrases, text) if whole is None or whole(text, a, b)}
                    at += [i] * len(met)
                    found += [phrases[k] for k in sorted(met)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["id", "phrase"])

    return run


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether neither side of a span is a lower-case letter or digit of ASCII."""
    return not ((start and text[start - 1] in _WORD) or (end < len(text) and text[end] in _WORD))


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def phrases_in(texts: DataFrame, phrases: DataFrame, whole: Callable[[str, int, int], bool] | None = None) -> DataFrame:
    """(id, phrase) once for each phrase (column `phrase`) that occurs in a text (id, text), where `whole` accepts an occurrence.

    The driver holds a block of at most BLOCK phrases at a time, dealt by hash; each block is one pass over the texts. Null and empty texts
    and phrases meet nothing.
    """
    known = phrases.select("phrase").where("phrase <> ''").distinct()
    blocks = -(-known.count() // (BLOCK * 3 // 4))  # blocks by hash differ a little in size
    narrow = texts.select("id", "text")
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, phrase string"
    out = None if blocks else narrow.select("id", F.lit(None).cast("string").alias("phrase")).where("false")  # no pass for no phrase
    for b in range(blocks):
        own = sorted(r["phrase"] for r in known.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b).collect())
        part = narrow.mapInArrow(_marked(own, whole), schema)
        out = part if out is None else out.unionByName(part)
    return out
