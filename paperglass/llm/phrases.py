"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces at punctuation, and pieces into overlapping chunks where the content says so: a word whose hash is
divisible by `MODULUS` triggers, and a chunk reaches from one trigger to four words behind its start of the next. Equal
passages give equal chunks wherever they stand, so the chunks form a dictionary with frequencies. Phrases are counted inside the
distinct chunks, weighted; a phrase belongs to the chunk whose own part, up to the next trigger, it starts in, so the overlap
counts once. Lengths are counted one after another: a phrase is counted only where both phrases that are shorter by a
word passed the threshold, which a bitmap of fixed size tells, exact counts deciding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperglass.llm.common import written

#: Words of the longest phrase; a chunk overlaps the next by one less.
LONGEST = 5
#: One word of so many triggers.
MODULUS = 16
#: Bits of the bitmap of frequent phrases; a larger corpus prunes less and counts the same.
FILTER_BITS = 1 << 28
#: Words that a task counts before it gives out its counts.
AT_ONCE = 1_000_000
_BREAKS, _BLANKS = "[.,;:!?\n\x0b\x0c\r]", "[ \t]"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, the number of each one's text, and of its piece."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), _BREAKS)
    text_of = pc.list_parent_indices(pieces).to_numpy()
    words = pc.split_pattern_regex(pc.list_flatten(pieces), _BLANKS)
    piece_of = pc.list_parent_indices(words).to_numpy()
    flat = pc.list_flatten(words)
    real = pc.greater(pc.binary_length(flat), 0)
    piece_of = piece_of[real.to_numpy(zero_copy_only=False)]
    return flat.filter(real), text_of[piece_of] if len(piece_of) else piece_of, piece_of


def _joined(words: pa.Array, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The ranges of words, which may overlap, each joined by spaces."""
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(begin, size)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), words.take(pa.array(at)))
    return pc.binary_join(lists, " ")


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal ones, and the words' 64-bit hashes."""
    coded = words.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    codes = coded.indices.to_numpy()
    return codes.astype(np.int64), own[codes] if len(own) else np.zeros(0, np.uint64)


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunks of texts: their words joined, the number of words of the own part, and the number of the text."""
    words, text_of, piece_of = _words(texts)
    n = len(words)
    if not n:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens = np.ones(n, bool)
    opens[1:] = piece_of[1:] != piece_of[:-1]
    trigger = _hashes(words)[1] % np.uint64(MODULUS) == 0
    begin = np.flatnonzero(opens | trigger)
    own = np.diff(np.append(begin, n))
    piece_end = np.append(np.flatnonzero(opens)[1:], n)[np.cumsum(opens) - 1]
    end = np.minimum(begin + own + LONGEST - 1, piece_end[begin])
    return _joined(words, begin, end - begin), own, text_of[begin]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // (1 << 22), prepend=0)).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            chunk, own, at = chunks_of(pc.fill_null(part.column("text"), ""))
            table = pa.table({"lang": part.column("lang").take(pa.array(at, pa.int64())), "chunk": chunk, "own": pa.array(own, pa.int64())})
            counted = table.group_by(["lang", "chunk", "own"]).aggregate([([], "count_all")]).rename_columns(["lang", "chunk", "own", "n"])
            yield from counted.select(["lang", "chunk", "own", "n"]).cast(pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("own", pa.int64()), ("n", pa.int64())])).combine_chunks().to_batches()


def dictionary(docs: DataFrame, text_col: str = "text", group_col: str = "lang", unknown: str = "und") -> DataFrame:
    """(lang, chunk, own, n): the distinct chunks of all texts and how often each occurs."""
    narrow = docs.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit(unknown)).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(_parse, "lang string, chunk string, own long, n long").groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n"))


def _slots(groups: list[str], group_of: np.ndarray, first: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """Bit numbers of the phrases of `length` words that begin at the positions `first`."""
    salt = np.array([xxhash.xxh64_intdigest(g) for g in groups], np.uint64)
    h = salt[group_of[first]]
    for k in range(length):
        h = (h ^ hashes[first + k]) * _MIX
        h ^= h >> np.uint64(29)
    return (h % np.uint64(FILTER_BITS)).astype(np.int64)


def _counter(length: int, bitmap):
    """Counts the phrases of `length` words of dictionary rows. With a bitmap, only those of frequent parts."""

    def count(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = pc.split_pattern(table.column("chunk").combine_chunks(), " ")
        words = pc.list_flatten(lists)
        row = pc.list_parent_indices(lists).to_numpy()
        codes, hashes = _hashes(words)
        groups = table.column("lang").combine_chunks().dictionary_encode()
        group_of, names = groups.indices.to_numpy()[row], groups.dictionary.to_pylist()
        size = np.bincount(row, minlength=table.num_rows)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        first = np.flatnonzero((place < table.column("own").to_numpy()[row]) & (place + length <= size[row]))
        if length > 1:
            bits = bitmap.value
            # a part of each phrase is asked for once, at the place where it begins
            asked = np.unique(np.concatenate([first, first + 1]))
            slot = _slots(names, group_of, asked, hashes, length - 1)
            frequent = np.zeros(len(row) + 1, bool)
            frequent[asked] = (np.frombuffer(bits, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            first = first[frequent[first] & frequent[first + 1]]
        name = group_of[first].astype(np.int64)
        for k in range(length):  # equal numbers for equal phrases so far
            name = np.unique((name << 32) | codes[first + k], return_inverse=True)[1]
        weight = table.column("n").to_numpy()[row[first]]
        kinds, at = np.unique(name, return_index=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, name, weight)
        begin = first[at]
        phrase = _joined(words, begin, np.full(len(begin), length))
        return pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(group_of[begin])), phrase, pa.array(total)], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += pc.sum(pc.add(batch.column("own"), LONGEST - 1)).as_py() or 0
            if size >= AT_ONCE:
                yield count(held)
                held, size = [], 0
        if held:
            yield count(held)

    return run


def _marked(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = pc.list_flatten(pc.split_pattern(batch.column("phrase"), " "))
                groups = batch.column("lang").dictionary_encode()
                group_of = np.repeat(groups.indices.to_numpy(), length)
                slot = _slots(groups.dictionary.to_pylist(), group_of, np.arange(batch.num_rows) * length, _hashes(words)[1], length)
                yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.left_shift(np.int64(1), slot & 63))], names=["word", "bits"])

    return run


def _bitmap(frequent: DataFrame, length: int) -> bytes:
    """A bit for each frequent phrase. Its size is FILTER_BITS / 8 bytes, whatever the input."""
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    marks = frequent.mapInArrow(_marked(length), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for batch in marks.toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return bits.tobytes()


def frequent_phrases(docs: DataFrame, least: int = 100, text_col: str = "text", group_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to LONGEST words that occur at least `least` times, and (lang, n), all words."""
    chunks = written(dictionary(docs, text_col, group_col), "chunks")
    one = written(chunks.mapInArrow(_counter(1, None), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f")), "words")
    total = one.groupBy("lang").agg(F.sum("f").alias("n"))
    found = [one.where(F.col("f") >= least).withColumn("words", F.lit(1))]
    for length in range(2, LONGEST + 1):
        bits = docs.sparkSession.sparkContext.broadcast(_bitmap(found[-1], length - 1))
        counted = chunks.mapInArrow(_counter(length, bits), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        found.append(written(counted.where(F.col("f") >= least), f"phrases-{length}").withColumn("words", F.lit(length)))
        bits.unpersist()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, total


def collocations(docs: DataFrame, least: int = 100, first: int = 2000, text_col: str = "text", group_col: str = "lang") -> DataFrame:
    """Each language's `first` collocations: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the occurrences of a phrase and of the two parts of its weakest cut, n all words of the language, score is
    floor(1000 * a * n / (l * r)), in decimals of 38 digits, and the lowest over all cuts, ties to the shortest first part. A phrase inside a
    longer one that occurs as often is left out. Order: score and a descending, phrase ascending by bytes. A null
    language is `und`, null texts and texts without words count nothing, repeated rows count again, an empty table gives no
    rows. Only the two columns are read; the names of others do not matter. Very long texts are parsed whole.
    """
    every, total = frequent_phrases(docs, least, text_col, group_col)
    split = every.withColumn("word", F.split("phrase", " "))
    candidate = split.where(F.col("words") > 1)

    def part(begin, size):
        return F.array_join(F.slice("word", begin, size), " ")

    rest = F.col("words") - 1
    longer = candidate.where(F.col("words") > 2).select("lang", F.explode(F.array(part(1, rest), part(2, rest))).alias("phrase"), F.col("f").alias("a")).distinct()
    kept = candidate.select("lang", "phrase", "word", "words", F.col("f").alias("a")).join(longer, ["lang", "phrase", "a"], "left_anti")
    cut = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), rest)).alias("k"), "word", "words")
    cut = cut.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    of = every.select("lang", "phrase", "f")
    cut = cut.join(of.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(of.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r", "n")}
    scored = cut.join(total, "lang").withColumn("top", (wide["a"] * 1000 * wide["n"]).cast("decimal(38,0)")).withColumn("below", (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    best = scored.withColumn("score", F.expr("top div below")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", place).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
