"""Chat formatting: a hidden Markov model recovers speakers line by line, then turns are rendered in one form.

Hidden states are a role and whether the line opens a turn. A line shows one symbol: its speaker marker, its length class
and whether it ends as a question. Counts over all labelled rows, with pseudo-counts for the markers, give the model.
Lines are put in order over all tasks by range. A task decodes the conversations that lie within it by Viterbi, thousands
of them in step. A conversation that reaches into other tasks, or is very long, is cut: each cut is a max-plus matrix over
states, the matrices are chained, and each cut is decoded between its entry and exit state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperglass.llm.common import written

ROLES = ("system", "user", "assistant")
#: Speaker markers at the start of a line, by role (fixed values).
MARKERS = {
    "system": r"(?:system|instructions?)\s*:|<\|system\|>|<\|im_start\|>\s*system|###\s*system\s*:?",
    "user": r"(?:user|human|q|question)\s*:|<\|user\|>|<\|im_start\|>\s*user|###\s*(?:human|user|instruction)\s*:?",
    "assistant": r"(?:assistant|ai|bot|a|answer)\s*:|<\|assistant\|>|<\|im_start\|>\s*assistant|###\s*(?:assistant|response)\s*:?",
}
MARKER = re.compile("|".join(f"(?P<{r}>^\\s*(?:{p}))" for r, p in MARKERS.items()), re.IGNORECASE)
#: Upper characters of the length classes of a line.
LENGTHS = (0, 40, 160, 640)
N_MARKS, N_LENGTHS = len(ROLES) + 1, len(LENGTHS) + 1
N_SYMBOLS = N_MARKS * N_LENGTHS * 2
N_STATES = 2 * len(ROLES)
#: Pseudo-count of a marker in its role's opening state.
MARKER_WEIGHT = 50.0
#: Lines of a cut, and of conversations that are decoded at once.
CUT, AT_ONCE = 20_000, 200_000
#: Styles of speaker markers in raw transcripts (fixed values).
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "}, {"system": "Instructions: ", "user": "Human: ", "assistant": "AI: "},
    {"system": "System: ", "user": "Q: ", "assistant": "A: "}, {"system": "<|im_start|>system\n", "user": "<|im_start|>user\n", "assistant": "<|im_start|>assistant\n"},
    {"system": "### System\n", "user": "### Human:\n", "assistant": "### Response:\n"},
)


def symbols(text: str) -> np.ndarray:
    """The symbol of each line of a text: marker (0: none, 1..3: a role's), length class, question."""
    lines = text.split("\n")
    marks = [MARKER.match(line) for line in lines]
    bare = [line.strip() for line in lines]
    mark = np.array([1 + ROLES.index(m.lastgroup) if m else 0 for m in marks], np.int64)
    size = np.searchsorted(LENGTHS, np.fromiter(map(len, bare), np.int64, len(bare)))
    return (mark * N_LENGTHS + size) * 2 + np.array([b.endswith("?") for b in bare], np.int64)


class Chain:
    """Log probabilities: first state, transitions (from, to) and symbols (state, symbol). State 2r opens role r's turn, 2r + 1 goes on."""

    def __init__(self, lines: dict[tuple[str, int, int], float], turns: dict[tuple[str, str], float], first: dict[str, float]):
        emit = np.full((N_STATES, N_SYMBOLS), 0.1)
        go_on = np.full((N_STATES, 2), 1.0)
        for r, role in enumerate(ROLES):
            for m in range(N_LENGTHS * 2):
                emit[2 * r, (1 + r) * N_LENGTHS * 2 + m] += MARKER_WEIGHT
                emit[2 * r, m] += 1.0
                emit[2 * r + 1, m] += 1.0
            for (name, opens, symbol), n in lines.items():
                if name == role:
                    emit[2 * r + 1 - opens, symbol] += n
                    go_on[2 * r + 1 - opens, 0] += n
        change = np.full((len(ROLES), len(ROLES)), 1.0)
        for (a, b), n in turns.items():
            if a in ROLES and b in ROLES:
                change[ROLES.index(a), ROLES.index(b)] += n
        change /= change.sum(1, keepdims=True)
        move = np.full((N_STATES, N_STATES), 1e-9)
        for r in range(len(ROLES)):
            opened, more = go_on[2 * r, 0], go_on[2 * r + 1, 0]
            stay = more / (opened + more)
            for s in (2 * r, 2 * r + 1):
                move[s, 2 * r + 1] = stay
                move[s, ::2] = (1 - stay) * change[r]
        begin = np.full(N_STATES, 1e-9)
        begin[::2] = [first.get(r, 0.0) + 1.0 for r in ROLES]
        self.first, self.move, self.emit = np.log(begin / begin.sum()), np.log(move), np.log(emit / emit.sum(1, keepdims=True))

    def product(self, seen: np.ndarray) -> np.ndarray:
        """Best log probability from each state before the lines to each state at their end."""
        total = np.where(np.eye(N_STATES, dtype=bool), 0.0, -np.inf)
        for s in seen:
            total = (total[:, :, None] + self.move[None]).max(1) + self.emit[:, s]
        return total

    def decode(self, seen: list[np.ndarray], entry: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """The best states of many runs of lines, in step: from an entry state (-1: the start of a conversation) to an end
        state (-1: any)."""
        order = np.argsort([-len(x) for x in seen], kind="stable")
        length = np.array([len(seen[i]) for i in order], np.int64)
        width = int(length.max(initial=0))
        flat = np.concatenate([seen[i] for i in order]) if len(order) else np.zeros(0, np.int64)
        first = np.cumsum(length) - length
        live = len(length) - np.searchsorted(length[::-1], np.arange(width), side="right")
        begin, stop = entry[order], end[order]
        best = np.where((begin < 0)[:, None], 0.0, np.where(np.arange(N_STATES) == begin[:, None], 0.0, -np.inf))
        back, where = [], []
        for t in range(width):
            n = live[t]
            all_ = best[:n, :, None] + self.move[None]
            came, step = all_.argmax(1).astype(np.int8), all_.max(1)
            if t == 0:
                step = np.where((begin[:n] < 0)[:, None], self.first, step)
            best[:n] = step + self.emit.T[flat[first[:n] + t]]
            back.append(came)
        state = np.where(stop < 0, best.argmax(1), stop)
        out = np.empty(len(flat), np.int64)
        for t in reversed(range(width)):
            n = live[t]
            out[first[:n] + t] = state[:n]
            state[:n] = back[t][np.arange(n), state[:n]]
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        return [out[first[k] : first[k] + length[k]] for k in where]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = np.zeros((len(ROLES), 2, N_SYMBOLS), np.int64)
        for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = symbols(text)
            total[role, 1, seen[0]] += 1
            np.add.at(total[role, 0], seen[1:], 1)
        role, opens, symbol = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (role, opens, symbol, total[role, opens, symbol])], names=["role", "opens", "symbol", "n"])


def fit(rows: DataFrame) -> Chain:
    """The chain of labelled rows (conv, turn, role int, text), counted over all of them."""
    known = rows.where("role is not null")
    lines = known.select("role", "text").mapInArrow(_counted, "role long, opens long, symbol long, n long").groupBy("role", "opens", "symbol").agg(F.sum("n").alias("n")).collect()
    named = known.select("conv", "turn", "role").distinct()
    later = named.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    turns = named.join(later, ["conv", "turn"]).groupBy("role", "next").count().collect()
    start = known.where("turn = 0").groupBy("role").count().collect()
    return Chain({(ROLES[r["role"]], r["opens"], r["symbol"]): r["n"] for r in lines}, {(ROLES[r["role"]], ROLES[r["next"]]): r["count"] for r in turns}, {ROLES[r["role"]]: r["count"] for r in start})


def pieces(text: str, states: np.ndarray, opened: bool) -> list[tuple[str, bool, str, int]]:
    """(role, opens, rendered, lines) of a row's turns; the first goes on with the row before if it was opened and its state says so."""
    lines = text.split("\n")
    opens = (states % 2 == 0) | np.concatenate([[not opened], states[1:] // 2 != states[:-1] // 2])
    cuts = [0, *(np.flatnonzero(opens[1:]) + 1).tolist(), len(states)]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        role = ROLES[states[a] // 2]
        body = "\n".join([MARKER.sub("", lines[a], count=1), *lines[a + 1 : b]]).strip()
        out.append((role, bool(opens[a]), f"<|{role}|>\n{body}" if opens[a] else body, b - a))
    return out


#: Rows of a task: decoded pieces (kind 0), rows of a cut run (1), and the matrices of runs (2) and of their cuts (3).
PARSED = "kind int, conv long, run long, cut int, pos long, turn long, part int, role string, opens boolean, text string, n_lines int, through array<double>, opened array<double>"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
_NAMES = [c.split()[0] for c in PARSED.split(", ")]
#: Runs of a task have numbers below this power of two.
RUN_BITS = 32


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


class Parser:
    """Decodes the runs of one task's sorted rows (conv, turn, text). The first run and the last may go on in other tasks."""

    def __init__(self, chain: Chain, task: int):
        self.chain, self.run, self.conv = chain, task << RUN_BITS, None
        self.ready: list[tuple[int, list, list]] = []
        self.whole, self.size = False, 0
        self._begin(None)

    def _begin(self, conv: int | None) -> None:
        self.conv, self.rows, self.seen, self.lines = conv, [], [], 0
        self.cut, self.pos, self.through, self.opened = 0, 0, None, None

    def _flush(self) -> Iterator[tuple]:
        """The held rows of a run as its next cut, and the cut's matrices."""
        if not self.rows:
            return
        seen = np.concatenate(self.seen)
        start = (self.chain.first + self.chain.emit[:, seen[0]])[:, None]
        m, opened = self.chain.product(seen), (start + self.chain.product(seen[1:])).max(0)
        for turn, text in self.rows:
            yield (1, self.conv, self.run, self.cut, self.pos, turn, None, None, None, text, None, None, None)
            self.pos += 1
        yield (3, self.conv, self.run, self.cut, None, None, None, None, None, None, None, m.reshape(-1).tolist(), opened.tolist())
        if self.through is None:
            self.through, self.opened = m, opened
        else:
            self.through, self.opened = (self.through[:, :, None] + m[None]).max(1), (self.opened[:, None] + m).max(0)
        self.cut, self.rows, self.seen, self.lines = self.cut + 1, [], [], 0

    def _end(self, whole: bool) -> Iterator[tuple]:
        """Ends the current run: it is decoded here if no other task has lines of it, and it was not cut."""
        if self.conv is None:
            return
        if whole and not self.cut:
            self.ready.append((self.conv, self.rows, self.seen))
            self.size += self.lines
        else:
            yield from self._flush()
            yield (2, self.conv, self.run, None, None, None, None, None, None, None, None, self.through.reshape(-1).tolist(), self.opened.tolist())
        self.run += 1

    def decoded(self) -> Iterator[tuple]:
        any_ = np.full(len(self.ready), -1, np.int64)
        found = self.chain.decode([np.concatenate(s) for _, _, s in self.ready], any_, any_)
        for (conv, rows, seen), states in zip(self.ready, found, strict=True):
            at = 0
            for (turn, text), own in zip(rows, seen, strict=True):
                for part, (role, opens, shown, n) in enumerate(pieces(text, states[at : at + len(own)], at > 0 and states[at] // 2 == states[at - 1] // 2)):
                    yield (0, conv, None, None, None, turn, part, role, opens, shown, n, None, None)
                at += len(own)
        self.ready, self.size = [], 0

    def take(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        for conv, turn, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if conv != self.conv:
                first = self.conv is None
                yield from self._end(self.whole)
                self.whole = not first
                self._begin(conv)
            own = symbols(text)
            self.rows.append((turn, text))
            self.seen.append(own)
            self.lines += len(own)
            if self.lines >= CUT:
                yield from self._flush()
            if self.size >= AT_ONCE:
                yield from self.decoded()

    def end(self) -> Iterator[tuple]:
        yield from self._end(False)
        yield from self.decoded()


def _parsed(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(chain, TaskContext.get().partitionId())
        for batch in batches:
            yield _batch(list(parser.take(batch)))
        yield _batch(list(parser.end()))

    return run


def path_over(matrices: list[np.ndarray], start: np.ndarray, end: int) -> tuple[list[int], list[int]]:
    """Entry and exit states of consecutive matrices: `start` scores the first one's exits; end -1 is any."""
    best, back = start, []
    for m in matrices[1:]:
        all_ = best[:, None] + m
        back.append(all_.argmax(0))
        best = all_.max(0)
    ends = [int(np.argmax(best)) if end < 0 else end]
    for came in reversed(back):
        ends.append(int(came[ends[-1]]))
    ends = ends[::-1]
    return [-1, *ends[:-1]], ends


def _square(m: list[float]) -> np.ndarray:
    return np.reshape(m, (N_STATES, N_STATES))


def _run_ends(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("run")
    entry, end = path_over([_square(m) for m in rows["through"]], np.asarray(rows["opened"].iloc[0]), -1)
    return pd.DataFrame({"run": rows["run"], "entry": entry, "exit": end})


def _cut_ends(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("cut")
    matrices, into = [_square(m) for m in rows["through"]], int(rows["entry"].iloc[0])
    start = np.asarray(rows["opened"].iloc[0]) if into < 0 else matrices[0][into]
    entry, end = path_over(matrices, start, int(rows["exit"].iloc[0]))
    return pd.DataFrame({"run": rows["run"], "cut": rows["cut"], "entry": [into, *entry[1:]], "exit": end})


def _between(chain: Chain):
    """Decodes the rows of cuts, which lie one behind the other in order, between their entry and exit states."""

    def shown(rows: list[tuple]) -> Iterator[tuple]:
        entry, end = rows[0][5], rows[0][6]
        seen = [symbols(r[4]) for r in rows]
        states = chain.decode([np.concatenate(seen)], np.array([entry]), np.array([end]))[0]
        at, before = 0, entry
        for (conv, _, _, turn, text, _, _), own in zip(rows, seen, strict=True):
            mine = states[at : at + len(own)]
            for part, (role, opens, body, n) in enumerate(pieces(text, mine, before >= 0 and mine[0] // 2 == before // 2)):
                yield (conv, turn, part, role, opens, body, n)
            at, before = at + len(own), mine[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int32()), strict=True)], names=["conv", "turn", "part", "role", "opens", "rendered", "n_lines"])

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if held and held[0][1:3] != row[1:3]:
                    out += shown(held)
                    held = []
                held.append(row)
            yield packed(out)
        if held:
            yield packed(list(shown(held)))

    return run


def raw_transcripts(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """The rows with their speaker marked in the text, as in a raw transcript: a conversation has one style of markers, and
    one row of eight has none."""
    style = F.pmod(F.xxhash64(conv_col), F.lit(len(STYLES)))
    mark = F.lit("")
    for k, own in enumerate(STYLES):
        for role, sign in own.items():
            mark = F.when((style == k) & (F.col(role_col) == role), sign).otherwise(mark)
    bare = F.pmod(F.xxhash64(conv_col, turn_col), F.lit(8)) == 0
    return rows.withColumn(text_col, F.concat(F.when(bare, "").otherwise(mark), F.coalesce(F.col(text_col), F.lit(""))))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = "role", chain: Chain | None = None) -> DataFrame:
    """(conv, turn, part, role, opens, rendered, n_lines): the turns recovered from transcripts, in canonical form.

    The texts of a conversation, in the order of turn and of the text's hash, are the lines of its transcript. Where the
    rows begin and what roles they have is not seen; roles serve to fit the model only (none: pseudo-counts alone). A row may
    hold several turns, counted by `part`; one whose first piece does not open goes on with the turn before. The pieces in
    order are the canonical transcript: a turn is `<|role|>`, a line end and its text, and ends where the next begins. Null
    texts are empty lines; rows without a conversation or turn are left out; repeated rows count once; other columns are
    ignored. Conversations and texts of any length are read whole. An empty table gives no rows.
    """
    role = F.lit(None).cast("int")
    if role_col:
        for k, name in enumerate(ROLES):
            role = F.when(F.col(role_col) == name, k).otherwise(role)
    narrow = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("conv is not null and turn is not null")
    once = narrow.groupBy("conv", "turn", "text").agg(F.min("role").alias("role"))
    if chain is None:
        chain = fit(narrow)
    keyed = once.select("conv", "turn", "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("conv", "turn", "h").sortWithinPartitions("conv", "turn", "h", "text").select("conv", "turn", "text")
    parsed = written(ordered.mapInArrow(_parsed(chain), PARSED), "parsed")
    run_ends = parsed.where("kind = 2").select("conv", "run", "through", "opened").groupBy("conv").applyInPandas(_run_ends, "run long, entry int, exit int")
    cuts = parsed.where("kind = 3").select("run", "cut", "through", "opened").join(run_ends, "run")
    cut_ends = cuts.groupBy("run").applyInPandas(_cut_ends, "run long, cut int, entry int, exit int")
    waiting = parsed.where("kind = 1").join(cut_ends, ["run", "cut"]).select("conv", "run", "cut", "turn", "text", "entry", "exit", "pos")
    dealt = waiting.repartition("run", "cut").sortWithinPartitions("run", "cut", "pos").drop("pos")
    rest = dealt.mapInArrow(_between(chain), "conv long, turn long, part int, role string, opens boolean, rendered string, n_lines int")
    done = parsed.where("kind = 0").select("conv", "turn", "part", "role", "opens", F.col("text").alias("rendered"), "n_lines")
    return done.unionByName(rest).withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col)
