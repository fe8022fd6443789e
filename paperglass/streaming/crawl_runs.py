"""Crawl runs merged as a stream over keyed state: work follows what arrives, not what is known.

Outcomes wait in the state of their key until their run has ended and the watermark has passed its end, so they may arrive in any
order within the delay, again, or behind the end event. Closing a run classifies its urls against what the key knows, in
the order of the ends. A key is a source and a bucket of its urls; end events go to all buckets of their source, so a
source of any size spreads over tasks. State is in the state store: a batch reads and writes the keys that it has, and a
restart goes on from the last committed batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What the stream reads: outcomes with a url, and end events (kind = 'end') with `complete`, whether the run met all of its source.
EVENTS = "source string, run_no long, kind string, url string, status string, sha256 string, bytes long, at timestamp, complete boolean"
ACTIONS = "source string, run_no long, url string, action string, sha256 string, revision_no int, bytes long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAMES = [c.split()[0] for c in ACTIONS.split(", ")]


def outcome(known: tuple | None, status: str, sha: str | None) -> tuple[str, str | None, int, str]:
    """(action, sha256, revision_no, status) of one outcome against what is known of its url: (sha256, revision_no, status)."""
    had_sha, had, _ = known or (None, 0, None)
    if status in ("gated", "robots"):
        return "skipped", had_sha, had, "skipped"
    if status == "error":
        return "error", had_sha, had, "error"
    if status != "fetched":
        return ("seen" if known else "new"), had_sha, had, "seen"
    if had == 0:
        return "new", sha, 1, "seen"
    if sha == had_sha:
        return "unchanged", had_sha, had, "seen"
    return "changed", sha, had + 1, "seen"


def _text(v) -> str | None:
    return None if v is None or v != v else str(v)


def _keep_later(met: dict[str, tuple], url: str, new: tuple) -> bool:
    """Keeps the later of two outcomes (status, sha256, bytes, at) of a url; whether it is the url's first."""
    old = met.get(url)
    if old is None or (old[3], old[0] or "", old[1] or "") < (new[3], new[0] or "", new[1] or ""):
        met[url] = new
    return old is None


#: Outcomes of one key that are held before they go to its state (fixed value).
HELD = 100_000


class Runs(StatefulProcessor):
    """State of one source and bucket: waiting outcomes by run, ends of runs, and the urls that are known.

    Outcomes of a run wait in parts, one for each time that what arrived was put away, so a batch calls the state for runs and not for
    rows, and closing a run reads its own parts. All runs that a batch can close are closed together, in the order of
    their ends: what is known of the key is read once and each url that has changed is written once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "run_no long", "n int")
        self.waiting = handle.getMapState("waiting", "run_no long, part int", "url array<string>, status array<string>, sha256 array<string>, bytes array<long>, at array<long>")
        self.ends = handle.getMapState("ends", "run_no long", "ended long, complete boolean")
        self.known = handle.getMapState("known", "url string", "sha256 string, revision_no int, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends: dict[int, tuple[int, bool]] = {}
        held: dict[int, dict[str, tuple]] = {}
        n = 0
        for part in rows:
            at = part["at"].astype("datetime64[us]").astype("int64").where(part["at"].notna(), 0)
            for run, kind, url, status, sha, size, t, complete in zip(part["run_no"], part["kind"], part["url"], part["status"], part["sha256"], part["bytes"], at, part["complete"], strict=True):
                if kind == "end":
                    ends[int(run)] = (int(t) // 1000, bool(complete))
                elif _text(url) is not None:
                    new = (_text(status), _text(sha), None if size is None or size != size else int(size), int(t))
                    n += _keep_later(held.setdefault(int(run), {}), str(url), new)
            if n >= HELD:
                self._put_away(held)
                held, n = {}, 0
        self._put_away(held)
        for run, end in ends.items():
            if not self.ends.containsKey((run,)):
                self.handle.registerTimer(end[0])
            self.ends.updateValue((run,), end)
        yield pd.DataFrame(columns=NAMES)

    def _put_away(self, held: dict[int, dict[str, tuple]]) -> None:
        for run, urls in held.items():
            n = self.parts.getValue((run,))[0] if self.parts.containsKey((run,)) else 0
            self.waiting.updateValue((run, n), (list(urls), *map(list, zip(*urls.values(), strict=True))))
            self.parts.updateValue((run,), (n + 1,))

    def _take(self, run: int) -> dict[str, tuple]:
        met: dict[str, tuple] = {}
        if self.parts.containsKey((run,)):
            for n in range(self.parts.getValue((run,))[0]):
                for url, *new in zip(*self.waiting.getValue((run, n)), strict=True):
                    _keep_later(met, url, tuple(new))
                self.waiting.removeKey((run, n))
            self.parts.removeKey((run,))
        return met

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        due = sorted((v[0], k[0], v[1]) for k, v in self.ends.iterator() if v[0] <= until or v[0] < passed)
        if not due:  # closed with an earlier one
            return
        known = {k[0]: tuple(v) for k, v in self.known.iterator()}
        live = {url for url, v in known.items() if v[2] != "missing"}
        changed: set[str] = set()
        for _, run, complete in due:
            met, out = self._take(run), []
            for url, (status, sha, size, _) in sorted(met.items()):
                action, sha, number, state = outcome(known.get(url), status, sha)
                known[url] = (sha, number, state)
                out.append((key[0], run, url, action, sha, number, size if status == "fetched" else None))
            changed.update(met)
            live.update(met)
            if complete:
                gone = sorted(live - met.keys())
                for url in gone:
                    sha, number, _ = known[url]
                    known[url] = (sha, number, "missing")
                    out.append((key[0], run, url, "missing", sha, number, None))
                changed.update(gone)
                live = set(met)
            self.ends.removeKey((run,))
            yield pd.DataFrame(out, columns=NAMES).astype({"run_no": "int64", "revision_no": "int32", "bytes": "Int64"})
        for url in changed:
            self.known.updateValue((url,), known[url])

    def close(self) -> None:
        pass


def run_actions(events: DataFrame, delay: str = "1 hour", buckets: int = 64) -> DataFrame:
    """(source, run_no, url, action, sha256, revision_no, bytes) of every closed run, as a stream over `events` (EVENTS).

    new, seen, unchanged, changed, skipped and error as in crawl.classify; missing for urls that a complete run of their source has
    not met, once. Of several outcomes of a url in a run the last by time counts. A run without an end event waits; what comes later than
    `delay` behind the newest event may be left out. Rows without a source or url are ignored. The session needs the
    state store PROVIDER.
    """
    known = events.where("source is not null and run_no is not null and (kind = 'end' or url is not null)")
    whole = F.sequence(F.lit(0), F.lit(buckets - 1))
    bucket = F.explode(F.when(F.col("kind") == "end", whole).otherwise(F.array(F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int"))))
    keyed = known.withColumn("bucket", bucket).withWatermark("at", delay)
    return keyed.groupBy("source", "bucket").transformWithStateInPandas(Runs(), ACTIONS, "append", "eventTime")


def run_totals(actions: DataFrame) -> DataFrame:
    """Counters of each run (source, run_no) over its actions: total, each action, new revisions and the bytes fetched."""
    names = ("new", "seen", "unchanged", "changed", "missing", "skipped", "error")
    revision = F.col("bytes").isNotNull() & F.col("action").isin("new", "changed")
    return actions.groupBy("source", "run_no").agg(F.count("*").alias("total"), *[F.count_if(F.col("action") == a).alias(a) for a in names], F.count_if(revision).alias("new_revisions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
