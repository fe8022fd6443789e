"""The stream of crawl runs against runs merged one after the other."""

import datetime as dt
import random

import pytest

from paperglass.streaming import crawl_runs as C

START = dt.datetime(2024, 1, 1)


def history(rng):
    """(outcomes, ends) of seven runs of three sources."""
    outcomes, ends = [], []
    for source in ("s", "t", "é"):
        for run in range(1, 8):
            began = START + dt.timedelta(hours=10 * run)
            for k in rng.sample(range(12), rng.randrange(12)):
                for n in range(rng.choice([1, 1, 2])):
                    outcomes.append((source, run, "url", f"u{k}", rng.choice(["fetched"] * 5 + ["listed", "error", "gated", "robots"]), rng.choice("abc"), rng.choice([5, None]), began + dt.timedelta(minutes=k + 20 * n), None))
            ends.append((source, run, "end", None, None, None, None, began + dt.timedelta(hours=1), rng.random() < 0.7))
    return outcomes, ends


def one_after_the_other(outcomes, ends):
    known, out = {}, []
    for source, run, _, _, _, _, _, _, complete in sorted(ends, key=lambda e: (e[0], e[7])):
        met = {}
        for o in outcomes:
            if o[:2] == (source, run):
                met[o[3]] = max(met.get(o[3], o), o, key=lambda x: (x[7], x[4], x[5]))
        mine = known.setdefault(source, {})
        for url, o in met.items():
            action, sha, number, state = C.outcome(mine.get(url), o[4], o[5])
            mine[url] = (sha, number, state)
            out.append((source, run, url, action, sha, number))
        for url, (sha, number, state) in list(mine.items()):
            if complete and url not in met and state != "missing":
                mine[url] = (sha, number, "missing")
                out.append((source, run, url, "missing", sha, number))
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_replays_and_restarts(spark, tmp_path, seed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.PROVIDER)
    rng = random.Random(seed)
    outcomes, ends = history(rng)
    rows = [*outcomes, *ends, *rng.sample(outcomes, 20), *rng.sample(ends, 3), (None, 1, "url", "x", "fetched", "a", 1, START, None), ("s", 1, "url", None, "fetched", "a", 1, START, None)]
    rng.shuffle(rows)
    last = [("end of all", 1, "end", None, None, None, None, START + dt.timedelta(days=60), True)]
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :], last):  # each a run of the query of its own, from the checkpoint
        spark.createDataFrame(part, C.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = C.run_actions(spark.readStream.schema(C.EVENTS).parquet(str(tmp_path / "in")), "40 days", buckets=3)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    actions = spark.read.parquet(str(tmp_path / "out"))
    got = sorted(repr(tuple(r)) for r in actions.select("source", "run_no", "url", "action", "sha256", "revision_no").collect())
    assert got == one_after_the_other(outcomes, ends)
    totals = {(r["source"], r["run_no"]): r for r in C.run_totals(actions).collect()}
    assert sum(r["total"] for r in totals.values()) == len(got)
    assert sum(r["missing"] for r in totals.values()) == sum("'missing'" in x for x in got) > 0


class Counted(dict):
    """A map state in memory that counts its calls."""

    calls = 0

    def _count(self, value=None):
        Counted.calls += 1
        return value

    def containsKey(self, k):
        return self._count(k in self)

    def getValue(self, k):
        return self._count(self.get(k))

    def updateValue(self, k, v):
        self._count()
        self[k] = v

    def removeKey(self, k):
        self._count(self.pop(k, None))

    def iterator(self):
        Counted.calls += len(self)
        return iter(list(self.items()))


def test_state_calls_follow_runs_and_urls_not_rows(monkeypatch):
    from types import SimpleNamespace as N

    import pandas as pd

    monkeypatch.setattr(C, "HELD", 700, raising=False)
    Counted.calls, timers = 0, []
    runs = C.Runs()
    runs.init(N(getMapState=lambda *_: Counted(), registerTimer=timers.append))
    rng = random.Random(4)
    outcomes, ends = [], []
    for run in range(30):
        began = START + dt.timedelta(days=run)
        outcomes += [("s", run, "url", f"u{rng.randrange(60)}", rng.choice(["fetched", "listed", "error", "gated"]), rng.choice("abc"), rng.choice([5, None]), began + dt.timedelta(seconds=k), None) for k in range(200)]
        ends += [("s", run, "end", None, None, None, None, began + dt.timedelta(hours=1), run % 3 == 0)] * 20
    rows = [*outcomes, *ends]
    rng.shuffle(rows)
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in C.EVENTS.split(", ")])
    list(runs.handleInputRows(("s", 0), iter([frame[k : k + 500] for k in range(0, len(frame), 500)]), None))
    assert sorted(timers) == sorted({int(e[7].replace(tzinfo=dt.timezone.utc).timestamp()) * 1000 for e in ends})
    out = []
    for t in sorted(timers):
        out += list(runs.handleExpiredTimer(("s", 0), N(getCurrentWatermarkInMs=lambda: max(timers)), N(getExpiryTimeInMs=lambda t=t: t)))
    got = pd.concat(out)[["source", "run_no", "url", "action", "sha256", "revision_no"]].itertuples(index=False, name=None)
    assert sorted(map(repr, got)) == one_after_the_other(outcomes, sorted(set(ends)))
    assert Counted.calls < len(rows)
