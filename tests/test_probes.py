"""Audio probes against a fold one probe at a time, and the reports of a catalogue."""

import random

import pytest

from paperglass.operators import probes as P

CANDIDATES = "identity string, scope string, part int, source string, url string, via string"
PROBES = "probe_id long, seen_at long, identity string, scope string, part int, source string, url string, via string, sha256 string, error string, magic_ok boolean, decode_ok boolean, bytes long, duration_sec double"


def frame(spark, rows, schema):
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def key_of(r):
    if r.get("identity") is None:
        return None
    return (r["identity"], r["scope"], None if r["scope"] == "full_test" else r.get("part"))


def one_by_one(candidates, probes):
    """The catalogue by a plain fold over the probes in order."""
    records, issues = [], []

    def new(key, variant, source):
        name = "audio:" + key[0] + (":full" if key[1] == "full_test" else "") + (f":v{variant}" if variant > 1 else "")
        return {"key": key, "variant": variant, "audio_id": name, "status": "candidate", "error": None, "sha256": None, "bytes": None, "duration_sec": None, "source": source, "urls": {}}

    for key in sorted({key_of(c) for c in candidates}, key=str):
        own = [c for c in candidates if key_of(c) == key]
        records.append(new(key, 1, min(c["source"] for c in own)))
        records[-1]["urls"] = {c["url"]: [c["via"], False, None] for c in own}
    for p in sorted(probes, key=lambda p: (p["seen_at"], p["probe_id"])):
        held = next((r for r in records if p.get("url") is not None and p["url"] in r["urls"]), None)
        if p.get("sha256") is None:
            if p.get("error") is None:
                issues.append(("no_outcome", None, None, None, p["probe_id"]))
            elif held:
                held["urls"][p["url"]][1:] = [True, p["error"]]
                if held["status"] == "candidate" and all(u[1] for u in held["urls"].values()):
                    held["status"], held["error"] = "failed", "all_urls_failed"
            continue
        if held is None and key_of(p) is not None:
            held = next((r for r in records if r["key"] == key_of(p)), None)
            if held is None:
                held = new(key_of(p), 1, p.get("source") or "unknown")
                records.append(held)
        if held is None:
            continue
        group = [r for r in records if r["key"] == held["key"]]
        same = next((r for r in group if r["sha256"] == p["sha256"]), None)
        if same:
            held = same
        elif held["sha256"]:
            made = new(held["key"], max(r["variant"] for r in group) + 1, held["source"])
            issues.append(("content_variant", made["audio_id"], held["audio_id"], p["sha256"], p["probe_id"]))
            records.append(made)
            held = made
        held["sha256"] = p["sha256"]
        if p.get("url") is not None:
            held["urls"].setdefault(p["url"], [p.get("via") or "unknown", True, None])[1:] = [True, None]
        for n in ("bytes", "duration_sec"):
            held[n] = held[n] if p.get(n) is None else p[n]
        if p.get("decode_ok") is not None:
            held["status"] = "available" if p["decode_ok"] else "failed"
            held["error"] = None if p["decode_ok"] else "probe_failed" if p.get("magic_ok") is False else "decode_failed"
    for r in records:
        if r["sha256"] and sum(x["sha256"] == r["sha256"] for x in records) > 1:
            issues.append(("duplicate_content_across_parts", r["audio_id"], None, r["sha256"], None))
    return records, issues


def scene(seed):
    rng = random.Random(seed)
    keys = [("a", "part", 1), ("a", "part", 2), ("b", "full_test", None), ("c", "part", 1)]
    candidates = [dict(identity=k[0], scope=k[1], part=k[2], source="s1", url=f"u{n}{m}", via="raw") for n, k in enumerate(keys[:3]) for m in range(rng.randint(1, 3))]
    probes = []
    for n in range(rng.randint(0, 25)):
        k = rng.choice([*keys, (None, None, None)])
        good = rng.random() < 0.5
        probes.append(dict(
            probe_id=n, seen_at=rng.randint(0, 12), identity=k[0], scope=k[1], part=k[2], source=rng.choice([None, "s2"]), url=rng.choice([None, *(f"u{a}{b}" for a in range(4) for b in range(3))]),
            via=rng.choice([None, "api"]), sha256=rng.choice("xyz") if good else None, error=None if good or rng.random() < 0.1 else rng.choice(["http", "time"]),
            magic_ok=rng.choice([None, True, False]), decode_ok=rng.choice([None, None, True, False]), bytes=rng.choice([None, 5, 7]), duration_sec=rng.choice([None, 1.5])))
    return candidates, probes


def test_fold_in_any_order(spark):
    """Forty catalogues at once: their names go into identities, addresses and contents."""
    candidates, probes, records, issues = [], [], [], []
    for seed in range(40):
        c, p = scene(seed)
        for row in (*c, *p):
            for n in ("identity", "url", "sha256"):
                if row.get(n) is not None:
                    row[n] = f"{row[n]}-{seed}"
        for row in p:
            row["probe_id"] += 100 * seed
        r, i = one_by_one(c, p)
        candidates, probes, records, issues = candidates + c, probes + p, records + r, issues + i
    random.Random(1).shuffle(probes)
    got, found = P.fold_probes(frame(spark, candidates, CANDIDATES), frame(spark, probes, PROBES).repartition(3))
    want = sorted(repr((r["audio_id"], r["key"][2], r["variant"], r["source"], r["status"], r["error"], r["sha256"], r["bytes"], r["duration_sec"], [(u, *v) for u, v in sorted(r["urls"].items())])) for r in records)
    have = sorted(repr((r.audio_id, r.part, r.variant, r.source, r.status, r.error, r.sha256, r.bytes, r.duration_sec, [tuple(u) for u in r.urls])) for r in got.collect())
    assert have == want
    assert {r["error"] for r in records} >= {"all_urls_failed", "probe_failed", "decode_failed"}
    assert sorted(map(repr, issues)) == sorted(repr((r.kind, r.audio_id, r.base_audio_id, r.sha256, r.probe_id)) for r in found.collect())


def test_fold_of_nothing(spark):
    records, issues = P.fold_probes(frame(spark, [], CANDIDATES), frame(spark, [], PROBES))
    assert records.count() == issues.count() == 0


@pytest.mark.parametrize(("statuses", "derived", "open_"), [
    ({1: ["verified"], 2: ["verified"], 3: ["failed", "verified"], 4: ["verified"]}, [], []),
    ({1: ["verified"], 2: ["failed", "available"], 4: ["available", "candidate"]}, [3], [(2, "failed"), (3, "derived_only"), (4, "available")]),
    ({1: ["candidate"], 2: ["candidate"], 3: ["verified"]}, [1], [(1, "derived_only"), (2, "candidate"), (4, "missing")]),
    ({}, [2], [(1, "missing"), (2, "derived_only"), (3, "missing"), (4, "missing")]),
])
def test_complete_tests(spark, statuses, derived, open_):
    rows = [(f"cambridge:9:shared:listening:2:P{p}", "part", p, s) for p, own in statuses.items() for s in own] + [("cambridge:9:shared:listening:2", "full_test", None, "verified"), ("other:1", "part", 1, "verified")]
    records = spark.createDataFrame(rows, "identity string, scope string, part int, status string")
    cut = spark.createDataFrame([(f"cambridge:9:shared:listening:2:P{p}", p) for p in derived] + [("cambridge:8:shared:listening:1:P1", 1)], "identity string, part int")
    (row,) = P.audio_tests(records, cut).collect()
    assert (row.book, row.test, row.audio_complete, [tuple(p) for p in row.incomplete_parts]) == (9, 2, not open_, open_)


def test_counts_by_status_and_source(spark):
    df = spark.createDataFrame([("failed", "x"), ("failed", "y"), ("verified", "x")], "status string, source string")
    assert {(r.status, r.source, r.n) for r in P.audio_counts(df).collect()} == {("failed", None, 2), ("verified", None, 1), (None, "x", 2), (None, "y", 1), (None, None, 3)}
