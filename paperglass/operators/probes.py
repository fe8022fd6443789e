"""Audio probes folded to records: contents as variants, addresses with their outcomes, issues; and the report of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Identities of the parts of a listening test (a fixed value).
TEST_PART = r"^cambridge:(\d+):shared:listening:(\d+)"

_KEY = "identity string, scope string, part int"


def _keyed(rows: DataFrame) -> DataFrame:
    part = F.when(F.col("scope") != "full_test", F.col("part"))
    return rows.withColumn("_key", F.when(F.col("identity").isNotNull(), F.to_json(F.struct("identity", "scope", part.cast("int").alias("part")))))


def _audio_id(identity: Column, scope: Column, variant: Column) -> Column:
    return F.concat(F.lit("audio:"), identity, F.when(scope == "full_test", ":full").otherwise(""), F.when(variant > 1, F.concat(F.lit(":v"), variant.cast("string"))).otherwise(""))


def _home(homes: Column, at: Column, own: bool) -> Column:
    """The first of the records that listed an address before a time, or at it if `own`."""
    there = F.filter(homes, lambda h: h["since"].isNull() | ((h["since"] <= at) if own else (h["since"] < at)))
    return F.array_min(F.transform(there, lambda h: h["variant"]))


def fold_probes(candidates: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and issues of a catalogue after all its probes, whatever order they arrive in.

    `candidates`: (identity, scope, part, source, url, via), the addresses a record may be read from. `probes`: (probe_id, seen_at,
    identity, scope, part, source, url, via, sha256, error, magic_ok, decode_ok, bytes, duration_sec), in the order of (seen_at,
    probe_id). With a sha256 a probe is a success, else with an error a failure; one with neither is an issue `no_outcome`.

    * A probe belongs to the record that lists its address (candidates first, the least key if several; else the first success
      that brought the address before), else, if it is a success, to its identity, scope and part. Others change nothing.
    * The contents of one identity, scope and part are variants 1, 2, ... in the order of their first success; each from the second
      on is an issue `content_variant`. Addresses go with the content that they gave; candidates stay listed with variant 1.
    * The last success that says whether it decodes makes a record `available` or `failed`. Without one a record is `failed` with
      `all_urls_failed` once a failure finds all its addresses tried, else `candidate`. Of bytes and duration the last known stay.
    * A content that several records hold gives each of them an issue `duplicate_content_across_parts`.

    Records: identity, scope, part, variant, audio_id, source, status, error, sha256, bytes, duration_sec, urls (array of url, via,
    tried, last_error, by url). Issues: kind, audio_id, base_audio_id, sha256, probe_id. Every step groups by a record and an
    address or a content before it groups by a record, so a record's many probes are combined first.
    """
    at = F.struct("seen_at", "probe_id")
    candidates = _keyed(candidates).where("_key is not null")
    probes = _keyed(probes).withColumn("_at", at).withColumn("_ok", F.col("sha256").isNotNull())
    silent = probes.where("not _ok and error is null")
    probes = probes.where("_ok or error is not null")

    listed = candidates.where("url is not null").groupBy("url").agg(F.min("_key").alias("_owner"))
    brought = probes.where("_ok and url is not null and _key is not null").groupBy("url").agg(F.min_by("_key", "_at").alias("_bringer"), F.min("_at").alias("_since"))
    placed = probes.join(listed, "url", "left").join(brought, "url", "left")
    key = F.coalesce("_owner", F.when(F.col("_since") <= F.col("_at"), F.col("_bringer")), F.when(F.col("_ok"), F.col("_key")))
    placed = placed.withColumn("_key", key).where("_key is not null").drop("_owner", "_bringer", "_since")

    contents = placed.where("_ok").groupBy("_key", "sha256").agg(F.min("_at").alias("_first"), F.min_by("url", "_at").alias("url"))
    contents = contents.withColumn("variant", F.row_number().over(Window.partitionBy("_key").orderBy("_first")))
    hits = placed.where("_ok").join(contents.select("_key", "sha256", "variant"), ["_key", "sha256"])

    none = F.lit(None)
    lists = hits.where("url is not null").groupBy("_key", "url", "variant").agg(F.min("_at").alias("since"))
    lists = lists.unionByName(candidates.where("url is not null").select("_key", "url", F.lit(1).alias("variant"), none.cast(lists.schema["since"].dataType).alias("since")).distinct())
    homes = lists.groupBy("_key", "url").agg(F.collect_list(F.struct("variant", "since")).alias("_homes"))
    misses = placed.where("not _ok").join(homes, ["_key", "url"]).withColumn("variant", _home(F.col("_homes"), F.col("_at"), own=True)).where("variant is not null")

    tried = hits.unionByName(misses.drop("_homes")).select(
        "_key", "variant", "url", F.coalesce("via", F.lit("unknown")).alias("via"), "source", F.lit(False).alias("candidate"), "_at", "sha256", F.when(~F.col("_ok"), F.col("error")).alias("error"),
        F.when(~F.col("_ok"), F.col("_at")).alias("failed"), F.when(F.col("_ok") & F.col("bytes").isNotNull(), F.col("_at")).alias("sized"), "bytes",
        F.when(F.col("_ok") & F.col("duration_sec").isNotNull(), F.col("_at")).alias("timed"), "duration_sec", F.when(F.col("_ok") & F.col("decode_ok").isNotNull(), F.col("_at")).alias("decoded"), "decode_ok", "magic_ok",
    )
    open_ = candidates.select("_key", F.lit(1).alias("variant"), "url", "via", "source", F.lit(True).alias("candidate"))
    rows = tried.unionByName(open_, allowMissingColumns=True)
    by_url = rows.groupBy("_key", "variant", "url").agg(
        F.min_by("via", F.struct(~F.col("candidate"), "_at")).alias("via"), F.bool_or("candidate").alias("candidate"), F.min("_at").alias("first_tried"), F.max_by("error", "_at").alias("last_error"),
        F.max("failed").alias("failed"), F.max("sha256").alias("sha256"), F.max_by("bytes", "sized").alias("bytes"), F.max("sized").alias("sized"), F.max_by("duration_sec", "timed").alias("duration_sec"), F.max("timed").alias("timed"),
        F.max_by(F.struct("decode_ok", "magic_ok"), "decoded").alias("decode"), F.max("decoded").alias("decoded"),
    )
    named_by = F.coalesce("source", F.lit("unknown"))
    sources = rows.groupBy("_key").agg(F.min_by(named_by, F.struct(~F.col("candidate"), "_at", named_by)).alias("source"))
    entry = F.when(F.col("url").isNotNull(), F.struct("url", "via", F.col("first_tried").isNotNull().alias("tried"), "last_error"))
    waiting = F.col("candidate") & F.col("url").isNotNull()
    records = by_url.groupBy("_key", "variant").agg(
        F.array_sort(F.collect_list(entry)).alias("urls"), F.max("sha256").alias("sha256"), F.max_by("bytes", "sized").alias("bytes"), F.max_by("duration_sec", "timed").alias("duration_sec"),
        F.max_by("decode", "decoded").alias("_decode"), F.max("failed").alias("_failed"), F.coalesce(F.bool_and(F.when(waiting, F.col("first_tried").isNotNull())), F.lit(True)).alias("_all"), F.max(F.when(waiting, F.col("first_tried"))).alias("_all_at"),
    )
    gone = F.col("_all") & F.col("_failed").isNotNull() & (F.col("_all_at").isNull() | (F.col("_failed") >= F.col("_all_at")))
    decodes = F.col("_decode.decode_ok")
    status = F.when(decodes, "available").when(~decodes | gone, "failed").otherwise("candidate")
    why = F.when(~decodes & (~F.col("_decode.magic_ok")), "probe_failed").when(~decodes, "decode_failed").when(decodes.isNull() & gone, "all_urls_failed")
    k = F.from_json("_key", _KEY)
    records = records.join(sources, "_key").withColumn("_k", k).select(
        "_k.identity", "_k.scope", "_k.part", "variant", _audio_id(F.col("_k.identity"), F.col("_k.scope"), F.col("variant")).alias("audio_id"), "source",
        status.alias("status"), why.alias("error"), "sha256", "bytes", "duration_sec", "urls",
    )

    base = F.coalesce(_home(F.col("_homes"), F.col("_first"), own=False), F.lit(1))
    later = contents.where("variant > 1").join(homes, ["_key", "url"], "left").withColumn("_k", k)
    named = lambda v: _audio_id(F.col("_k.identity"), F.col("_k.scope"), v)
    variants = later.select(F.lit("content_variant").alias("kind"), named(F.col("variant")).alias("audio_id"), named(base).alias("base_audio_id"), "sha256", F.col("_first.probe_id").alias("probe_id"))
    held = records.where("sha256 is not null")
    twice = held.groupBy("sha256").agg(F.count("*").alias("_n")).where("_n > 1").select("sha256")
    copies = held.join(twice, "sha256").select(F.lit("duplicate_content_across_parts").alias("kind"), "audio_id", "sha256")
    mute = silent.select(F.lit("no_outcome").alias("kind"), "probe_id")
    return records, variants.unionByName(copies, allowMissingColumns=True).unionByName(mute, allowMissingColumns=True)


def audio_counts(records: DataFrame) -> DataFrame:
    """(status, source, n): records by status, by source and in all; a column outside a count is null."""
    return records.groupingSets([[F.col("status")], [F.col("source")], []], "status", "source").agg(F.count("*").alias("n"))


def audio_tests(records: DataFrame, derived: DataFrame, parts: int = 4) -> DataFrame:
    """(book, test, audio_complete, incomplete_parts) of every test that a record names.

    A test is complete if each of its parts has a verified record. A part that has none is `missing` without any record or derived
    interval, else `failed` or `available` if one of its records is, else `derived_only`, else `candidate`. Derived parts
    (identity, part) of tests without records name no test.
    """

    def of_test(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("book", F.regexp_extract("identity", TEST_PART, 1)).withColumn("test", F.regexp_extract("identity", TEST_PART, 2))
        return found.where("book <> ''").withColumn("book", F.col("book").cast("int")).withColumn("test", F.col("test").cast("int"))

    held = of_test(records).select("book", "test", F.when(F.col("scope") == "part", F.col("part")).alias("part"), "status", F.lit(False).alias("derived"), F.lit(True).alias("record"))
    cut = of_test(derived).select("book", "test", "part", F.lit(None).cast("string").alias("status"), F.lit(True).alias("derived"), F.lit(False).alias("record"))
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    by_part = held.unionByName(cut).groupBy("book", "test", "part").agg(F.bool_or("record").alias("named"), has("verified").alias("v"), has("failed").alias("f"), has("available").alias("a"), F.bool_or("derived").alias("d"))
    state = F.when(F.col("v"), "verified").when(F.col("f"), "failed").when(F.col("a"), "available").when(F.col("d"), "derived_only").otherwise("candidate")
    in_range = F.col("part").between(1, parts)
    tests = by_part.groupBy("book", "test").agg(F.bool_or("named").alias("named"), F.map_from_entries(F.collect_list(F.when(in_range, F.struct("part", state.alias("state"))))).alias("states")).where("named")
    each = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda p: F.struct(p.alias("part"), F.coalesce(F.try_element_at("states", p), F.lit("missing")).alias("status")))
    open_ = F.filter(each, lambda p: p["status"] != "verified")
    return tests.select("book", "test", open_.alias("incomplete_parts")).withColumn("audio_complete", F.size("incomplete_parts") == 0)
