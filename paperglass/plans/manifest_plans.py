"""Manifests, audio catalogues, question trees, boards and revisions of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.operators import manifests as M
from paperglass.operators import probes as P
from paperglass.operators import ranking as W
from paperglass.operators import reports as R
from paperglass.operators import revision as V
from paperglass.operators import search as S
from paperglass.operators import trust as T
from paperglass.plans import relation_plans  # noqa: F401  its SQL of answers is used
from paperglass.plans.registry import ORACLE_SQL, query
from paperglass.plans.roles import Roles

_PART = "SELECT p_brand, p_name, p_partkey, p_size, p_type FROM part"


def _revision_sql(rows: str, digits: tuple[int, ...], name: str) -> str:
    """CTEs `{name}{digits}` (place, node, n) of a query of parts."""
    out = f"""{name}rows AS ({rows}), {name}leaf AS (SELECT sha256(CAST(to_json({{p_brand: p_brand, p_name: p_name, p_partkey: p_partkey, p_size: p_size, p_type: p_type}}) AS VARCHAR)) AS place, count(*) AS n FROM {name}rows GROUP BY 1),
{name}9 AS (SELECT place, sha256(place || ':' || n) AS node, n FROM {name}leaf)"""
    last = 9
    for d in digits:
        out += f""", {name}{d} AS (SELECT substr(place, 1, {d}) AS place, sha256(string_agg(place || node, '' ORDER BY place)) AS node, CAST(sum(n) AS BIGINT) AS n FROM {name}{last} GROUP BY 1)"""
        last = d
    return out


@query(f"WITH {_revision_sql(_PART, (6, 3, 0), 'x')} SELECT 'rev-' || substr(node, 1, 32) AS revision, n AS rows FROM x0", with_roles=False)
def x4_dataset_revision(r: Roles):
    return V.dataset_revision(r.table("part").select("p_type", "p_size", "p_partkey", "p_name", "p_brand").repartition(7))


_NEW = "SELECT p_brand, p_name, p_partkey, CASE WHEN p_partkey % 40 = 0 THEN 0 ELSE p_size END AS p_size, p_type FROM part WHERE p_partkey % 50 <> 1"


@query(
    f"""WITH {_revision_sql(_PART, (6, 3), 'a')}, {_revision_sql(_NEW, (6, 3), 'b')}
SELECT coalesce(x.place, y.place) AS place, CASE WHEN x.place IS NULL THEN 'added' WHEN y.place IS NULL THEN 'removed' ELSE 'changed' END AS change, x.n AS rows_before, y.n AS rows_after
FROM a3 x FULL JOIN b3 y ON x.place = y.place WHERE x.node IS DISTINCT FROM y.node""",
    with_roles=False,
)
def x4_revision_changes(r: Roles):
    before = r.table("part").select("p_brand", "p_name", "p_partkey", "p_size", "p_type")
    after = before.where("p_partkey % 50 <> 1").withColumn("p_size", F.when(F.col("p_partkey") % 40 == 0, 0).otherwise(F.col("p_size")))
    return V.revision_changes(before, after)


def _items(r: Roles):
    k, j, n = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")
    names = F.array(*[F.lit(s) for s in ("listening", "reading", "writing", "speaking", "dance")])
    numbers = F.filter(F.sequence((j - 1) * 10 + 1, j * 10), lambda x: (F.col("l_partkey") % 11 != 0) | (x != (j - 1) * 10 + 2))
    page = F.struct(F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey")).cast("int").alias("file_page"))
    text = lambda c, m: (F.col(c) % m).cast("string")
    return r.table("lineitem").select(
        F.floor(k / 4).alias("book"), F.concat_ws(":", k.cast("string"), j.cast("string")).alias("id"), F.when(F.col("l_returnflag") == "A", "academic").when(F.col("l_returnflag") == "R", "general").otherwise("shared").alias("variant"),
        F.get(names, (k % 5).cast("int")).alias("skill"), (k % 4).cast("string").alias("test"), F.concat(F.when(k % 5 == 2, "WT").otherwise("P"), j.cast("string")).alias("part"),
        F.when(n > 45, "not_in_book").when(F.col("l_linestatus") == "O", "verified").when(n >= 3, "unverified").alias("status"), F.when(F.col("l_discount") > 0.05, F.array(page)).alias("evidence"),
        F.when(k % 5 < 2, numbers).alias("expected_numbers"), F.array(F.concat(F.lit("a"), text("l_suppkey", 2))).alias("assets"),
        F.array(F.struct(F.lit("g").alias("id"), F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("a"), text("l_partkey", 2))).alias("asset_ref"), F.array(F.concat(F.lit("P"), text("l_partkey", 6))).alias("parts"))).alias("groups"),
    )


_ITEM = """
WITH item AS (SELECT l_orderkey // 4 AS book, l_orderkey || ':' || l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 'academic' WHEN 'R' THEN 'general' ELSE 'shared' END AS variant,
  ['listening', 'reading', 'writing', 'speaking', 'dance'][1 + l_orderkey % 5] AS skill, CAST(l_orderkey % 4 AS VARCHAR) AS test, CASE WHEN l_orderkey % 5 = 2 THEN 'WT' ELSE 'P' END || l_linenumber AS part,
  CASE WHEN l_quantity > 45 THEN 'not_in_book' WHEN l_linestatus = 'O' THEN 'verified' WHEN l_quantity >= 3 THEN 'unverified' END AS status, l_discount > 0.05 AS shown, l_suppkey % 3 <> 0 AS paged,
  CASE WHEN l_orderkey % 5 < 2 THEN list_filter(range((l_linenumber - 1) * 10 + 1, l_linenumber * 10 + 1), lambda x: l_partkey % 11 <> 0 OR x <> (l_linenumber - 1) * 10 + 2) ELSE [] END AS numbers,
  l_partkey % 3 <> 0 AND l_partkey % 2 <> l_suppkey % 2 AS dangling, 'P' || l_partkey % 6 AS group_part, l_partkey % 11 = 0 AS gap FROM lineitem),
number AS (SELECT book, variant, skill, test, number, count(*) AS n FROM (SELECT book, variant, skill, test, unnest(numbers) AS number FROM item) GROUP BY ALL)
"""


@query(
    _ITEM
    + """, finding AS (
SELECT book, id AS item_id, 'illegal_status' AS rule, 'error' AS severity, NULL AS detail FROM item WHERE status IS NULL
UNION ALL SELECT book, id, 'illegal_skill', 'error', NULL FROM item WHERE skill = 'dance'
UNION ALL SELECT book, id, 'variant_not_allowed', 'error', NULL FROM item WHERE (skill IN ('listening', 'speaking') AND variant <> 'shared') OR (skill IN ('reading', 'writing') AND variant = 'shared')
UNION ALL SELECT book, id, 'invalid_part', 'error', NULL FROM item WHERE (skill = 'listening' AND part NOT IN ('P1', 'P2', 'P3', 'P4')) OR (skill = 'reading' AND part NOT IN ('P1', 'P2', 'P3')) OR (skill = 'writing' AND part NOT IN ('WT1', 'WT2')) OR skill = 'speaking'
UNION ALL SELECT book, id, 'verified_without_evidence', 'error', NULL FROM item WHERE status = 'verified' AND NOT shown
UNION ALL SELECT book, id, 'verified_without_page', 'warning', NULL FROM item WHERE status = 'verified' AND shown AND NOT paged
UNION ALL SELECT book, id, 'numbers_not_gap_free', 'error', NULL FROM item WHERE skill IN ('listening', 'reading') AND gap
UNION ALL SELECT book, id, 'unknown_asset', 'error', 'g' FROM item WHERE dangling
UNION ALL SELECT book, id, 'invalid_group_part', 'error', 'g:' || group_part FROM item WHERE (skill = 'listening' AND group_part IN ('P0', 'P5')) OR (skill = 'reading' AND group_part IN ('P0', 'P4', 'P5')) OR skill IN ('writing', 'speaking')
UNION ALL SELECT DISTINCT book, id, 'duplicate_item_id', 'error', CAST(count(*) OVER (PARTITION BY id) AS VARCHAR) FROM item QUALIFY count(*) OVER (PARTITION BY id) > 1
UNION ALL SELECT book, NULL, 'overlapping_number', 'error', variant || ':' || skill || ':' || test || ':' || number FROM number WHERE n > 1
UNION ALL SELECT book, NULL, 'not_contiguous_from_1', 'error', variant || ':' || skill || ':' || test FROM number GROUP BY book, variant, skill, test HAVING list_sort(flatten(list(list_transform(range(n), lambda i: number)))) <> range(1, CAST(sum(n) AS BIGINT) + 1))
SELECT * FROM finding
""",
    with_roles=False,
)
def g7_manifest_rules(r: Roles):
    return M.manifest_findings(_items(r))


@query(
    _ITEM
    + """, unit AS (SELECT book, variant, skill, test, count(*) = count(*) FILTER (status = 'verified') AS v, count(*) = count(*) FILTER (status = 'not_in_book') AS a, sum(len(numbers)) AS q FROM item GROUP BY ALL),
part AS (SELECT 'variant,skill' AS level, variant, skill, CAST(NULL AS BIGINT) AS book, v, a, q FROM unit UNION ALL SELECT 'book', NULL, NULL, book, v, a, q FROM unit UNION ALL SELECT '', NULL, NULL, NULL, v, a, q FROM unit)
SELECT level, variant, skill, book, count(*) AS expected_units, count(*) FILTER (v) AS verified_units, count(*) FILTER (a) AS not_in_book_units, count(*) - count(*) FILTER (v) - count(*) FILTER (a) AS unverified_units, CAST(sum(q) AS BIGINT) AS questions_expected
FROM part GROUP BY ALL
""",
    with_roles=False,
)
def a17_unit_coverage(r: Roles):
    return M.manifest_coverage(_items(r), [["variant", "skill"], ["book"], []])


@query(
    _ITEM
    + """, book AS (SELECT DISTINCT o_orderkey // 4 + 3 AS book FROM orders),
b AS (SELECT book, CASE WHEN book % 4 <> 0 THEN 'complete' END AS e, CASE book % 5 WHEN 0 THEN 'unverified' WHEN 1 THEN 'not_in_book' WHEN 2 THEN NULL ELSE 'in_book' END AS g,
  (SELECT count(*) FROM item i WHERE i.book = book.book) AS n, (SELECT count(*) FROM item i WHERE i.book = book.book AND status = 'verified') AS v FROM book)
SELECT book, list_filter([CASE WHEN n = 0 THEN 'no_items' WHEN v < n THEN 'items_not_verified' END, CASE WHEN e IS NULL THEN 'extraction_open' END, CASE WHEN g IS NULL OR g = 'unverified' THEN 'general_open' END], lambda x: x IS NOT NULL) AS reasons,
  n > 0 AND v = n AND e IS NOT NULL AND coalesce(g, '') IN ('in_book', 'not_in_book') AS complete FROM b
""",
    with_roles=False,
)
def a17_book_completeness(r: Roles):
    book = (F.floor(F.col("o_orderkey") / 4) + 3).alias("book")
    g = F.when(F.col("book") % 5 == 0, "unverified").when(F.col("book") % 5 == 1, "not_in_book").when(F.col("book") % 5 > 2, "in_book")
    books = r.table("orders").select(book).distinct().select("book", F.when(F.col("book") % 4 != 0, "complete").alias("extraction"), F.when(F.col("book") % 2 == 0, g).otherwise("").alias("general"), g.alias("gt"))
    return M.book_completeness(_items(r), books)


def _catalogue(r: Roles):
    """Candidates of three addresses for each user's part of a test, and events as probes of five."""
    u, e = F.col("user_id"), F.col("event_id")
    identity = F.concat_ws(":", F.lit("cambridge"), (u % 21).cast("string"), F.lit("shared:listening"), (u % 4).cast("string"), u.cast("string"))
    own = [identity.alias("identity"), F.lit("part").alias("scope"), (u % 4 + 1).cast("int").alias("part")]
    users = r.table("events").select("user_id").distinct()
    candidates = users.select(*own, F.lit("s").alias("source"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.concat(F.lit("u"), u.cast("string"), F.lit("-"), n.cast("string")))).alias("url"), F.lit("raw").alias("via"))
    bad = (F.col("event_type") == "error") | ((u % 3 == 0) & (F.col("event_type") != "click"))
    probes = r.table("events").select(
        e.alias("probe_id"), F.col("ts").alias("seen_at"), F.when(e % 17 != 0, identity).alias("identity"), *own[1:], F.lit("t").alias("source"),
        F.when(e % 13 != 0, F.concat(F.lit("u"), u.cast("string"), F.lit("-"), (e % 5).cast("string"))).alias("url"), F.lit("api").alias("via"), F.when(~bad, F.concat(F.lit("s"), (e % 2).cast("string"), F.lit("-"), (u % 9).cast("string"))).alias("sha256"),
        F.when(bad, "http").alias("error"), F.lit(None).cast("boolean").alias("magic_ok"), F.when((u % 3 == 2) & F.col("event_type").isin("click", "view"), F.col("event_type") == "click").alias("decode_ok"),
        F.when(e % 3 == 0, e).alias("bytes"), F.lit(None).cast("double").alias("duration_sec"),
    )
    return candidates, probes


_PROBE = """
WITH ev AS (SELECT event_id AS probe_id, row_number() OVER (ORDER BY ts, event_id) AS tm, user_id AS u, event_id % 17 <> 0 AS named, CASE WHEN event_id % 13 <> 0 THEN event_id % 5 END AS url, coalesce(event_id % 13 <> 0 AND event_id % 5 < 3, false) AS listed,
  CASE WHEN NOT (event_type = 'error' OR (user_id % 3 = 0 AND event_type <> 'click')) THEN 's' || event_id % 2 || '-' || user_id % 9 END AS sha, CASE WHEN user_id % 3 = 2 AND event_type IN ('click', 'view') THEN event_type = 'click' END AS decode,
  CASE WHEN event_id % 3 = 0 THEN event_id END AS bytes FROM events),
brought AS (SELECT u, url, min(tm) AS since FROM ev WHERE sha IS NOT NULL AND named AND url IS NOT NULL GROUP BY 1, 2),
hit0 AS (SELECT ev.* FROM ev LEFT JOIN brought b ON b.u = ev.u AND b.url = ev.url WHERE sha IS NOT NULL AND (listed OR named OR b.since <= tm)),
content AS (SELECT u, sha, min(tm) AS first, row_number() OVER (PARTITION BY u ORDER BY min(tm)) AS variant FROM hit0 GROUP BY 1, 2),
hit AS (SELECT h.*, variant FROM hit0 h JOIN content c ON c.u = h.u AND c.sha = h.sha),
puts AS (SELECT u, url, variant, min(tm) AS since FROM hit WHERE url IS NOT NULL GROUP BY 1, 2, 3),
miss AS (SELECT e.*, CASE WHEN listed THEN 1 ELSE (SELECT min(variant) FROM puts p WHERE p.u = e.u AND p.url = e.url AND p.since <= e.tm) END AS variant FROM ev e WHERE sha IS NULL AND url IS NOT NULL),
open AS (SELECT DISTINCT u, unnest(range(3)) AS url FROM ev),
tried AS (SELECT u, variant, url, tm FROM hit UNION ALL SELECT u, variant, url, tm FROM miss WHERE variant IS NOT NULL),
list AS (SELECT u, 1 AS variant, url FROM open UNION SELECT u, variant, url FROM puts),
state AS (SELECT l.u, l.variant, l.url, min(tm) AS first, l.variant = 1 AND l.url < 3 AS candidate FROM list l LEFT JOIN tried t ON t.u = l.u AND t.variant = l.variant AND t.url = l.url GROUP BY ALL),
rec AS (SELECT u, variant, count(*) AS n_urls, count(first) AS n_tried, coalesce(bool_and(first IS NOT NULL) FILTER (candidate), true) AS all_tried, max(first) FILTER (candidate) AS all_at FROM state GROUP BY 1, 2),
every AS (SELECT u, 1 AS variant FROM ev UNION SELECT u, variant FROM content),
said AS (SELECT u, variant, arg_max(decode, tm) FILTER (decode IS NOT NULL) AS ok, arg_max(bytes, tm) FILTER (bytes IS NOT NULL) AS bytes, min(sha) AS sha FROM hit GROUP BY 1, 2),
lost AS (SELECT u, variant, max(tm) AS tm FROM miss WHERE variant IS NOT NULL GROUP BY 1, 2),
record AS (SELECT 'audio:cambridge:' || e.u % 21 || ':shared:listening:' || e.u % 4 || ':' || e.u || CASE WHEN e.variant > 1 THEN ':v' || e.variant ELSE '' END AS audio_id, e.u, e.variant, sha AS sha256, bytes, coalesce(n_urls, 0) AS n_urls, coalesce(n_tried, 0) AS n_tried,
  CASE WHEN ok THEN 'available' WHEN NOT ok OR (coalesce(all_tried, true) AND (all_at IS NULL OR lost.tm >= all_at) AND lost.tm IS NOT NULL) THEN 'failed' ELSE 'candidate' END AS status, CASE WHEN NOT ok THEN 'decode_failed' END AS decoded
  FROM every e LEFT JOIN rec r ON r.u = e.u AND r.variant = e.variant LEFT JOIN said s ON s.u = e.u AND s.variant = e.variant LEFT JOIN lost ON lost.u = e.u AND lost.variant = e.variant)
"""


@query(_PROBE + "SELECT audio_id, CAST(variant AS INTEGER) AS variant, status, CASE WHEN status = 'failed' THEN coalesce(decoded, 'all_urls_failed') END AS error, sha256, bytes, n_urls, n_tried FROM record", with_roles=False)
def g6_probe_records(r: Roles):
    records, _ = P.fold_probes(*_catalogue(r))
    counts = [F.size("urls").cast("long").alias("n_urls"), F.size(F.filter("urls", lambda u: u["tried"])).cast("long").alias("n_tried")]
    return records.select("audio_id", "variant", "status", "error", "sha256", "bytes", *counts)


@query(
    _PROBE
    + """SELECT 'duplicate_content_across_parts' AS kind, audio_id, sha256 FROM record WHERE sha256 IN (SELECT sha256 FROM record GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'content_variant', audio_id, sha256 FROM record WHERE variant > 1""",
    with_roles=False,
)
def g6_probe_issues(r: Roles):
    return P.fold_probes(*_catalogue(r))[1].select("kind", "audio_id", "sha256")


_AUDIO = """
WITH rec AS (SELECT event_id, user_id % 29 AS book, (user_id // 29 + event_id) % 5 AS test, event_id % 7 AS part, CASE event_type WHEN 'view' THEN 'verified' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'available' ELSE 'candidate' END AS status, event_id % 11 = 0 AS whole, 's' || event_id % 3 AS source FROM events WHERE event_id % 10 <> 9),
cut AS (SELECT user_id % 29 AS book, (user_id // 29 + event_id) % 5 AS test, event_id % 7 AS part FROM events WHERE event_id % 10 = 9)
"""


def _audio(r: Roles):
    u, e = F.col("user_id"), F.col("event_id")
    name = F.concat(F.lit("cambridge:"), (u % 29).cast("string"), F.lit(":shared:listening:"), ((F.floor(u / 29) + e) % 5).cast("string"))
    status = F.when(F.col("event_type") == "view", "verified").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "available").otherwise("candidate")
    rows = r.table("events").select(e.alias("event_id"), name.alias("identity"), F.when(e % 11 == 0, "full_test").otherwise("part").alias("scope"), (e % 7).cast("int").alias("part"), status.alias("status"), F.concat(F.lit("s"), (e % 3).cast("string")).alias("source"))
    return rows.where("event_id % 10 <> 9"), rows.where("event_id % 10 = 9")


@query(
    _AUDIO
    + """, place AS (SELECT book, test, p FROM (SELECT DISTINCT book, test FROM rec), range(1, 5) t(p)),
s AS (SELECT place.*, (SELECT list(DISTINCT status) FROM rec WHERE rec.book = place.book AND rec.test = place.test AND part = p AND NOT whole) AS st, EXISTS (SELECT 1 FROM cut WHERE cut.book = place.book AND cut.test = place.test AND part = p) AS d FROM place),
f AS (SELECT book, test, p, CASE WHEN list_contains(st, 'failed') THEN 'failed' WHEN list_contains(st, 'available') THEN 'available' WHEN d THEN 'derived_only' WHEN st IS NULL THEN 'missing' ELSE 'candidate' END AS status FROM s WHERE NOT coalesce(list_contains(st, 'verified'), false))
SELECT CAST(t.book AS INTEGER) AS book, CAST(t.test AS INTEGER) AS test, coalesce((SELECT string_agg(p || '=' || status, ',' ORDER BY p) FROM f WHERE f.book = t.book AND f.test = t.test), '') AS incomplete, NOT EXISTS (SELECT 1 FROM f WHERE f.book = t.book AND f.test = t.test) AS audio_complete
FROM (SELECT DISTINCT book, test FROM rec) t
""",
    with_roles=False,
)
def a19_audio_tests(r: Roles):
    open_ = F.transform("incomplete_parts", lambda p: F.concat_ws("=", p["part"].cast("string"), p["status"]))
    return P.audio_tests(*_audio(r)).select("book", "test", F.array_join(open_, ",").alias("incomplete"), "audio_complete")


@query(_AUDIO + "SELECT status, NULL AS source, count(*) AS n FROM rec GROUP BY 1 UNION ALL SELECT NULL, source, count(*) FROM rec GROUP BY 2 UNION ALL SELECT NULL, NULL, count(*) FROM rec", with_roles=False)
def a19_audio_counts(r: Roles):
    return P.audio_counts(_audio(r)[0])


@query("""
, q AS (SELECT id, paper_id, parent_id, depth + CASE WHEN id % 13 = 0 THEN 2 ELSE 0 END AS depth, display_order, CASE WHEN id % 17 = 0 THEN 'x' WHEN parent_id IS NULL THEN CAST(display_order // 4 + 1 AS VARCHAR) ELSE number_path END AS number_path FROM question WHERE id % 9 <> 0),
t AS (SELECT id, paper_id, display_order, TRY_CAST(number_path AS INTEGER) AS n, number_path FROM q WHERE parent_id IS NULL),
i AS (SELECT id, paper_id, n, (SELECT max_by(p.n, p.display_order) FROM t p WHERE p.paper_id = t.paper_id AND p.n IS NOT NULL AND p.display_order < t.display_order) AS prev FROM t WHERE n IS NOT NULL)
SELECT paper_id, id, 'top_level_number_not_integer' AS rule, 'warning' AS severity, number_path AS detail FROM t WHERE n IS NULL
UNION ALL SELECT paper_id, id, 'numbering_gap', 'error', prev || ' -> ' || n FROM i WHERE n <> prev + 1
UNION ALL SELECT paper_id, id, 'numbering_not_start_at_one', 'error', CAST(n AS VARCHAR) FROM i WHERE prev IS NULL AND n <> 1
UNION ALL SELECT paper_id, NULL, 'duplicate_number_paths', 'error', number_path || ' x' || count(*) FROM q GROUP BY paper_id, number_path HAVING count(*) > 1
UNION ALL SELECT c.paper_id, c.id, 'depth_skip', 'warning', p.depth || ' -> ' || c.depth FROM q c JOIN q p ON p.id = c.parent_id AND p.paper_id = c.paper_id WHERE c.depth - p.depth > 1
UNION ALL SELECT paper_id, id, 'parent_missing', 'error', CAST(parent_id AS VARCHAR) FROM q WHERE parent_id NOT IN (SELECT id FROM q)
""")
def w9_tree_findings(r: Roles):
    path = F.when(F.col("id") % 17 == 0, "x").when(F.col("parent_id").isNull(), (F.floor(F.col("display_order") / 4) + 1).cast("string")).otherwise(F.col("number_path"))
    return W.tree_findings(r.questions().where("id % 9 <> 0").withColumn("number_path", path).withColumn("depth", F.col("depth") + F.when(F.col("id") % 13 == 0, 2).otherwise(0)))


@query(
    """
WITH s AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, lo, hi, l_linenumber) AS rn FROM (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS lo, l_partkey % 50 + l_suppkey % 7 - 1 AS hi FROM lineitem) WHERE hi >= lo),
h AS (SELECT *, NOT EXISTS (SELECT 1 FROM s b WHERE b.l_orderkey = s.l_orderkey AND b.rn < s.rn AND b.hi >= s.lo) AS head FROM s),
c AS (SELECT h.*, (SELECT count(*) FROM h b WHERE b.l_orderkey = h.l_orderkey AND b.rn <= h.rn AND b.head) AS cluster FROM h)
SELECT l_orderkey, l_linenumber, lo, hi, cluster, size, reaches FROM c JOIN (SELECT l_orderkey, cluster, count(*) AS size, max(hi) AS reaches FROM c GROUP BY 1, 2 HAVING count(*) > 1) USING (l_orderkey, cluster)
""",
    with_roles=False,
)
def a25_overlapping_intervals(r: Roles):
    lo = F.col("l_partkey") % 50
    rows = r.table("lineitem").select("l_orderkey", "l_linenumber", lo.alias("lo"), (lo + F.col("l_suppkey") % 7 - 1).alias("hi"))
    return W.overlapping_intervals(rows, "l_orderkey", "l_linenumber", "lo", "hi")


@query("""
, e AS (SELECT *, CASE WHEN id % 5 <> 0 THEN 1 END AS marks FROM (SELECT id, paper_id, number_path FROM entry UNION ALL SELECT id, paper_id, number_path FROM entry WHERE id % 20 = 0 OR id % 31 = 0))
SELECT paper_id, number_path, 'ms_duplicate_numbers' AS rule, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT a.paper_id, a.number_path, 'ms_parent_child_marks_ambiguous', count(*) FROM (SELECT DISTINCT paper_id, number_path FROM e WHERE marks IS NOT NULL) a JOIN e b ON b.paper_id = a.paper_id AND b.marks IS NOT NULL AND starts_with(b.number_path, a.number_path || '(') GROUP BY 1, 2
UNION ALL SELECT paper_id, number_path, 'ms_marks_missing', count(*) FROM e WHERE marks IS NULL GROUP BY 1, 2
""")
def a25_entry_findings(r: Roles):
    e = r.entries().select("id", "paper_id", "number_path")
    return R.entry_findings(e.unionByName(e.where("id % 20 = 0 or id % 31 = 0")).withColumn("marks", F.when(F.col("id") % 5 != 0, 1)))


@query(
    """
WITH doc AS (SELECT c_custkey AS id, r_name AS board, CASE WHEN c_custkey % 29 = 0 THEN 'failed' WHEN c_custkey % 6 < 5 THEN 'parsed' END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA'),
b AS (SELECT r_name AS board, (SELECT count(*) FROM doc WHERE board = r_name) AS documents, (SELECT count(*) FROM doc JOIN orders ON o_custkey = id WHERE board = r_name) AS papers,
  (SELECT count(*) FROM doc JOIN orders ON o_custkey = id JOIN lineitem ON l_orderkey = o_orderkey WHERE board = r_name) AS questions, (SELECT count(*) FROM doc WHERE board = r_name AND status = 'failed') AS failed,
  (SELECT count(*) FROM doc WHERE board = r_name AND status = 'parsed') AS parsed, (SELECT count(*) FROM doc JOIN events ON user_id = id WHERE board = r_name AND event_type IN ('error', 'purchase') AND event_id % 3 <> 0) AS open_errors,
  (SELECT count(*) FROM doc JOIN events ON user_id = id WHERE board = r_name AND event_type = 'click' AND event_id % 2 = 0) AS open_reviews FROM region)
SELECT board, documents, papers, questions, failed, open_errors, open_reviews, round(parsed / nullif(documents, 0), 4) AS parsed_ratio, round(questions / nullif(papers, 0), 4) AS questions_per_paper, CASE WHEN documents > 0 THEN failed = 0 AND open_errors = 0 END AS healthy FROM b
""",
    with_roles=False,
)
def a6_board_totals(r: Roles):
    c, n, g = r.table("customer"), r.table("nation"), r.table("region")
    docs = c.join(n, c.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey).where("r_name <> 'AFRICA'")
    docs = docs.select(F.col("c_custkey").alias("id"), F.col("r_name").alias("board"), F.when(F.col("c_custkey") % 29 == 0, "failed").when(F.col("c_custkey") % 6 < 5, "parsed").alias("status"))
    kind = F.col("event_type")
    severity = F.when(kind == "error", "error").when(kind == "purchase", "critical").otherwise("warning")
    findings = r.table("events").select(F.col("user_id").alias("document_id"), severity.alias("severity"), F.when(F.col("event_id") % 3 != 0, "open").otherwise("closed").alias("status"))
    reviews = r.table("events").where(kind == "click").select(F.col("user_id").alias("document_id"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("done").alias("status"))
    papers = r.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"))
    return R.board_status(g.select(F.col("r_name").alias("board")), docs, papers, r.table("lineitem").select(F.col("l_orderkey").alias("paper_id")), findings, reviews)


@query(f"""
, ans AS ({ORACLE_SQL["j10_resolve_answers"]}), best AS (SELECT question_id, max(confidence) AS confidence FROM link WHERE code = 'T8' GROUP BY 1),
hit AS (SELECT q.*, p.year, p.board, p.subject_code, p.session, p.paper_code, b.confidence FROM question q JOIN paper p ON p.id = q.paper_id JOIN best b ON b.question_id = q.id WHERE session = 'june' AND year >= 2017 AND b.confidence >= 0.1 AND board <> 'EUROPE')
SELECT hit.id, year, paper_id, confidence, substr(trim(regexp_replace(stem_text, '\\s+', ' ', 'g')), 1, 200) AS excerpt, (SELECT count(*) FROM hit) AS total, number_path, marks, board, subject_code, session, paper_code, 'T8' AS taxonomy_code,
  CASE WHEN hit.id % 2 = 0 THEN 'auto' ELSE 'manual' END AS source, CASE WHEN hit.id % 2 = 1 THEN 'agent' END AS assigned_by, 'T8 of ' || board AS taxonomy_name, mode AS answer_mode, answer
FROM hit LEFT JOIN ans ON ans.id = hit.id ORDER BY year DESC, paper_id, display_order, hit.id LIMIT 15
""")
def f10_tagged_with_answers(r: Roles):
    boards = r.table("region").where("r_name <> 'EUROPE'").select(F.col("r_name").alias("board"))
    nodes = r.nodes().select("code").crossJoin(boards).withColumn("name", F.concat("code", F.lit(" of "), "board"))
    links = r.links().withColumn("assigned_by", F.when(F.col("source") == "manual", "agent"))
    return S.tagged_questions(r.questions(), r.papers(), links, "T8", min_confidence=0.1, limit=15, year_from=2017, session="june", nodes=nodes, entries=r.entries(), official=r.official())


_ENTRY = """
WITH e AS (SELECT o_orderkey AS id, ['question', 'answer', 'tag', 'widget'][1 + o_custkey % 4] AS kind, CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN '__unknown__' ELSE 'v' END AS val,
  ['complete', 'partial', 'missing', NULL][1 + o_orderkey % 4] AS content, ['present', 'missing', NULL][1 + o_orderkey % 3] AS presence, ['source_verified', 'manual_adjudicated', 'unverified', NULL, NULL][1 + o_orderkey % 5] AS verification,
  o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS authority, o_orderpriority LIKE '3%' AS rumour, o_orderpriority NOT LIKE '5%' AS evidence, o_orderstatus = 'F' AS chosen FROM orders),
p AS (SELECT *, kind IN ('question', 'answer') AS bears, coalesce(verification IN ('source_verified', 'manual_adjudicated'), false) AS verified, content IS NOT NULL OR presence IS NOT NULL OR verification IS NOT NULL AS said,
  CASE WHEN val IS NULL THEN 'identity_none_value:' WHEN val = '' THEN 'identity_empty_value:' WHEN val = '__unknown__' THEN 'identity_unknown_encoding:' END AS odd FROM e),
c AS (SELECT *, concat_ws('; ', CASE WHEN rumour THEN 'unknown_evidence_label:rumour' END, CASE WHEN NOT bears AND (verified OR presence IS NOT NULL) THEN 'answer_axis_not_applicable' END, CASE WHEN content = 'complete' AND NOT evidence THEN 'content_claim_without_evidence' END,
  CASE WHEN bears AND verification = 'source_verified' AND NOT authority THEN 'verification_without_authoritative_evidence' END, CASE WHEN bears AND verification = 'manual_adjudicated' AND NOT chosen THEN 'verification_without_manual_decision' END,
  CASE WHEN bears AND verified AND (presence = 'missing' OR content = 'missing') THEN 'quality_claim_contradiction' END) AS claims,
  CASE kind WHEN 'tag' THEN concat_ws('; ', odd || 'scheme', 'identity_missing_key:version') WHEN 'widget' THEN coalesce(odd || 'scheme', '') WHEN 'question' THEN 'identity_missing_key:system; identity_missing_key:container_native_identity; identity_missing_key:native_id; identity_missing_key:number_path; identity_missing_key:parent_native_id'
  ELSE 'identity_missing_key:system; identity_missing_key:question_native_id; identity_missing_key:source; identity_missing_key:native_answer_key' END AS identity FROM p)
"""


def _entries(r: Roles):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    pick = lambda by, values: F.get(F.array(*[F.lit(v) for v in values]), by.cast("int"))
    value = F.when(k % 31 != 0, F.when(k % 7 == 0, "").when(k % 11 == 0, "__unknown__").otherwise("v"))
    claims = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in (("content", pick(k % 4, ["complete", "partial", "missing", None])), ("answer_presence", pick(k % 3, ["present", "missing", None])), ("answer_verification", pick(k % 5, ["source_verified", "manual_adjudicated", "unverified", None, None])))]))
    label = F.when(F.startswith(p, F.lit("1")), "copied_snapshot").when(F.startswith(p, F.lit("2")), "full_source_validation").when(F.startswith(p, F.lit("3")), "rumour").when(~F.startswith(p, F.lit("5")), "static_inspection")
    return r.table("orders").select(
        k.alias("public_id"), pick(F.col("o_custkey") % 4, ["question", "answer", "tag", "widget"]).alias("kind"), F.map_from_entries(F.array(F.struct(F.lit("scheme"), value), F.struct(F.lit("code"), F.lit("c")))).alias("identity_fields"),
        F.map_filter(claims, lambda _, v: v.isNotNull()).alias("quality_summary"), F.array_compact(F.array(label)).alias("evidence_labels"), F.when(F.col("o_orderstatus") == "F", "B").otherwise(" ").alias("selected_value"),
    )


@query(
    _ENTRY
    + """SELECT id AS public_id, identity, claims, CASE WHEN claims <> '' THEN 'partial' WHEN NOT said THEN 'unknown' WHEN content = 'complete' AND (verified OR NOT bears) THEN 'verified' ELSE 'partial' END AS state,
  CASE WHEN claims <> '' THEN claims WHEN NOT said THEN 'no_quality_information' ELSE concat_ws('; ', CASE WHEN coalesce(content, '') <> 'complete' THEN 'content_not_complete' END, CASE WHEN bears AND NOT verified THEN 'answers_not_verified' END) END AS reasons FROM c""",
    with_roles=False,
)
def x36_entry_quality(r: Roles):
    joined = lambda c: F.array_join(c, "; ")
    return T.entry_quality(_entries(r)).select("public_id", joined("identity_problems").alias("identity"), joined("claim_problems").alias("claims"), "state", joined("reasons").alias("reasons"))


@query(_ENTRY + "SELECT id AS public_id, 'identity_unresolved' AS code, identity AS detail FROM c WHERE identity <> '' UNION ALL SELECT id, 'quality_claim_invalid', claims FROM c WHERE claims <> ''", with_roles=False)
def x36_problem_records(r: Roles):
    return T.problem_records(T.entry_quality(_entries(r)))
