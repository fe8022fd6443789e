"""Scans and sinks of files: each query writes a table in the format of a source to the shared folder and scans it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.plans.registry import query
from paperglass.plans.roles import Roles
from paperglass.sources import tables as S


@query("SELECT c_custkey AS id, c_name AS title, c_mktsegment AS code FROM customer", with_roles=False)
def s1_table_scan(r: Roles):
    """A stored table whose file lacks columns of the schema and has one more."""
    folder = S.work_folder(r.spark)
    r.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("code"), F.lit(1).alias("other")).write.parquet(folder)
    return S.scan(r.spark, folder, "subject").where("slug is null and created_at is null").select("id", "title", "code")


def _lines(r: Roles, name: str):
    """JSON lines of the orders: some are blank, some broken."""
    k = F.col("o_orderkey")
    good = F.to_json(F.struct(k.alias("question_id"), F.col("o_orderstatus").alias("decision")))
    folder = f"{S.work_folder(r.spark)}/{name}"
    line = F.when(k % 7 == 0, "").when(k % 5 == 0, F.concat(F.lit("{broken"), k.cast("string"))).otherwise(good)
    r.table("orders").select(line.alias("value")).write.text(folder)
    return folder


@query("SELECT o_orderkey AS question_id, o_orderstatus AS decision FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0", with_roles=False)
def s2_lenient_lines(r: Roles):
    return S.read_jsonl(r.spark, _lines(r, "lines"), "question_id long, decision string").where("question_id is not null")


@query("SELECT n_name AS file, CAST(3 AS BIGINT) AS line, 'broken ' || n_name AS value FROM nation WHERE n_nationkey % 3 = 0", with_roles=False)
def s3_decision_problems(r: Roles):
    """A file of decisions for each nation; every third has a broken line behind a blank one; applied files are not read."""
    folder = S.work_folder(r.spark)
    k, good = F.col("n_nationkey"), F.to_json(F.struct(F.col("n_nationkey").alias("question_id"), F.lit("keep").alias("decision")))
    files = r.table("nation").select("n_name", F.concat_ws("\n", good, F.lit(""), F.when(k % 3 == 0, F.concat(F.lit("broken "), F.col("n_name"))), good).alias("value"))
    rows = [(x["n_name"], x["value"]) for x in files.collect()]  # a file for each of the 25 nations
    place = r.spark._jvm.org.apache.hadoop.fs
    for name, text in [*rows, ("NONE.applied", "broken")]:
        path = place.Path(f"{folder}/{name}.jsonl")
        out = path.getFileSystem(r.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
    bad = S.read_decisions(r.spark, folder, "question_id long, decision string")[1]
    return bad.select(F.replace("file", F.lit(".jsonl"), F.lit("")).alias("file"), F.col("line").cast("long").alias("line"), F.trim("value").alias("value"))


@query("SELECT r_name AS board, n_name AS key, strftime(o_orderdate, '%Y-%m-%d') AS date, c_mktsegment AS subject_code FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey % 10 = 1", with_roles=False)
def s4_season_scan(r: Roles):
    return S.season_scan(r.spark, _seasons(r)).select("board", "key", F.date_format("date", "yyyy-MM-dd").alias("date"), "subject_code")


@query("SELECT r_name AS board, n_name AS season, c_custkey AS component FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey IN (SELECT c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 = 1)", with_roles=False)
def s4_season_windows(r: Roles):
    return S.season_windows(r.spark, _seasons(r)).select("board", "season", F.col("component").cast("long").alias("component"))


def _seasons(r: Roles) -> str:
    folder = S.work_folder(r.spark)
    c = r.table("customer").join(r.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(r.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.select(F.col("r_name").alias("board"), F.col("n_name").alias("key"), "c_custkey", "c_mktsegment")
    events = r.table("orders").where("o_orderkey % 10 = 1").join(c, F.col("o_custkey") == F.col("c_custkey"))
    of_season = events.groupBy("board", "key").agg(F.collect_list(F.struct(F.to_date("o_orderdate").alias("date"), F.col("c_mktsegment").alias("subject_code"), F.lit(90).alias("duration_minutes"))).alias("events"))
    windows = c.groupBy("board", "key").agg(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("component"), F.lit("2024-05-01").alias("start"))).alias("date_windows"))
    of_season.join(windows, ["board", "key"]).withColumn("_file", F.col("key")).write.partitionBy("_file").json(folder)  # one object in each file
    return folder


@query("SELECT r_name AS board, n_name AS key, CASE n_nationkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'cancelled' ELSE 'unobtainable' END AS state FROM nation JOIN region ON n_regionkey = r_regionkey", with_roles=False)
def s4_season_list(r: Roles):
    folder, m = S.work_folder(r.spark), F.col("n_nationkey") % 3
    n = r.table("nation").join(r.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = [F.collect_list(F.when(m == k, F.struct(F.col("n_name").alias("key"), F.lit("x").alias("reason")))).alias(name) for k, name in enumerate(("available", "cancelled", "unobtainable"))]
    n.groupBy(F.col("r_name").alias("board")).agg(*lists).withColumn("_file", F.col("board")).write.partitionBy("_file").json(folder)
    return S.season_list(r.spark, folder).select("board", "key", "state")


@query("SELECT p_type AS id, p_brand AS board, count(*) AS n_versions FROM part GROUP BY 1, 2", with_roles=False)
def s5_catalog_scan(r: Roles):
    folder = S.work_folder(r.spark)
    items = r.table("part").groupBy("p_type", "p_brand").agg(F.collect_list(F.struct(F.col("p_name").alias("label"), F.col("p_size").cast("long").alias("bytes"))).alias("versions"))
    items.groupBy("p_brand").agg(F.collect_list(F.struct(F.col("p_type").alias("id"), F.col("p_brand").alias("board"), F.array(F.lit("a")).alias("subjects"), "versions")).alias("items")).select("items").write.json(folder)
    return S.read_catalog_lines(r.spark, folder).select("id", "board", F.size("versions").cast("long").alias("n_versions"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ', \"x\"' AS p_name FROM part", with_roles=False)
def s6_csv_scan(r: Roles):
    folder = S.work_folder(r.spark)
    r.table("part").select("p_partkey", F.concat("p_name", F.lit(', "x"')).alias("p_name")).write.option("header", True).option("escape", '"').csv(folder)
    return S.read_csv(r.spark, folder)


@query("SELECT p_brand || '/' || p_type || '/' || CAST(2010 + p_size % 20 AS VARCHAR) || '/f' || p_partkey AS path, CAST(2010 + p_size % 20 AS INTEGER) AS year, p_type AS subject FROM part WHERE p_partkey % 4 <> 0 AND 2010 + p_size % 20 BETWEEN 2014 AND 2020", with_roles=False)
def s8_tree_inventory(r: Roles):
    path = F.concat_ws("/", "p_brand", "p_type", (2010 + F.col("p_size") % 20).cast("string"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
    tree = r.table("part").select(F.when(F.col("p_partkey") % 4 == 0, "tree").otherwise("blob").alias("type"), path.alias("path"))
    return S.inventory(tree, (2014, 2020))


@query("SELECT c_mktsegment || '_' AS folder, c_custkey AS question_id FROM customer", with_roles=False)
def s9_review_files(r: Roles):
    folder = S.work_folder(r.spark)
    entries = r.table("customer").select(F.concat("c_mktsegment", F.lit("/?")).alias("subject"), F.col("c_custkey").alias("question_id"))
    S.write_review_files(entries, folder)
    return r.spark.read.schema("question_id long, subject string, _folder string").json(folder).select(F.col("_folder").alias("folder"), "question_id")
