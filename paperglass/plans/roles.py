"""The test tables in the roles of the model, as frames and as the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Roles:
    """Frames of one folder of tables. An order is a question: four in a row are a root and its parts, forty a paper."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def questions(self) -> DataFrame:
        o, k = self.table("orders"), F.col("o_orderkey")
        part = F.pmod(k, F.lit(4))
        root = F.floor(k / 4)
        label = F.element_at(F.array(F.lit("(a)"), F.lit("(b)"), F.lit("(c)")), part.cast("int"))
        return o.select(
            k.alias("id"), F.floor(k / 40).alias("paper_id"), F.when(part != 0, k - part).alias("parent_id"),
            F.when(part == 0, root.cast("string")).otherwise(F.concat(root.cast("string"), F.when(part > 0, label))).alias("number_path"),
            F.pmod(k, F.lit(40)).cast("int").alias("display_order"), F.when(part == 0, 0).otherwise(1).alias("depth"),
            F.when(F.pmod(k, F.lit(11)) != 0, F.pmod(k * 7, F.lit(13))).cast("int").alias("marks"),
            F.concat(F.lower("o_orderpriority"), F.lit(" 50%_off "), "o_orderstatus").alias("stem_text"),
        )

    def papers(self) -> DataFrame:
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return j.select(
            F.col("c_custkey").alias("id"), F.col("r_name").alias("board"), F.col("n_name").alias("qualification"), F.col("c_mktsegment").alias("subject_code"),
            (2015 + F.pmod("c_custkey", F.lit(10))).cast("int").alias("year"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, "june").otherwise("november").alias("session"),
            F.pmod("c_custkey", F.lit(5)).cast("string").alias("paper_code"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, "mark_scheme").otherwise("question_paper").alias("doc_type"),
            F.when(F.pmod("c_custkey", F.lit(7)) != 0, "core").alias("level"),
        )

    def links(self) -> DataFrame:
        k = F.col("o_orderkey")
        one = self.table("orders").select(k.alias("question_id"), F.pmod(k, F.lit(7)).alias("t"))
        both = one.unionByName(self.table("orders").where("o_orderkey % 5 = 0").select(k.alias("question_id"), (F.pmod(k, F.lit(7)) + 7).alias("t")))
        source = F.when(F.pmod("question_id", F.lit(2)) == 0, "auto").otherwise("manual")
        return both.select("question_id", F.concat(F.lit("T"), F.col("t").cast("string")).alias("code"), source.alias("source"), (F.pmod("question_id", F.lit(100)) / 100).alias("confidence"))

    def difficulty(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").where("o_orderkey % 3 <> 1").select(k.alias("question_id"), F.when(F.pmod(k, F.lit(2)) == 0, "estimated").otherwise("manual").alias("source"), (F.pmod(k, F.lit(10)) / 10).alias("value"))

    def assets(self) -> DataFrame:
        return self.table("orders").where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("question_id"))

    def entries(self) -> DataFrame:
        """Mark-scheme entries of some questions, some blank, and of some paths that no question has."""
        q = self.questions()
        text = F.when(F.pmod("id", F.lit(9)) == 0, " ").otherwise(F.concat(F.lit("ans "), F.col("id").cast("string")))
        path = F.when(F.pmod("id", F.lit(12)) == 5, F.concat("number_path", F.lit("(i)"))).otherwise(F.col("number_path"))
        return q.where("id % 3 <> 1").select("id", "paper_id", path.alias("number_path"), text.alias("text"))

    def official(self) -> DataFrame:
        return self.table("orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("official "), F.col("o_orderkey").cast("string")).alias("content"))

    def nodes(self) -> DataFrame:
        """Fourteen topics in three levels: T0 over T1..T3, those over T4..T13."""
        n = self.links().select("code").distinct().withColumn("id", F.substring("code", 2, 3).cast("int"))
        parent = F.when(F.col("id") == 0, None).when(F.col("id") <= 3, 0).otherwise(F.pmod("id", F.lit(3)) + 1)
        return n.select("id", "code", parent.cast("int").alias("parent_id"))


#: The same roles as common table expressions.
SQL = """
question AS (
  SELECT o_orderkey AS id, CAST(floor(o_orderkey / 40) AS BIGINT) AS paper_id,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey - o_orderkey % 4 END AS parent_id,
    CAST(CAST(floor(o_orderkey / 4) AS BIGINT) AS VARCHAR) || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '(a)' WHEN 2 THEN '(b)' ELSE '(c)' END AS number_path,
    CAST(o_orderkey % 40 AS INTEGER) AS display_order, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS depth,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST((o_orderkey * 7) % 13 AS INTEGER) END AS marks,
    lower(o_orderpriority) || ' 50%_off ' || o_orderstatus AS stem_text
  FROM orders
), paper AS (
  SELECT c_custkey AS id, r_name AS board, n_name AS qualification, c_mktsegment AS subject_code,
    CAST(2015 + c_custkey % 10 AS INTEGER) AS year, CASE WHEN c_custkey % 2 = 0 THEN 'june' ELSE 'november' END AS session,
    CAST(c_custkey % 5 AS VARCHAR) AS paper_code, CASE WHEN c_custkey % 3 = 0 THEN 'mark_scheme' ELSE 'question_paper' END AS doc_type,
    CASE WHEN c_custkey % 7 <> 0 THEN 'core' END AS level
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), link AS (
  SELECT question_id, 'T' || CAST(t AS VARCHAR) AS code, CASE WHEN question_id % 2 = 0 THEN 'auto' ELSE 'manual' END AS source,
    (question_id % 100) / 100 AS confidence
  FROM (SELECT o_orderkey AS question_id, o_orderkey % 7 AS t FROM orders
        UNION ALL SELECT o_orderkey, o_orderkey % 7 + 7 FROM orders WHERE o_orderkey % 5 = 0)
), difficulty AS (
  SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 2 = 0 THEN 'estimated' ELSE 'manual' END AS source, (o_orderkey % 10) / 10 AS value
  FROM orders WHERE o_orderkey % 3 <> 1
), asset AS (SELECT o_orderkey AS question_id FROM orders WHERE o_orderkey % 6 = 0
), entry AS (
  SELECT id, paper_id, CASE WHEN id % 12 = 5 THEN number_path || '(i)' ELSE number_path END AS number_path,
    CASE WHEN id % 9 = 0 THEN ' ' ELSE 'ans ' || CAST(id AS VARCHAR) END AS text
  FROM question WHERE id % 3 <> 1
), official AS (SELECT o_orderkey AS question_id, 'official ' || CAST(o_orderkey AS VARCHAR) AS content FROM orders WHERE o_orderkey % 10 = 0
), node AS (
  SELECT id, code, CAST(CASE WHEN id = 0 THEN NULL WHEN id <= 3 THEN 0 ELSE id % 3 + 1 END AS INTEGER) AS parent_id
  FROM (SELECT DISTINCT code, CAST(substr(code, 2, 3) AS INTEGER) AS id FROM link)
)
"""
