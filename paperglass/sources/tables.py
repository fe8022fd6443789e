"""Table scans with enforced schemas, lenient and strict line scans, and partitioned sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STAMPS = "created_at timestamp, updated_at timestamp"
#: Columns of the stored tables. JSON fields are strings, read with from_json or get_json_object.
SCHEMAS: dict[str, str] = {
    "board": "id long, key string, name string, homepage string, accessibility string, attrs string",
    "qualification": "id long, board_id long, key string, name string, attrs string",
    "subject": "id long, qualification_id long, code string, title string, slug string, attrs string",
    "exam_series": "id long, year int, session string, month int, attrs string",
    "resource_source": "id long, board_id long, url string, kind string, adapter_key string, discovery_method string, active boolean, last_checked_at timestamp, consecutive_empty_runs int, last_error string, attrs string",
    "sync_run": "id long, board_id long, adapter_key string, status string, started_at timestamp, finished_at timestamp, stats string, error string",
    "resource_candidate": "id long, source_id long, board_id long, url string, label string, status string, guessed_doc_type string, parsed_meta string, page_metadata string, etag string, last_modified string, first_seen_run_id long, last_seen_run_id long, last_seen_at timestamp, content_sha256 string, error string",
    "artifact": "id long, sha256 string, size_bytes long, mime string, storage_key string, first_fetched_at timestamp, source_url string, attrs string",
    "artifact_revision": "id long, artifact_id long, url string, etag string, last_modified string, fetched_at timestamp, supersedes_id long, change_kind string",
    "document": "id long, identity_key string, board_id long, qualification_id long, subject_id long, series_id long, doc_type string, year int, paper_code string, component string, variant string, level string, title string, current_revision_id long, status string, attrs string",
    "document_revision": "id long, document_id long, artifact_id long, revision_no int, source_url string, discovered_at timestamp, status string, parser_version string, parse_status string, parse_error string",
    "doc_classification": "id long, document_id long, doc_type string, confidence double, evidence string, method string",
    "paper": "id long, document_id long, paper_no string, duration_minutes int, marks_total int, question_count int, parse_run_id long, page_count int, attrs string",
    "question": "id long, paper_id long, parent_id long, number_label string, number_path string, display_order int, depth int, kind string, marks int, page_from int, page_to int, stem_text string, bbox_from string, bbox_to string, parse_run_id long, parse_confidence double, has_override boolean, attrs string",
    "asset": "id long, sha256 string, storage_key string, kind string, mime string, width int, height int, attrs string",
    "question_asset": "id long, question_id long, asset_id long, role string, page int, bbox string, reading_order int, caption string, confidence double",
    "formula": "id long, question_id long, latex string, mathml string, source string, page int, bbox string, confidence double",
    "mark_scheme": "id long, document_id long, matched_paper_document_id long, match_confidence double, match_method string, match_evidence string, parse_run_id long",
    "mark_scheme_entry": "id long, mark_scheme_id long, question_id long, number_label string, number_path string, marks int, answer_text string, acceptable_answers string, method_marks int, accuracy_marks int, independent_marks int, ecf boolean, guidance string, raw string, parse_confidence double",
    "official_answer": "id long, question_id long, source string, source_document_id long, content string, is_official boolean, attrs string",
    "generated_explanation": "id long, question_id long, provider string, model string, prompt_version string, approach string, steps string, final_answer string, marking_points string, common_errors string, review_status string, is_official boolean",
    "taxonomy_node": "id long, board_id long, parent_id long, code string, name string, node_type string, source string, attrs string",
    "question_taxonomy": "id long, question_id long, node_id long, source string, confidence double, assigned_by string, reviewed boolean",
    "difficulty": "id long, question_id long, source string, value double, scale string, features string, model_version string",
    "question_similarity": "id long, question_a_id long, question_b_id long, method string, score double, features string",
    "parse_run": "id long, document_revision_id long, parser_version string, params string, status string, started_at timestamp, finished_at timestamp, stats string, error string",
    "provenance_edge": "id long, subject_type string, subject_id long, source_kind string, source_ref string, source_url string, run_id long, observed_at timestamp, attrs string",
    "validation_finding": "id long, subject_type string, subject_id long, rule_code string, severity string, message string, evidence string, parse_run_id long, status string",
    "review_task": "id long, target_type string, target_id long, reason string, priority int, status string, parse_run_id long, assignee string, resolution string",
    "field_override": "id long, target_type string, target_id long, field_path string, value string, source_value string, author string, active boolean, applies_to_parser_versions string, conflict_detected boolean, conflict_detail string, attrs string",
    "job": "id long, kind string, payload string, status string, attempts int, max_attempts int, run_after timestamp, last_error string, board_id long",
}


def scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table under its schema; columns that a file lacks are null."""
    return spark.read.schema(f"{SCHEMAS[name]}, {_STAMPS}").parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_decisions(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, problems) of a folder of JSON lines without `*applied.jsonl`: a bad line is a problem with its file and line.

    Files of decisions are written by hand and short: each is read whole, so that its lines have numbers."""
    files = spark.read.option("pathGlobFilter", "*.jsonl").text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    lines = files.where(~F.endswith("file", F.lit("applied.jsonl"))).select("file", F.posexplode(F.split("value", r"\r?\n")).alias("at", "value")).where("trim(value) <> ''")
    parsed = lines.select("file", (F.col("at") + 1).alias("line"), "value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    bad = F.col("d").isNull() | F.col("d._corrupt").isNotNull()
    return parsed.where(~bad).select("file", "line", "d.*").drop("_corrupt"), parsed.where(bad).select("file", "line", "value")


_SEASON = (
    "board string, key string, events array<struct<date:date,session:string,subject_code:string,paper_code:string,duration_minutes:int>>, "
    "date_windows array<struct<component:string,start:date,end:date>>, unparsed_rows array<struct<page:int,text:string>>"
)


def _season_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SEASON).option("multiLine", True).json(path).where("key is not null")


def season_scan(spark: SparkSession, path: str) -> DataFrame:
    """One row for each event of the season files (one JSON object each)."""
    return _season_files(spark, path).select("board", "key", F.explode("events").alias("e")).select("board", "key", "e.*")


def season_windows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each date window of the season files."""
    return _season_files(spark, path).select("board", "key", F.explode("date_windows").alias("w")).select("board", F.col("key").alias("season"), "w.*")


def season_unparsed(spark: SparkSession, path: str) -> DataFrame:
    """One row for each row of the season files that their parser could not read."""
    return _season_files(spark, path).select("board", "key", F.explode("unparsed_rows").alias("u")).select("board", "key", "u.*")


def season_list(spark: SparkSession, index_path: str) -> DataFrame:
    """(board, key, state, reason) of an index of seasons: one JSON object with lists of available, cancelled and unobtainable ones."""
    schema = "board string, available array<struct<key:string,reason:string>>, cancelled array<struct<key:string,reason:string>>, unobtainable array<struct<key:string,reason:string>>"
    index = spark.read.schema(schema).option("multiLine", True).json(index_path)
    out = None
    for state in ("available", "cancelled", "unobtainable"):
        part = index.select("board", F.explode(state).alias("s")).select("board", "s.key", F.lit(state).alias("state"), "s.reason")
        out = part if out is None else out.unionByName(part)
    return out


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paperglass-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the folder that the driver and all executors share: computed once and planned once."""
    folder = work_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_CATALOG = "items array<struct<id:string,board:string,title:string,kind:string,candidate_facing:boolean,subjects:array<string>,versions:array<struct<label:string,url:string,sha256:string,bytes:long,pages:int>>>>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row for each item of a catalog file, with its versions as an array."""
    return spark.read.schema(_CATALOG).option("multiLine", True).json(path).select(F.explode("items").alias("i")).select("i.*")


def read_catalog_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_catalog, of catalogs that are one line each."""
    return spark.read.schema(_CATALOG).json(path).select(F.explode("items").alias("i")).select("i.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header line; quotes within quoted fields are doubled."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def inventory(tree: DataFrame, years: tuple[int, int]) -> DataFrame:
    """(path, year, subject) of the blobs (type, path) whose path holds a year in the range."""
    year = F.regexp_extract("path", r"(?:^|\D)(20\d{2})(?:\D|$)", 1)
    return tree.where("type = 'blob'").select("path", F.nullif(year, F.lit("")).cast("int").alias("year"), F.substring_index(F.substring_index("path", "/", 2), "/", -1).alias("subject")).where(F.col("year").between(*years))


def write_review_files(entries: DataFrame, path: str, subject: str = "subject", key: str = "question_id") -> None:
    """JSON lines by subject, each file in the order of the keys; subjects become safe folder names."""
    safe = F.regexp_replace(F.coalesce(subject, F.lit("none")), "[^A-Za-z0-9_-]+", "_")
    entries.withColumn("_folder", safe).repartition("_folder").sortWithinPartitions("_folder", key).write.mode("overwrite").partitionBy("_folder").json(path)


def review_batches(rows: DataFrame, subject: str, order: list[str], size: int = 50) -> DataFrame:
    """Rows with the number of their package of `size` within the subject."""
    n = F.row_number().over(Window.partitionBy(subject).orderBy(*order))
    return rows.withColumn("batch", (F.floor((n - 1) / size) + 1).cast("long"))


def season_index(events: DataFrame) -> DataFrame:
    """One row for each season (board, key): totals and its sorted subjects."""
    return events.groupBy("board", "key").agg(F.count("*").alias("events"), F.count_distinct("date").alias("days"), F.array_sort(F.collect_set("subject_code")).alias("subjects"))


def flatten_specification(spec: DataFrame) -> DataFrame:
    """(code, parent_code, name, node_type, depth) of nested units (units > topics > points, each code and name)."""
    unit = spec.select(F.explode_outer("units").alias("u"))
    topic = unit.select(F.col("u.code").alias("up"), F.explode("u.topics").alias("t"))
    point = topic.select(F.col("t.code").alias("up"), F.explode("t.points").alias("p"))
    out = unit.select("u.code", F.lit(None).cast("string").alias("parent_code"), "u.name", F.lit("unit").alias("node_type"), F.lit(1).alias("depth"))
    out = out.unionByName(topic.select("t.code", F.col("up").alias("parent_code"), "t.name", F.lit("topic").alias("node_type"), F.lit(2).alias("depth")))
    return out.unionByName(point.select("p.code", F.col("up").alias("parent_code"), "p.name", F.lit("point").alias("node_type"), F.lit(3).alias("depth"))).where("code is not null")
