"""The supplied tables as the evidence model, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import cut


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def index_rows(spark, d) -> DataFrame:
    """documents as search documents: title is source and language, body the text; one in ten is superseded."""
    return t(spark, d, "documents").select(
        F.lit("observation").alias("subject_kind"), F.concat(F.lit("d"), F.col("doc_id")).alias("subject_id"), F.concat_ws(" ", "source", "lang").alias("title"),
        F.col("text").alias("body"), F.col("lang").alias("facet"), (F.col("doc_id") % 10 == 0).alias("superseded"),
    )


INDEX_SQL = "SELECT 'observation' AS subject_kind, 'd' || doc_id AS subject_id, concat_ws(' ', source, lang) AS title, text AS body, lang AS facet, doc_id % 10 = 0 AS superseded FROM documents"


def entity_rows(spark, d) -> DataFrame:
    """customers as persons, suppliers as organisations, in search form."""
    row = lambda df, key, name, note, facet, p: df.select(
        F.lit("entity").alias("subject_kind"), F.concat(F.lit(p), F.col(key)).alias("subject_id"), F.translate(name, "#", " ").alias("title"), F.concat_ws(" ", F.translate(name, "#", " "), F.col(note)).alias("body"),
        F.lit(facet).alias("facet"), F.lit(False).alias("superseded"),
    )
    return row(t(spark, d, "customer"), "c_custkey", "c_name", "c_mktsegment", "person", "c").unionByName(row(t(spark, d, "supplier"), "s_suppkey", "s_name", "s_nationkey", "organisation", "s"))


ENTITY_SQL = """SELECT 'entity' AS subject_kind, 'c' || c_custkey AS subject_id, replace(c_name, '#', ' ') AS title, replace(c_name, '#', ' ') || ' ' || c_mktsegment AS body, 'person' AS facet, false AS superseded FROM customer
UNION ALL SELECT 'entity', 's' || s_suppkey, replace(s_name, '#', ' '), replace(s_name, '#', ' ') || ' ' || s_nationkey, 'organisation', false FROM supplier"""


def merges(spark, d) -> DataFrame:
    """Every customer whose key is divisible by 7 (and over 0) is merged into the one before."""
    c = t(spark, d, "customer").filter("c_custkey % 7 = 0 AND c_custkey > 1")
    return c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("entity_id"), F.concat(F.lit("c"), F.col("c_custkey") - 1).alias("canonical_id"))


MERGES_SQL = "SELECT 'c' || c_custkey AS entity_id, 'c' || (c_custkey - 1) AS canonical_id FROM customer WHERE c_custkey % 7 = 0 AND c_custkey > 1"


_KEPT: dict = {}


def kept(spark: SparkSession, d: str, name: str, rows: DataFrame) -> DataFrame:
    """rows, written once in an application as the table it stands for."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _KEPT:
        _KEPT[key] = cut(rows)
    return _KEPT[key]


def artifacts(spark, d) -> DataFrame:
    """documents as artifacts; contents are hashed once, when the table is first asked for."""
    x = t(spark, d, "documents")
    rows = x.select(F.concat(F.lit("d"), F.col("doc_id")).alias("artifact_id"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").alias("byte_length"), F.col("source").alias("locator"), F.col("doc_id").alias("row_seq"))
    return kept(spark, d, "artifacts", rows)


ARTIFACTS_SQL = "SELECT 'd' || doc_id AS artifact_id, sha256(text) AS content_hash, strlen(text)::INT AS byte_length, source AS locator, doc_id AS row_seq FROM documents"


def runs(spark, d) -> DataFrame:
    """events as runs over artifacts, in seconds so that ties occur."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").otherwise("succeeded")
    return t(spark, d, "events").select(
        F.concat(F.lit("r"), F.col("event_id")).alias("run_id"), F.concat(F.lit("d"), F.col("user_id")).alias("artifact_id"), status.alias("status"), F.date_format("ts", "yyyy-MM-dd HH").alias("started_utc"), F.col("event_id").alias("row_seq")
    )


RUNS_SQL = "SELECT 'r' || event_id AS run_id, 'd' || user_id AS artifact_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'succeeded' END AS status, strftime(ts, '%Y-%m-%d %H') AS started_utc, event_id AS row_seq FROM events"


def gaps(spark, d) -> DataFrame:
    e = t(spark, d, "events").filter("event_type IN ('purchase', 'error')")
    return e.select(F.concat(F.lit("r"), F.col("event_id")).alias("run_id"), F.when(F.col("event_type") == "error", "unreadable").otherwise("truncated").alias("gap_kind"), (F.col("event_id") % 7).alias("magnitude"), F.lit("rows").alias("unit"))


GAPS_SQL = "SELECT 'r' || event_id AS run_id, CASE event_type WHEN 'error' THEN 'unreadable' ELSE 'truncated' END AS gap_kind, event_id % 7 AS magnitude, 'rows' AS unit FROM events WHERE event_type IN ('purchase', 'error')"

LATEST_SQL = f"SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY started_utc DESC, row_seq DESC) AS r FROM ({RUNS_SQL})) WHERE r = 1"
STATES_SQL = f"""SELECT a.artifact_id, l.run_id, l.status, CASE WHEN l.status IS NULL THEN 'never' WHEN l.status = 'failed' THEN 'failed'
  WHEN l.status = 'succeeded' AND l.run_id IN (SELECT run_id FROM ({GAPS_SQL})) THEN 'partial' WHEN l.status = 'succeeded' THEN 'complete' ELSE 'in_progress' END AS state
  FROM ({ARTIFACTS_SQL}) a LEFT JOIN ({LATEST_SQL}) l USING (artifact_id)"""
