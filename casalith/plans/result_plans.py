"""Research result queries. events stand for results; every fifth has no readable artifact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results as R
from . import model as M

c = F.col


def results(spark, d):
    e = M.t(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    card = lambda m, age: F.concat(F.lit(f'{{"module":"{m}","fields":{{"verified":'), F.when(c("event_id") % 3 == 0, "true").when(c("event_id") % 3 == 1, "false").otherwise('"yes"'), F.lit(',"age":'), age, F.lit(',"created":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('","name":"n'), (c("event_id") % 11).cast("string"), F.lit('"}}'))
    payload = F.concat(F.lit('{"source":"'), F.when(c("event_id") % 2 == 0, "github").otherwise("hackernews"), F.lit('","fields":{"cards":['), card("alpha", (k % 90).cast("string")), F.lit(","), card("beta", F.concat((k % 40).cast("string"), F.lit(".0"))), F.lit("]}}"))
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("found", "not_found", "blocked", "error", "taken")]), (c("event_id") % 5 + 1).cast("int"))
    return e.select(
        c("event_id").alias("sequence"), (c("user_id") % 4).cast("string").alias("run_id"), outcome.alias("outcome"), F.when(c("event_id") % 2 == 0, F.concat(F.lit("d"), c("event_id") % 1500)).alias("artifact_id"),
        F.when(c("event_id") % 50 == 0, "not json").otherwise(payload).alias("payload_json"), c("event_type").alias("cache_key"), (c("event_id") % 7 == 0).alias("from_cache"), (c("event_id") * 10).alias("created_epoch"),
    )


def _parts(spark, d):
    a = M.artifacts(spark, d).select(c("artifact_id").alias("id"), "content_hash")
    b = M.artifacts(spark, d).groupBy("content_hash").agg(F.when(F.min("row_seq") % 5 != 0, F.lit("key")).alias("wrapped_key"))
    return results(spark, d), a, b


def projected(spark, d):
    return R.project(*_parts(spark, d))


RESULTS_SQL = """SELECT event_id AS sequence, (user_id % 4)::VARCHAR AS run_id, ['found', 'not_found', 'blocked', 'error', 'taken'][event_id % 5 + 1] AS outcome, CASE WHEN event_id % 2 = 0 THEN 'd' || (event_id % 1500) END AS artifact_id,
  event_id % 50 = 0 AS broken, CASE WHEN event_id % 2 = 0 THEN 'github' ELSE 'hackernews' END AS src, (props->>'$.k')::BIGINT AS k, strftime(ts, '%Y-%m-%d') AS day, event_type AS cache_key, event_id % 7 = 0 AS from_cache, event_id * 10 AS created_epoch FROM events"""
PROJECTED_SQL = f"""WITH b AS (SELECT sha256(text) AS h, min(doc_id) % 5 <> 0 AS ok FROM documents GROUP BY 1), a AS (SELECT 'd' || doc_id AS id, ok FROM documents JOIN b ON h = sha256(text)),
  r AS ({RESULTS_SQL}) SELECT r.*, CASE WHEN broken THEN 'unknown' ELSE src END AS source, artifact_id IS NULL OR coalesce(a.ok, false) AS readable, CASE WHEN artifact_id IS NULL OR coalesce(a.ok, false) THEN outcome ELSE 'unknown' END AS effective_outcome FROM r LEFT JOIN a ON a.id = r.artifact_id"""
ALPHA = R.CardFilter(module="alpha", verified="true", min_age=10, max_age=60)
UNKNOWN = R.CardFilter(verified="unknown", pattern="n?")
DATES = R.CardFilter(module="beta", date_field="created", date_from="2024-01-10", date_to="2024-01-20")
GLOB = R.CardFilter(module="alpha", field="name", pattern="n[1-3]*")
HALF_AGE = R.CardFilter(min_age=0)  # the beta cards have ages such as 7.0, the alpha cards whole ones


def _filtered(f):
    return lambda spark, d: R.by_cards(projected(spark, d), f).select("sequence", "source", "effective_outcome")


def _revisions(spark, d):
    return M.t(spark, d, "orders").select(c("o_custkey").alias("id"), c("o_orderkey").alias("revision"), (c("o_orderstatus") == "F").alias("archived"), c("o_orderpriority").alias("name"))


def _sources(spark, d):
    n = M.t(spark, d, "nation")
    return n.select(c("n_name").alias("source"), F.when(c("n_nationkey") % 2 == 0, F.array(F.lit("email"), F.lit("username"))).otherwise(F.array(F.lit("username"))).alias("kinds"))


def _selectors(spark, d):
    return M.t(spark, d, "customer").select(F.element_at(F.array(F.lit("email"), F.lit("username"), F.lit("phone")), (c("c_custkey") % 3 + 1).cast("int")).alias("kind"), c("c_name").alias("normalized"))


QUERIES = {
    "results_effective_outcome": lambda s, d: projected(s, d).select("sequence", "source", "effective_outcome", "readable"),
    "results_facets": lambda s, d: R.facets(projected(s, d)),
    "results_card_filter": _filtered(ALPHA),
    "results_unknown_and_leaf": _filtered(UNKNOWN),
    "results_date_filter": _filtered(DATES),
    "results_glob_leaf": _filtered(GLOB),
    "results_age_must_be_whole": _filtered(HALF_AGE),
    "results_page": lambda s, d: R.page(projected(s, d).filter("effective_outcome = 'blocked' AND source = 'hackernews'"), 50, 100).select("sequence", "run_id"),
    "runs_status": lambda s, d: R.run_status(M.t(s, d, "region").select(c("r_regionkey").cast("string").alias("run_id"), F.lit(2500).alias("expected"), F.when(c("r_regionkey") == 1, "cancelled").when(c("r_regionkey") == 4, "running").otherwise("done").alias("status")), results(s, d)),
    "cache_lookup": lambda s, d: R.cache_lookup(results(s, d).select("cache_key"), projected(s, d), 50_000),
    "plan_cross_product": lambda s, d: R.plan(_selectors(s, d), _sources(s, d))[0],
    "plan_without_source": lambda s, d: R.plan(_selectors(s, d), _sources(s, d))[1],
    "documents_latest_revision": lambda s, d: R.latest_revisions(_revisions(s, d)),
    "revision_conflicts": lambda s, d: R.conflicts(M.t(s, d, "customer").select(c("c_custkey").alias("id"), (c("c_custkey") * 7).alias("base_revision")), _revisions(s, d)).select("id", "latest"),
    "results_selected": lambda s, d: R.selected(results(s, d).select("sequence", "outcome"), [7, 3, 99, 3, 12]),
}

_s = f"SELECT sequence, source, effective_outcome FROM ({PROJECTED_SQL}) WHERE readable AND NOT broken AND "
_bare = f"SELECT sequence, source, effective_outcome FROM ({PROJECTED_SQL}) WHERE "
SQL = {
    "results_effective_outcome": f"SELECT sequence, source, effective_outcome, readable FROM ({PROJECTED_SQL})",
    "results_facets": f"""WITH p AS ({PROJECTED_SQL}) SELECT 'source' AS facet, source AS value, count(*) AS n FROM p GROUP BY source UNION ALL SELECT 'outcome', effective_outcome, count(*) FROM p GROUP BY effective_outcome UNION ALL SELECT 'total', '', count(*) FROM p""",
    "results_card_filter": _s + "sequence % 3 = 0 AND k % 90 BETWEEN 10 AND 60",
    "results_unknown_and_leaf": _s + "sequence % 3 = 2 AND sequence % 11 < 10",
    "results_date_filter": _s + "day BETWEEN '2024-01-10' AND '2024-01-20'",
    "results_glob_leaf": _s + "regexp_matches('n' || (sequence % 11), '^n[1-3]')",
    "results_age_must_be_whole": _s + "k % 90 BETWEEN 0 AND 150",
    "results_page": f"SELECT sequence, run_id FROM ({PROJECTED_SQL}) WHERE effective_outcome = 'blocked' AND source = 'hackernews' ORDER BY sequence LIMIT 50 OFFSET 100",
    "runs_status": f"""SELECT r_regionkey::VARCHAR AS run_id, coalesce(n, 0) AS completed, CASE WHEN r_regionkey = 1 THEN 'cancelled' WHEN coalesce(n, 0) >= 2500 THEN 'completed' WHEN r_regionkey = 4 THEN 'interrupted' ELSE 'partial' END AS status
      FROM region LEFT JOIN (SELECT run_id, count(*) AS n FROM ({RESULTS_SQL}) GROUP BY run_id) x ON x.run_id = r_regionkey::VARCHAR""",
    "cache_lookup": f"SELECT cache_key, max(sequence) AS sequence FROM ({PROJECTED_SQL}) WHERE effective_outcome IN ('found', 'not_found', 'taken', 'available') AND readable AND NOT from_cache AND created_epoch BETWEEN 50000 - 28800 AND 50000 GROUP BY cache_key",
    "plan_cross_product": "SELECT s.kind, c_name AS normalized, n_name AS source FROM (SELECT c_name, ['email', 'username', 'phone'][c_custkey % 3 + 1] AS kind FROM customer) s JOIN nation ON s.kind = 'username' OR (s.kind = 'email' AND n_nationkey % 2 = 0)",
    "plan_without_source": "SELECT 'phone' AS kind, c_name AS normalized FROM customer WHERE c_custkey % 3 = 2",
    "documents_latest_revision": "SELECT o_custkey AS id, o_orderkey AS revision, false AS archived, o_orderpriority AS name FROM orders o WHERE o_orderstatus <> 'F' AND o_orderkey = (SELECT max(o_orderkey) FROM orders p WHERE p.o_custkey = o.o_custkey)",
    "revision_conflicts": "SELECT c_custkey AS id, m AS latest FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) x ON x.o_custkey = c_custkey WHERE coalesce(m, 0) <> c_custkey * 7",
    "results_selected": "SELECT i::INT AS position, event_id AS sequence, ['found', 'not_found', 'blocked', 'error', 'taken'][event_id % 5 + 1] AS outcome FROM (VALUES (0, 7), (1, 3), (2, 99), (3, 12)) v(i, s) JOIN events ON event_id = s",
}
