"""Reads, semantic search, exports and rules over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import exports as X
from ..operators import reads as R
from ..operators import semantic as SE
from ..operators import vectors as V
from . import entity_plans as E
from . import model as M
from . import result_plans as RP

c, t = F.col, M.t


def _reviews(s, d):
    return t(s, d, "labels").select(F.concat(F.lit("d"), c("doc_id") % 40).alias("suggestion_id"), F.when(c("quality") == 1, "accepted").otherwise("rejected").alias("decision"), c("doc_id").alias("row_seq"), F.concat(F.lit("c"), c("doc_id") % 30).alias("entity_id"))


REVIEWS = "SELECT 'd' || (doc_id % 40) AS suggestion_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS decision, doc_id AS row_seq, 'c' || (doc_id % 30) AS entity_id FROM labels"
LAST_REVIEW = f"SELECT suggestion_id, max_by(decision, row_seq) AS decision, max_by(entity_id, row_seq) AS entity_id FROM ({REVIEWS}) GROUP BY 1"


def _refs(s, d):
    return t(s, d, "orders").select(F.element_at(F.array(F.lit("entity"), F.lit("identifier"), F.lit("relationship"), F.lit("other")), (c("o_orderkey") % 4 + 1).cast("int")).alias("subject_kind"), (c("o_custkey") % 300).cast("string").alias("subject_id"), "o_orderkey")


def _subjects(s, d):
    row = lambda name, key, label: t(s, d, name).select(c(key).cast("string").alias("id"), c(label).alias("label"))
    return R.subjects(_refs(s, d), row("customer", "c_custkey", "c_name"), row("supplier", "s_suppkey", "s_name"), row("part", "p_partkey", "p_name"))


def _evidence(s, d):
    links = t(s, d, "orders").select("o_orderkey", F.element_at(F.array(F.lit("artifact"), F.lit("observation"), F.lit("capture")), (c("o_orderkey") % 3 + 1).cast("int")).alias("evidence_kind"), (c("o_orderkey") % 500).cast("string").alias("evidence_id"))
    obs = t(s, d, "conversations").select(c("conv_id").cast("string").alias("id"), F.concat(F.lit("a"), "conv_id").alias("artifact_id")).distinct()
    caps = t(s, d, "events").select((c("user_id") % 400).cast("string").alias("id"), F.concat(F.lit("e"), "event_id").alias("artifact_id"), c("event_id").alias("row_seq"))
    return R.evidence_artifacts(links, obs, caps)


def _links(s, d):
    return t(s, d, "orders").select(F.when(c("o_orderkey") % 3 == 0, "relationship").otherwise("entity").alias("subject_kind"), F.concat(F.lit("c"), "o_custkey").alias("subject_id"), c("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_utc"))


def _views(s, d):
    edges = t(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("from_entity"), F.concat(F.lit("c"), (c("c_custkey") * 7 + 13) % 200).alias("to_entity"))
    return R.entity_views(E.entities(s, d), M.merges(s, d), E.identifiers(s, d), edges)


def _documents(s, d):
    docs = t(s, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("content_hash"))
    blobs = docs.groupBy("content_hash").agg(F.min("doc_id").alias("n")).filter("n % 11 <> 0").select("content_hash", F.when(c("n") % 7 != 0, F.lit("key")).alias("wrapped_key"))
    files = docs.groupBy("content_hash").agg(F.min("doc_id").alias("n"), F.min("text").alias("text")).filter("n % 5 <> 0").select("content_hash", F.when(c("n") % 3 == 0, F.encode(F.lit("x"), "UTF-8")).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return R.document_states(docs.select(c("doc_id").alias("artifact_id"), "content_hash"), blobs, files, 16).select("artifact_id", "state", F.octet_length("head").alias("head_bytes"))


def _pointers(s, d):
    text = F.concat(F.lit('{"a/b":{"~k":['), c("event_id").cast("string"), F.lit(',{"x":"'), c("event_type"), F.lit('"}]}}'))
    at = F.when(c("event_id") % 3 == 0, "/a~1b/~0k/0").when(c("event_id") % 3 == 1, "/a~1b/~0k/1/x").otherwise("/none/3")
    return t(s, d, "events").select("event_id", R.pointer_value(text, at).alias("value"))


def _images(s, d):
    x = t(s, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("domain"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (c("page_id") % 60).cast("int")), "yyyy-MM-dd").alias("indexed"), F.substring("html", 60, 40).alias("title"),
                                   F.when(c("page_id") % 4 == 0, "text/html").otherwise("image/png").alias("media_type"), F.octet_length("html").alias("byte_length"))
    return R.images(x, date_from="2024-01-10", date_to="2024-02-20", title="TITLE", least_bytes=500)


IMAGES = """SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS domain, strftime(DATE '2024-01-01' + (page_id % 60)::INT, '%Y-%m-%d') AS indexed, substring(html, 60, 40) AS title FROM pages
  WHERE page_id % 4 <> 0 AND strftime(DATE '2024-01-01' + (page_id % 60)::INT, '%Y-%m-%d') BETWEEN '2024-01-10' AND '2024-02-20' AND contains(lower(substring(html, 60, 40)), 'title') AND strlen(html) >= 500"""


def _board(s, d):
    board = t(s, d, "customer").select(F.concat(F.lit("c"), c("c_custkey") + F.when(c("c_custkey") % 10 == 9, 1_000_000).otherwise(0)).alias("node_id"), F.when(c("c_custkey") % 5 == 0, "old name").otherwise(c("c_name")).alias("name"))
    return R.hydrated_board(board, E.entities(s, d), M.merges(s, d))


def _decisions(s, d):
    o = t(s, d, "orders")
    return o.select(c("o_orderkey").alias("id"), F.concat(F.lit("c"), c("o_custkey") % 50).alias("left_entity"), F.concat(F.lit("d"), c("o_custkey") % 7).alias("right_entity"), F.when(c("o_orderkey") % 3 == 0, "reject").when(c("o_orderkey") % 7 == 0, "split").otherwise("merge").alias("action"),
                    F.when(c("o_orderkey") % 7 == 0, c("o_orderkey") - 6).alias("reverses_id"), c("o_orderkey").alias("row_seq"))


DECISIONS = "SELECT o_orderkey AS id, 'c' || (o_custkey % 50) AS l, 'd' || (o_custkey % 7) AS r, CASE WHEN o_orderkey % 3 = 0 THEN 'reject' WHEN o_orderkey % 7 = 0 THEN 'split' ELSE 'merge' END AS action, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 6 END AS reverses_id FROM orders"


def _items(s, d):
    e = t(s, d, "events")
    items = e.filter("event_type <> 'view'").select(c("event_id").alias("item_id"), c("user_id").alias("artifact_id"), F.hour("ts").alias("at"), (c("event_id") / 1000).cast("long").alias("run_seq"))
    sampled = e.filter("event_id % 4 = 0").select(c("user_id").alias("artifact_id"), F.hour("ts").alias("at"), (c("event_id") / 1000).cast("long").alias("run_seq"))
    return R.mark_stale(items, sampled)


ITEMS = """WITH s AS (SELECT user_id, hour(ts) AS at, max(event_id // 1000) AS m FROM events WHERE event_id % 4 = 0 GROUP BY ALL),
  i AS (SELECT event_id AS item_id, e.user_id AS artifact_id, hour(ts) AS at, event_id // 1000 AS run_seq, coalesce(s.m > event_id // 1000, false) AS stale FROM events e LEFT JOIN s ON s.user_id = e.user_id AND s.at = hour(ts) WHERE event_type <> 'view')"""


def _groups(s, d):
    g = t(s, d, "events").select((c("event_id") % 97).alias("group_id"), c("event_id").alias("item_id")).filter("item_id % 5 = 0")
    out = t(s, d, "events").filter("event_id % 25 = 0").select((c("event_id") % 97).alias("group_id"), c("event_id").alias("item_id"))
    return R.live_groups(g, t(s, d, "events").select(c("event_id").alias("item_id"), (c("event_id") % 1000 == 35).alias("stale")), out)


def _embedded(s, d):
    x = t(s, d, "documents").filter("doc_id % 6 <> 0")
    return x.select(F.concat(F.lit("d"), "doc_id").alias("observation_id"), F.when(c("doc_id") % 4 == 0, "old").otherwise("m1").alias("model_identity"), F.sha2(F.when(c("doc_id") % 9 == 0, "changed").otherwise(c("text")), 256).alias("value_hash"))


def _observations(s, d):
    return t(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), c("text").alias("value"))


def _near(s, d):
    q = t(s, d, "embeddings").filter("vec_id = 0").select(F.lit(0).alias("query_id"), c("embedding").alias("vector"))
    return V.knn(t(s, d, "embeddings"), q, 200).select(F.concat(F.lit("o"), "vec_id").alias("observation_id"), (c("rank") - 1).alias("rank"))


def _hybrid(s, d):
    e = t(s, d, "embeddings")
    links = e.select(F.concat(F.lit("o"), "vec_id").alias("evidence_id"), F.lit("entity").alias("subject_kind"), F.concat(F.lit("c"), c("vec_id") % 60).alias("subject_id"))
    words = t(s, d, "customer").filter("c_custkey % 3 = 0").select(F.lit("entity").alias("subject_kind"), F.concat(F.lit("c"), "c_custkey").alias("subject_id"), (c("c_custkey") / 3).cast("int").alias("rank"))
    known = t(s, d, "customer").select(F.lit("entity").alias("subject_kind"), F.concat(F.lit("c"), "c_custkey").alias("subject_id"), c("c_mktsegment").alias("facet")).unionByName(
        e.select(F.lit("observation").alias("subject_kind"), F.concat(F.lit("o"), "vec_id").alias("subject_id"), c("label").cast("string").alias("facet")))
    return SE.hybrid(_near(s, d), links, M.merges(s, d), words, known, limit=100)


_dot = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
NEAR = f"SELECT 'o' || vec_id AS o, r - 1 AS rank, vec_id FROM (SELECT a.vec_id, row_number() OVER (ORDER BY round(1 - {_dot}, 6) + 0.0, a.vec_id) AS r FROM embeddings a, embeddings b WHERE b.vec_id = 0) WHERE r <= 200"


def _csv(s, d):
    r = RP.results(s, d)
    text = lambda x: F.lit(x).cast("string")
    return X.csv_lines(r.select(c("sequence").cast("string").alias("result_id"), "run_id", F.lit("email").alias("selector_type"), F.concat(F.lit(" =u"), "sequence").alias("original"), F.concat(F.lit("u"), "sequence").alias("normalized"), F.lit('a"b').alias("source"), "outcome", text(None).alias("url"),
                                text("2024-01-01").alias("observed_utc"), text(None).alias("source_reported_utc"), text(None).alias("indexed_utc"), "artifact_id", c("from_cache").cast("string").alias("from_cache"), F.lit('{"k":1}').alias("fields_json"), F.lit("-none").alias("limitation")))


def _constraints(s, d):
    o = t(s, d, "orders")
    pairs = o.select(F.concat(F.lit("c"), "o_custkey").alias("left_entity"), F.concat(F.lit("c"), c("o_orderkey") % 1500).alias("right_entity"))
    gaps = M.gaps(s, d).withColumn("unit", F.when(c("magnitude") != 3, c("unit")))
    values = s.range(10).select((c("id") % 2).alias("scale_id"), c("id").alias("value_key"), (c("id") % 3 != 0).alias("machine_assignable"))
    said = o.select(c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 2 == 0, "machine").otherwise("person").alias("actor"), (c("o_orderkey") % 2).alias("scale_id"), (c("o_orderkey") % 12).alias("value_key"))
    return (
        K.unordered_pairs(pairs).unionByName(K.half_measures(gaps)).unionByName(K.repeated(t(s, d, "labels").withColumn("k", c("doc_id") % 300), ["k"], "assessed twice"))
        .unionByName(K.unlisted(o, "o_orderkey", "o_orderstatus", ("F", "O"), "unknown status")).unionByName(K.ungrounded(o.select(c("o_custkey").alias("k")).distinct(), "k", t(s, d, "customer").filter("c_custkey % 50 <> 0"), "c_custkey", "no such customer"))
        .unionByName(K.machine_values(said, values))
    )


def _imports(s, d):
    rows = t(s, d, "customer").select(c("c_custkey").alias("row_no"), F.lit("username").alias("kind"), c("c_name").alias("original"), F.when(c("c_custkey") % 9 == 0, F.concat(F.lit(" x"), c("c_custkey") % 90)).otherwise(F.concat(F.lit("u"), c("c_custkey") % 1000)).alias("normalized"))
    return K.import_errors(rows, F.trim("normalized"))


def _appends(s, d):
    runs = s.range(3).select(c("id").cast("string").alias("run_id"), F.when(c("id") == 1, "completed").otherwise("running").alias("status"), (c("id") * 100 + 50).alias("expected"), F.lit(120).alias("completed"))
    return K.append_errors(RP.results(s, d).withColumnRenamed("sequence", "id"), runs)


def _uncited(s, d):
    x = t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("context"))
    return K.uncited(x.select(c("conv_id").alias("id"), F.when(c("conv_id") % 3 == 0, F.array().cast("array<long>")).otherwise(F.array(c("conv_id") % 9, F.lit(0).cast("long"))).alias("cited"), "context"))


def _staged(s, d):
    obs = t(s, d, "events").select(c("event_id").alias("id"), c("user_id").alias("artifact_id"), c("event_type").alias("value"), F.lit("/k").alias("pointer"), (c("event_id") % 2 == 0).alias("superseded"))
    res = t(s, d, "customer").select(c("c_custkey").alias("id"), F.lit("src").alias("source"), (c("c_custkey") % 300).alias("artifact_id"), F.when(c("c_custkey") % 2 == 0, "click").otherwise("view").alias("value"), F.lit("/k").alias("pointer"))
    return K.staged(res, obs)


def _classified(s, d):
    n = c("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 429, 503, 200, 200)]), (n % 6 + 1).cast("int"))
    body = F.when(n % 6 == 4, "<html>").otherwise('{"login":"x"}')
    login = F.when(n % 12 == 5, "other").otherwise(F.upper(F.concat(F.lit("u"), n.cast("string"))))
    return t(s, d, "events").select("event_id", K.classify(status, body, login, F.concat(F.lit("u"), n.cast("string"))).alias("outcome"))


QUERIES = {
    "activity_page": lambda s, d: R.page_with_total(t(s, d, "events").select("event_id", "event_type"), [F.desc("event_id")], 200, 100),
    "runs_page": lambda s, d: R.page_with_total(M.runs(s, d).select("run_id", "started_utc", "row_seq"), [F.desc("started_utc"), F.desc("row_seq")], 50),
    "results_filtered_page": lambda s, d: RP.R.filtered_page(RP.projected(s, d), RP.ALPHA, "not_found", ("github",), 50, 20).select("sequence", "total", "run_total"),
    "latest_reviews": lambda s, d: R.latest(_reviews(s, d), ["suggestion_id"], [F.desc("row_seq")]),
    "suggestions_with_review": lambda s, d: R.with_latest_review(t(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id")), _reviews(s, d)),
    "accepted_links": lambda s, d: R.accepted_links(_reviews(s, d).withColumnRenamed("suggestion_id", "item_id"), M.merges(s, d)),
    "latest_derivative": lambda s, d: R.latest(t(s, d, "lineitem").select(c("l_partkey").alias("artifact_id"), c("l_linenumber").alias("page"), c("l_orderkey").alias("row_seq"), "l_suppkey"), ["artifact_id", "page"], [F.desc("row_seq"), "l_suppkey"]).select("artifact_id", "page", "row_seq", "l_suppkey"),
    "subject_lookup": _subjects,
    "evidence_to_artifact": _evidence,
    "evidence_of_cluster": lambda s, d: R.evidence_of_clusters(_links(s, d), M.merges(s, d)),
    "entity_view": lambda s, d: _views(s, d).withColumns({"aliases": F.concat_ws("|", "aliases"), "identifiers": F.concat_ws("|", "identifiers")}),
    "document_states": _documents,
    "gap_rows": lambda s, d: R.gap_rows(t(s, d, "events").select(F.concat(F.lit("r"), "event_id").alias("run_id"), c("user_id").alias("artifact_id"), (c("event_id") % 5).alias("text_truncated_bytes"), (c("event_id") % 3).alias("skipped_oversize"))),
    "pointer_citation": _pointers,
    "nearest_rank_percentiles": lambda s, d: R.nearest_rank(t(s, d, "events"), "value"),
    "image_candidates": lambda s, d: _images(s, d).select("page_id", "domain", "indexed", "title"),
    "image_group_sizes": lambda s, d: R.group_sizes(_images(s, d)),
    "directory_words": lambda s, d: R.words_filter(t(s, d, "part").select("p_partkey", "p_name", "p_type"), "p_type", "STEEL brushed"),
    "board_hydration": _board,
    "resolution_history": lambda s, d: R.resolution_history(_decisions(s, d)).select("id", "place", "reversed"),
    "merges_after_splits": lambda s, d: R.split(_decisions(s, d)),
    "stale_items": lambda s, d: _items(s, d).select("item_id", "stale"),
    "live_groups": _groups,
    "group_ids": lambda s, d: R.group_ids(t(s, d, "events").select(c("user_id").alias("group"), c("event_type").alias("item_id")), "m1"),
    "semantic_index_status": lambda s, d: R.index_status(_observations(s, d), _embedded(s, d), "m1"),
    "semantic_to_embed": lambda s, d: R.to_embed(_observations(s, d), _embedded(s, d), "m1").select("id"),
    "semantic_hybrid": _hybrid,
    "guide_status": lambda s, d: R.guide_status(**{n: t(s, d, n) for n in ("documents", "orders", "events", "customer", "labels", "pages", "embeddings")}),
    "best_model": lambda s, d: R.best_model(t(s, d, "part").select(c("p_partkey").alias("id"), (c("p_size") % 20).alias("quality"), c("p_retailprice").alias("bytes")), 10),
    "call_bounds": lambda s, d: R.call_bounds(t(s, d, "orders").select(c("o_orderpriority").alias("source")), t(s, d, "orders").select(c("o_orderpriority").alias("source")).distinct().select("source", F.length("source").alias("calls_each"), (F.length("source") % 3).alias("credits_each"))),
    "export_csv": _csv,
    "export_json": lambda s, d: X.json_lines(t(s, d, "customer").select(c("c_custkey").alias("result_id"), c("c_name").alias("name"))),
    "canonical_json": lambda s, d: t(s, d, "events").select("event_id", X.canonical_json(F.concat(F.lit('{"b": '), "props", F.lit(', "a" : "'), "event_type", F.lit('"}'))).alias("json")),
    "markdown_escape": lambda s, d: t(s, d, "pages").select("page_id", X.markdown_escape(c("url")).alias("escaped")),
    "package_manifest": lambda s, d: X.manifest(M.artifacts(s, d).select(F.when(c("row_seq") % 3 == 0, "shredded").otherwise("travelling").alias("standing"), c("byte_length").alias("size"))),
    "module_counters": lambda s, d: X.module_counters(t(s, d, "events").select(F.when(c("event_id") % 5 != 0, c("event_type")).alias("module"), (c("event_id") % 7 != 0).alias("valid"))),
    "classify_responses": _classified,
    "constraints": _constraints,
    "append_only": lambda s, d: K.changed(t(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), t(s, d, "orders").filter("o_orderkey % 100 <> 3").select("o_orderkey", F.when(c("o_orderkey") % 100 == 7, F.lit(None)).otherwise(c("o_orderstatus")).alias("o_orderstatus"), "o_totalprice"), "o_orderkey"),
    "scales_without": lambda s, d: K.scales_without(t(s, d, "part").select(c("p_brand").alias("scale_id"), F.when(c("p_partkey") % 40 == 0, "insufficient_information").otherwise(c("p_type")).alias("value_key"))),
    "import_errors": _imports,
    "append_errors": _appends,
    "uncited_answers": _uncited,
    "staged_reviews": _staged,
}

SQL = {
    "activity_page": "SELECT event_id, event_type, row_number() OVER (ORDER BY event_id DESC)::INT AS position, (SELECT count(*) FROM events) AS total FROM (SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 200 OFFSET 100)",
    "runs_page": f"SELECT *, row_number() OVER (ORDER BY started_utc DESC, row_seq DESC)::INT AS position, (SELECT count(*) FROM events) AS total FROM (SELECT run_id, started_utc, row_seq FROM ({M.RUNS_SQL}) ORDER BY started_utc DESC, row_seq DESC LIMIT 50)",
    "results_filtered_page": f"""WITH p AS ({RP.PROJECTED_SQL}), f AS (SELECT sequence, count(*) OVER () AS total, (SELECT count(*) FROM p) AS run_total FROM p WHERE readable AND NOT broken AND sequence % 3 = 0 AND k % 90 BETWEEN 10 AND 60 AND effective_outcome = 'not_found' AND source = 'github')
      SELECT * FROM f ORDER BY sequence LIMIT 50 OFFSET 20""",
    "latest_reviews": f"SELECT suggestion_id, max_by(decision, row_seq) AS decision, max(row_seq) AS row_seq, max_by(entity_id, row_seq) AS entity_id FROM ({REVIEWS}) GROUP BY 1",
    "suggestions_with_review": f"SELECT 'd' || doc_id AS id, coalesce(decision, 'pending') AS decision FROM documents LEFT JOIN ({LAST_REVIEW}) r ON r.suggestion_id = 'd' || doc_id",
    "accepted_links": f"SELECT DISTINCT suggestion_id AS item_id, coalesce(canonical_id, r.entity_id) AS canonical_id FROM ({LAST_REVIEW}) r LEFT JOIN ({M.MERGES_SQL}) m ON m.entity_id = r.entity_id WHERE decision = 'accepted'",
    "latest_derivative": "SELECT l_partkey AS artifact_id, l_linenumber AS page, l_orderkey AS row_seq, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey DESC, l_suppkey) AS r FROM lineitem) WHERE r = 1",
    "subject_lookup": """WITH r AS (SELECT o_orderkey, (o_custkey % 300)::VARCHAR AS subject_id, ['entity', 'identifier', 'relationship', 'other'][o_orderkey % 4 + 1] AS subject_kind FROM orders),
      n AS (SELECT 'entity' AS k, c_custkey::VARCHAR AS i, c_name AS label FROM customer UNION ALL SELECT 'identifier', s_suppkey::VARCHAR, s_name FROM supplier UNION ALL SELECT 'relationship', p_partkey::VARCHAR, p_name FROM part)
      SELECT subject_id, subject_kind, o_orderkey, label FROM r JOIN n ON k = subject_kind AND i = subject_id""",
    "evidence_to_artifact": """WITH l AS (SELECT o_orderkey, ['artifact', 'observation', 'capture'][o_orderkey % 3 + 1] AS evidence_kind, (o_orderkey % 500)::VARCHAR AS evidence_id FROM orders)
      SELECT *, evidence_id AS artifact_id FROM l WHERE evidence_kind = 'artifact' UNION ALL SELECT l.*, 'a' || i FROM l JOIN (SELECT DISTINCT conv_id::VARCHAR AS i FROM conversations) ON i = evidence_id WHERE evidence_kind = 'observation'
      UNION ALL SELECT l.*, 'e' || e FROM l JOIN (SELECT (user_id % 400)::VARCHAR AS i, min(event_id) AS e FROM events GROUP BY 1) ON i = evidence_id WHERE evidence_kind = 'capture'""",
    "evidence_of_cluster": f"""WITH l AS (SELECT 'entity' AS subject_kind, 'c' || o_custkey AS subject_id, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created_utc FROM orders WHERE o_orderkey % 3 <> 0), j AS (SELECT l.*, coalesce(m.canonical_id, l.subject_id) AS canonical_id FROM l LEFT JOIN ({M.MERGES_SQL}) m ON m.entity_id = l.subject_id)
      SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY created_utc, id)::INT AS place FROM j""",
    "entity_view": f"""WITH m AS ({M.MERGES_SQL}), w AS (SELECT c_custkey AS k, 'c' || c_custkey AS id, c_name, c_mktsegment || '-' || c_nationkey AS n, coalesce(m.canonical_id, 'c' || c_custkey) AS root FROM customer LEFT JOIN m ON m.entity_id = 'c' || c_custkey),
      e AS (SELECT id AS a, 'c' || ((k * 7 + 13) % 200) AS b FROM w), u AS (SELECT * FROM e UNION SELECT b, a FROM e),
      x AS (SELECT w.root, count(DISTINCT coalesce(o.root, u.b)) AS n FROM u JOIN w ON w.id = u.a LEFT JOIN w o ON o.id = u.b WHERE coalesce(o.root, u.b) <> w.root GROUP BY w.root)
      SELECT w.root AS id, max(c_name) FILTER (w.id = w.root) AS display_name, coalesce(string_agg(c_name, '|' ORDER BY c_name) FILTER (w.id <> w.root), '') AS aliases, string_agg(DISTINCT w.n, '|' ORDER BY w.n) AS identifiers, coalesce(max(x.n), 0) AS neighbours
      FROM w LEFT JOIN x ON x.root = w.root GROUP BY w.root""",
    "document_states": """WITH h AS (SELECT doc_id, text, sha256(text) AS h FROM documents), g AS (SELECT h, min(doc_id) AS n FROM h GROUP BY h)
      SELECT doc_id AS artifact_id, CASE WHEN n % 11 = 0 THEN 'unrecorded' WHEN n % 7 = 0 THEN 'shredded' WHEN n % 5 = 0 THEN 'lost' WHEN n % 3 = 0 THEN 'damaged' ELSE 'readable' END AS state,
      CASE WHEN n % 11 <> 0 AND n % 7 <> 0 AND n % 5 <> 0 AND n % 3 <> 0 THEN least(strlen(text), 16)::INT END AS head_bytes FROM h JOIN g USING (h)""",
    "gap_rows": "SELECT 'r' || event_id AS run_id, user_id AS artifact_id, 'text_truncated' AS gap_kind, event_id % 5 AS magnitude, 'bytes' AS unit FROM events WHERE event_id % 5 > 0 UNION ALL SELECT 'r' || event_id, user_id, 'value_oversize', event_id % 3, 'values' FROM events WHERE event_id % 3 > 0",
    "pointer_citation": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_type END AS value FROM events",
    "nearest_rank_percentiles": "WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT p::INT AS percent, value FROM s, (VALUES (50), (95), (99)) v(p) WHERE i = (n - 1) * p // 100",
    "image_candidates": IMAGES,
    "image_group_sizes": f"SELECT domain, count(*) AS n FROM ({IMAGES}) GROUP BY domain",
    "directory_words": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_type), 'steel') AND contains(lower(p_type), 'brushed')",
    "board_hydration": f"""WITH b AS (SELECT 'c' || (c_custkey + CASE WHEN c_custkey % 10 = 9 THEN 1000000 ELSE 0 END) AS node_id, CASE WHEN c_custkey % 5 = 0 THEN 'old name' ELSE c_name END AS name FROM customer), e AS (SELECT 'c' || c_custkey AS id, c_name AS n FROM customer)
      SELECT b.node_id, CASE WHEN e.id IS NOT NULL THEN coalesce(m.canonical_id, b.node_id) END AS canonical_id, coalesce(x.n, b.name) AS name, CASE WHEN e.id IS NULL THEN 'missing' WHEN m.canonical_id IS NOT NULL THEN 'merged' WHEN x.n <> b.name THEN 'renamed' END AS notice
      FROM b LEFT JOIN e ON e.id = b.node_id LEFT JOIN ({M.MERGES_SQL}) m ON m.entity_id = b.node_id LEFT JOIN e x ON e.id IS NOT NULL AND x.id = coalesce(m.canonical_id, b.node_id)""",
    "resolution_history": f"WITH d AS ({DECISIONS}) SELECT id, row_number() OVER (PARTITION BY least(l, r), greatest(l, r) ORDER BY id DESC)::INT AS place, id IN (SELECT reverses_id FROM d WHERE reverses_id IS NOT NULL) AS reversed FROM d",
    "merges_after_splits": f"WITH d AS ({DECISIONS}), k AS (SELECT * FROM d WHERE action <> 'split' AND id NOT IN (SELECT reverses_id FROM d WHERE reverses_id IS NOT NULL)) SELECT least(l, r) AS left_entity, greatest(l, r) AS right_entity FROM k GROUP BY ALL HAVING max_by(action, id) = 'merge'",
    "stale_items": f"{ITEMS} SELECT item_id, stale FROM i",
    "live_groups": """WITH g AS (SELECT event_id % 97 AS group_id, event_id AS item_id FROM events WHERE event_id % 5 = 0) SELECT group_id, count(*) AS members FROM g
      WHERE group_id NOT IN (SELECT group_id FROM g WHERE item_id % 1000 = 35) AND item_id % 25 <> 0 GROUP BY group_id""",
    "group_ids": "SELECT user_id AS \"group\", sha256('m1:' || string_agg(DISTINCT event_type, ',' ORDER BY event_type)) AS group_id, count(DISTINCT event_type)::INT AS members FROM events GROUP BY user_id",
    "semantic_index_status": "SELECT count(*) AS observations, count(*) FILTER (doc_id % 6 <> 0 AND doc_id % 4 <> 0 AND (doc_id % 9 <> 0 OR text = 'changed')) AS indexed, count(*) FILTER (doc_id % 6 <> 0 AND (doc_id % 4 = 0 OR doc_id % 9 = 0)) AS stale, count(*) FILTER (doc_id % 6 = 0) AS missing FROM documents",
    "semantic_to_embed": "SELECT 'd' || doc_id AS id FROM documents WHERE doc_id % 6 = 0 OR doc_id % 4 = 0 OR doc_id % 9 = 0",
    "semantic_hybrid": f"""WITH n AS ({NEAR}), m AS ({M.MERGES_SQL}), s AS (SELECT 'observation' AS k, o AS i, 1 / (60.0::DOUBLE + rank) AS s FROM n UNION ALL SELECT 'entity', coalesce(m.canonical_id, 'c' || (vec_id % 60)), 1 / (60.0::DOUBLE + rank) FROM n LEFT JOIN m ON m.entity_id = 'c' || (vec_id % 60)),
      w AS (SELECT 'entity' AS k, coalesce(m.canonical_id, 'c' || c_custkey) AS i, 1 / (60.0::DOUBLE + c_custkey // 3) AS s FROM customer LEFT JOIN m ON m.entity_id = 'c' || c_custkey WHERE c_custkey % 3 = 0 AND c_custkey // 3 < 200),
      a AS (SELECT k, i, max(s) AS s FROM s GROUP BY ALL UNION ALL SELECT k, i, sum(s) FROM w GROUP BY ALL), f AS (SELECT k, i, round(sum(s), 9) AS score FROM a GROUP BY ALL),
      x AS (SELECT 'entity' AS k, 'c' || c_custkey AS i, c_mktsegment AS facet FROM customer UNION ALL SELECT 'observation', 'o' || vec_id, label::VARCHAR FROM embeddings)
      SELECT k AS subject_kind, i AS subject_id, score, facet, row_number() OVER (ORDER BY score DESC, k, i)::INT AS position FROM f JOIN x USING (k, i) QUALIFY position <= 100""",
    "guide_status": "SELECT " + ", ".join(f"(SELECT count(*) FROM {n}) AS {n}" for n in ("documents", "orders", "events", "customer", "labels", "pages", "embeddings")),
    "best_model": "SELECT p_partkey AS id, p_size % 20 AS quality, p_retailprice AS bytes FROM part WHERE p_size % 20 >= 10 ORDER BY 2 DESC, 3, 1 LIMIT 1",
    "call_bounds": "SELECT o_orderpriority AS source, count(*) * length(o_orderpriority) AS calls, count(*) * (length(o_orderpriority) % 3) AS credits FROM orders GROUP BY 1",
    "export_csv": f"""SELECT sequence::VARCHAR AS result_id, '"' || sequence || '","' || run_id || '","email","'' =u' || sequence || '","u' || sequence || '","a""b","' || outcome || '","","2024-01-01","","","' || coalesce(artifact_id, '') || '","' || from_cache || '","{{""k"":1}}","''-none"' AS line FROM ({RP.RESULTS_SQL})""",
    "export_json": """SELECT c_custkey AS result_id, '{"result_id":' || c_custkey || ',"name":"' || c_name || '"}' AS line FROM customer""",
    "canonical_json": """SELECT event_id, '{"a":"' || event_type || '","b":{"k":' || (props->>'$.k') || '}}' AS json FROM events""",
    "markdown_escape": r"""SELECT page_id, replace(replace(replace(regexp_replace(url, '([\\`*_{}\[\]()#+.!|~-])', '\\\1', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages""",
    "package_manifest": "SELECT CASE WHEN doc_id % 3 = 0 THEN 'shredded' ELSE 'travelling' END AS standing, count(*) AS entries, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1",
    "module_counters": "SELECT count(DISTINCT event_type) FILTER (event_id % 5 <> 0) AS modules, count(*) FILTER (event_id % 5 = 0) AS unclassified, count(*) FILTER (event_id % 7 = 0) AS malformed, count(*) FILTER (event_id % 7 <> 0 AND event_id % 5 <> 0) AS accounts FROM events",
    "classify_responses": "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'unknown' WHEN 2 THEN 'blocked' WHEN 3 THEN 'error' WHEN 4 THEN 'unknown' WHEN 0 THEN 'found' ELSE CASE WHEN event_id % 12 = 5 THEN 'unknown' ELSE 'found' END END AS outcome FROM events",
    "constraints": f"""SELECT 'c' || o_custkey || '|c' || (o_orderkey % 1500) AS key, 'pair is not ordered' AS violation FROM orders WHERE 'c' || o_custkey >= 'c' || (o_orderkey % 1500)
      UNION ALL SELECT run_id, 'magnitude and unit go together' FROM ({M.GAPS_SQL}) WHERE magnitude = 3 UNION ALL SELECT (doc_id % 300)::VARCHAR, 'assessed twice' FROM labels GROUP BY doc_id % 300 HAVING count(*) > 1
      UNION ALL SELECT o_orderkey::VARCHAR, 'unknown status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 'no such customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)
      UNION ALL SELECT o_orderkey::VARCHAR, 'a machine may not assign this' FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 12 > 9 OR o_orderkey % 12 % 3 = 0)""",
    "append_only": "SELECT o_orderkey::VARCHAR AS key, CASE o_orderkey % 100 WHEN 3 THEN 'removed' ELSE 'changed' END AS violation FROM orders WHERE o_orderkey % 100 IN (3, 7)",
    "scales_without": "SELECT p_brand AS key, 'no value insufficient_information' AS violation FROM part GROUP BY p_brand HAVING count(*) FILTER (p_partkey % 40 = 0) = 0",
    "import_errors": """WITH r AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 9 = 0 THEN ' x' || (c_custkey % 90) ELSE 'u' || (c_custkey % 1000) END AS v FROM customer), x AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY n) AS r FROM r)
      SELECT n AS row_no, CASE WHEN v <> trim(v) THEN 'not normalised' ELSE 'repeated' END AS error FROM x WHERE v <> trim(v) OR r > 1""",
    "append_errors": f"""SELECT sequence AS id, CASE WHEN run_id = '3' THEN 'no such run' WHEN run_id = '1' THEN 'run is over' WHEN run_id = '0' THEN 'run is full' ELSE 'no evidence' END AS error FROM ({RP.RESULTS_SQL}) WHERE run_id <> '2' OR (outcome IN ('found', 'not_found', 'taken', 'available') AND artifact_id IS NULL)""",
    "uncited_answers": """WITH x AS (SELECT conv_id, list(DISTINCT turn) AS t FROM conversations GROUP BY 1), y AS (SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE len(list_filter(list_distinct([conv_id % 9, 0]), lambda v: NOT list_contains(t, v))) END AS outside FROM x)
      SELECT id, CASE WHEN id % 3 = 0 THEN 'cites nothing' ELSE 'cites what it was not given' END AS error, outside::INT AS outside FROM y WHERE id % 3 = 0 OR outside > 0""",
    "staged_reviews": "SELECT 'src:' || c_custkey AS key, event_id AS observation_id FROM customer JOIN events ON user_id = c_custkey % 300 AND event_type = CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'view' END WHERE event_id % 2 = 1",
}
