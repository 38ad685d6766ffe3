"""Search and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import occurrences_sql, parse_query, tokens_sql
from ..operators import coverage as C
from ..operators import search as S
from . import model as M

TOPK, PHRASE, PREFIX, NEGATION, ENTITY = 'the "of the"', '"to the"', "the than", "the -and", "customer build"
BATCH = ["of the", "to the", "and the"]


def ranked_sql(base: str, text: str, typeahead: bool = False) -> str:
    """Ranked matches of a query in plain SQL."""
    q = parse_query(text, typeahead)
    hit = lambda p, i: tuple(occurrences_sql(c, p, q.prefix_last and i == len(q.positives) - 1) for c in ("tt", "bt"))
    hits = [hit(p, i) for i, p in enumerate(q.positives)]
    counts = ", ".join(f"{a} AS t{i}, {b} AS b{i}" for i, (a, b) in enumerate(hits))
    nots = "".join(f" AND {occurrences_sql('tt', p)} = 0 AND {occurrences_sql('bt', p)} = 0" for p in q.negatives)
    stats = ", ".join(f"count(*) FILTER (t{i} > 0 OR b{i} > 0) AS n{i}" for i in range(len(hits)))
    f = lambda i: f"(t{i} * 10.0::DOUBLE + b{i})"
    score = " + ".join(
        f"greatest(ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * ({f(i)} * 2.2::DOUBLE) / ({f(i)} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))" for i in range(len(hits))
    )
    where = " AND ".join(f"(t{i} > 0 OR b{i} > 0)" for i in range(len(hits)))
    return f"""WITH ix AS (SELECT *, {tokens_sql("title")} AS tt, {tokens_sql("body")} AS bt FROM ({base})),
h AS (SELECT *, len(tt) + len(bt) AS len, {counts} FROM ix), st AS (SELECT count(*) AS n, greatest(1.0::DOUBLE, sum(len)::DOUBLE / count(*)) AS mean, {stats} FROM h)
SELECT subject_kind, subject_id, facet, superseded, round(-({score}), 6) AS relevance FROM h, st WHERE {where}{nots}"""


def page_sql(inner: str, limit: int = 50) -> str:
    return f"SELECT row_number() OVER (ORDER BY relevance, subject_id)::INT AS position, subject_kind, subject_id, facet, relevance FROM ({inner}) WHERE NOT superseded ORDER BY relevance, subject_id LIMIT {limit}"


_BUILT: dict = {}


def indexed(spark, d, rows=M.index_rows) -> S.Index:
    """The index of a data folder, built when it is first asked for in an application, and then opened."""
    key = (spark.sparkContext.applicationId, d, rows.__name__)
    if key not in _BUILT:
        _BUILT[key] = S.index(rows(spark, d))
    return _BUILT[key]


def _page(text, typeahead=False):
    def run(spark, d):
        return S.search(indexed(spark, d), text, typeahead=typeahead).drop("canonical_id")

    return run


def _collapsed(spark, d):
    ix = indexed(spark, d, M.entity_rows)
    found = S.hydrate(ix, S.filtered(S.rank(ix, parse_query(ENTITY, True)))).select("subject_kind", "subject_id", "facet", "relevance")
    return S.collapse(found, M.merges(spark, d))


def _responded(spark, d):
    return S.respond(indexed(spark, d), PHRASE, C.summary(M.artifacts(spark, d), M.runs(spark, d), M.gaps(spark, d)).select("artifacts", "incomplete", "is_complete"), 20).drop("canonical_id")


def _disagreements(spark, d):
    now = M.index_rows(spark, d).filter("subject_id NOT LIKE '%7'").withColumn("facet", F.when(F.col("subject_id").endswith("3"), "moved").otherwise(F.col("facet")))
    more = M.entity_rows(spark, d).filter("facet = 'organisation'")
    return S.disagreements(indexed(spark, d), now.unionByName(more))


COLLAPSED_SQL = f"""WITH r AS ({ranked_sql(M.ENTITY_SQL, ENTITY, True)}), m AS ({M.MERGES_SQL}),
k AS (SELECT entity_id AS member, canonical_id FROM m UNION SELECT canonical_id, canonical_id FROM m),
j AS (SELECT r.*, k.canonical_id FROM r LEFT JOIN k ON r.subject_id = k.member)
SELECT subject_kind, subject_id, facet, relevance, NULL::VARCHAR AS canonical_id FROM j WHERE canonical_id IS NULL UNION ALL
SELECT subject_kind, subject_id, facet, relevance, nullif(canonical_id, subject_id) FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY relevance, subject_id) AS n FROM j WHERE canonical_id IS NOT NULL) WHERE n = 1"""


def _projection(spark, d):
    e = M.t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("person").alias("type_key"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("notes"), F.lit("2024-01-01").alias("updated_utc"))
    i = M.t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("name").alias("namespace"), F.col("s_name").alias("value"), F.lower("s_name").alias("normalized"), F.lit("2024-01-01").alias("created_utc"))
    r = M.t(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_utc"))
    o = M.t(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("lang").alias("kind"), F.col("text").alias("value"), (F.col("doc_id") % 10 == 0).alias("superseded"), F.lit("2024-01-01").alias("observed_utc"))
    return S.project_documents(e, i, r, o)


PROJECTION_SQL = """SELECT 'entity' AS subject_kind, 'c' || c_custkey AS subject_id, c_name AS title, c_name || ' ' || c_mktsegment AS body, 'person' AS facet, false AS superseded, '2024-01-01' AS indexed_utc FROM customer
UNION ALL SELECT 'identifier', 's' || s_suppkey, s_name, s_name || ' ' || lower(s_name), 'name', false, '2024-01-01' FROM supplier
UNION ALL SELECT 'relationship', 'o' || o_orderkey, o_orderpriority, o_orderpriority, o_orderpriority, false, strftime(o_orderdate, '%Y-%m-%d') FROM orders
UNION ALL SELECT 'observation', 'd' || doc_id, '', text, lang, doc_id % 10 = 0, '2024-01-01' FROM documents"""


def _batch(spark, d):
    return S.batch(indexed(spark, d), BATCH).select("query_no", "subject_id", "rank", "total", "relevance")


BATCH_SQL = " UNION ALL ".join(
    f"SELECT {i} AS query_no, subject_id, rank, total, relevance FROM (SELECT *, (row_number() OVER (ORDER BY relevance, subject_id))::INT AS rank, count(*) OVER () AS total FROM ({ranked_sql(M.INDEX_SQL, chr(34) + q + chr(34))})) WHERE rank <= 50"
    for i, q in enumerate(BATCH)
)


def _matched(spark, d):
    return S.filtered(S.rank(indexed(spark, d), TOPK))


def _abr(f):
    return lambda spark, d: f(M.artifacts(spark, d), M.runs(spark, d), M.gaps(spark, d))


def _dangling(spark, d):
    docs = M.index_rows(spark, d).select("subject_kind", "subject_id")
    kept = M.t(spark, d, "labels").select(F.lit("observation").alias("kind"), F.concat(F.lit("d"), F.col("doc_id")).alias("id"))
    return S.dangling(docs, kept)


def _requests(spark, d):
    return C.one_state(M.t(spark, d, "customer").select(F.concat(F.lit("d"), F.col("c_custkey")).alias("artifact_id")), M.artifacts(spark, d), M.runs(spark, d), M.gaps(spark, d))


QUERIES = {
    "fts_documents_topk": _page(TOPK),
    "fts_phrase_match": _page(PHRASE),
    "fts_prefix_match": _page(PREFIX, True),
    "fts_negation": _page(NEGATION),
    "fts_count": lambda spark, d: S.count(_matched(spark, d)),
    "fts_facets": lambda spark, d: S.facet_counts(_matched(spark, d)),
    "fts_collapse_alias": _collapsed,
    "fts_collapse_facets": lambda spark, d: S.facet_counts(_collapsed(spark, d)),
    "fts_local_batch": _batch,
    "fts_response": _responded,
    "fts_index_agreement": _disagreements,
    "search_document_projection": _projection,
    "dangling_documents": _dangling,
    "coverage_summary": _abr(C.summary),
    "coverage_states": _abr(C.states),
    "coverage_latest_run": lambda spark, d: C.latest_runs(M.runs(spark, d)),
    "coverage_incomplete": _abr(C.incomplete),
    "coverage_gaps_latest": lambda spark, d: C.latest_gaps(M.runs(spark, d), M.gaps(spark, d)),
    "coverage_of_requested": _requests,
}

_counted = f"SELECT * FROM ({ranked_sql(M.INDEX_SQL, TOPK)}) WHERE NOT superseded"
SQL = {
    "fts_documents_topk": page_sql(ranked_sql(M.INDEX_SQL, TOPK)),
    "fts_phrase_match": page_sql(ranked_sql(M.INDEX_SQL, PHRASE)),
    "fts_prefix_match": page_sql(ranked_sql(M.INDEX_SQL, PREFIX, True)),
    "fts_negation": page_sql(ranked_sql(M.INDEX_SQL, NEGATION)),
    "fts_count": f"SELECT count(*) AS total FROM ({_counted})",
    "fts_facets": f"SELECT subject_kind, facet, count(*) AS n FROM ({_counted}) GROUP BY ALL",
    "fts_collapse_alias": COLLAPSED_SQL,
    "fts_collapse_facets": f"SELECT subject_kind, facet, count(*) AS n FROM ({COLLAPSED_SQL}) GROUP BY ALL",
    "fts_local_batch": BATCH_SQL,
    "fts_response": f"""WITH r AS ({ranked_sql(M.INDEX_SQL, PHRASE)}), f AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY relevance, subject_id)::INT AS position FROM r WHERE NOT superseded),
        p AS (SELECT f.*, i.title, regexp_split_to_array(i.body, '\\s+') AS w FROM f JOIN ({M.INDEX_SQL}) i USING (subject_id) WHERE position <= 20),
        h AS (SELECT *, list_transform(w, lambda x: len(list_filter({tokens_sql('x')}, lambda y: y IN ('to'))) > 0) AS hit FROM p), s AS (SELECT *, greatest(coalesce(list_position(hit, true), 0) - 6, 1) AS a FROM h),
        c AS (SELECT count(*) AS n, count(*) FILTER (state <> 'complete') AS i FROM ({M.STATES_SQL}))
        SELECT position, subject_kind, subject_id, facet, relevance, title, total, CASE WHEN a > 1 THEN '…' ELSE '' END || array_to_string(list_transform(range(a, least(a + 12, len(w) + 1)), lambda k: CASE WHEN hit[k] THEN '[' || w[k] || ']' ELSE w[k] END), ' ') || CASE WHEN a + 12 <= len(w) THEN '…' ELSE '' END AS snippet,
        c.n AS coverage_artifacts, c.i AS coverage_incomplete, c.i = 0 AS coverage_is_complete FROM s, c""",
    "fts_index_agreement": f"""WITH n AS (SELECT subject_kind, subject_id, CASE WHEN ends_with(subject_id, '3') THEN 'moved' ELSE facet END AS facet FROM ({M.INDEX_SQL}) WHERE NOT ends_with(subject_id, '7') UNION ALL SELECT subject_kind, subject_id, facet FROM ({M.ENTITY_SQL}) WHERE facet = 'organisation'),
        t AS (SELECT subject_kind, subject_id, facet FROM ({M.INDEX_SQL})) SELECT * FROM (SELECT coalesce(n.subject_kind, t.subject_kind) AS subject_kind, coalesce(n.subject_id, t.subject_id) AS subject_id, CASE WHEN t.facet IS NULL THEN 'missing' WHEN n.facet IS NULL THEN 'orphan' WHEN n.facet <> t.facet THEN 'stale' END AS finding
        FROM n FULL JOIN t ON n.subject_kind = t.subject_kind AND n.subject_id = t.subject_id) WHERE finding IS NOT NULL""",
    "search_document_projection": PROJECTION_SQL,
    "dangling_documents": "SELECT 'observation' AS subject_kind, 'd' || doc_id AS subject_id FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id)",
    "coverage_summary": f"""SELECT *, incomplete = 0 AS is_complete FROM (SELECT *, never_attempted + in_progress + failed + partial AS incomplete FROM (SELECT count(*) AS artifacts, count(*) FILTER (state = 'never') AS never_attempted,
        count(*) FILTER (state = 'in_progress') AS in_progress, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'partial') AS partial, count(*) FILTER (state = 'complete') AS complete FROM ({M.STATES_SQL})))""",
    "coverage_states": M.STATES_SQL,
    "coverage_latest_run": M.LATEST_SQL,
    "coverage_incomplete": f"""SELECT s.artifact_id, state, CASE state WHEN 'never' THEN 0 WHEN 'failed' THEN 1 ELSE 2 END AS badness, coalesce((SELECT string_agg(DISTINCT gap_kind, ',' ORDER BY gap_kind) FROM ({M.GAPS_SQL}) g WHERE g.run_id = s.run_id), '') AS gap_kinds
        FROM ({M.STATES_SQL}) s WHERE state <> 'complete'""",
    "coverage_gaps_latest": f"SELECT artifact_id, run_id, gap_kind, magnitude, unit FROM ({M.GAPS_SQL}) JOIN ({M.LATEST_SQL}) USING (run_id)",
    "coverage_of_requested": f"SELECT 'd' || c_custkey AS artifact_id, coalesce(state, 'missing') AS state FROM customer LEFT JOIN ({M.STATES_SQL}) s ON s.artifact_id = 'd' || c_custkey",
}
