"""Sources and recipes, snapshots, whole reports, restored packages, scales, places and submitted selectors over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import exports as X
from ..operators import lineage as L
from ..operators import reads as R
from ..operators import search as SE
from ..operators.stored import new_path
from ..sources import registry as G
from ..sources import tabular as T
from . import model as M
from .search_plans import ranked_sql

c, t = F.col, M.t
KINDS = ("username", "domain", "name", "email", "phone", "ip", "wallet", "image")


def _pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _choices(s, d):
    return G.choices(t(s, d, "customer").select("c_custkey", _pick(KINDS, c("c_custkey")).alias("kind")))


#: Bodies by a customer's key: a profile, another's, none (a message or null), anything else; %s stands for the name.
BODIES = ('{"login":"%s","id":%k}', '{"login":"other","id":5}', '{"message":"Not Found"}', '{"message":"The user does not exist [uid: 3]"}', "null", "no json", '{"login":"%s","id":0}', '{"login":"%s","id":"7"}', '{"id":"%s"}', '{"id":"%S"}', '{"login":3,"id":3}')
STATUSES = (200, 404, 200, 200, 403, 200, 503, 200)


def _profiles(s, d):
    k, name = c("c_custkey"), F.concat(F.lit("u"), c("c_custkey"))
    body = F.replace(F.replace(F.replace(_pick(BODIES, k), F.lit("%s"), name), F.lit("%S"), F.upper(name)), F.lit("%k"), k.cast("string"))
    rows = t(s, d, "customer").select("c_custkey", _pick([r[0] for r in G.RECIPES] + ["else"], F.floor(k / 88)).alias("source"), F.when(k % 3 == 0, F.upper(name)).otherwise(name).alias("username"), _pick(STATUSES, F.floor(k / 11)).alias("status"), (k % 41 == 0).alias("redirected"), body.alias("body"))
    return G.profile_outcomes(rows).select("c_custkey", "outcome", "url")


def _snapshots(s, d):
    x = t(s, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    one = F.struct("turn", c("role").alias("locator"), c("text").alias("value"))
    rows = x.filter("conv_id % 11 <> 0").groupBy(c("conv_id").alias("artifact_id")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    made = F.transform("all", lambda o: F.struct(F.when(o["turn"] % 2 == 0, F.lit("ocr.line")).otherwise("page.text").alias("kind"), o["locator"].alias("locator"), o["value"].alias("value")))
    new = rows.select("artifact_id", F.concat(F.lit("h"), "artifact_id").alias("snapshot_hash"), F.lit("e2").alias("engine"), F.lit(2).alias("row_seq"), made.alias("observations"))
    snapshots = new.unionByName(new.withColumns({"engine": F.lit("e1"), "row_seq": F.lit(1), "observations": F.slice("observations", 1, 1)}))
    cited = x.select(
        "conv_id", "turn", c("conv_id").alias("artifact_id"), F.when(c("conv_id") % 5 != 1, F.concat(F.lit("h"), "conv_id")).alias("snapshot_hash"), F.when(c("conv_id") % 7 == 2, c("turn") + 100).otherwise(c("turn")).alias("snapshot_index"),
        c("role").alias("locator"), F.when(c("turn") % 3 == 2, F.concat("text", F.lit("."))).otherwise(c("text")).alias("value"),
    )
    return L.snapshot_agreement(cited, snapshots).select("conv_id", "turn", "verdict", "basis")


def _document(form):
    def made(s, d):
        findings = t(s, d, "nation").select(c("n_nationkey").alias("finding_id"), c("n_nationkey").alias("position"), F.concat("n_name", F.lit(" <&> *"), "n_regionkey").alias("heading"))
        bodies = t(s, d, "supplier").groupBy(c("s_nationkey").alias("finding_id")).agg(F.array_join(F.array_sort(F.collect_list("s_name")), "\n").alias("body"))
        return L.report_document(findings, bodies, form)

    return made


def _restored(s, d):
    files = t(s, d, "pages").select(c("page_id").cast("string").alias("name"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
    claimed = files.select("name", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))
    return X.restore(claimed, files, new_path(s, "restored")).select("name", "hash", "size")


def _seeded(s, d):
    rows = t(s, d, "part").select(c("p_brand").alias("scale_id"), (c("p_partkey") % 4).alias("version"), c("p_type").alias("value_key")).distinct()
    offered = rows.unionByName(rows.select("scale_id", "version", F.lit("insufficient_information").alias("value_key")).distinct())
    return K.scales_to_seed(offered, t(s, d, "part").filter("p_size % 10 = 1").select(c("p_brand").alias("scale_id"), (c("p_partkey") % 4).alias("version")))


def _places(s, d):
    return R.on_map(t(s, d, "customer").select("c_custkey", c("c_mktsegment").alias("label"), F.when(c("c_custkey") % 3 == 0, F.lit("near a BUILDING site")).alias("uncertainty"), (c("c_custkey") % 181 - 90).cast("double").alias("latitude")), "building").select("c_custkey", "mapped")


def _submitted(s, d):
    plan = F.concat(F.lit('{"parent":{"id":"i'), c("event_id") % 3, F.lit('"},"selectors":[{"kind":"username","normalized":"u'), "user_id", F.lit('"},{"kind":"domain","normalized":"'), "event_type", F.lit('.example"}]}'))
    return R.submitted_keys(t(s, d, "events").select(F.when(c("event_id") % 5 == 0, "broken").otherwise(plan).alias("plan")), "i1")


#: Passages, and queries with the number of the passage that answers them: a yardstick for the ranking, so it is a fixed list.
PASSAGES = (
    "The harbour office logs every vessel that berths after dark.",
    "Night trains between the two capitals stop at the border for an hour.",
    "Invoices are paid within thirty days unless the buyer disputes them.",
    "The archive keeps letters of the botanist and her drawings of ferns.",
    "A vessel without papers is held until the harbour office hears from its owner.",
    "Ferns grow along the north wall where the sun seldom falls.",
    "The border was closed for an hour after the storm.",
    "Letters to the buyer went unanswered, and the invoices stayed open.",
    "The owner of the mill sold it to his brother in spring.",
    "Trains were late all spring because of works on the northern line.",
)
QUESTIONS = (("vessel owner", 4), ("night trains", 1), ("disputes", 2), ("botanist letters", 3), ("ferns wall", 5), ("border storm", 6), ("invoices unanswered", 7), ("mill spring", 8), ("spring trains", 9), ("harbour dark", 0))


def _lexical_quality(s, d):
    rows = s.createDataFrame([("passage", str(i), "", p, "text", False) for i, p in enumerate(PASSAGES)], "subject_kind string, subject_id string, title string, body string, facet string, superseded boolean")
    ix, out = SE.index(rows), None
    for no, (q, answer) in enumerate(QUESTIONS):
        top = SE.search(ix, q, limit=1).select(F.lit(no).alias("query_no"), "subject_id", (c("subject_id") == str(answer)).alias("right"))
        out = top if out is None else out.unionByName(top)
    return out


def _origins(s, d):
    x = t(s, d, "events").select("event_type", (c("user_id") % 20).alias("place"), c("user_id").alias("origin"), "event_id")
    return T.with_origins(x, ["event_type", "place"], "origin", "event_id", 3).withColumn("origins", F.array_join(c("origins").cast("array<string>"), ","))


QUERIES = {
    "lexical_quality": _lexical_quality,
    "value_origins": _origins,
    "source_choices": _choices,
    "profile_outcomes": _profiles,
    "snapshot_agreement": _snapshots,
    "report_markdown": _document("markdown"),
    "report_html": _document("html"),
    "package_restore": _restored,
    "scales_to_seed": _seeded,
    "map_places": _places,
    "submitted_keys": _submitted,
}


def _sql(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def _list(values):
    return "[" + ", ".join(_sql(v) for v in values) + "]"


_ROWS = "SELECT n_nationkey AS k, n_name || ' <&> *' || n_regionkey AS h, (SELECT string_agg(s_name, chr(10) ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey) AS b FROM nation"


def _html(x):
    return f"replace(replace(replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def _mark(x):
    return rf"replace(replace(replace(regexp_replace(coalesce({x}, ''), '([\\`*_{{}}\[\]()#+.!|~-])', '\\\1', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_PASSAGES = "SELECT * FROM (VALUES " + ", ".join(f"('passage', '{i}', '', '{p}', 'text', false)" for i, p in enumerate(PASSAGES)) + ") v(subject_kind, subject_id, title, body, facet, superseded)"

SQL = {
    "lexical_quality": " UNION ALL ".join(f"SELECT {no} AS query_no, subject_id, subject_id = '{answer}' AS \"right\" FROM (SELECT * FROM ({ranked_sql(_PASSAGES, q)}) ORDER BY relevance, subject_id LIMIT 1)" for no, (q, answer) in enumerate(QUESTIONS)),
    "value_origins": """WITH e AS (SELECT event_type, user_id % 20 AS place, user_id AS origin, min(event_id) AS at_, count(*) AS c FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, place ORDER BY at_, origin) AS n FROM e)
      SELECT event_type, place, sum(c)::BIGINT AS repeats, string_agg(origin::VARCHAR, ',' ORDER BY n) FILTER (n <= 3) AS origins FROM r GROUP BY 1, 2""",
    "source_choices": f"""WITH k AS (SELECT c_custkey, {_list(KINDS)}[c_custkey % 8 + 1] AS kind FROM customer), g(source, host, kinds, most_calls) AS (VALUES {", ".join(f"('{r[0]}', '{r[3]}', '{r[4]}', {r[6]})" for r in G.SOURCES if r[2] == "native")})
      SELECT c_custkey, kind, source, host, most_calls::INT AS most_calls FROM k JOIN g ON list_contains(string_split(kinds, ' '), kind)""",
    "profile_outcomes": f"""WITH r(source, shown, field, exact, numeric_id, missing, message, more) AS (VALUES {", ".join("(" + ", ".join(_sql(v) for v in (r[0], r[2], r[3], r[4], r[5], r[6], r[7], r[8])) + ")" for r in G.RECIPES)}),
      p AS (SELECT c_custkey, {_list([r[0] for r in G.RECIPES] + ["else"])}[c_custkey // 88 % 4 + 1] AS source, CASE WHEN c_custkey % 3 = 0 THEN 'U' ELSE 'u' END || c_custkey AS username, {_list(STATUSES)}[c_custkey // 11 % 8 + 1] AS status, c_custkey % 41 = 0 AS redirected,
        replace(replace(replace({_list(BODIES)}[c_custkey % 11 + 1], '%s', 'u' || c_custkey), '%S', 'U' || c_custkey), '%k', c_custkey::VARCHAR) AS body FROM customer),
      j AS (SELECT p.*, r.* EXCLUDE source, r.source IS NOT NULL AS known, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM p LEFT JOIN r USING (source)),
      x AS (SELECT *, CASE WHEN json_type(v, '$.' || field) = 'VARCHAR' THEN v->>('$.' || field) END AS who, CASE WHEN json_type(v, '$.message') = 'VARCHAR' THEN v->>'$.message' END AS said, coalesce(json_type(v, '$.id') IN ('UBIGINT', 'BIGINT') AND TRY_CAST(v->>'$.id' AS HUGEINT) > 0, false) AS numbered FROM j),
      o AS (SELECT *, CASE WHEN NOT known OR redirected THEN 'unknown' WHEN status IN (401, 402, 403, 429) THEN 'blocked' WHEN status >= 500 THEN 'error' WHEN v IS NULL THEN 'unknown'
        WHEN status = missing AND CASE WHEN message IS NULL THEN json_type(v) = 'NULL' ELSE said = message OR more AND starts_with(said, message || ' [') END THEN 'not_found'
        WHEN status = 200 AND CASE WHEN exact THEN who = username ELSE lower(who) = lower(username) END AND (NOT numeric_id OR numbered) THEN 'found' ELSE 'unknown' END AS outcome FROM x)
      SELECT c_custkey, outcome, CASE WHEN outcome = 'found' THEN replace(shown, '{{username}}', username) END AS url FROM o""",
    "snapshot_agreement": """WITH x AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM x WHERE conv_id % 11 <> 0),
      q AS (SELECT *, CASE WHEN conv_id % 7 = 2 THEN turn + 100 ELSE turn END AS i, CASE WHEN turn % 3 = 2 THEN text || '.' ELSE text END AS v FROM x),
      j AS (SELECT q.*, s.i IS NOT NULL AS hit, s.text IS NOT DISTINCT FROM q.v AND s.role IS NOT DISTINCT FROM q.role AS same, s.turn AS st FROM q LEFT JOIN s ON s.conv_id = q.conv_id AND s.i = q.i),
      o AS (SELECT *, CASE WHEN conv_id % 5 = 1 THEN 'uncited' WHEN conv_id % 11 = 0 THEN 'unavailable' WHEN NOT hit THEN 'out_of_range' WHEN same THEN 'agrees' ELSE 'differs' END AS verdict FROM j)
      SELECT conv_id, turn, verdict, CASE WHEN verdict = 'agrees' THEN CASE WHEN st % 2 = 0 THEN 'recorded words' ELSE 'recorded transformation' END || ' of e2' END AS basis FROM o""",
    "report_markdown": f"SELECT string_agg('## ' || {_mark('h')} || chr(10) || chr(10) || {_mark('b')} || chr(10), chr(10) ORDER BY k) AS document FROM ({_ROWS})",
    "report_html": f"SELECT '{L.HTML_HEAD.replace(chr(39), chr(39) * 2)}' || string_agg('<section><h2>' || {_html('h')} || '</h2><pre>' || {_html('b')} || '</pre></section>', '' ORDER BY k) || '</body></html>' AS document FROM ({_ROWS})",
    "package_restore": "SELECT page_id::VARCHAR AS name, sha256(coalesce(html, '')) AS hash, strlen(coalesce(html, '')) AS size FROM pages",
    "scales_to_seed": """WITH p AS (SELECT DISTINCT p_brand AS scale_id, p_partkey % 4 AS version, p_type AS value_key FROM part), a AS (FROM p UNION SELECT scale_id, version, 'insufficient_information' FROM p)
      FROM a WHERE NOT EXISTS (FROM part WHERE p_size % 10 = 1 AND p_brand = scale_id AND p_partkey % 4 = version)""",
    "map_places": "SELECT c_custkey, abs(c_custkey % 181 - 90) <= 85.0511 AS mapped FROM customer WHERE contains(lower(c_mktsegment), 'building') OR c_custkey % 3 = 0",
    "submitted_keys": "WITH e AS (FROM events WHERE event_id % 3 = 1 AND event_id % 5 <> 0) SELECT 'username' AS kind, 'u' || user_id AS normalized FROM e UNION SELECT 'domain', event_type || '.example' FROM e",
}
