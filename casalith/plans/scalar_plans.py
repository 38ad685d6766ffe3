"""Selectors, URLs, addresses, lists and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import selectors as S
from ..functions import web as W
from ..sources import public as P
from ..sources import tabular as T
from . import model as M

c = F.col
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TRACKED = f"^(?:(?:{'|'.join(W.TRACKING)})(?:=|$)|(?:{'|'.join(W.TRACKING_PREFIXES)}))"
DOMAIN_SQL = lambda v: f"CASE WHEN regexp_full_match({v}, '([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\\.)+[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?') AND NOT regexp_matches({v}, '(^|\\.)(0x[0-9a-f]*|[0-9]+)$') AND length({v}) <= 253 AND NOT regexp_matches({v}, '\\.(local|localhost|internal|lan)$') THEN {v} END"


def _found(spark, d, pattern):
    return M.t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("found"))


def _scan(pattern):
    return f"SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS found FROM documents"


def _hosts(spark, d):
    return M.t(spark, d, "pages").select("page_id", W.host(c("url")).alias("host"))


def _candidates(spark, d):
    x = M.t(spark, d, "documents").select("doc_id", F.explode(S.candidate_tokens(c("text"))).alias("token")).withColumn("kind", S.candidate_kind(c("token")))
    return x.filter("kind IS NOT NULL AND kind <> 'phone'").groupBy("kind", "token").agg(F.count("*").alias("repeats"), F.min("doc_id").alias("first_doc"))


def _suggest(spark, d):
    x = M.t(spark, d, "customer").select(c("c_name").alias("full_name"), F.concat(F.lit("u"), c("c_custkey"), F.lit("@Example.com")).alias("contact"), F.concat_ws(".", F.lit("10"), F.lit("0"), c("c_custkey") % 7, c("c_nationkey")).alias("ip"), c("c_mktsegment").alias("segment"))
    return T.suggestions(x, ["full_name", "contact", "ip", "segment"])


def _ranges(spark, d):
    x = M.t(spark, d, "lineitem")
    return T.coalesced_ranges(x.select(c("l_suppkey").alias("source"), (c("l_orderkey") * 100 + c("l_linenumber")).alias("start"), c("l_quantity").cast("long").alias("size")), 4096)


def _v6(column, grouped=False):
    """Every customer's address, of one of ten kinds. grouped: keys of more than four digits fill as many groups as they need."""
    n = c("c_custkey").cast("string")
    n = F.regexp_replace(n, r"(?<=\d)(?=(?:\d{4})+$)", ":") if grouped else n
    kinds = [F.lit("::1"), F.concat(F.lit("FE80::"), n), F.concat(F.lit("fd00::"), n), F.lit("::"), F.lit("ff02::1"), F.concat(F.lit("2001:DB8::"), n), F.lit("::ffff:10.0.0.1"), F.concat(F.lit("2606:4700::"), n), F.lit("::ffff:8.8.8.8"), F.lit("not one")]
    return column(F.element_at(F.array(*kinds), (c("c_custkey") % 10 + 1).cast("int")))


def _hits(s, d):
    row = lambda i, url: F.concat(F.lit(f'{{"title":"t{i}","content":"s{i}","url":"'), url, F.lit('"}'))
    body = F.concat(F.lit('{"results":['), row(0, c("url")), F.lit(","), row(1, F.lit("nonsense")), F.lit(","), row(2, F.lit("https://example.org/x")), F.lit("]}"))
    return P.search_hits(M.t(s, d, "pages").select(c("page_id").alias("id"), F.when(c("page_id") % 5 == 0, "broken").otherwise(body).alias("body")))


def _requests(s, d):
    x = M.t(s, d, "nation").select(F.when(c("n_nationkey") % 4 == 0, "no domain").otherwise(F.concat(F.lit("N"), "n_nationkey", F.lit(".Example.org"))).alias("domain"))
    return P.requests(x, "https://dns.test/{domain}/{type}", "https://rdap.test/{domain}", "https://log.test/?q={domain}", "https://web.test/?u={domain}&n={limit}")


def _replay(s, d):
    asked = M.t(s, d, "pages").select("page_id", F.lit("get").alias("method"), F.concat("url", F.lit("#x")).alias("url"), F.lit(None).cast("string").alias("body"))
    kept = M.t(s, d, "pages").filter("page_id % 3 = 0").select(P.fixture_key(F.lit("GET"), c("url"), F.lit("")).alias("key"), F.lit(200).alias("status")).distinct()
    return P.replay(asked, kept).select("page_id", "status")


QUERIES = {
    "ip_guard_v6": lambda s, d: M.t(s, d, "customer").select("c_custkey", _v6(W.address_class6, grouped=True).alias("class")),
    "selector_ipv6": lambda s, d: M.t(s, d, "customer").select("c_custkey", _v6(S.ipv6).alias("normalized")),
    "search_hits": _hits,
    "public_requests": _requests,
    "replayed_responses": _replay,
    "url_canonicalise": lambda s, d: M.t(s, d, "pages").select("page_id", W.canonical_url(F.concat("url", F.when(c("page_id") % 3 == 0, "&b=2&a=1&fbclid=x").otherwise(""))).alias("canonical")),
    "url_hosts": _hosts,
    "browser_handoff": lambda s, d: M.t(s, d, "pages").select("page_id", W.browser_handoff(F.when(c("page_id") % 4 == 0, F.concat(F.lit("ftp://"), "url")).otherwise(c("url"))).alias("allowed")),
    "host_allowlist": lambda s, d: W.allowed_hosts(_hosts(s, d), [".example.org", "m.ththth.example.net"]),
    "ip_guard_v4": lambda s, d: _found(s, d, r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b").select("doc_id", "found", W.address_class(c("found")).alias("class")),
    "media_type_of_path": lambda s, d: M.t(s, d, "part").select("p_partkey", W.media_type_of_path(F.concat(F.lit("/a.b/f"), F.element_at(F.array(*[F.lit(x) for x in (".HTML", ".txt", ".jpeg", ".mov", ".xyz", "", ".tar.csv")]), (c("p_partkey") % 7 + 1).cast("int")))).alias("media_type")),
    "media_type_of_header": lambda s, d: M.t(s, d, "part").select("p_partkey", W.media_type_of_header(F.element_at(F.array(F.lit("Text/HTML; charset=utf-8"), F.lit(" application/JSON "), F.lit(None).cast("string")), (c("p_partkey") % 3 + 1).cast("int"))).alias("media_type")),
    "selector_email": lambda s, d: _found(s, d, EMAIL).select("doc_id", "found", S.email(c("found")).alias("normalized")),
    "selector_phone": lambda s, d: _found(s, d, r"\+[0-9][0-9 ().-]+").select("doc_id", "found", S.phone(c("found")).alias("normalized")),
    "selector_domain": lambda s, d: _hosts(s, d).select("page_id", S.domain(F.when(c("page_id") % 5 == 0, F.concat("host", F.lit(".local"))).otherwise(F.upper("host"))).alias("normalized")),
    "selector_username": lambda s, d: M.t(s, d, "customer").select("c_custkey", S.username(F.when(c("c_custkey") % 2 == 0, c("c_name")).otherwise(F.concat(F.lit(" u_"), "c_custkey"))).alias("normalized")),
    "selector_ip": lambda s, d: _found(s, d, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").select("doc_id", "found", S.ipv4(c("found")).alias("normalized")),
    "candidate_tokens": _candidates,
    "bulk_list_dedup": lambda s, d: T.bulk_list(M.t(s, d, "documents").select("doc_id", "text"), "username").select("doc_id", "first", "value", "normalized", "repeats"),
    "text_lines": lambda s, d: T.lines(M.t(s, d, "documents")),
    "column_suggestions": _suggest,
    "mapped_name_columns": lambda s, d: M.t(s, d, "customer").select("c_custkey", T.mapped(["c_mktsegment", "c_name"], "name").alias("name")),
    "coalesced_ranges": _ranges,
    "csv_neutralise": lambda s, d: M.t(s, d, "documents").select("doc_id", W.spreadsheet_cell(F.concat(F.element_at(F.array(F.lit(" ="), F.lit("a,\""), F.lit("-"), F.lit("")), (c("doc_id") % 4 + 1).cast("int")), c("text"))).alias("cell")),
    "html_escape": lambda s, d: M.t(s, d, "pages").select("page_id", W.html_escape(c("html")).alias("escaped")),
}

_host_sql = "SELECT page_id, nullif(lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host FROM pages"
SQL = {
    "ip_guard_v6": "SELECT c_custkey, ['loopback', 'link_local', 'private', 'not_global', 'not_global', 'not_global', 'private', 'public', 'public', NULL][c_custkey % 10 + 1] AS class FROM customer",
    "selector_ipv6": "SELECT c_custkey, ['::1', 'fe80::' || c_custkey, 'fd00::' || c_custkey, '::', 'ff02::1', '2001:db8::' || c_custkey, '::ffff:10.0.0.1', '2606:4700::' || c_custkey, '::ffff:8.8.8.8', NULL][c_custkey % 10 + 1] AS normalized FROM customer WHERE c_custkey < 10000 UNION ALL SELECT c_custkey, ['::1', NULL, NULL, '::', 'ff02::1', NULL, '::ffff:10.0.0.1', NULL, '::ffff:8.8.8.8', NULL][c_custkey % 10 + 1] FROM customer WHERE c_custkey >= 10000",
    "search_hits": "SELECT page_id AS id, 0 AS position, 't0' AS title, url, 's0' AS snippet FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT page_id, 2, 't2', 'https://example.org/x', 's2' FROM pages WHERE page_id % 5 <> 0",
    "public_requests": """WITH d AS (SELECT 'n' || n_nationkey || '.example.org' AS d FROM nation WHERE n_nationkey % 4 <> 0) SELECT d AS domain, 'dns:' || t AS kind, 'https://dns.test/' || d || '/' || t AS url FROM d, unnest(['A', 'AAAA', 'CNAME', 'MX', 'NS', 'TXT', 'SOA']) u(t)
      UNION ALL SELECT d, 'rdap', 'https://rdap.test/' || d FROM d UNION ALL SELECT d, 'certificates', 'https://log.test/?q=' || d FROM d UNION ALL SELECT d, 'archive', 'https://web.test/?u=' || d || '&n=100' FROM d""",
    "replayed_responses": "SELECT p.page_id, CASE WHEN EXISTS (FROM pages q WHERE q.page_id % 3 = 0 AND q.url = p.url) THEN 200 END AS status FROM pages p",
    "url_canonicalise": rf"""WITH u AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '&b=2&a=1&fbclid=x' ELSE '' END AS url FROM pages),
      p AS (SELECT page_id, split_part(url, '#', 1) AS u FROM u), q AS (SELECT page_id, regexp_extract(u, '^([a-z]+)://([^/?]*)([^?]*)', ['s', 'h', 'p']) AS x, CASE WHEN contains(u, '?') THEN substring(u, strpos(u, '?') + 1) ELSE '' END AS q FROM p),
      k AS (SELECT page_id, x, list_sort(list_filter(string_split(q, '&'), lambda v: v <> '' AND NOT regexp_matches(lower(v), '{TRACKED}'))) AS k FROM q)
      SELECT page_id, x.s || '://' || lower(x.h) || CASE x.p WHEN '' THEN '/' ELSE x.p END || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS canonical FROM k""",
    "url_hosts": _host_sql,
    "browser_handoff": "SELECT page_id, page_id % 4 <> 0 AS allowed FROM pages",
    "host_allowlist": f"SELECT page_id, host, host = 'example.org' OR ends_with(host, '.example.org') OR host = 'm.ththth.example.net' AS allowed FROM ({_host_sql})",
    "ip_guard_v4": rf"""WITH f AS ({_scan(r'\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')}), o AS (SELECT *, list_transform(string_split(found, '.'), lambda x: x::INT) AS o FROM f)
      SELECT doc_id, found, CASE WHEN list_max(o) > 255 THEN NULL WHEN o[1] = 127 THEN 'loopback' WHEN o[1] = 169 AND o[2] = 254 THEN 'link_local' WHEN o[1] = 10 OR o[1] = 172 AND o[2] BETWEEN 16 AND 31 OR o[1] = 192 AND o[2] = 168 THEN 'private'
      WHEN o[1] = 100 AND o[2] BETWEEN 64 AND 127 THEN 'carrier_nat' WHEN o[1] = 0 OR o[1] >= 224 OR o[1:3] IN ([192, 0, 2], [198, 51, 100], [203, 0, 113]) THEN 'not_global' ELSE 'public' END AS class FROM o""",
    "media_type_of_path": "SELECT p_partkey, ['text/html', 'text/plain', 'image/jpeg', 'video/quicktime', 'application/octet-stream', 'application/octet-stream', 'text/csv'][p_partkey % 7 + 1] AS media_type FROM part",
    "media_type_of_header": "SELECT p_partkey, ['text/html', 'application/json', 'application/octet-stream'][p_partkey % 3 + 1] AS media_type FROM part",
    "selector_email": rf"WITH f AS ({_scan(EMAIL)}), s AS (SELECT *, regexp_extract(found, '^(.*)@', 1) AS l, lower(rtrim(regexp_extract(found, '@([^@]*)$', 1), '.')) AS h FROM f) SELECT doc_id, found, CASE WHEN regexp_full_match(l, '[A-Za-z0-9_%+-]+(\.[A-Za-z0-9_%+-]+)*') AND length(l) <= 64 THEN l || '@' || {DOMAIN_SQL('h')} END AS normalized FROM s",
    "selector_phone": rf"WITH f AS ({_scan(r'\+[0-9][0-9 ().-]+')}), v AS (SELECT *, regexp_replace(trim(found), '[ ().-]', '', 'g') AS v FROM f) SELECT doc_id, found, CASE WHEN regexp_full_match(v, '\+[1-9][0-9]{{6,14}}') THEN v END AS normalized FROM v",
    "selector_domain": f"WITH h AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN host || '.local' ELSE host END AS v FROM ({_host_sql})) SELECT page_id, {DOMAIN_SQL('v')} AS normalized FROM h",
    "selector_username": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'u_' || c_custkey END AS normalized FROM customer",
    "selector_ip": rf"WITH f AS ({_scan(r'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')}) SELECT doc_id, found, CASE WHEN regexp_full_match(found, '{OCTET}(\.{OCTET}){{3}}') THEN found END AS normalized FROM f",
    "candidate_tokens": rf"""WITH r AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\s\x0B,;<>"(){{}}]')) AS x FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '^[.,!?]+', ''), '[.,!?]+$', ''), '(?i)^(?:{S.LABELS}):', '') AS token FROM r),
      k AS (SELECT *, CASE WHEN contains(token, '@') THEN 'email' WHEN starts_with(token, '0x') OR starts_with(lower(token), 'bc1') OR (strlen(token) BETWEEN 26 AND 35 AND regexp_matches(token, '^[13T]')) THEN 'wallet' WHEN starts_with(token, '+') THEN 'phone'
        WHEN (contains(token, ':') AND NOT contains(token, '://')) OR regexp_full_match(token, '[0-9]*\.[0-9]*\.[0-9]*\.[0-9]*') THEN 'ip' WHEN contains(token, '.') AND regexp_matches(token, '[A-Za-z]') THEN 'domain' END AS kind FROM b WHERE token <> '')
      SELECT kind, token, count(*) AS repeats, min(doc_id) AS first_doc FROM k WHERE kind IS NOT NULL AND kind <> 'phone' GROUP BY ALL""",
    "bulk_list_dedup": r"""WITH r AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, trim(unnest(a)) AS value FROM (SELECT doc_id, regexp_split_to_array(text, '[\n\r\t,;]') AS a FROM documents)),
      n AS (SELECT *, CASE WHEN regexp_full_match(value, '[A-Za-z0-9._-]{1,64}') AND regexp_matches(value, '[A-Za-z0-9]') THEN value END AS normalized FROM r WHERE value <> '')
      SELECT doc_id, min(pos)::INT AS first, value, normalized, count(*) AS repeats FROM n GROUP BY doc_id, value, normalized""",
    "text_lines": r"SELECT doc_id, (i - 1)::INT AS line_no, line FROM (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS a FROM documents)) WHERE trim(line) <> ''",
    "column_suggestions": "SELECT * FROM (VALUES ('full_name', 'name', 100::BIGINT, 100::BIGINT, true), ('contact', 'email', 100, 100, false), ('ip', 'ip', 100, 100, true)) t(\"column\", kind, valid, sampled, named)",
    "mapped_name_columns": "SELECT c_custkey, regexp_replace(trim(c_mktsegment) || ' ' || trim(c_name), '\\s+', ' ', 'g') AS name FROM customer",
    "coalesced_ranges": """WITH r AS (SELECT l_suppkey AS source, l_orderkey * 100 + l_linenumber AS a, l_quantity::BIGINT AS n FROM lineitem),
      e AS (SELECT *, max(a + n) OVER (PARTITION BY source ORDER BY a, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM r),
      i AS (SELECT *, sum(CASE WHEN e IS NULL OR a > e + 4096 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY a, n ROWS UNBOUNDED PRECEDING) AS i FROM e)
      SELECT source, min(a) AS first, max(a + n) AS last, count(*) AS pieces FROM i GROUP BY source, i""",
    "csv_neutralise": """WITH x AS (SELECT doc_id, [' =', 'a,"', '-', ''][doc_id % 4 + 1] || text AS t FROM documents) SELECT doc_id, '"' || CASE WHEN regexp_matches(t, '^\\s*[=+@-]') THEN '''' ELSE '' END || replace(t, '"', '""') || '"' AS cell FROM x""",
    "html_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages",
}
