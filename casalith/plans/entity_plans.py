"""Entity resolution and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import resolve as R
from . import model as M

c = F.col


def entities(spark, d):
    return M.t(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), c("c_custkey")).alias("id"), c("c_name").alias("display_name"), (c("c_custkey") % 5).cast("string").alias("created_utc"), c("c_custkey").alias("row_seq"))


def identifiers(spark, d):
    x = M.t(spark, d, "customer")
    return x.select(F.concat(F.lit("c"), c("c_custkey")).alias("entity_id"), F.lit("segment").alias("namespace"), F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("normalized"))


def evidence(spark, d):
    x = M.t(spark, d, "orders")
    return x.select(F.when(c("o_orderkey") % 3 == 0, "relationship").otherwise("entity").alias("subject_kind"), F.concat(F.lit("c"), c("o_custkey")).alias("subject_id"))


def pairs(spark, d):
    x = M.t(spark, d, "customer").filter("c_custkey % 4 <> 0 AND c_custkey > 0")
    return x.select(F.concat(F.lit("c"), c("c_custkey")).alias("left_entity"), F.concat(F.lit("c"), c("c_custkey") - 1).alias("right_entity"))


def decisions(spark, d):
    x = M.t(spark, d, "customer")
    return x.select(F.concat(F.lit("c"), c("c_custkey")).alias("left_entity"), F.concat(F.lit("c"), c("c_custkey") - 1).alias("right_entity"), F.when(c("c_custkey") % 3 == 0, "merge").otherwise("reject").alias("action"), c("c_custkey").alias("row_seq")).filter("row_seq % 2 = 0 AND row_seq > 1")


def relations(spark, d):
    x = M.t(spark, d, "lineitem").join(M.t(spark, d, "orders"), c("l_orderkey") == c("o_orderkey"))
    return x.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("id"), F.concat(F.lit("c"), c("o_custkey")).alias("from_entity"), F.concat(F.lit("s"), c("l_suppkey")).alias("to_entity"), F.lit("buys_from").alias("kind"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("row_seq"))


RELATIONS_SQL = "SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS id, 'c' || o_custkey AS f, 's' || l_suppkey AS t, l_orderkey * 10 + l_linenumber AS row_seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
PAIRS_SQL = "SELECT 'c' || c_custkey AS a, 'c' || (c_custkey - 1) AS b FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey > 0"


def seeds(spark, d):
    return M.t(spark, d, "customer").filter("c_custkey <= 2").select(F.concat(F.lit("c"), c("c_custkey")).alias("node"))


def _assessments(spark, d):
    x = M.t(spark, d, "labels").select(F.concat(F.lit("d"), c("doc_id") % 50).alias("subject_id"), F.col("quality"), F.col("toxic"))
    return x.select("subject_id", F.lit("quality").alias("dimension"), c("quality").alias("value_key")).unionByName(x.select("subject_id", F.lit("toxic").alias("dimension"), c("toxic").alias("value_key")))


def _agreement(spark, d):
    subjects = M.t(spark, d, "documents").select(F.concat(F.lit("d"), c("doc_id")).alias("subject_id"))
    return R.agreement(subjects, ["quality", "toxic", "age"], _assessments(spark, d))


def _normalised(spark, d):
    x = M.t(spark, d, "pages").select("page_id", F.explode(F.array(F.struct(F.lit("url").alias("ns"), c("url").alias("v")), F.struct(F.lit("email_address").alias("ns"), F.concat(F.lit(" Press@"), F.upper(F.substring("url", 9, 8)), F.lit(" ")).alias("v")))).alias("x"))
    return x.select("page_id", c("x.ns").alias("namespace"), R.normalise_identifier(c("x.ns"), c("x.v")).alias("normalized"))


def _expand(spark, d):
    nodes, _, _ = G.expand(seeds(spark, d), relations(spark, d), hops=2, per_node=20, most_nodes=100)
    return nodes


def _descendants(spark, d):
    p = M.t(spark, d, "customer").filter("c_custkey > 1").select((c("c_custkey") / 3).cast("long").alias("parent_id"), c("c_custkey").alias("id"))
    return G.closure(M.t(spark, d, "customer").filter("c_custkey IN (5, 7)").select(c("c_custkey").alias("id")), p)


QUERIES = {
    "er_normalise_identifiers": _normalised,
    "er_shared_identifier_candidates": lambda s, d: R.shared_identifiers(identifiers(s, d)),
    "er_open_candidates": lambda s, d: R.open_candidates(R.propose(pairs(s, d).withColumns({"proposed_by": F.lit("rule:shared_identifier"), "rationale": c("left_entity"), "row_seq": F.length("left_entity")})), decisions(s, d)).select("left_entity", "right_entity", "rationale"),
    "er_active_merges": lambda s, d: R.active(decisions(s, d)),
    "er_merge_components": lambda s, d: R.merge_map(entities(s, d), pairs(s, d)),
    "er_canonical": lambda s, d: R.canonical(entities(s, d).select("id"), M.merges(s, d)),
    "er_cluster_counts": lambda s, d: R.cluster_counts(entities(s, d), M.merges(s, d), identifiers(s, d), evidence(s, d)),
    "er_map_violations": lambda s, d: R.map_violations(M.merges(s, d).unionByName(M.merges(s, d).filter("entity_id IN ('c7', 'c14')").select(F.lit("c3").alias("entity_id"), c("entity_id").alias("canonical_id")))),
    "entity_list": lambda s, d: R.entity_list(entities(s, d), M.merges(s, d)).select("position", "id", "display_name"),
    "entity_dimension_agreement": _agreement,
    "graph_one_hop": lambda s, d: G.reach(seeds(s, d), relations(s, d), 1),
    "graph_three_hop_reach": lambda s, d: G.reach(seeds(s, d), relations(s, d), 3),
    "graph_bounded_expand": _expand,
    "relationships_of_cluster": lambda s, d: G.touching(relations(s, d), seeds(s, d)).select("id", "from_entity", "to_entity"),
    "shred_closure": _descendants,
}

_reach = lambda hops: f"""WITH RECURSIVE e AS (SELECT DISTINCT f, t FROM ({RELATIONS_SQL}) UNION SELECT DISTINCT t, f FROM ({RELATIONS_SQL})),
r(node, depth) AS (SELECT 'c' || c_custkey, 0 FROM customer WHERE c_custkey <= 2 UNION SELECT e.t, depth + 1 FROM r JOIN e ON e.f = r.node WHERE depth < {hops})
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node"""  # noqa: E731
_who = f"WITH m AS ({M.MERGES_SQL}), w AS (SELECT 'c' || c_custkey AS id, coalesce(m.canonical_id, 'c' || c_custkey) AS canonical_id FROM customer LEFT JOIN m ON m.entity_id = 'c' || c_custkey)"
SQL = {
    "er_normalise_identifiers": "SELECT page_id, 'url' AS namespace, lower(trim(url)) AS normalized FROM pages UNION ALL SELECT page_id, 'email_address', 'Press@' || lower(trim(upper(substring(url, 9, 8)))) FROM pages",
    "er_shared_identifier_candidates": "WITH i AS (SELECT 'c' || c_custkey AS e, c_mktsegment || '-' || c_nationkey AS n FROM customer) SELECT DISTINCT m.l AS left_entity, i.e AS right_entity FROM i JOIN (SELECT n, min(e) AS l FROM i GROUP BY n) m USING (n) WHERE i.e > m.l",
    "er_open_candidates": f"SELECT least(a, b) AS left_entity, greatest(a, b) AS right_entity, a AS rationale FROM ({PAIRS_SQL}) p WHERE NOT EXISTS (FROM customer c WHERE c_custkey % 2 = 0 AND c_custkey > 1 AND 'c' || c_custkey = p.a)",
    "er_active_merges": "SELECT least('c' || c_custkey, 'c' || (c_custkey - 1)) AS left_entity, greatest('c' || c_custkey, 'c' || (c_custkey - 1)) AS right_entity FROM customer WHERE c_custkey % 2 = 0 AND c_custkey > 1 AND c_custkey % 3 = 0",
    # pairs link runs of keys from a multiple of 4 to the one before the next; the oldest of a run has the least (key % 5, key)
    "er_merge_components": """WITH k AS (SELECT c_custkey AS x, c_custkey // 4 AS g FROM customer),
      b AS (SELECT g, min_by(x, (x % 5) * 1000000000 + x) AS root, count(*) AS n FROM k GROUP BY g) SELECT 'c' || x AS entity_id, 'c' || root AS canonical_id FROM k JOIN b USING (g) WHERE x <> root AND n > 1""",
    "er_canonical": f"{_who} SELECT id, canonical_id FROM w",
    "er_cluster_counts": f"""{_who} SELECT canonical_id, count(*) - 1 AS members, count(*) AS identifiers,
      coalesce(sum((SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0 AND 'c' || o_custkey = w.id)), 0)::BIGINT AS evidence FROM w GROUP BY canonical_id""",
    "er_map_violations": f"""WITH m AS ({M.MERGES_SQL} UNION ALL SELECT 'c3', 'c7' UNION ALL SELECT 'c3', 'c14') SELECT entity_id, 'canonical is absorbed' AS violation FROM m WHERE canonical_id IN (SELECT entity_id FROM m)
      UNION ALL SELECT entity_id, 'absorbed twice' FROM m GROUP BY entity_id HAVING count(*) > 1""",
    "entity_list": "SELECT (row_number() OVER (ORDER BY c_name, c_custkey))::INT AS position, 'c' || c_custkey AS id, c_name AS display_name FROM customer WHERE NOT (c_custkey % 7 = 0 AND c_custkey > 1) ORDER BY c_name, c_custkey LIMIT 500",
    "entity_dimension_agreement": """WITH s AS (SELECT 'd' || doc_id AS subject_id, unnest(['quality', 'toxic', 'age']) AS dimension FROM documents),
      a AS (SELECT 'd' || (doc_id % 50) AS subject_id, 'quality' AS dimension, quality AS v FROM labels UNION ALL SELECT 'd' || (doc_id % 50), 'toxic', toxic FROM labels),
      n AS (SELECT subject_id, dimension, count(DISTINCT v) AS n FROM a GROUP BY ALL)
      SELECT s.subject_id, s.dimension, CASE WHEN n IS NULL THEN 'unassessed' WHEN n > 1 THEN 'disagreed' ELSE 'assessed' END AS standing FROM s LEFT JOIN n ON n.subject_id = s.subject_id AND n.dimension = s.dimension""",
    "graph_one_hop": _reach(1),
    "graph_three_hop_reach": _reach(3),
    "relationships_of_cluster": f"SELECT id, f AS from_entity, t AS to_entity FROM ({RELATIONS_SQL}) WHERE f IN ('c1', 'c2', 'c0') OR t IN ('c1', 'c2', 'c0')",
    "shred_closure": "WITH RECURSIVE r(id) AS (SELECT c_custkey FROM customer WHERE c_custkey IN (5, 7) UNION SELECT c_custkey FROM customer JOIN r ON c_custkey // 3 = r.id WHERE c_custkey > 1) SELECT id FROM r",
}
