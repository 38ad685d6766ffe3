"""Vector, fusion and Hamming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as V
from . import model as M

c = F.col


def items(spark, d):
    return M.t(spark, d, "embeddings")


def _queries(spark, d):
    return items(spark, d).filter("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("vector"))


def _threshold(spark, d):
    q = items(spark, d).filter("vec_id = 0").first()["embedding"]
    return V.threshold_by_owner(items(spark, d).withColumn("owner", c("label")), q, 0.1)


def _hashes(spark, d):
    return M.t(spark, d, "documents").select(c("doc_id").alias("id"), V.text_simhash(c("text")).alias("hash"))


def _ranked(spark, d):
    near = V.knn(items(spark, d), items(spark, d).filter("vec_id IN (0, 1)").select(c("vec_id").alias("query_id"), c("embedding").alias("vector")), 40)
    return near.select((c("vec_id") % 50).alias("key"), (c("rank") - 1).alias("rank"), "query_id")


def _fused(spark, d):
    r = _ranked(spark, d)
    return V.fuse(r.filter("query_id = 0").select("key", "rank"), r.filter("query_id = 1").groupBy("key").agg(F.min("rank").alias("rank")))


def _gate(spark, d):
    near = V.knn(items(spark, d), _queries(spark, d), 2).filter("rank = 2")
    e = items(spark, d).select("vec_id", "label")
    hit = near.join(e, "vec_id").join(e.select(c("vec_id").alias("query_id"), c("label").alias("want")), "query_id")
    return V.quality_gate(hit.select((c("label") == c("want")).alias("embedding_hit"), (c("query_id") % 200 == 0).alias("lexical_hit")))


def _boxes(spark, d):
    x = M.t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") % 7).alias("a"), (c("l_quantity") % 5).alias("b"))
    one = (c("a"), c("b"), c("a") + 4, c("b") + 3)
    two = (F.lit(2.0), F.lit(2.0), F.lit(6.0), F.lit(4.0))
    return x.select("l_orderkey", "l_linenumber", F.round(V.overlap(one, two), 6).alias("iou"), V.thousandths(c("a"), F.lit(7.5)).alias("left"), V.thousandths(c("a") + 4, F.lit(7.5), True).alias("right"))


QUERIES = {
    "vec_normalise": lambda s, d: items(s, d).withColumn("v", F.transform("embedding", lambda x: (x * 3).cast("float"))).select("vec_id", F.round(F.element_at(V.normalise(c("v"), 64), 1), 6).alias("first"), V.normalise(c("v"), 32).isNull().alias("wrong_size")),
    "vec_knn": lambda s, d: V.knn(items(s, d), _queries(s, d), 10),
    "vec_threshold_by_owner": _threshold,
    "vec_quality_gate": _gate,
    "hybrid_rrf": _fused,
    "hamming_duplicates": lambda s, d: V.hamming_pairs(_hashes(s, d), 8),
    "diverse_round_robin": lambda s, d: V.round_robin(M.t(s, d, "documents").select("doc_id", "source"), "source", ["doc_id"]),
    "complete_link_groups": lambda s, d: V.complete_link(items(s, d), None, 0.3),
    "box_overlap": _boxes,
}

_dot = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_knn = lambda which, k: f"SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id, round(1 - {_dot}, 6) + 0.0 AS distance FROM embeddings a, embeddings b WHERE {which})) WHERE rank <= {k}"
SQL = {
    "vec_normalise": "SELECT vec_id, round((embedding[1] * 3)::FLOAT::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: (x * 3)::FLOAT::DOUBLE * (x * 3)::FLOAT::DOUBLE))), 6) AS first, true AS wrong_size FROM embeddings",
    "vec_knn": _knn("b.vec_id % 20 = 0", 10),
    "vec_threshold_by_owner": f"SELECT label AS owner, min_by(vec_id, -s * 1000000000 + vec_id) AS best_id, max(s) AS similarity, count(*) - 1 AS others FROM (SELECT a.label, a.vec_id, round({_dot}, 6) AS s FROM embeddings a, embeddings b WHERE b.vec_id = 0) WHERE s >= 0.1 GROUP BY label",
    "vec_quality_gate": f"""WITH k AS ({_knn("b.vec_id % 20 = 0", 2)}), h AS (SELECT e.label = q.label AS e, k.query_id % 200 = 0 AS l FROM k JOIN embeddings e ON e.vec_id = k.vec_id JOIN embeddings q ON q.vec_id = k.query_id WHERE rank = 2),
      n AS (SELECT count(*) AS total, count(*) FILTER (e) AS hits, count(*) FILTER (l) AS lexical FROM h) SELECT *, hits * 4 >= total * 3 AND hits >= lexical AS passed FROM n""",
    "hybrid_rrf": f"""WITH k AS ({_knn("b.vec_id IN (0, 1)", 40)}), s AS (SELECT vec_id % 50 AS key, max(1 / (60.0::DOUBLE + rank - 1)) AS s FROM k WHERE query_id = 0 GROUP BY 1 UNION ALL SELECT vec_id % 50, 1 / (60.0::DOUBLE + min(rank) - 1) FROM k WHERE query_id = 1 GROUP BY 1)
      SELECT key, round(sum(s), 9) AS score FROM s GROUP BY key""",
    "hamming_duplicates": """WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), s AS (SELECT id, unnest(list_transform(range(greatest(len(w) - 2, 1)), lambda i: ('0x' || substring(md5(array_to_string(w[i + 1:i + 3], ' ')), 1, 16))::UBIGINT)) AS x FROM t WHERE len(w) > 0),
      f AS (SELECT id, unnest(range(64)) AS b, unnest([""" + ", ".join(f"2 * sum((x >> {b}) & 1) > count(*)" for b in range(64)) + """]) AS one FROM s GROUP BY id), g AS (SELECT id, sum(CASE WHEN one THEN (1::UBIGINT << b::UBIGINT)::HUGEINT ELSE 0 END)::UBIGINT AS h FROM f GROUP BY id),
      h AS (SELECT t.id, coalesce(g.h, 0)::UBIGINT AS h FROM t LEFT JOIN g USING (id)), l AS (SELECT h, min(id) AS root FROM h GROUP BY h)
      SELECT root AS left_id, id AS right_id, 0 AS bits FROM h JOIN l USING (h) WHERE id <> root UNION ALL SELECT a.root, b.root, bit_count(xor(a.h, b.h))::INT FROM l a JOIN l b ON a.root < b.root WHERE bit_count(xor(a.h, b.h)) <= 8""",
    "diverse_round_robin": "SELECT doc_id, source, row_number() OVER (ORDER BY n, source) AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)",
    "box_overlap": """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity % 7 AS a, l_quantity % 5 AS b FROM lineitem), i AS (SELECT *, greatest(0, least(a + 4, 6) - greatest(a, 2)) * greatest(0, least(b + 3, 4) - greatest(b, 2)) AS i FROM x)
      SELECT l_orderkey, l_linenumber, round(i / (12 + 8 - i), 6) AS iou, greatest(0, least(1000, floor(a * 1000 / 7.5)))::INT AS "left", greatest(0, least(1000, ceil((a + 4) * 1000 / 7.5)))::INT AS "right" FROM i""",
}
