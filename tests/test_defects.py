"""Cases that went wrong once: nulls in the audit chain, deep descendants, nested leaves, many searches at once, unknown ids, vectors of any length."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from casalith.operators import graph as G
from casalith.operators import lineage as L
from casalith.operators import resolve as R
from casalith.operators import results as RS
from casalith.operators import search as SE
from casalith.operators import vectors as V


def test_null_fields_change_the_chain_hash(spark):
    rows = [("a", None, "b"), ("a", "b", None), ("a", "", "b"), ("ab", None, None), ("a", "b", "")]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    assert df.select(L.chain_hash(F.lit(None).cast("string"), F.col("x"), F.col("y"), F.col("z")).alias("h")).distinct().count() == len(rows)


def test_closure_has_no_depth(spark):
    links = spark.range(70).select(F.col("id").alias("parent_id"), (F.col("id") + 1).alias("id")).unionByName(spark.createDataFrame([(70, 0)], "parent_id long, id long"))
    assert G.closure(spark.createDataFrame([(0,)], "id long"), links).count() == 71


def test_merge_chains_of_any_length(spark):
    n = 150
    entities = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("created_utc"), F.col("id").alias("row_seq"))
    pairs = spark.range(n - 1).select(F.col("id").cast("string").alias("left_entity"), (F.col("id") + 1).cast("string").alias("right_entity"))
    got = R.merge_map(entities, pairs).collect()
    assert len(got) == n - 1 and {r.canonical_id for r in got} == {"0"}


def test_leaves_are_found_at_any_depth(spark):
    fields = [
        {"cards": [{"module": "m", "fields": {"note": "[draft]", "deep": {"list": [1, {"tag": "red"}], "flag": True}}}]},
        {"cards": [{"module": "m", "fields": {"note": "{x"}}, {"module": "n", "fields": {"tag": "blue"}}]},
        {"legacy": {"tag": "red"}},
        {"cards": []},
        {"cards": [{"module": "m", "fields": {"age": 30.0, "verified": "true"}}]},
    ]
    rows = [(i, "r", "found", None, json.dumps({"source": "s", "fields": f})) for i, f in enumerate(fields)] + [(9, "r", "found", None, "not json"), (10, "r", "found", "gone", json.dumps({"fields": fields[0]}))]
    res = spark.createDataFrame(rows, "sequence long, run_id string, outcome string, artifact_id string, payload_json string")
    none = spark.createDataFrame([], "id string, content_hash string")
    p = RS.project(res, none, spark.createDataFrame([], "content_hash string, wrapped_key string")).cache()
    find = lambda **f: sorted(r.sequence for r in RS.by_cards(p, RS.CardFilter(**f)).collect())
    assert find(pattern="*draft*") == [0] and find(pattern="{x") == [1]
    assert find(field="tag") == [0, 1, 2] and find(field="tag", pattern="red") == [0, 2] and find(field="tag", pattern="red", module="m") == [0]
    assert find(field="0", pattern="1") == [0] and find(pattern="true") == [0, 4] and find(field="flag", pattern="true") == [0]
    assert find(min_age=0) == [] and find(verified="unknown") == [0, 1, 2, 3, 4, 9, 10] and find(verified="true") == []
    with pytest.raises(ValueError):
        RS.CardFilter(pattern="a\x07")
    with pytest.raises(ValueError):
        RS.CardFilter(min_age=151)


def test_unknown_results_are_an_error(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "sequence long, x string")
    assert [(r.position, r.sequence) for r in RS.selected(rows, [2, 1, 2]).orderBy("position").collect()] == [(0, 2), (1, 1)]
    with pytest.raises(KeyError):
        RS.selected(rows, [1, 7])


def test_a_batch_has_no_limit(spark):
    rows = [("entity", f"{i:02}", f"name{i}", f"name{i} of w{i % 4}", "person", False) for i in range(40)]
    ix = SE.index(spark.createDataFrame(rows, "subject_kind string, subject_id string, title string, body string, facet string, superseded boolean"))
    got = SE.batch(ix, [f"name{i} of" for i in range(40)] + ["nothing here", "!!"]).collect()
    assert sorted((r.query_no, r.subject_id, r.rank, r.total) for r in got) == [(i, f"{i:02}", 1, 1) for i in range(40)]
    for i in (0, 17):
        assert [(r.subject_id, r.relevance) for r in SE.hydrate(ix, SE.rank(ix, f'"name{i} of"')).collect()] == [(r.subject_id, r.relevance) for r in got if r.query_no == i]


def test_neighbours_by_direction(spark):
    v = np.array([[3.0, 0], [0, 2], [1, 1], [0, 0]])
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = V.knn(items, spark.createDataFrame([(0, [5.0, 0.0])], "query_id long, vector array<double>"), 3).orderBy("rank").collect()
    assert [(r.vec_id, r.distance) for r in got] == [(0, 0.0), (2, 0.292893), (1, 1.0)]


def test_expansion_does_not_depend_on_partitions(spark):
    edges = spark.range(400).select(F.concat(F.lit("e"), "id").alias("id"), F.lit("hub").alias("from_entity"), F.concat(F.lit("n"), "id").alias("to_entity"), F.lit("k").alias("kind"), (F.col("id") % 7).alias("row_seq"))
    seeds = spark.createDataFrame([("hub",)], "node string")
    one, two = (sorted(map(tuple, G.expand(seeds, edges.repartition(n), hops=2, per_node=50, most_nodes=30)[0].collect())) for n in (1, 5))
    assert one == two and len(one) == 30
