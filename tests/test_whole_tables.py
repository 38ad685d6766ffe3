"""Queries over whole tables and whole texts, against brute force or the registered SQL."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casalith.operators import vectors as V
from casalith.plans import registry

DATA = Path("/root/testdata")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_hamming_duplicates_reads_whole_texts(spark, tmp_path):
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    base = r.choice(words, 300).tolist()
    start = ["the", "same", "thirty", "characters", "and", "more"]
    texts = [" ".join(base), " ".join(["changed", *base[1:]]), " ".join([*base[:-1], "changed"]), *(" ".join(start + r.choice(words, 80).tolist()) for _ in range(12)), "", None, "one", "one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x.left_id, x.right_id): x.bits for x in QUERIES["hamming_duplicates"](spark, str(tmp_path)).collect()}
    h = {x.doc_id: x.h & (2**64 - 1) for x in spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", V.text_simhash(F.col("text")).alias("h")).collect()}
    root = {f: min(i for i in h if h[i] == f) for f in h.values()}
    want = {(root[f], i): 0 for i, f in h.items() if i != root[f]}
    want |= {(a, b): n for a in root.values() for b in root.values() if a < b and (n := (h[a] ^ h[b]).bit_count()) <= 8}
    assert got == want
    assert {(0, 1), (0, 2), (15, 16), (17, 18)} <= set(got) and not any(3 <= a < 15 and 3 <= b < 15 for a, b in got)


def test_hamming_pairs_against_all_pairs(spark):
    r = np.random.default_rng(2)
    base = int(r.integers(0, 2**63))
    h = [base] + [base ^ sum(1 << int(b) for b in r.choice(64, n, replace=False)) for n in (1, 4, 7, 8, 9, 12) for _ in range(4)] + [int(x) for x in r.integers(0, 2**63, 20)]
    rows = spark.createDataFrame([(i, x - 2**64 if x >= 2**63 else x) for i, x in enumerate(h)], "id long, hash long")
    for most in (3, 8):
        assert {(x.left_id, x.right_id, x.bits) for x in V.hamming_pairs(rows, most).collect()} == {(i, j, n) for j in range(len(h)) for i in range(j) if (n := (h[i] ^ h[j]).bit_count()) <= most}


def test_complete_link_groups_of_all_vectors(spark, tmp_path):
    r = np.random.default_rng(3)
    near = lambda n: r.normal(size=(n, 64)) * 0.03 + r.normal(size=64)
    v = np.concatenate([r.normal(size=(150, 64)), near(560), near(40), r.normal(size=(150, 64))])[r.permutation(900)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    close = v @ v.T >= 0.3
    groups = []
    for i in range(len(v)):
        for g in groups:
            if close[i, g].all():
                g.append(i)
                break
        else:
            groups.append([i])
    want = {i: g[0] for g in groups if len(g) > 1 for i in g}
    got = {x.vec_id: x.group_id for x in QUERIES["complete_link_groups"](spark, str(tmp_path)).collect()}
    assert got == want and max(want) >= 200
    items = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    pairs = {(i, j) for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True)}
    assert {(x.left_id, x.right_id) for x in V.pairs_within(items, 0.7, block=100).collect()} == pairs


def same_rows(spark, name, sf="sf0.01"):
    """The query's rows against its SQL."""
    con = duckdb.connect()
    for f in sorted((DATA / sf).glob("*.parquet")):
        con.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    df = QUERIES[name](spark, str(DATA / sf))
    cols = sorted(df.columns)
    want = con.sql(SQL[name]).select(*[f'"{c}"' for c in cols]).fetchall()
    plain = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(map(plain, r))) for r in want)


@pytest.mark.skipif(not DATA.exists(), reason="no supplied tables")
@pytest.mark.parametrize("name", ["graph_one_hop", "graph_three_hop_reach", "relationships_of_cluster"])
def test_graph_of_all_customers(spark, name):
    same_rows(spark, name)


def test_graph_passes_through_any_customer(spark, tmp_path):
    orders = [(1, 1), (2, 900), (3, 901)]
    lines = [(1, 1, 10, 5), (2, 1, 10, 5), (2, 2, 11, 5), (3, 1, 11, 5)]
    spark.createDataFrame([(1,), (900,), (901,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {n: {(x.node, x.depth) for x in QUERIES[n](spark, str(tmp_path)).collect()} for n in ("graph_one_hop", "graph_three_hop_reach", "graph_bounded_expand")}
    two = {("c1", 0), ("s10", 1), ("c900", 2)}
    assert got == {"graph_one_hop": {("c1", 0), ("s10", 1)}, "graph_three_hop_reach": two | {("s11", 3)}, "graph_bounded_expand": two}


@pytest.mark.skipif(not DATA.exists(), reason="no supplied tables")
@pytest.mark.parametrize("name", ["audit_chain_verify", "entity_dimension_agreement", "box_overlap", "coalesced_ranges", "csv_neutralise", "html_escape", "hamming_duplicates"])
def test_whole_tables_and_texts(spark, name):
    same_rows(spark, name)


def test_chain_against_a_loop(spark):
    import hashlib

    from casalith.operators import lineage as L

    events = [(i, None if i % 7 == 0 else f"a{i % 3}") for i in range(50)]
    got, last = L.chain(spark.createDataFrame(events[::-1], "id long, action string")).orderBy("id").collect(), None
    for (i, action), r in zip(events, got, strict=True):
        h = hashlib.sha256("\x1f".join("-1:" if f is None else f"{len(f)}:{f}" for f in (last, str(i), action)).encode()).hexdigest()
        assert (r.id, r.action, r.prev_hash, r.hash) == (i, action, last, h)
        last = h
    rows = spark.createDataFrame([(r.id, "edited" if r.id == 30 else r.action, r.prev_hash, r.hash) for r in got], "id long, action string, prev_hash string, hash string")
    assert tuple(L.verify_chain(rows, ["id", "action"], 7).first()) == (50, 30, "event was changed")


def test_complete_link_by_blocks(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(3000, 8))
    v[r.integers(0, 3000, 900)] = v[5]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near, groups = v @ v.T >= 0.3, []
    for i in range(len(v)):
        g = next((g for g in groups if near[i, g].all()), None)
        if g is None:
            groups.append([i])
        else:
            g.append(i)
    items = spark.createDataFrame([(2 * i, x.tolist()) for i, x in enumerate(v)] + [(7, None)], "vec_id long, embedding array<double>")
    for block in (1500, 700, 5000):
        assert {(x.vec_id, x.group_id) for x in V.complete_link(items, None, 0.3, block).collect()} == {(2 * i, 2 * g[0]) for g in groups if len(g) > 1 for i in g}


def test_hamming_pairs_in_small_cells(spark, monkeypatch):
    r = np.random.default_rng(5)
    h = r.integers(0, 2**63, 40, dtype=np.uint64)[r.integers(0, 40, 2500)]
    for _ in range(6):
        h ^= np.where(r.random(2500) < 0.7, np.uint64(1) << r.integers(0, 64, 2500, dtype=np.uint64), np.uint64(0))
    root = {x: i for i, x in reversed(list(enumerate(h.tolist())))}
    reps = sorted(root.values())
    d = np.bitwise_count(h[reps][:, None] ^ h[reps][None])
    want = {(reps[i], reps[j], int(d[i, j])) for i, j in zip(*np.nonzero(np.triu(d <= 8, 1)), strict=True)} | {(root[x], i, 0) for i, x in enumerate(h.tolist()) if root[x] != i}
    rows = spark.createDataFrame(list(enumerate(h.view(np.int64).tolist())), "id long, hash long")
    for cell, whole in ((16, 16_384), (1 << 17, 4)):
        monkeypatch.setattr(V._near_hashes, "__defaults__", (whole,))
        got = [(x.left_id, x.right_id, x.bits) for x in V.hamming_pairs(rows, 8, cell).collect()]
        assert len(got) == len(want) and set(got) == want
