"""corpus_pipeline.run against a plain version of each stage, and its stages on odd rows and clashing columns."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casalith.llm import html_text, similar, simhash
from tests.llm.test_ops import DOCS, prose

BAD = ["grumble", "snarlish", "snarlest", "snarling"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    item = prose(900, 40)
    rows = [(i, prose(i, 60) + (f" {BAD[i % 4]} {prose(i + 5000, 20)} {BAD[(i + 1) % 4]}" if i % 5 == 0 else ""), "en", "abc"[i % 3], 1) for i in range(300)]
    rows += [(1000 + i, prose(7, 200) + f" tail{i}", "en", "a", 1) for i in range(5)]  # near copies of each other
    rows += [(2000, f"{prose(8, 30)} {item} {prose(9, 30)}", "en", "b", 1), (3000, None, "en", "c", 0), (3001, "", "en", None, 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "short one")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, item


def jaccard(a, b):
    x, y = (set(simhash.hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / max(1, len(x | y)) if x or y else 1.0


def test_pipeline_against_a_plain_version(spark, folder):
    d, rows, item = folder
    out = corpus_pipeline.run(spark, d).collect()
    toxic = lambda t: any(w in (t or "").split() for w in BAD)
    clean = [r for r in rows if not toxic(r[1])]
    root = list(range(len(clean)))
    for i in range(len(clean)):
        for j in range(i):
            if jaccard(clean[i][1], clean[j][1]) >= 0.8:
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    kept = {min(clean[i][0] for i in range(len(clean)) if root[i] == g) for g in set(root)}
    kept -= {r[0] for r in clean if item in (r[1] or "")}
    kept -= {r[0] for r in clean if not (r[1] or "").split()}  # nothing to take
    got = {r.doc_id for r in out}
    # the mix takes almost all words there are, so a source below its share loses none and one above it loses its tail
    size = {}
    for r in clean:
        if r[0] in kept:
            size[r[3]] = size.get(r[3], 0) + len(r[1].split())
    assert got <= kept and got >= {r[0] for r in clean if r[0] in kept and r[3] == "a"}
    assert abs(sum(len(r.text.split()) for r in out) - sum(size.values())) < 8
    slots = sorted((r.shard, r.slot) for r in out)
    n = len(out)
    assert slots == sorted((s, i) for s in range(8) for i in range(n // 8 + (s < n % 8)))
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r.doc_id].startswith(r.text) for r in out)


def test_stages_keep_columns_that_clash(spark, folder):
    d, rows, _ = folder
    docs = spark.createDataFrame(rows[:60], DOCS)
    for c in ("score", "predicted", "offsets", "size", "k", "w", "row", "__mix", "slot2", "check", "s"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        extra = ["shard", "slot"] if name == "sharding" else []
        assert out.columns == [*docs.columns, *extra], name
        first = out.first()
        assert first is None or all(first[c] == f"own {c}" for c in docs.columns if c not in [f.split()[0] for f in DOCS.split(", ")]), name
        empty = stage(spark, docs.limit(0), d)
        assert empty.count() == 0 and empty.columns == out.columns


def test_recall_of_near_duplicates(spark):
    """Every row whose id is divisible by 20 against all rows: pairs at 0.8 or more are in one group."""
    rows = []
    for i in range(300):
        base = prose(i // 6, 150).split()
        r = np.random.default_rng(i)
        for at in r.choice(150, i % 6, replace=False):
            base[int(at)] = f"edit{i}"
        rows.append((i, " ".join(base), "en", "a", 1))
    found = similar.groups(spark.createDataFrame(rows, DOCS)).collect()
    root = {r.text_key: r.root for r in found}
    keys = {r.doc_id: r.k for r in spark.createDataFrame(rows, DOCS).select("doc_id", F.xxhash64("text").alias("k")).collect()}
    links = [(i, j) for i in range(0, 300, 20) for j in range(300) if i != j and jaccard(rows[i][1], rows[j][1]) >= 0.8]
    assert links and all(root[keys[i]] == root[keys[j]] for i, j in links)


def test_supplied_pages():
    """The article of a supplied page, read by plain patterns, is what the trees keep: 0.95 of all pages at least."""
    duckdb = pytest.importorskip("duckdb")
    try:
        pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()
    except duckdb.Error:
        pytest.skip("no supplied pages")
    squeeze = lambda t: re.sub(r"\s+", " ", t).strip()
    same = 0
    got = html_text.main_texts([p[0] for p in pages], html_text.model())
    for (source,), text in zip(pages, got, strict=True):
        inner = re.search(r"(?s)<article>(.*)</article>", source)[1]
        blocks = [squeeze(html_text.html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b)))) for b in re.split(r"</?(?:p|h1)>", inner)]
        same += "\n".join(b for b in blocks if b) == text
    assert same >= 0.95 * len(pages)
