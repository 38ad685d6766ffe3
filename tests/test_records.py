"""Recipes, snapshots, reports, restored packages, scales, buckets and previews: small cases with known results."""

import hashlib
import random
import uuid

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casalith.operators import checks as K
from casalith.operators import exports as X
from casalith.operators import lineage as L
from casalith.operators import reads as R
from casalith.operators import stored
from casalith.plans import lineage_plans as LP
from casalith.plans import scalar_plans as SP
from casalith.sources import extract as E
from casalith.sources import registry as G
from casalith.sources import tabular as T


def test_profiles(spark):
    rows = [
        ("github", "Ann", 200, None, '{"login":"aNN","id":12}', "found"),
        ("github", "Ann", 200, None, '{"login":"Ann","id":1.5}', "unknown"),
        ("github", "Ann", 200, True, '{"login":"Ann","id":12}', "unknown"),
        ("github", "Ann", 404, False, '{"message":"Not Found [x]"}', "unknown"),
        ("codeberg", "Ann", 404, False, '{"message":"The user does not exist [x]"}', "not_found"),
        ("hackernews", "Ann", 200, False, '{"id":"ann"}', "unknown"),
        ("hackernews", "Ann", 200, False, "null", "not_found"),
        ("hackernews", "Ann", 200, False, None, "unknown"),
        ("hackernews", None, 200, False, '{"id":"ann"}', "unknown"),
        ("github", "Ann", 429, False, "", "blocked"),
        ("github", "Ann", 502, False, "<html>", "error"),
        ("github", "Ann", None, False, "{}", "unknown"),
        ("github", "Ann", 200, False, '{"login":"Ann","id":12,"bio":"' + "x" * 2_100_000 + '"}', "unknown"),
        (None, "Ann", 200, False, "{}", "unknown"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, source string, username string, status int, redirected boolean, body string, want string")
    got = G.profile_outcomes(df).orderBy("n").collect()
    assert [r.outcome for r in got] == [r[-1] for r in rows]
    assert got[0].url == "https://github.com/Ann" and all(r.url is None for r in got[1:])


def test_registry(spark):
    rows = G.sources(spark).collect()
    assert len({r.source for r in rows}) == len(rows) == 16 and {r.delivery for r in rows} == {"native", "provider_backed", "manual_workflow"}
    asked = G.choices(spark.createDataFrame([("domain", 1), ("phone", 2), (None, 3)], "kind string, n int"))
    assert sorted((r.n, r.source) for r in asked.collect()) == [(1, "crt_sh"), (1, "dns"), (1, "rdap"), (1, "wayback")]


def test_snapshots(spark):
    one = [("ocr.line", "p1", "a"), ("page.text", "p2", None)]
    snapshots = spark.createDataFrame([("x", "h", "old", 1, []), ("x", "h", "new", 2, one)], "artifact_id string, snapshot_hash string, engine string, row_seq int, observations array<struct<kind:string,locator:string,value:string>>")
    cited = [("h", 0, "p1", "a", "agrees"), ("h", 1, "p2", None, "agrees"), ("h", 1, "p2", "", "differs"), ("h", 0, "p9", "a", "differs"), ("h", 2, "p1", "a", "out_of_range"), ("g", 0, "p1", "a", "unavailable"), (None, 0, "p1", "a", "uncited"), ("h", None, "p1", "a", "uncited")]
    df = spark.createDataFrame([("x", *c) for c in cited], "artifact_id string, snapshot_hash string, snapshot_index int, locator string, value string, want string")
    got = L.snapshot_agreement(df, snapshots).collect()
    assert len(got) == len(cited) and all(r.verdict == r.want for r in got)
    assert {r.basis for r in got} == {None, "recorded words of new", "recorded transformation of new"}
    assert L.snapshot_agreement(df.limit(0), snapshots).count() == 0


def test_report_document(spark):
    findings = spark.createDataFrame([(1, 2, "b<"), (2, 1, None)], "finding_id int, position int, heading string")
    bodies = spark.createDataFrame([(1, "x & *y*")], "finding_id int, body string")
    assert L.report_document(findings, bodies).first()[0] == "## \n\n\n\n## b&lt;\n\nx &amp; \\*y\\*\n"
    page = L.report_document(findings, bodies, "html").first()[0]
    assert page == L.HTML_HEAD + "<section><h2></h2><pre></pre></section><section><h2>b&lt;</h2><pre>x &amp; *y*</pre></section></body></html>"
    for bound in ({"most": 1}, {"most_bytes": 10}):
        with pytest.raises(ValueError):
            L.report_document(findings, bodies, **bound)


def test_restore(spark):
    path = lambda: f"{stored.shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b""))], "name string, content binary")
    row = lambda n, b: (n, hashlib.sha256(b).hexdigest(), len(b))
    claims = lambda *rows: spark.createDataFrame(rows, "name string, hash string, size long")
    there = path()
    assert {bytes(r.content) for r in X.restore(claims(row("a", b"x"), row("b", b"")), files, there).collect()} == {b"x", b""}
    with pytest.raises(FileExistsError):
        X.publish(files, there)
    for wrong, said in ((claims(row("a", b"y"), row("b", b"")), "1 mismatch"), (claims(row("a", b"x")), "1 unclaimed"), (claims(row("a", b"x"), row("b", b""), row("c", b"")), "1 absent")):
        gone = path()
        with pytest.raises(ValueError, match=said):
            X.restore(wrong, files, gone)
        X.publish(files, gone)  # nothing was left there


def test_scales(spark):
    offered = spark.createDataFrame([("s", 1, "insufficient_information"), ("s", 2, "insufficient_information"), ("s", 2, "low")], "scale_id string, version int, value_key string")
    held = spark.createDataFrame([("s", 1)], "scale_id string, version int")
    assert {(r.version, r.value_key) for r in K.scales_to_seed(offered, held).collect()} == {(2, "insufficient_information"), (2, "low")}
    with pytest.raises(ValueError):
        K.scales_to_seed(offered.filter("value_key = 'low'"), held)


def test_places_and_keys(spark):
    places = spark.createDataFrame([("Old Town", None, 86.0), (None, "town hall", -85.0), ("x", "y", 1.0), ("town", "", None)], "label string, uncertainty string, latitude double")
    assert sorted(r.mapped for r in R.on_map(places, "TOWN").collect()) == [False, False, True]
    plan = '{"parent":{"id":"i"},"selectors":[{"kind":"k","normalized":"a"},{"kind":"k","normalized":"a"}]}'
    runs = spark.createDataFrame([(plan,), (plan.replace('"i"', '"j"'),), ("{",), (None,), ('{"parent":{"id":"i"}}',)], "plan string")
    assert [tuple(r) for r in R.submitted_keys(runs, "i").collect()] == [("k", "a")]


def test_bucket_streams_keys(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, round(draw.random() * 20, 1)]), i) for i in range(400)]
    want, keys = {}, {r[0] for r in rows}
    for key in keys:
        tokens, last = 3.0, None
        for _, at, seq in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            if at is not None:
                tokens, last = min(3.0, tokens + (0 if last is None else at - last) * 0.5), at
            want[seq] = tokens >= 1
            tokens -= want[seq]
    got = L.token_bucket(spark.createDataFrame(rows, "key string, at double, seq long"), 3, 0.5)
    assert {r.seq: r.allowed for r in got.collect()} == want


def test_preview_of_a_large_artifact(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("artifact_id"), F.col("id").alias("row_seq"), F.when(F.col("id") % 7 != 0, F.repeat(F.lit("é"), (F.col("id") % 5).cast("int"))).alias("value"))
    all_rows = {a: sorted((r.row_seq, len((r.value or "").encode())) for r in rows.filter(F.col("artifact_id") == a).collect()) for a in (0, 1)}
    for most_bytes, most_rows in ((900, 10_000), (10**6, 400)):
        want = set()
        for found in all_rows.values():
            total = 0
            for seq, size in found[:most_rows]:
                total += size
                if total <= most_bytes:
                    want.add((seq, total))
        assert {(r.row_seq, r.total) for r in L.preview(rows, most_bytes, most_rows, 8).collect()} == want


def test_preview_counts_what_exceeds_it(spark):
    values = [(a, i, "x" * n) for a, sizes in enumerate([[90, 5, 5, 5, 5, 5], [3, 90, 5, 5, 5, 5], [3, 4, 90, 1, 1, 1], [1] * 30]) for i, n in enumerate(sizes)] + [(4, i // 3, "yy") for i in range(12)]
    rows = spark.createDataFrame(values, "artifact_id int, row_seq long, value string")
    got = sorted((r.artifact_id, r.row_seq, r.total) for r in L.preview(rows, 20, 4, 8).collect())
    assert got == [(1, 0, 3), (2, 0, 3), (2, 1, 7), *((3, i, i + 1) for i in range(4)), *((4, 0, 6),) * 3, (4, 1, 12)]


def test_origins(spark):
    rows = [("a", "x", 3), ("a", "y", 1), ("a", "x", 0), ("a", None, -1), ("a", "z", 1), (None, "x", 1), ("b", None, 2)]
    got = T.with_origins(spark.createDataFrame(rows, "v string, origin string, at int"), ["v"], "origin", "at", 2)
    assert {r.v: (r.repeats, r.origins) for r in got.collect()} == {"a": (5, ["x", "y"]), None: (1, ["x"]), "b": (1, [])}


def test_titles_of_every_page(spark, tmp_path):
    odd = ["<title>a &amp;&amp</title>", "<title>b&lt &gt;&nosuch;&amp;lt;</title><a href=\"/x?a=1&amp;b&amp\">x</a><svg><title>z</title></svg>", "<p>none</p>", "", None, "<title>&notit; x\n y </title>", "<title>\u00a0&quot;q&quot; &#65;\u00a0 </title>"]
    rows = spark.createDataFrame(list(enumerate(odd)), "page_id long, html string")
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.title, r.links) for r in LP.QUERIES["html_title_links"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {r[0]: r[1:] for r in con.sql(LP.SQL["html_title_links"]).fetchall()}
    assert [v for k, v in E.read_html(odd[1]) if k in ("page.title", "link.href")] == ["b&lt >&nosuch;&lt;", "/x?a=1&b&amp"]
    assert E.read_html("<title>&quot;&#65;&eacute;&notit;</title>")[0] == ("page.title", "\"A\u00e9&notit;")


def test_address_classes_of_long_keys(spark, tmp_path):
    keys = [10**n + i for n in (0, 3, 4, 5, 7, 8, 12, 17) for i in range(10)]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = SP.QUERIES["ip_guard_v6"](spark, str(tmp_path)).select("c_custkey", "class").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(SP.SQL["ip_guard_v6"]).select("c_custkey", "class").fetchall()))


def test_quotes_of_short_texts(spark, tmp_path):
    texts = ["", None, "a", "ab", "é", "\U0001f600\U0001f600\U0001f600\U0001f600\U0001f600", "abcde", "abcdef", '"', '""', "é" * 80]
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)] + [(4 * len(texts) + 2, "x" * 10_000_001)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.doc_id: r.verdict for r in LP.QUERIES["lineage_quote_check"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got == dict(con.sql(LP.SQL["lineage_quote_check"]).fetchall())


def test_reports_hold_all_citations(spark):
    findings = spark.createDataFrame([(1, "one"), (2, "two")], "finding_id long, title string")
    citations = spark.createDataFrame([(1, i, i) for i in range(250)], "finding_id long, position long, subject_id long")
    subjects = citations.filter("subject_id % 3 > 0").select("subject_id", F.concat(F.lit("s"), "subject_id").alias("label"))
    got = {r.finding_id: r.body for r in L.report(findings, citations, subjects).collect()}
    assert got == {1: "\n".join(["## one", *(f"- s{i}" if i % 3 else "- [not available]" for i in range(250))]), 2: "## two"}


def test_pages_that_the_parser_refused(spark, tmp_path, monkeypatch):
    rest = "<title>a</title><a href=\"/x\">x</a>"
    broken = ["<title>a<![x]>b</title>", "<title>a<![</title><title>b</title><![<a href=\"/x\">"]
    odd = [f"{mark}{rest}{end}" for mark in ("<![", "<![x]>", "<![ x", "<![1]>", "<![endif]-->", "<![x", "<![CDATA[") for end in ("", "<p>y]></p>", mark)] + [f"{rest}<![x>"]
    spark.createDataFrame(list(enumerate(odd + broken)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.title, r.links) for r in LP.QUERIES["html_title_links"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {r[0]: r[1:] for r in con.sql(LP.SQL["html_title_links"]).fetchall()} == dict(enumerate([("a", 1)] * len(odd) + [("", 0), ("b", 1)]))
    assert E.read_html(broken[0]) == [("page.title", "ab")]
    assert E.read_html("<p>a</p><![x]>b<![ c <i>d</i><![CDATA[e < f]]>")[-1] == ("page.text", "a b d")
    assert E.read_html(f"<p>&#{'9' * 5000};&#{'0' * 5000}65;&#x{'F' * 5000};&#X00041;&#0;</p>") == [("page.text", "\ufffdA\ufffdA\ufffd")]

    failed = spark.createDataFrame([(3, None, None, None, "no reading")], "page_id long, row_seq long, kind string, value string, error string")
    monkeypatch.setattr(E, "html_observations", lambda pages, **options: failed)
    with pytest.raises(PySparkException, match="page 3 no reading"):
        LP.QUERIES["html_title_links"](spark, str(tmp_path)).collect()
