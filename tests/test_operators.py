"""Small cases with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casalith.functions import selectors as S
from casalith.functions import text as T
from casalith.functions import web as W
from casalith.operators import coverage as C
from casalith.operators import graph as G
from casalith.operators import lineage as L
from casalith.operators import resolve as R
from casalith.operators import results as RS
from casalith.operators import search as SE
from casalith.operators import vectors as V
from casalith.sources import extract as E
from casalith.sources import tabular as TB


def values(spark, column, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_query_parser():
    p = T.parse_query
    assert p("acme holdings").positives == (("acme",), ("holdings",))
    assert p("press@acme.example").positives == (("press", "acme", "example"),)
    assert p("acme -holdings").negatives == (("holdings",),)
    assert p("well-known").positives == (("well", "known"),)
    assert p("").empty and p("!!! ???").empty and p("-acme").empty
    assert p("acme hold", True).prefix_last and not p('acme "holdings ltd"', True).prefix_last
    assert p('"open phrase').positives == (("open", "phrase"),)


def test_fold_and_search(spark):
    rows = [("entity", "1", "Jürgen Müller", "Jürgen Müller head", "person", False), ("entity", "2", "Other", "nobody", "person", False), ("entity", "3", "", "muller old", "person", True)]
    ix = SE.index(spark.createDataFrame(rows, "subject_kind string, subject_id string, title string, body string, facet string, superseded boolean"))
    for q in ("muller", "Müller"):
        assert [r.subject_id for r in SE.search(ix, q).collect()] == ["1"]
    assert SE.search(ix, "-muller").count() == 0
    assert {r.subject_id for r in SE.match(ix, '"jurgen muller"').collect()} == {"1"}
    assert SE.match(ix, '"muller jurgen"').count() == 0


def test_counts_equal_lists(spark):
    rows = [("entity", str(i), "acme", f"acme {i}", "person" if i % 2 else "org", False) for i in range(9)]
    ix = SE.index(spark.createDataFrame(rows, "subject_kind string, subject_id string, title string, body string, facet string, superseded boolean"))
    merges = spark.createDataFrame([("1", "0"), ("2", "0")], "entity_id string, canonical_id string")
    ranked = SE.hydrate(ix, SE.rank(ix, "acme")).select("subject_kind", "subject_id", "facet", "relevance")
    found = SE.collapse(ranked, merges)
    n = found.count()
    assert n == 7 and SE.count(found).first()[0] == n == sum(r.n for r in SE.facet_counts(found).collect())
    none = SE.collapse(ranked, merges.limit(0))
    assert none.count() == 9


def test_selectors(spark):
    assert values(spark, S.email, ["Kim.Ode@Mail.TEST.net", "q@w", "x..y@test.net", None]) == ["Kim.Ode@mail.test.net", None, None, None]
    assert values(spark, S.phone, ["+49 (30) 901.820-0", "901 820", "+0499018200"]) == ["+49309018200", None, None]
    assert values(spark, S.domain, ["Example.ORG.", "a.local", "1.2.3.4", "-a.org"]) == ["example.org", None, None, None]
    assert values(spark, S.ipv4, ["192.0.2.1", "192.0.2.01", "256.1.1.1"]) == ["192.0.2.1", None, None]


def test_urls(spark):
    urls = ["https://e.org/article?id=7&utm_source=twitter&fbclid=abc123", "https://e.org/?b=2&a=1", "https://E.org:443/x", "https://e.org:8443/x#y", "http://e.org", "nonsense"]
    assert values(spark, W.canonical_url, urls) == ["https://e.org/article?id=7", "https://e.org/?a=1&b=2", "https://e.org/x", "https://e.org:8443/x", "http://e.org/", None]
    assert values(spark, W.address_class, ["127.0.0.1", "169.254.169.254", "10.1.1.1", "100.64.0.1", "0.1.2.3", "8.8.8.8", "x"]) == ["loopback", "link_local", "private", "carrier_nat", "not_global", "public", None]
    assert values(spark, W.mail_recipient, ["mailto:first@example.org,second@example.org?subject=x", "mailto:", "mailto:none"]) == ["first@example.org", None, None]


def test_cells_and_globs(spark):
    assert values(spark, W.spreadsheet_cell, ['a,"b"', ' \t=HYPERLINK("x")', "ordinary"]) == ['"a,""b"""', '"\' \t=HYPERLINK(""x"")"', '"ordinary"']
    for glob, text, hit in (("B?ta", "Beta", True), ("b?ta", "Beta", False), ("[A-C]*", "Box", True), ("[^A]*", "Ax", False)):
        assert values(spark, lambda v, g=glob: v.rlike(W.glob_pattern(g)), [text]) == [hit]


def test_dates(spark):
    days = ["1900-02-29", "0000-01-01", "2024-04-31", "2024-02-29", "2000-02-29"]
    assert values(spark, RS.calendar_date, days) == [None, None, None, "2024-02-29", "2000-02-29"]


def test_coverage_ties(spark):
    arts = spark.createDataFrame([("a",)], "artifact_id string")
    runs = spark.createDataFrame([("zzzz-earlier", "a", "succeeded", "t", 1), ("aaaa-later", "a", "succeeded", "t", 2)], "run_id string, artifact_id string, status string, started_utc string, row_seq long")
    gaps = spark.createDataFrame([("zzzz-earlier", "truncated", 1, "rows")], "run_id string, gap_kind string, magnitude int, unit string")
    s = C.summary(arts, runs, gaps).first()
    assert (s.complete, s.partial, s.is_complete) == (1, 0, True)
    assert C.summary(arts.limit(0), runs.limit(0), gaps.limit(0)).first().is_complete


def test_identifier(spark):
    df = spark.createDataFrame([("email_address", " Desk@News.TEST "), ("other", " X ")], "n string, v string")
    assert [r[0] for r in df.select(R.normalise_identifier(F.col("n"), F.col("v"))).collect()] == ["Desk@news.test", "X"]


def test_expand(spark):
    edges = spark.createDataFrame([("e", "A", "B", "knows", 1)], "id string, from_entity string, to_entity string, kind string, row_seq long")
    seeds = spark.createDataFrame([("A",), ("B",)], "node string")
    nodes, inside, why = G.expand(seeds, edges, hops=2, kinds=["knows"])
    assert (nodes.count(), inside.count(), why) == (2, 1, [])
    nodes, inside, _ = G.expand(seeds.filter("node = 'A'"), edges, direction="in")
    assert nodes.count() == 1


def test_complete_link_has_no_chaining(spark):
    v = [[math.cos(a), math.sin(a)] for a in (0, 0.8, 1.6)]
    items = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "left_id long, right_id long")
    assert {(r.vec_id, r.group_id) for r in V.complete_link(items, pairs, 0.5).collect()} == {(0, 0), (1, 0)}


def test_tables():
    assert TB.parse_delimited('who,where\n"Ode, Kim",Room 7\n\n"say ""hi""",here\n') == (["who", "where"], [["Ode, Kim", "Room 7"], ['say "hi"', "here"]], [])
    assert TB.parse_json('[{"left":1},{"right":[2]}]') == (["left", "right"], [["1", ""], ["", "[2]"]])
    with pytest.raises(ValueError):
        TB.parse_json('[{"a":1},[2]]')
    with pytest.raises(ValueError):
        TB.mapped(["a", "b"], "email")


def test_extraction():
    found = E.read_html('<title>T  x</title><meta property="og:title" content="O"><a href="https://acme.example/">x</a><a href="mailto:press@acme.example">m</a><script><a href=/no></script><p>Acme</p><p>Holdings</p>')
    assert ("page.title", "T x") in found and ("meta:og:title", "O") in found and ("domain.mention", "acme.example") in found and ("email.address", "press@acme.example") in found
    assert found[-1] == ("page.text", "x m Acme Holdings")
    assert E.read_json('{"a/b":{"~key":["literal <script>",1,true,null]}}')[0] == ("/a~1b/~0key/0", "literal <script>")


def test_chain_and_bucket(spark):
    rows = spark.createDataFrame([("k", 0.0, 1), ("k", 0.0, 2), ("k", 0.1, 3), ("k", 1.2, 4)], "key string, at double, seq long")
    assert [r.allowed for r in L.token_bucket(rows, 2, 1).orderBy("seq").collect()] == [True, True, False, True]


def test_perceptual_hash():
    flat = np.zeros((32, 32))
    flat[:, 16:] = 255
    assert V.perceptual_hash(flat) == V.perceptual_hash(flat * 0.5)


def test_wallets():
    from casalith.functions.wallet import keccak256, normalise_wallet

    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    good = "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"
    assert normalise_wallet(good.lower()) == good and normalise_wallet(good[:-1] + "D") is None
    assert normalise_wallet("BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4") == "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"
    assert normalise_wallet("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa") and normalise_wallet("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb") is None


def test_index_is_maintained(spark, tmp_path):
    from casalith.streaming import index as I

    schema = "subject_id string, body string"
    for i, body in enumerate(("one two two", "two three")):
        spark.createDataFrame([(str(i), body)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    I.maintain(stream, str(tmp_path / "out"), str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.token, r.subject_id): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("one", "0"): 1, ("two", "0"): 2, ("two", "1"): 1, ("three", "1"): 1}
