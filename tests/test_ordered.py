"""Running sums, numbers and joined ranges against loops, with one group that spans many ranges, nulls and no rows."""

import random

from pyspark.sql import functions as F

from casalith.operators import ordered as O
from casalith.operators import reads as R
from casalith.operators import vectors as V
from casalith.sources import tabular as T


def table(spark, n=600):
    draw = random.Random(5)
    rows = [(draw.choice(["hot"] * 6 + ["cold", None]), i, draw.choice([None, draw.randint(-9, 9)])) for i in range(n)]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, i long, v long").repartition(7)


def test_sums_and_maxima(spark):
    rows, df = table(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = O.dealt(df, ["g"], [F.desc("i")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert d.filter("g = 'hot'").select("__range").distinct().count() > 1
    for fold, start, step, before in ((F.sum, 0, lambda a, v: a + v, False), (F.max, None, lambda a, v: v if a is None else max(a, v), True)):
        want = {}
        for g in ("hot", "cold", None):
            total = start
            for _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]):
                after = total if v is None else step(total, v)
                want[i] = total if before else after
                total = after
        got = O.running(d, ["g"], [F.desc("i")], F.col("v"), "x", fold, before)
        assert got.columns == ["g", "i", "v", "__range", "x"] and {r.i: r.x for r in got.collect()} == want
    assert O.numbered(df.limit(0), ["g"], ["i"], "n").count() == 0


def test_round_robin(spark):
    rows, df = table(spark, 200)
    want, left = [], {g: sorted(i for h, i, _ in rows if h == g) for g in (None, "cold", "hot")}
    while any(left.values()):
        want += [left[g].pop(0) for g in left if left[g]]
    got = V.round_robin(df, "g", ["i"])
    assert [r.i for r in got.orderBy("place").collect()] == want and sorted(r.place for r in got.collect()) == list(range(1, 201))


def test_nearest_rank(spark):
    values = [random.Random(7).randint(0, 40) for _ in range(301)]
    got = {r.percent: r.value for r in R.nearest_rank(spark.createDataFrame([(v,) for v in [*values, None]], "v int"), "v").collect()}
    assert got == {p: sorted(values)[300 * p // 100] for p in (50, 95, 99)}
    assert R.nearest_rank(spark.createDataFrame([], "v int"), "v").count() == 0


def test_joined_ranges(spark):
    draw = random.Random(9)
    rows = [(draw.choice("aab"), draw.randint(0, 4000), draw.choice([0, 5, 5, 60])) for _ in range(400)]
    want = []
    for source in "ab":
        mine = sorted(r[1:] for r in rows if r[0] == source)
        for start, size in mine:
            if not want or want[-1][0] != source or start > want[-1][2] + 3:
                want.append([source, start, start + size, 1])
            else:
                want[-1][2], want[-1][3] = max(want[-1][2], start + size), want[-1][3] + 1
    got = T.coalesced_ranges(spark.createDataFrame(rows, "source string, start long, size long"), 3)
    assert sorted([list(r) for r in got.select("source", "first", "last", "pieces").collect()]) == sorted(want)
