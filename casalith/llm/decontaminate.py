"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

A window that is at all similar to an item shares a shingle with it. So the windows looked at are those that such a shared
shingle lines up with an item, at every place where one occurs; all others have similarity 0. Each window and item gets a
fingerprint. Fingerprints of 64 bits, cut into radius + 1 blocks, agree in one block at least if they differ in radius bits at
most: pairs that agree in none go, and so do those over the radius; no pair within it is lost. What is left is compared shingle
by shingle. At a similarity of 0.8 fingerprints differ in some 10 bits and up to 18, for which blocks have 3 or 4 bits and tell
little apart on their own; the items that a window is paired with are therefore only those that a shingle lines up with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

#: So many shingles of the benchmark are broadcast at most (a row has some 40 bytes); a larger benchmark is taken in blocks.
MOST_BROADCAST_ROWS = 400_000
WORDS = r"[\p{L}\p{N}]+"


def shingle_hashes(text: Column, n: int = 5) -> Column:
    """array<long>: hashes of all n-word shingles of the lower-cased text, in order; of fewer words: of the whole sequence; of none: empty."""

    def hashed(w):
        at = F.sequence(F.lit(0), F.size(w) - n)
        whole = F.array(F.xxhash64(F.size(w), F.array_join(w, " ")))
        none = F.array().cast("array<long>")
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.xxhash64(*[w[i + j] for j in range(n)]))).when(F.size(w) > 0, whole).otherwise(none)

    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0)), hashed)


def simhash(hashes: str) -> Column:
    """64-bit fingerprint of a column of hashes: a bit is set if more than half of the hashes have it."""
    ones = f"aggregate({hashes}, 0, (a, x) -> a + cast(shiftright(x, b) & 1L AS int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L))")


def hamming_blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of radius + 1 blocks that cover 64 bits."""
    n = radius + 1
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def item_table(benchmark: DataFrame, n: int = 5) -> DataFrame:
    """(item_id, size, bag array<struct<sh, w, c>>, total, plain, hashes, fingerprint): one row per item with a shingle.

    w = ln(1 + items / items that have the shingle). size counts shingles.
    """
    rows = benchmark.select("item_id", shingle_hashes(F.col("text"), n).alias("hashes")).filter(F.size("hashes") > 0)
    count = rows.agg(F.count("*").alias("items"))
    each = rows.select("item_id", F.explode("hashes").alias("sh")).groupBy("item_id", "sh").agg(F.count("*").alias("c"))
    spread = each.groupBy("sh").agg(F.count("*").alias("df"))
    weighed = each.join(spread, "sh").join(F.broadcast(count)).withColumn("w", F.log(1 + F.col("items") / F.col("df")))
    bags = weighed.groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("sh", "w", "c"))).alias("bag"), F.first(F.log(1.0 + F.col("items"))).alias("plain")
    )
    total = F.aggregate("bag", F.lit(0.0), lambda a, x: a + x.w * x.c)
    return rows.join(bags, "item_id").select("item_id", F.size("hashes").alias("size"), "bag", total.alias("total"), "plain", "hashes", simhash("hashes").alias("fingerprint"))


def _windows(docs: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_key, start_word, window, item_id): a row for each place where a shingle lines a document up with an item."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), shingle_hashes(F.col("text"), n).alias("h"), F.least(words, F.lit(n)).alias("few")).filter(F.size("h") > 0)
    # the join is broadcast, so a document's hashes stay where they are until the windows are cut from them
    at = hashed.select("doc_id", "text_key", "h", "few", F.posexplode("h").alias("pos", "sh")).join(F.broadcast(anchors), "sh").select("*", F.explode("places").alias("p"))
    start = F.greatest(F.col("pos") - F.col("p.item_pos"), F.lit(0))
    end = F.least(F.col("pos") - F.col("p.item_pos") + F.col("p.size"), F.size("h"))
    return at.select("doc_id", "text_key", "few", start.alias("start_word"), F.slice("h", start + 1, end - start).alias("window"), "p.item_id")


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 18, n: int = 5, block: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_key, item_id, start_word, n_words, hamming, similarity): each document and item alike, by its best window.

    Similarity is the weighted Jaccard of shingle bags; shingles that the item lacks weigh as one that a single item has. An item,
    or a text, of fewer than n words is one shingle, its whole sequence, so such an item matches texts of just its words. Items and
    texts without words match nothing, and so do null ones. Rows alike in doc_id and text give one result. Of windows that are
    equally similar the first counts. Extra columns are ignored.

    A benchmark with more than `block` shingles is taken in blocks of so many, each broadcast to a pass over docs.
    """
    spark = docs.sparkSession
    items = cut(item_table(benchmark, n))
    shingles = items.select("item_id", "size", F.posexplode("hashes").alias("item_pos", "sh"))
    blocks = max(1, -(-shingles.count() // block))
    found = None
    for i in range(blocks):
        # a shingle's places all lie in one block
        some = shingles if blocks == 1 else shingles.filter(F.pmod(F.xxhash64("sh"), F.lit(blocks)) == i)
        one = _windows(docs, some.groupBy("sh").agg(F.collect_list(F.struct("item_id", "item_pos", "size")).alias("places")), n)
        found = one if found is None else found.unionByName(one)
    # clipped windows of other raw starts may share a start: both count
    key = ["doc_id", "text_key", "start_word", "size", "item_id"]
    pairs = found.withColumn("size", F.size("window")).groupBy(*key).agg(F.max("window").alias("window"), F.max("few").alias("few"))
    # as many tasks as the session has partitions: the few bytes of windows take long to compare
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).drop("size")
    pairs = pairs.withColumn("f", F.coalesce(simhash("window"), F.lit(0).cast("long"))).join(items.select("item_id", "bag", "total", "plain", "fingerprint"), "item_id")
    x = F.col("f").bitwiseXOR(F.col("fingerprint"))
    agree = F.lit(False)
    for at, width in hamming_blocks(radius):
        agree = agree | (F.shiftright(x, at).bitwiseAND((1 << width) - 1) == 0)
    pairs = pairs.filter(agree).withColumn("hamming", F.bit_count(x)).filter(F.col("hamming") <= radius)
    shared = F.transform("bag", lambda s: F.struct(s.w.alias("w"), s.c.alias("c"), F.size(F.filter("window", lambda y: y == s.sh)).alias("in")))
    pairs = pairs.withColumn("shared", shared)
    both = F.aggregate("shared", F.lit(0.0), lambda a, s: a + s.w * F.least(s.c, s["in"].cast("long")))
    known = F.aggregate("shared", F.lit(0.0), lambda a, s: a + s.w * s["in"])
    other = F.col("plain") * (F.size("window") - F.aggregate("shared", F.lit(0), lambda a, s: a + s["in"]))
    pairs = pairs.withColumns({"both": both, "either": F.col("total") + known + other})
    pairs = pairs.withColumn("similarity", F.round(F.col("both") / (F.col("either") - F.col("both")), 6)).filter(F.col("similarity") >= least)
    best = pairs.groupBy("doc_id", "text_key", "item_id").agg(
        F.min_by(
            F.struct("start_word", (F.size("window") + F.col("few") - 1).alias("n_words"), "hamming", "similarity"), F.struct(-F.col("similarity"), F.col("start_word"), F.size("window"))
        ).alias("b")
    )
    return best.select("doc_id", "text_key", "item_id", "b.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold an item of the benchmark; all other rows as they are."""
    bad = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__d"]) & (F.xxhash64(docs["text"]) == bad["__t"]), "left_anti")


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark).select("doc_id", "item_id", "start_word", "n_words", "similarity")


#: The same result by plain joins: all windows that a shared shingle lines up, no fingerprints.
OP4_SQL = r"""
WITH dw AS (
  SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
d AS (SELECT doc_id, hash(text) AS t, greatest(len(w) - 4, 1) AS n, least(len(w), 5) AS few, unnest(range(greatest(len(w) - 4, 1))) AS pos, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS sh
      FROM dw WHERE len(w) > 0),
i AS (SELECT item_id, greatest(len(w) - 4, 1) AS size, unnest(range(greatest(len(w) - 4, 1))) AS pos, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS sh
      FROM iw WHERE len(w) > 0),
bag AS (SELECT item_id, any_value(size) AS size, sh, count(*) AS c FROM i GROUP BY item_id, sh),
n AS (SELECT count(DISTINCT item_id) AS items FROM i),
w AS (SELECT sh, ln(1 + (SELECT items FROM n) / count(*)) AS w FROM bag GROUP BY sh),
total AS (SELECT item_id, sum(w * c) AS total FROM bag JOIN w USING (sh) GROUP BY item_id),
win AS (
  SELECT DISTINCT doc_id, t, n, few, item_id, size, greatest(d.pos - i.pos, 0) AS a, least(d.pos - i.pos + size, n) AS b FROM d JOIN i USING (sh)),
inside AS (
  SELECT win.doc_id, win.t, win.few, win.item_id, a, b, bag.sh, w.w, bag.c, count(*) AS k
  FROM win JOIN d ON d.doc_id IS NOT DISTINCT FROM win.doc_id AND d.t = win.t AND d.pos >= a AND d.pos < b
  JOIN bag ON bag.item_id = win.item_id AND bag.sh = d.sh JOIN w ON w.sh = bag.sh
  GROUP BY ALL),
score AS (
  SELECT doc_id, t, few, item_id, a, b, sum(w * least(c, k)) AS shared, sum(w * k) AS known, sum(k) AS ks FROM inside GROUP BY ALL),
sim AS (
  SELECT doc_id, t, few, item_id, a, b, round(shared / (total + known + ln(1 + (SELECT items FROM n)) * (b - a - ks) - shared), 6) AS similarity
  FROM score JOIN total USING (item_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t, item_id ORDER BY similarity DESC, a) AS r FROM sim WHERE similarity >= 0.8)
SELECT doc_id, item_id, a::INT AS start_word, (b - a + few - 1)::INT AS n_words, similarity FROM best WHERE r = 1
"""
