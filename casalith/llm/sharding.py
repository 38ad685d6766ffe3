"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Rows lie in blocks. How many rows each block sends to each bin is one draw of a multivariate hypergeometric law, whose
margins are the block sizes and the bin sizes; a local permutation decides which rows go, and after the exchange a second one
decides their order. Shard sizes are therefore exact before any row moves, and no task ever needs a whole shard: a shard is
made of bins with known offsets. The permutations work on keys of rows; whole rows move once, to their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, power_of_two

#: Upper bounds of the matrix. Blocks and bins hold keys of rows (some 30 bytes each), so beyond these they grow without harm.
MOST_BLOCKS, MOST_BINS = 16384, 4096
#: Copies of one row are written out in runs of this many.
RUN = 1 << 16


def even_parts(total: int, parts: int) -> list[int]:
    """total in so many parts whose sizes differ by one at most, larger ones first."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def _uniform(seed: int, *by: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 52)) / F.lit(float(1 << 52))


def hypergeometric(draws: Column, good: Column, population: Column, u: Column) -> Column:
    """The number of good ones among so many draws without return, by inversion of u in [0, 1).

    Probabilities are built up from each other by their ratio, so none needs a factorial. What lies over nine standard
    deviations (and nine) from the mean has no chance in 53 bits and isn't looked at.
    """

    def bounds(v):
        spread = F.sqrt(v.m * (v.k / v.n) * (F.lit(1.0) - v.k / v.n) * ((v.n - v.m) / F.greatest(v.n - 1, F.lit(1.0)))) * 9 + 9
        mean = v.m * v.k / v.n
        low = F.greatest(F.lit(0.0), v.m - (v.n - v.k), F.floor(mean - spread).cast("double"))
        high = F.least(v.m, v.k, F.ceil(mean + spread).cast("double"))
        return F.struct(v.m.alias("m"), v.k.alias("k"), v.n.alias("n"), v.u.alias("u"), low.alias("low"), high.alias("high"))

    def drawn(v):
        steps = F.when(v.high > v.low, F.sequence(v.low.cast("long"), v.high.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
        ratio = lambda x: ((v.k - x) * (v.m - x)) / ((x + 1.0) * (v.n - v.k - v.m + x + 1.0))
        whole = F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("all")),
            lambda s, x: let(s.w * ratio(x.cast("double")), lambda w: F.struct(w.alias("w"), (s["all"] + w).alias("all"))),
            lambda s: s["all"],
        )
        return let(
            whole * v.u,
            lambda goal: F.aggregate(
                steps,
                F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), v.low.cast("long").alias("x")),
                lambda s, x: let(
                    s.w * ratio(x.cast("double")),
                    lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), F.when(s["sum"] <= goal, x + 1).otherwise(s.x).alias("x")),
                ),
                lambda s: s.x,
            ),
        )

    d = lambda c, name: c.cast("double").alias(name)
    given = F.struct(d(draws, "m"), d(good, "k"), d(population, "n"), d(u, "u"))
    return F.when((population <= 0) | (draws <= 0), F.lit(0).cast("long")).otherwise(let(let(given, bounds), drawn))


def _deal(sizes: Column, draws: Column, seed: int, *by: Column) -> Column:
    """A multivariate draw: how many of so many draws fall on each bin; one bin after the other, from what is left."""
    state = F.struct(draws.alias("m"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(
        sizes,
        state,
        lambda s, k: let(
            hypergeometric(s.m, k, s.n, _uniform(seed, F.size(s.out), *by)),
            lambda x: F.struct((s.m - x).alias("m"), (s.n - k).alias("n"), F.concat(s.out, F.array(x)).alias("out")),
        ),
        lambda s: s.out,
    )


def communication_matrix(counts: DataFrame, bins: list[int], blocks: int, seed: int) -> DataFrame:
    """(block, sends array<long>): how many rows each block sends to each bin.

    counts: (block, n) of some or all blocks 0..blocks-1; blocks is a power of two. Halves the blocks again and again: the
    left half's share of every bin is drawn, the right half gets the rest. Each level is one narrow step over a table of
    blocks x bins whole numbers; once there are 64 nodes they are dealt over the cluster.
    """
    spark = counts.sparkSession
    everyone = spark.range(blocks).select(F.col("id").alias("block"))
    filled = everyone.join(counts, "block", "left").select("block", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    level = filled.agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("c")).select(
        F.lit(0).cast("long").alias("node"), F.col("c.n").alias("c"), F.array(*[F.lit(b).cast("long") for b in bins]).alias("sends")
    )
    width, depth = blocks, 0
    while width > 1:
        half = width // 2
        left = F.slice("c", 1, half)
        drawn = _deal(F.col("sends"), F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x), seed + depth, F.col("node"))
        level = level.withColumn("l", drawn)
        node = lambda side, c, sends: F.struct((F.col("node") * 2 + side).alias("node"), c.alias("c"), sends.alias("sends"))
        level = level.select(
            F.inline(
                F.array(
                    node(0, left, F.col("l")),
                    node(1, F.slice("c", half + 1, half), F.zip_with("sends", "l", lambda a, b: a - b)),
                )
            )
        )
        width, depth = half, depth + 1
        if depth == 6:
            level = level.repartition(64, "node")
    return level.select(F.col("node").alias("block"), "sends")


def _copies(keys: DataFrame) -> DataFrame:
    """(__k1, __k2, __copy): a row for each row of keys, copies numbered from 0. Rows alike are counted, never gathered."""
    runs = keys.groupBy("__k1", "__k2").agg(F.count("*").alias("__n")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(RUN).cast("long"))).alias("__from"))
    many = runs.filter(F.col("__n") > RUN).repartition("__k1", "__from")
    each = lambda df: df.select("__k1", "__k2", F.explode(F.sequence("__from", F.least(F.col("__from") + RUN, F.col("__n")) - 1)).alias("__copy"))
    return each(runs.filter(F.col("__n") <= RUN)).unionByName(each(many))


def places(keys: DataFrame, n: int, shards: int, seed: int, rows_a_block: int, rows_a_bin: int) -> DataFrame:
    """(__k1, __k2, shard, slot): a place for each row of keys (__k1, __k2), n in all; rows alike get places each."""
    spark = keys.sparkSession
    blocks = power_of_two(n / rows_a_block, 16, MOST_BLOCKS)
    per = power_of_two(n / shards / rows_a_bin, 4, max(4, MOST_BINS // shards))
    bins = [b for size in even_parts(n, shards) for b in even_parts(size, per)]
    first = [sum(bins[i - i % per : i]) for i in range(len(bins))]
    rows = cut(_copies(keys).withColumn("__block", F.pmod(F.xxhash64(F.lit(seed + 2), "__k1", "__copy"), F.lit(blocks))))
    counts = rows.groupBy(F.col("__block").alias("block")).agg(F.count("*").alias("n"))
    matrix = cut(communication_matrix(counts, bins, blocks, seed + 3))
    here = F.row_number().over(Window.partitionBy("__block").orderBy("__k1", "__k2", "__copy")) - 1
    placed = rows.withColumn("__at", here.cast("long"))
    # row i of the permuted block goes to the last bin that starts at i or before: starts and rows are read in one order
    sends = matrix.select(F.col("block").alias("__block"), F.posexplode("sends").alias("__bin", "__s"))
    starts = sends.withColumn("__at", F.sum("__s").over(Window.partitionBy("__block").orderBy("__bin")) - F.col("__s")).filter("__s > 0")
    nothing = F.lit(None).cast("long")
    both = placed.select("__block", "__at", F.lit(1).alias("__row"), F.lit(None).cast("int").alias("__bin"), "__k1", "__k2", "__copy").unionByName(
        starts.select("__block", "__at", F.lit(0).alias("__row"), "__bin", nothing.alias("__k1"), nothing.alias("__k2"), nothing.alias("__copy"))
    )
    bin_ = F.last("__bin", ignorenulls=True).over(Window.partitionBy("__block").orderBy("__at", "__row"))
    sent = both.withColumn("__to", bin_).filter("__row = 1").select(F.col("__to").alias("__bin"), "__k1", "__k2", "__copy")
    there = F.row_number().over(Window.partitionBy("__bin").orderBy(F.xxhash64(F.lit(seed + 4), "__k2", "__copy"), "__k1", "__k2", "__copy")) - 1
    base = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in first])).alias("__bin", "__first"))
    sent = sent.withColumn("slot", there.cast("long")).join(F.broadcast(base), "__bin")
    return sent.select("__k1", "__k2", F.floor(F.col("__bin") / per).cast("int").alias("shard"), (F.col("slot") + F.col("__first")).alias("slot"))


def shuffle_to_shards(docs: DataFrame, shards: int = 8, seed: int = 7, rows_a_block: int = 4096, rows_a_bin: int = 50_000) -> DataFrame:
    """docs with shard (int, 0 to shards-1) and slot (long, gapless from 0 in each shard), shuffled uniformly.

    Shard sizes differ by one at most. The keys of the permutations are two hashes of whole rows (128 bits), so a task that runs
    again makes the same choice, and a rerun over the same rows agrees; rows that are alike in every column are exchangeable.
    Nulls in any column, empty tables, repeated rows and long texts need no special case. Columns of docs named shard or slot
    are replaced.
    """
    docs = docs.drop("shard", "slot")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*cols).alias("row"), F.xxhash64(F.lit(seed), *cols).alias("__k1"), F.xxhash64(F.lit(seed + 1), *cols).alias("__k2"))
    keys = cut(keyed.select("__k1", "__k2"))
    found = places(keys, keys.count(), shards, seed, rows_a_block, rows_a_bin)
    # rows alike in all columns stand for each other: one of them meets all of their places, and a key with many is split by AQE
    return found.join(keyed.dropDuplicates(["__k1", "__k2"]), ["__k1", "__k2"]).select("row.*", "shard", "slot")


def op8(docs: DataFrame) -> DataFrame:
    """The contract's columns: the operator runs over what they need, so whole texts are never exchanged."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_to_shards(narrow).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
