"""Connected components of a graph of links, by alternating large and small stars. No link or label leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of a link with the least node that it reaches. links: (a, b) long, in any order and as often.

    Each round halves what is left of paths; every round's links are written to the shared folder, which cuts the lineage.
    An empty table gives an empty table; links with a null end and loops say nothing.
    """
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    last = state(now)
    while last[0]:
        now = cut(_small(_large(now)))
        here = state(now)
        if here == last:
            break
        last = here
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
