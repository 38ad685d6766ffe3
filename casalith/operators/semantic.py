"""Semantic and hybrid search: nearest observations, the subjects linked to them, fused with lexical ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The constant of rank fusion, and how many hits of either side count.
K, MOST_NEAR, MOST_LEXICAL = 60, 1000, 200


def semantic(near: DataFrame, links: DataFrame, merges: DataFrame) -> DataFrame:
    """(subject_kind, subject_id, semantic): every subject that a near observation is, or is evidence for, by its best 1/(60 + rank).

    near: observation_id, rank from 0. links: evidence_id (an observation), subject_kind, subject_id. Merged entities count as one.
    """
    near = near.filter(F.col("rank") < MOST_NEAR)
    own = near.select(F.lit("observation").alias("subject_kind"), F.col("observation_id").alias("subject_id"), "rank")
    linked = near.join(links.select(F.col("evidence_id").alias("observation_id"), "subject_kind", "subject_id"), "observation_id").select("subject_kind", "subject_id", "rank")
    return canonical(own.unionByName(linked), merges).groupBy("subject_kind", "subject_id").agg(F.max(1 / (F.lit(float(K)) + F.col("rank"))).alias("semantic"))


def canonical(subjects: DataFrame, merges: DataFrame) -> DataFrame:
    """subjects with the ids of merged entities replaced by that of the one they are merged into."""
    m = merges.select(F.col("entity_id").alias("__e"), F.col("canonical_id").alias("__c"))
    j = subjects.join(m, (F.col("subject_kind") == "entity") & (F.col("subject_id") == F.col("__e")), "left")
    return j.withColumn("subject_id", F.coalesce("__c", "subject_id")).drop("__e", "__c")


def hybrid(near: DataFrame, links: DataFrame, merges: DataFrame, lexical: DataFrame, subjects: DataFrame, kinds: tuple = (), facets: tuple = (), limit: int = 50) -> DataFrame:
    """position, subject_kind, subject_id, facet, score: semantic and lexical 1/(60 + rank) added, best first, ties by kind and id.

    lexical: subject_kind, subject_id, rank from 0. subjects: subject_kind, subject_id, facet; what isn't there is no hit. Kinds and
    facets filter what is left after linking.
    """
    words = canonical(lexical.filter(F.col("rank") < MOST_LEXICAL), merges).groupBy("subject_kind", "subject_id").agg(F.sum(1 / (F.lit(float(K)) + F.col("rank"))).alias("semantic"))
    scored = semantic(near, links, merges).unionByName(words).groupBy("subject_kind", "subject_id").agg(F.round(F.sum("semantic"), 9).alias("score"))
    found = scored.join(subjects.select("subject_kind", "subject_id", "facet"), ["subject_kind", "subject_id"])
    found = found.filter(F.col("subject_kind").isin(*kinds)) if kinds else found
    found = found.filter(F.col("facet").isin(*facets)) if facets else found
    order = [F.desc("score"), "subject_kind", "subject_id"]
    return found.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order)))
