"""Entity resolution: candidates, merges as a reversible projection of depth one, clusters, dimension agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import cut


def normalise_identifier(namespace: Column, value: Column) -> Column:
    """Trimmed; an e-mail's domain in lower case, its local part as it is; domains, URLs and addresses in lower case."""
    v = F.trim(value)
    mail = F.concat(F.regexp_extract(v, r"(?s)^(.*@)", 1), F.lower(F.substring_index(v, "@", -1)))
    return F.when((namespace == "email_address") & v.contains("@"), mail).when(namespace.isin("domain", "url", "ip_address"), F.lower(v)).otherwise(v)


def propose(pairs: DataFrame) -> DataFrame:
    """Ordered pairs, the latest rationale of each proposer. pairs: left_entity, right_entity, proposed_by, rationale, row_seq."""
    ordered = pairs.filter("left_entity <> right_entity").withColumns({"left_entity": F.least("left_entity", "right_entity"), "right_entity": F.greatest("left_entity", "right_entity")})
    return ordered.groupBy("left_entity", "right_entity", "proposed_by").agg(F.max_by("rationale", "row_seq").alias("rationale"), F.max("row_seq").alias("row_seq"))


def shared_identifiers(identifiers: DataFrame) -> DataFrame:
    """Pairs of entities with the same (namespace, normalized): each entity with the least one, so a common value gives no square of pairs."""
    least = identifiers.groupBy("namespace", "normalized").agg(F.min("entity_id").alias("left_entity"))
    return identifiers.join(least, ["namespace", "normalized"]).filter("entity_id > left_entity").select("left_entity", F.col("entity_id").alias("right_entity")).distinct()


def open_candidates(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidate pairs without a decision."""
    done = decisions.select(F.least("left_entity", "right_entity").alias("left_entity"), F.greatest("left_entity", "right_entity").alias("right_entity"))
    return candidates.join(done, ["left_entity", "right_entity"], "left_anti")


def active(decisions: DataFrame) -> DataFrame:
    """The latest decision of each pair, where it is a merge. decisions: left_entity, right_entity, action, row_seq."""
    d = decisions.withColumns({"left_entity": F.least("left_entity", "right_entity"), "right_entity": F.greatest("left_entity", "right_entity")})
    last = d.groupBy("left_entity", "right_entity").agg(F.max_by("action", "row_seq").alias("action"))
    return last.filter("action = 'merge'").select("left_entity", "right_entity")


def merge_map(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity_id, canonical_id) of all absorbed entities: within what accepted pairs connect, the oldest survives.

    entities: id, created_utc, row_seq; oldest by (created_utc, row_seq, id). The least of (age, neighbours' age) spreads until
    nothing changes; each round jumps to what the neighbour already knows.
    """
    age = entities.select(F.col("id"), F.struct("created_utc", "row_seq", "id").alias("best"))
    both = pairs.select(F.col("left_entity").alias("a"), F.col("right_entity").alias("b")).unionByName(pairs.select(F.col("right_entity").alias("a"), F.col("left_entity").alias("b")))
    links = cut(both.distinct())
    now = cut(age.join(links.select(F.col("a").alias("id")).distinct(), "id", "left_semi"))
    while True:
        seen = links.join(now.select(F.col("id").alias("b"), F.col("best").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        step = now.join(seen, "id", "left").select("id", F.least("best", F.coalesce("near", "best")).alias("best"))
        jump = step.join(step.select(F.struct("*").alias("s")).select(F.col("s.id").alias("root"), F.col("s.best").alias("far")), F.col("best.id") == F.col("root"), "left")
        new = cut(jump.select("id", F.least("best", F.coalesce("far", "best")).alias("best")))
        if not new.join(now.withColumnRenamed("best", "was"), "id").filter("best <> was").limit(1).count():
            break
        now = new
    return now.filter("id <> best.id").select(F.col("id").alias("entity_id"), F.col("best.id").alias("canonical_id"))


def canonical(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """entities with canonical_id."""
    return entities.join(merges.select(F.col("entity_id").alias("id"), F.col("canonical_id").alias("__c")), "id", "left").withColumn("canonical_id", F.coalesce("__c", "id")).drop("__c")


def cluster_counts(entities: DataFrame, merges: DataFrame, identifiers: DataFrame, evidence: DataFrame) -> DataFrame:
    """canonical_id, members (merged ones), identifiers, evidence; evidence counts links to entities only."""
    who = canonical(entities.select("id"), merges)
    count = lambda df, key, name: df.join(who.withColumnRenamed("id", key), key).groupBy("canonical_id").agg(F.count("*").alias(name))
    base = who.groupBy("canonical_id").agg((F.count("*") - 1).alias("members"))
    out = base.join(count(identifiers.select("entity_id"), "entity_id", "identifiers"), "canonical_id", "left")
    out = out.join(count(evidence.filter("subject_kind = 'entity'").select("subject_id"), "subject_id", "evidence"), "canonical_id", "left")
    return out.select("canonical_id", "members", F.coalesce("identifiers", F.lit(0)).alias("identifiers"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


def map_violations(merges: DataFrame) -> DataFrame:
    """Rows that break the map's depth of one: a canonical entity that is itself absorbed, an entity absorbed twice, or into itself."""
    absorbed = merges.select(F.col("entity_id").alias("x")).distinct()
    deep = merges.join(absorbed, merges["canonical_id"] == absorbed["x"], "left_semi").select("entity_id", F.lit("canonical is absorbed").alias("violation"))
    twice = merges.groupBy("entity_id").count().filter("count > 1").select("entity_id", F.lit("absorbed twice").alias("violation"))
    own = merges.filter("entity_id = canonical_id").select("entity_id", F.lit("absorbed into itself").alias("violation"))
    return deep.unionByName(twice).unionByName(own)


def agreement(subjects: DataFrame, dimensions: list[str], assessments: DataFrame) -> DataFrame:
    """(subject_id, dimension, standing): unassessed, assessed or disagreed. assessments: subject_id, dimension, value_key."""
    every = subjects.select("subject_id").withColumn("dimension", F.explode(F.array(*[F.lit(x) for x in dimensions])))
    said = assessments.groupBy("subject_id", "dimension").agg(F.countDistinct("value_key").alias("n"))
    joined = every.join(said, ["subject_id", "dimension"], "left")
    return joined.select("subject_id", "dimension", F.when(F.col("n").isNull(), "unassessed").when(F.col("n") > 1, "disagreed").otherwise("assessed").alias("standing"))


def entity_list(entities: DataFrame, merges: DataFrame, limit: int = 500) -> DataFrame:
    """Canonical entities by name, then row_seq."""
    kept = entities.join(merges.select(F.col("entity_id").alias("id")), "id", "left_anti")
    top = kept.orderBy("display_name", "row_seq").limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy("display_name", "row_seq")))
