"""Rules that rows must keep: integrity constraints, validated writes, imports, responses and cited answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of a response that say it was refused.
REFUSED = (401, 402, 403, 429)


def classify(status: Column, body: Column, login: Column, wanted: Column) -> Column:
    """Outcome of a profile response: blocked, error, found (JSON whose login is the wanted one, in any case), else unknown.

    A page that isn't the expected JSON, a status other than 200, or another login says nothing about availability.
    """
    json = F.try_parse_json(body).isNotNull()
    return (
        F.when(status.isin(*REFUSED), "blocked").when(status >= 500, "error").when(~json | (status != 200), "unknown")
        .when(F.lower(login) == F.lower(wanted), "found").otherwise("unknown")
    )


def unordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("left_entity >= right_entity").select(F.concat_ws("|", "left_entity", "right_entity").alias("key"), F.lit("pair is not ordered").alias("violation"))


def repeated(rows: DataFrame, keys: list[str], violation: str) -> DataFrame:
    """Keys that several rows have, where one is allowed: a subject's document, an assessment of a dimension."""
    return rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").select(F.concat_ws("|", *keys).alias("key"), F.lit(violation).alias("violation"))


def half_measures(gaps: DataFrame) -> DataFrame:
    """Gaps (run_id, magnitude, unit) with a magnitude and no unit, or the other way round."""
    return gaps.filter(F.col("magnitude").isNull() != F.col("unit").isNull()).select(F.col("run_id").alias("key"), F.lit("magnitude and unit go together").alias("violation"))


def unlisted(rows: DataFrame, key: str, column: str, allowed: tuple, violation: str) -> DataFrame:
    return rows.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(F.col(key).cast("string").alias("key"), F.lit(violation).alias("violation"))


def ungrounded(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, violation: str) -> DataFrame:
    """Rows whose key no parent has: a relationship without evidence, an assessment of a value that its scale lacks."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit(violation).alias("violation"))


def machine_values(assessments: DataFrame, values: DataFrame) -> DataFrame:
    """Assessments (id, actor, scale_id, value_key) by a machine of values (scale_id, value_key, machine_assignable) that machines may not give."""
    j = assessments.filter("actor = 'machine'").join(values, ["scale_id", "value_key"], "left")
    return j.filter(~F.coalesce("machine_assignable", F.lit(False))).select(F.col("id").cast("string").alias("key"), F.lit("a machine may not assign this").alias("violation"))


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of an append-only table that were changed or removed. Compared by a hash of all columns, nulls apart."""
    cols = [c for c in before.columns if c != key]
    said = F.xxhash64(*[F.struct(F.col(c).isNull(), c) for c in cols])
    j = before.select(key, said.alias("__a")).join(after.select(key, said.alias("__b")), key, "left")
    bad = F.when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return j.select(F.col(key).cast("string").alias("key"), bad.alias("violation")).filter("violation IS NOT NULL")


def scales_without(values: DataFrame, needed: str = "insufficient_information") -> DataFrame:
    """Scales none of whose values is the needed one."""
    return values.groupBy("scale_id").agg(F.max((F.col("value_key") == needed).cast("int")).alias("has")).filter("has = 0").select(F.col("scale_id").alias("key"), F.lit(f"no value {needed}").alias("violation"))


def scales_to_seed(offered: DataFrame, held: DataFrame, needed: str = "insufficient_information") -> DataFrame:
    """Rows of offered (scale_id, version, value_key, ...) of scales and versions that held (scale_id, version) doesn't have.

    What is held stays as it is. An offered scale without the needed value raises ValueError.
    """
    lacking = scales_without(offered.withColumn("scale_id", F.concat_ws(" ", "scale_id", "version")), needed).select("key").limit(1).collect()
    if lacking:
        raise ValueError(f"scale {lacking[0]['key']} has no value {needed}")
    return offered.join(held.select("scale_id", "version").distinct(), ["scale_id", "version"], "left_anti").select(offered.columns)


def import_errors(rows: DataFrame, normalise: Column) -> DataFrame:
    """Staged rows (row_no, kind, original, normalized) that may not go in: a kind and value that came before, or a value that doesn't normalise to itself."""
    again = F.row_number().over(Window.partitionBy("kind", "normalized").orderBy("row_no")) > 1
    marked = rows.withColumns({"__again": again, "__now": normalise})
    error = F.when(F.col("__now").isNull() | (F.col("__now") != F.col("normalized")), "not normalised").when(F.col("__again"), "repeated")
    return marked.select("row_no", error.alias("error")).filter("error IS NOT NULL")


def append_errors(results: DataFrame, runs: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """Results (id, run_id, outcome, artifact_id, payload_json) that a run (run_id, status, expected, completed) may not take."""
    j = results.join(runs, "run_id", "left")
    error = (
        F.when(F.col("status").isNull(), "no such run").when(F.col("status") != "running", "run is over").when(F.col("completed") >= F.col("expected"), "run is full")
        .when(F.octet_length("payload_json") > most_bytes, "payload is too large").when(F.col("outcome").isin("found", "not_found", "taken", "available") & F.col("artifact_id").isNull(), "no evidence")
    )
    return j.select("id", error.alias("error")).filter("error IS NOT NULL")


def uncited(answers: DataFrame) -> DataFrame:
    """Answers (id, cited, context: arrays of observation ids) that cite nothing, or something that was not in their context."""
    outside = F.array_except("cited", "context")
    error = F.when(F.size("cited") == 0, "cites nothing").when(F.size(outside) > 0, "cites what it was not given")
    return answers.select("id", error.alias("error"), F.size(outside).alias("outside")).filter("error IS NOT NULL")


def staged(results: DataFrame, observations: DataFrame) -> DataFrame:
    """Review candidates: results (id, source, artifact_id, value, pointer) with the current observation that holds their value at their place."""
    o = observations.filter("NOT superseded").select("artifact_id", "value", "pointer", F.col("id").alias("observation_id"))
    return results.join(o, ["artifact_id", "value", "pointer"]).select(F.concat_ws(":", "source", "id").alias("key"), "observation_id")
