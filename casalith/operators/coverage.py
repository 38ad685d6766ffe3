"""Coverage: what the latest run over each artifact left unread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each artifact. Start times have seconds only, so row_seq breaks ties. runs: run_id, artifact_id, status, started_utc, row_seq."""
    order = Window.partitionBy("artifact_id").orderBy(F.desc("started_utc"), F.desc("row_seq"))
    return runs.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def state(status: Column, has_gap: Column) -> Column:
    """never, failed, partial, complete, or in_progress (any status not known)."""
    return (
        F.when(status.isNull(), "never").when(status == "failed", "failed").when((status == "succeeded") & has_gap, "partial").when(status == "succeeded", "complete").otherwise("in_progress")
    )


def states(artifacts: DataFrame, runs: DataFrame, gaps: DataFrame) -> DataFrame:
    """artifact_id, run_id, status, state of every artifact. gaps: run_id, gap_kind, detail, magnitude, unit."""
    gapped = gaps.select("run_id").distinct().withColumn("has_gap", F.lit(True))
    latest = latest_runs(runs).select("artifact_id", "run_id", "status").join(gapped, "run_id", "left")
    all_ = artifacts.select("artifact_id").join(latest, "artifact_id", "left")
    return all_.select("artifact_id", "run_id", "status", state(F.col("status"), F.coalesce("has_gap", F.lit(False))).alias("state"))


def summary(artifacts: DataFrame, runs: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row of counts; an empty case is complete."""
    s = F.col("state")
    n = states(artifacts, runs, gaps).agg(
        F.count("*").alias("artifacts"), *[F.count_if(s == x).alias(y) for x, y in (("never", "never_attempted"), ("in_progress", "in_progress"), ("failed", "failed"), ("partial", "partial"), ("complete", "complete"))]
    )
    n = n.withColumn("incomplete", F.col("never_attempted") + F.col("in_progress") + F.col("failed") + F.col("partial"))
    return n.withColumn("is_complete", F.col("incomplete") == 0)


def latest_gaps(runs: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gaps of the latest run of each artifact only."""
    return gaps.join(latest_runs(runs).select("run_id", "artifact_id"), "run_id").select("artifact_id", "run_id", "gap_kind", "magnitude", "unit")


def incomplete(artifacts: DataFrame, runs: DataFrame, gaps: DataFrame) -> DataFrame:
    """artifact_id, state, badness (never 0, failed 1, others 2), gap_kinds (sorted, comma-joined), worst first when ordered by badness, artifact_id."""
    kinds = latest_gaps(runs, gaps).groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("gap_kind")), ",").alias("gap_kinds"))
    bad = states(artifacts, runs, gaps).filter("state <> 'complete'").join(kinds, "run_id", "left")
    badness = F.when(F.col("state") == "never", 0).when(F.col("state") == "failed", 1).otherwise(2)
    return bad.select("artifact_id", "state", badness.alias("badness"), F.coalesce("gap_kinds", F.lit("")).alias("gap_kinds"))


def one_state(requests: DataFrame, artifacts: DataFrame, runs: DataFrame, gaps: DataFrame) -> DataFrame:
    """State of requested artifacts; one that doesn't exist is `missing`, not `never`."""
    known = states(artifacts, runs, gaps).select("artifact_id", "state")
    return requests.select("artifact_id").join(known, "artifact_id", "left").select("artifact_id", F.coalesce("state", F.lit("missing")).alias("state"))
