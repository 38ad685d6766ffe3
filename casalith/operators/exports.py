"""Exports: result tables as CSV and JSON, canonical JSON, Markdown, package manifests."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.web import spreadsheet_cell

#: The columns of a result table.
CSV_COLUMNS = (
    "result_id", "run_id", "selector_type", "original", "normalized", "source", "outcome", "url", "observed_utc", "source_reported_utc", "indexed_utc", "artifact_id", "from_cache", "fields_json", "limitation",
)


def csv_lines(results: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS) -> DataFrame:
    """(result_id, line): each result as a line of CSV, every cell quoted, formulas made harmless, null empty. The header is header()."""
    cells = [spreadsheet_cell(F.col(c).cast("string")) for c in columns]
    return results.select("result_id", F.concat_ws(",", *cells).alias("line"))


def header(columns: tuple[str, ...] = CSV_COLUMNS) -> str:
    return ",".join(columns)


def json_lines(results: DataFrame) -> DataFrame:
    """(result_id, line): each result as one JSON object, null fields left out; a writer puts the envelope around them."""
    return results.select("result_id", F.to_json(F.struct(*results.columns)).alias("line"))


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys, no blanks, and what isn't ASCII as it is; null if it is none."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(one)

    return of(text)


def markdown_escape(text: Column) -> Column:
    """Text that Markdown shows as it is: marks get a backslash, < and > and & become references."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\`*_{}\[\]()#+.!|~-])", r"\\$1")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        marked = F.replace(marked, F.lit(a), F.lit(b))
    return marked


def manifest(entries: DataFrame) -> DataFrame:
    """(standing, entries, bytes): totals of a package by standing. entries: standing, size."""
    return entries.groupBy("standing").agg(F.count("*").alias("entries"), F.sum("size").cast("long").alias("bytes"))


def verdict(findings: DataFrame) -> DataFrame:
    """One row: failed if something was changed, doubled or isn't there, partial if something is there that was not claimed, else ok."""
    worst = F.max(F.when(F.col("finding").isin("mismatch", "duplicate", "absent"), 2).when(F.col("finding") == "unclaimed", 1).otherwise(0))
    return findings.agg(F.count("*").alias("entries"), F.when(worst == 2, "failed").when(worst == 1, "partial").otherwise("ok").alias("verdict"))


def module_counters(cards: DataFrame) -> DataFrame:
    """One row over cards (run_id, module, valid): modules, unclassified (no module), malformed, accounts."""
    return cards.agg(
        F.countDistinct("module").alias("modules"), F.count_if(F.col("module").isNull()).alias("unclassified"), F.count_if(~F.col("valid")).alias("malformed"), F.count_if(F.col("valid") & F.col("module").isNotNull()).alias("accounts")
    )


def publish(rows: DataFrame, path: str) -> DataFrame:
    """rows written as a table at path, which mustn't be there (FileExistsError): written beside it and renamed, so it's whole or absent."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    target, staging = at(path), at(f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    try:
        rows.write.parquet(staging.toString())
        if files.exists(target) or not files.rename(staging, target):
            raise FileExistsError(path)
    finally:
        files.delete(staging, True)
    return spark.read.schema(rows.schema).parquet(path)


def restore(claimed: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """A package's files (name, content binary) published at path with hash and size, once each of them is what the manifest claims.

    claimed: name, hash, size. Anything changed, doubled, absent or not claimed raises ValueError with a count of each finding, and
    nothing is written.
    """
    from .lineage import package_verify

    actual = files.select("name", "content", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))
    wrong = package_verify(claimed, actual.drop("content")).filter("finding <> 'ok'").groupBy("finding").count().orderBy("finding").collect()
    if wrong:
        raise ValueError("the package was changed or is damaged: " + ", ".join(f"{r['count']} {r['finding']}" for r in wrong))
    return publish(actual, path)
