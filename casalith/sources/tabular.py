"""Tables from text: lists, delimited text, JSON; column suggestions and mapped columns."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import selectors as S
from ..operators.ordered import dealt, running

#: Bounds of one imported table.
MOST_ROWS, MOST_COLUMNS, MOST_CELL = 20_000, 64, 8192
KINDS = {"email": S.email, "phone": S.phone, "domain": S.domain, "ip": S.ipv4, "username": S.username, "name": S.name}
SEPARATORS = r"[\n\r\t,;]"


def bulk_list(texts: DataFrame, kind: str) -> DataFrame:
    """(doc_id, first, value, normalized, repeats): entries of each text (doc_id, text), equal ones once, in the order first seen."""
    each = texts.select("doc_id", F.posexplode(F.split("text", SEPARATORS)).alias("pos", "raw")).withColumn("value", F.trim("raw")).filter("value <> ''")
    each = each.withColumn("normalized", KINDS[kind](F.col("value")))
    grouped = each.groupBy("doc_id", F.coalesce("normalized", "value").alias("identity")).agg(
        F.min("pos").alias("first"), F.min_by("value", "pos").alias("value"), F.min_by("normalized", "pos").alias("normalized"), F.count("*").alias("repeats")
    )
    return grouped.drop("identity")


def with_origins(rows: DataFrame, keys: list[str], origin: str, order: str, most: int = 100) -> DataFrame:
    """(keys, repeats, origins): how often each value occurs and its first `most` distinct origins, in the order first seen (ties by origin).

    repeats counts all rows; the list is a short one by design. Origins are made distinct before they are ranked, null ones aside.
    """
    seen = rows.groupBy(*keys, origin).agg(F.min(order).alias("__at"), F.count("*").alias("__c"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__at", origin))
    first = seen.filter(F.col(origin).isNotNull()).withColumn("__n", rank).filter(F.col("__n") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__n", origin)))[origin].alias("origins"))
    counts = seen.groupBy(*keys).agg(F.sum("__c").alias("repeats"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    j = counts.alias("a").join(first.alias("b"), [same[0], *same[1:]] if len(same) > 1 else same[0], "left")
    return j.select(*[F.col(f"a.{k}").alias(k) for k in keys], "repeats", F.coalesce("origins", F.array().cast(first.schema["origins"].dataType)).alias("origins"))


def suggestions(table: DataFrame, columns: list[str], sample: int = 100) -> DataFrame:
    """(column, kind, valid, sampled, named): kinds that a column's header or its first values suggest."""
    headers = {"email": ("email",), "phone": ("phone", "mobile"), "domain": ("domain", "website"), "ip": ("ip_address",), "username": ("username", "handle"), "name": ("name",)}
    some = table.select(columns).limit(sample)
    exprs = []
    for c in columns:
        v = F.col(c).cast("string")
        full = F.trim(v) != ""
        exprs.append(F.count_if(full).alias(f"{c}|n"))
        exprs += [F.count_if(full & f(v).isNotNull()).alias(f"{c}|{k}") for k, f in KINDS.items()]
    row = some.agg(*exprs)
    parts = []
    for c in columns:
        for k in KINDS:
            named = any(h in c.lower() for h in headers[k]) and not (k == "name" and "username" in c.lower()) or (k == "ip" and c.lower() == "ip")
            if k in ("name", "username") and not named:
                continue
            n, valid = F.col(f"`{c}|n`"), F.col(f"`{c}|{k}`")
            keep = F.lit(named) | ((n >= 2) & (valid * 10 >= n * 9))
            parts.append(F.when(keep, F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), valid.alias("valid"), n.alias("sampled"), F.lit(named).alias("named"))))
    return row.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("s")).select("s.*")


def mapped(columns: list[str], kind: str) -> Column:
    """One value of 1 to 4 columns: only names join several, by a space, blank ones left out."""
    if not 1 <= len(set(columns)) == len(columns) <= 4 or (kind != "name" and len(columns) > 1):
        raise ValueError("one column, or up to four different ones for a name")
    joined = F.concat_ws(" ", *[F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))) for c in columns])
    return KINDS[kind](joined)


def parse_delimited(text: str, separator: str = ",", header: bool = True) -> tuple[list[str], list[list[str]], list[str]]:
    """(columns, rows, warnings): RFC quoting held to strictly, blank rows dropped, short rows padded, bounds enforced."""
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), delimiter=separator, strict=True) if any(c.strip() for c in r)]
    if len(rows) > MOST_ROWS or any(len(r) > MOST_COLUMNS or any(len(c.encode()) > MOST_CELL for c in r) for r in rows):
        raise ValueError("the table exceeds the bounds of an import")
    width = max(map(len, rows), default=0)
    warnings = ["rows differ in length; short ones were padded"] if any(len(r) != width for r in rows) else []
    rows = [r + [""] * (width - len(r)) for r in rows]
    columns = [c.strip() or f"column_{i + 1}" for i, c in enumerate(rows.pop(0))] if header and rows else [f"column_{i + 1}" for i in range(width)]
    return columns, rows, warnings


def parse_json(text: str) -> tuple[list[str], list[list[str]]]:
    """(columns, rows) of an array of objects (union of keys in the order first seen), of arrays, or of scalars; no mixture."""
    value = json.loads(text)
    if not isinstance(value, list):
        raise ValueError("an array is wanted")
    said = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    kinds = {dict if isinstance(v, dict) else list if isinstance(v, list) else str for v in value}
    if len(kinds) > 1:
        raise ValueError("rows of one kind are wanted")
    if kinds == {dict}:
        columns = list(dict.fromkeys(k for v in value for k in v))
        return columns, [[said(v.get(k)) for k in columns] for v in value]
    rows = [[said(x) for x in v] if isinstance(v, list) else [said(v)] for v in value]
    width = max(map(len, rows), default=0)
    return [f"column_{i + 1}" for i in range(width)], [r + [""] * (width - len(r)) for r in rows]


def delimited(files: DataFrame, separator: str = ",", header: bool = True) -> DataFrame:
    """(id, row_no, columns, cells, error) from (id, text): a file that doesn't parse is one row with its error, not a failed task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["id"], b["text"], strict=True):
                try:
                    columns, rows, _ = parse_delimited(text or "", separator, header)
                    out += [(i, n, columns, r, None) for n, r in enumerate(rows)]
                except (ValueError, csv.Error) as e:
                    out.append((i, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["id", "row_no", "columns", "cells", "error"])

    return files.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "id string, row_no long, columns array<string>, cells array<string>, error string")


def lines(texts: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): lines that are not blank, numbered as they stand."""
    each = texts.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n")).alias("line_no", "line"))
    return each.filter(F.trim("line") != "")


def coalesced_ranges(ranges: DataFrame, gap: int = 4096) -> DataFrame:
    """(source, first, last, pieces): byte ranges (source, start, size) joined where at most `gap` bytes lie between them."""
    one = ranges.groupBy("source", "start").agg(F.max("size").alias("size"), F.count("*").alias("pieces"))
    rows = dealt(one, ["source"], ["start"])
    ended = running(rows, ["source"], ["start"], F.col("start") + F.col("size"), "__end", F.max, before=True)
    new = F.when(F.col("__end").isNull() | (F.col("start") > F.col("__end") + gap), 1).otherwise(0)
    named = running(ended, ["source"], ["start"], new.cast("long"), "__island")
    return named.groupBy("source", "__island").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("size")).alias("last"), F.sum("pieces").alias("pieces")).drop("__island")
