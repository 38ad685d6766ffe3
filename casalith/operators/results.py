"""Research results: effective outcomes, card filters over nested JSON, facets, pages, plans, caches, revisions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.web import glob_pattern

#: Outcomes that a cache may keep, and the longest time it may.
CONCLUSIVE, FRESH_SECONDS = ("found", "not_found", "taken", "available"), 8 * 3600


def project(results: DataFrame, artifacts: DataFrame, blobs: DataFrame) -> DataFrame:
    """results with source, effective_outcome, readable and search_fields (the JSON text of fields; {} where there is nothing to search).

    A result whose artifact is missing or whose blob was shredded is unknown and hides its fields.
    results: sequence, run_id, outcome, artifact_id, payload_json. artifacts: id, content_hash. blobs: content_hash, wrapped_key.
    """
    a = artifacts.select(F.col("id").alias("__a"), F.col("content_hash").alias("__h"))
    b = blobs.select(F.col("content_hash").alias("__b"), F.col("wrapped_key").alias("__k"))
    r = results.join(a, results["artifact_id"] == a["__a"], "left").join(b, F.col("__h") == F.col("__b"), "left")
    gone = F.col("artifact_id").isNotNull() & (F.col("__a").isNull() | F.col("__k").isNull())
    fields = F.get_json_object("payload_json", "$.fields")
    return r.select(
        *results.columns,
        F.coalesce(F.get_json_object("payload_json", "$.source"), F.lit("unknown")).alias("source"),
        F.when(gone, "unknown").otherwise(F.col("outcome")).alias("effective_outcome"),
        (~gone).alias("readable"),
        F.when(~gone & fields.rlike(r"^[\[{]"), fields).otherwise("{}").alias("search_fields"),
    )


@dataclass(frozen=True)
class CardFilter:
    """All that is set must hold of one and the same card."""

    module: str = ""
    verified: str = ""
    private: str = ""
    min_age: int | None = None
    max_age: int | None = None
    date_field: str = "created"
    date_from: str = ""
    date_to: str = ""
    field: str = ""
    pattern: str = ""

    def __post_init__(self):
        if self.verified not in ("", "true", "false", "unknown") or self.private not in ("", "true", "false", "unknown"):
            raise ValueError("true, false or unknown is wanted")
        if self.min_age is not None and self.max_age is not None and self.min_age > self.max_age:
            raise ValueError("the ages are reversed")
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("the dates are reversed")
        if any(x is not None and not 0 <= x <= 150 for x in (self.min_age, self.max_age)):
            raise ValueError("ages are 0 to 150")
        if len(self.field) > 128 or len(self.pattern) > 512 or len(self.module) > 128 or any(unicodedata.category(c) == "Cc" for c in self.field + self.pattern + self.module):
            raise ValueError("a field filter exceeds its bound or holds a control character")

    @property
    def empty(self) -> bool:
        return self == CardFilter(date_field=self.date_field)


def calendar_date(text: Column) -> Column:
    """The first ten characters if they are a date of the calendar, else null."""
    day = F.substring(text, 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(F.try_to_date(day, "yyyy-MM-dd"), "yyyy-MM-dd") == day) & (day >= "0001-01-01"), day)


def matches(card: Column, f: CardFilter) -> Column:
    """Whether a typed card satisfies all of the filter but its leaf pattern: booleans and whole ages are what JSON says they are."""
    ok = card.isNotNull()
    if f.module:
        ok = ok & (card["module"] == f.module)
    for name, want in (("verified", f.verified), ("private", f.private)):
        if want:
            ok = ok & (F.coalesce(card["fields"][name].cast("string"), F.lit("unknown")) == want)
    if f.min_age is not None or f.max_age is not None:
        ok = ok & card["fields"]["age"].between(f.min_age or 0, 150 if f.max_age is None else f.max_age)
    if f.date_from or f.date_to:
        day = calendar_date(card["fields"]["day"])
        ok = ok & (day >= (f.date_from or "0001-01-01")) & (day <= (f.date_to or "9999-12-31"))
    return F.coalesce(ok, F.lit(False))


def leaves(value) -> Iterator[tuple[str | None, str]]:
    """(key, text) of every scalar but null, however deep; a list's elements have their number as key."""
    todo: list[tuple[str | None, object]] = [(None, value)]
    while todo:
        key, v = todo.pop()
        if isinstance(v, dict):
            todo += v.items()
        elif isinstance(v, list):
            todo += [(str(i), x) for i, x in enumerate(v)]
        elif v is not None:
            yield key, v if isinstance(v, str) else json.dumps(v)


def has_leaf(texts: Column, f: CardFilter) -> Column:
    """array<boolean> from array<string> of JSON texts: whether a leaf has the exact key, matches the glob, or both."""
    wanted = re.compile(glob_pattern(f.pattern)) if f.pattern else None

    def one(text: str | None) -> bool:
        try:
            return any((not f.field or k == f.field) and (wanted is None or wanted.match(v) is not None) for k, v in leaves(json.loads(text or "{}")))
        except ValueError:
            return False

    @F.pandas_udf("array<boolean>")
    def of(batch: pd.Series) -> pd.Series:
        return batch.map(lambda some: [one(t) for t in some])

    return of(texts)


def by_cards(projected: DataFrame, f: CardFilter) -> DataFrame:
    """Rows one of whose cards satisfies the whole filter; a row without cards has one empty card, whose leaves are all of its fields.

    Cards are parsed once, into the few types that the filter reads; only rows that satisfy the rest have their leaves walked.
    """
    if f.empty:
        return projected
    typed = "fields struct<cards:array<struct<module:string,fields:struct<verified:boolean,private:boolean,age:bigint,day:string>>>>"
    # the filter's date field is read under one name
    text = F.regexp_replace("payload_json", f'"{re.escape(f.date_field)}"\\s*:', '"day":') if f.date_from or f.date_to else F.col("payload_json")
    empty = F.struct(F.lit(None).cast("string").alias("module"), F.from_json(F.lit("{}"), "verified boolean, private boolean, age bigint, day string").alias("fields"))
    one = lambda cards: F.when(F.size(cards) > 0, F.transform(cards, lambda c: matches(c, f))).otherwise(F.array(matches(empty, f)))
    parsed = F.from_json(F.when(F.col("readable"), text), typed)["fields"]["cards"]
    # as an array of one it is parsed once for all that the filter asks of it
    ok = F.element_at(F.transform(F.array(parsed), one), 1)
    rows = projected.filter(F.array_contains(ok, True))
    if f.field or f.pattern:
        own = F.from_json("search_fields", "cards array<struct<fields:string>>")["cards"]
        texts = F.when(F.size(own) > 0, F.transform(own, lambda c: F.coalesce(c["fields"], F.lit("{}")))).otherwise(F.array("search_fields"))
        hit = F.zip_with(ok, has_leaf(texts, f), lambda a, b: a & b)
        rows = rows.withColumn("__hit", hit).filter(F.array_contains("__hit", True)).drop("__hit")
    return rows


def facets(projected: DataFrame) -> DataFrame:
    """(facet, value, n): by source, by outcome, and the total, of all rows in one pass."""
    g = projected.groupingSets([["source"], ["effective_outcome"], []], "source", "effective_outcome").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return g.select(F.when(F.col("g") == 1, "source").when(F.col("g") == 2, "outcome").otherwise("total").alias("facet"), F.coalesce("source", "effective_outcome", F.lit("")).alias("value"), "n")


def page(rows: DataFrame, size: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy("sequence").offset(offset).limit(size)


def run_status(runs: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, completed, status): completed, partial, or interrupted where a run still says it is running. runs: run_id, expected, status."""
    done = results.groupBy("run_id").agg(F.count("*").alias("completed"))
    joined = runs.join(done, "run_id", "left").withColumn("completed", F.coalesce("completed", F.lit(0)))
    status = F.when(F.col("status") == "cancelled", "cancelled").when(F.col("completed") >= F.col("expected"), "completed").when(F.col("status") == "running", "interrupted").otherwise("partial")
    return joined.select("run_id", "completed", status.alias("status"))


def cache_lookup(requests: DataFrame, results: DataFrame, now: int, most_age: int = FRESH_SECONDS) -> DataFrame:
    """(cache_key, sequence): the newest usable result of each requested key: conclusive, readable, fresh, not itself from the cache."""
    ok = results.filter(F.col("effective_outcome").isin(*CONCLUSIVE) & F.col("readable") & ~F.col("from_cache") & (F.col("created_epoch") >= now - min(most_age, FRESH_SECONDS)) & (F.col("created_epoch") <= now))
    newest = ok.groupBy("cache_key").agg(F.max_by("sequence", F.struct("created_epoch", "sequence")).alias("sequence"))
    return requests.select("cache_key").distinct().join(newest, "cache_key")


def plan(selectors: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks (kind, normalized, source), selectors without any source). sources: source, kinds (array). Joined on the kind."""
    one = selectors.select("kind", "normalized").distinct()
    able = sources.select("source", F.explode("kinds").alias("kind")).distinct()
    return one.join(able, "kind"), one.join(able, "kind", "left_anti")


def latest_revisions(revisions: DataFrame, with_archived: bool = False) -> DataFrame:
    """The latest revision of each document; archived ones go unless asked for. revisions: id, revision, archived, ..."""
    order = Window.partitionBy("id").orderBy(F.desc("revision"))
    last = revisions.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
    return last if with_archived else last.filter(~F.col("archived"))


def conflicts(saves: DataFrame, revisions: DataFrame) -> DataFrame:
    """Saves (id, base_revision) whose base is no longer the latest revision."""
    last = revisions.groupBy("id").agg(F.max("revision").alias("latest"))
    return saves.join(last, "id", "left").filter(F.coalesce("latest", F.lit(0)) != F.col("base_revision"))


def selected(results: DataFrame, ids: list) -> DataFrame:
    """Results in the caller's order, each once, with position. An id that no result has is an error."""
    spark = results.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in dict.fromkeys(ids)])).alias("position", "sequence"))
    missing = [r[0] for r in wanted.join(results, "sequence", "left_anti").select("sequence").collect()]
    if missing:
        raise KeyError(f"no such results: {sorted(missing)}")
    return wanted.join(results, "sequence")


def filtered_page(projected: DataFrame, f: CardFilter, outcome: str = "", sources: tuple[str, ...] = (), size: int = 50, offset: int = 0) -> DataFrame:
    """The page of what the filters leave, by sequence, with total (of the filtered rows) and run_total (of all) on each row."""
    if offset > 1_000_000 or len(sources) > 100 or any(not s or len(s) > 128 for s in sources):
        raise ValueError("result filter or offset exceeds its bound")
    found = by_cards(projected, f)
    found = found.filter(F.col("effective_outcome") == outcome) if outcome else found
    found = found.filter(F.col("source").isin(*sources)) if sources else found
    totals = found.agg(F.count("*").alias("total")).first()[0], projected.count()
    return page(found, size, offset).withColumns({"total": F.lit(totals[0]).cast("long"), "run_total": F.lit(totals[1]).cast("long")})
