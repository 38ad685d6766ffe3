"""Personal data: base patterns, and bootstrapped contextual extraction.

Entities that base patterns find are seeds. The words before a seed are a lexical pattern; patterns and the instances that follow
them form a graph, on which confidence goes back and forth: a pattern is as sure as the share of its instances that are known, an
instance as sure as the patterns that lead to it together. Identifiers that sure patterns lead to are added to what the base found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values of the contract: kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
#: A local part is looked for from its first character only, and taken whole, so that long runs are read once.
_LOCAL = "[A-Za-z0-9._%+-]"
_DOMAIN = r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_EMAIL = re.compile(f"(?<!{_LOCAL}){_LOCAL}++{_DOMAIN}")
_EMAIL_HERE = re.compile(f"{_LOCAL}++{_DOMAIN}")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: An instance: a token that could name someone, and the two words before it.
_TOKEN = re.compile(r"[^\s,;!?\"'<>()\[\]]+")
_NAMES = re.compile("[0-9@]")
_BEFORE = re.compile(r"([^\W\d_]+)[^\w]*\s+([^\W\d_]+)[\s:=#\"'(\[-]*$")
#: The two words are looked for in so many code points before an instance; that bounds a pattern, not the text.
REACH = 60


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _low(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[re.Match]:
    """Leftmost non-overlapping e-mail addresses; the next one may start where the last one ended, within a run."""
    at = 0
    while m := (_EMAIL_HERE.match(text, at) if at else None) or _EMAIL.search(text, at):
        yield m
        at = m.end()


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """[start, end) of tokens with a digit or @; what stands before a colon that comes before those is no part of it."""
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if hit := _NAMES.search(text, a, b):
            yield max(a, text.rfind(":", a, hit.start()) + 1), b


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind, then start: leftmost non-overlapping matches, failing ones dropped."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in emails(text)]
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_low, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def _context(text: str, start: int) -> str | None:
    m = _BEFORE.search(text, max(0, start - REACH), start)
    return f"{m[1].lower()} {m[2].lower()}" if m else None


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str]]:
    """(kind number, or -1 if no base pattern names it; start; end; pattern; value): all that stand behind two words."""
    out = []
    for kind, a, b in base:
        if c := _context(text, a):
            out.append((kind, a, b, c, text[a:b].lower()))
    taken = sorted((a, b) for _, a, b in base)
    at = 0
    if "@" in text or _DIGIT.search(text):
        for a, b in tokens(text):
            b = a + len(text[a:b].rstrip(".-"))
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if b - a >= 5 and not any(x < b and a < y for x, y in taken[at : at + 4]) and (c := _context(text, a)):
                out.append((-1, a, b, c, text[a:b].lower()))
    return out


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_INSTANCE = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("value", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [["kind", "start", "end"], ["kind", "start", "end", "pattern", "value"]]
    as_dicts = lambda rows, keys: [dict(zip(keys, r, strict=True)) for r in rows]
    for batch in batches:
        base, found = [], []
        for t in batch.column("text").to_pylist():
            spans = base_spans(t or "")
            base.append(as_dicts(spans, names[0]))
            found.append(as_dicts(instances(t or "", spans), names[1]))
        kept = [batch.column(n) for n in batch.schema.names if n != "text"]
        kept_names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_INSTANCE))], names=[*kept_names, "base", "instances"]
        )


def learn(found: DataFrame, rounds: int = 3, least: float = 0.8, support: int = 3) -> DataFrame:
    """(kind, pattern, sure): confidence of patterns from (kind, pattern, value), kind -1 where no seed says so.

    Values count once for a pattern, however many rows hold them, and pairs are made distinct before they are grouped, so that a
    frequent pair of words makes no task large. A pattern needs support distinct seeds and known values. Each round: a pattern's
    confidence is the known share (by confidence) of its values, plus one against it; a value's is 1 minus the product of its
    patterns' doubts; values at least as sure as least are known in the next round.
    """
    pairs = cut(found.select("kind", "pattern", "value").distinct())
    seeds = pairs.filter("kind >= 0").select("kind", "value", F.lit(1.0).alias("known")).distinct()
    values = pairs.groupBy("pattern").agg(F.countDistinct("value").alias("all"))
    edges = pairs.select("pattern", "value").distinct()
    known, sure = seeds, None
    for _ in range(rounds):
        hit = edges.join(known, "value").groupBy("kind", "pattern").agg(F.sum("known").alias("hit"), F.count("*").alias("n"))
        sure = cut(hit.filter(F.col("n") >= support).join(values, "pattern").select("kind", "pattern", (F.col("hit") / (F.col("all") + 1)).alias("sure")))
        new = edges.join(sure, "pattern").groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("sure"))))).alias("known")).filter(F.col("known") >= least)
        known = seeds.unionByName(new.join(seeds.select("value").distinct(), "value", "left_anti").select("kind", "value", "known"))
    return sure.filter(F.col("sure") >= least)


def find(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs but text, with base and added: arrays of (kind, start, end) in code points; kind is a number of KINDS.

    Null text is empty; rows that repeat keep their places; long texts are one row as any other; an empty table gives an empty
    table. Added spans don't overlap base ones; a token that patterns of several kinds lead to has the kind they are surest of.
    Columns of docs named base, instances, added, __row are replaced.
    """
    docs = docs.drop("base", "instances", "added", "__row").withColumn("__row", F.monotonically_increasing_id())
    kept = [f for f in docs.schema.fields if f.name != "text"]
    spans = "array<struct<kind:int,start:int,end:int>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"base {spans}", "instances array<struct<kind:int,start:int,end:int,pattern:string,value:string>>"])
    rows = cut(docs.mapInArrow(_scan, schema))
    each = rows.filter(F.size("instances") > 0).select("__row", F.inline("instances"))
    sure = learn(each, **options)
    hits = each.filter("kind = -1").drop("kind").join(sure, "pattern")
    best = hits.groupBy("__row", "start", "end").agg(F.max_by("kind", F.struct("sure", -F.col("kind"))).alias("kind"))
    added = best.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    return rows.drop("instances").join(added, "__row", "left").withColumn("added", F.coalesce("added", F.array().cast(spans))).drop("__row")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7(docs: DataFrame) -> DataFrame:
    out = find(docs.select("doc_id", "text"))
    count = lambda no: F.size(F.filter("base", lambda s: s["kind"] == no)).cast("long")
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
