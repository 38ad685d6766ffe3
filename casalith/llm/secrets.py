"""Secret scans with corpus-wide ownership frequency.

Patterns give candidates; the hash of each candidate's value is counted by distinct owners and repositories over the whole corpus.
A value that many own, or that is in many repositories, is an example that was copied around; one that few own and that looks
random is taken for live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let
from .decontaminate import shingle_hashes, simhash

#: Fixed values of the contract: kinds in their order, patterns, the group whose length counts, and the least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: What the method adds where ownership says so: long mixed tokens that no base pattern names.
BARE = ("bare", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
KINDS = [k for k, *_ in (*BASE, BARE)]
#: Texts of one repository whose fingerprints differ in so many bits at most count as one owner.
NEAR = 3
#: A value in more rows than this is joined by broadcast.
HOT = 1_000_000


def _starts(sizes: Column, block: int = 128) -> Column:
    """array<int>: the sum of the sizes before each one, in two levels, so that many sizes don't cost their square."""

    def of(n):
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(n, b * block + 1, F.lit(block)), F.lit(0), lambda a, x: a + x))
        total = lambda some: F.aggregate(some, F.lit(0), lambda a, x: a + x)
        one = lambda s: F.transform(F.sequence(F.lit(0), F.size(n) - 1), lambda i: total(F.slice(s, F.lit(1), F.floor(i / block).cast("int"))) + total(F.slice(n, F.floor(i / block).cast("int") * block + 1, i % block)))
        return let(sums, one)

    return let(sizes, of)


def spans_of(text: Column, no: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>>: leftmost non-overlapping matches; start and end count code points.

    The gaps between matches and the matches themselves add up to positions.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def spans(parts):
        def span(x, at):
            start = at + F.length(x.gap)
            return F.struct(start.alias("start"), F.lit(no).alias("kind"), (start + F.length(x.hit)).alias("end"), x.value.alias("value"))

        sizes = F.transform(parts, lambda x: F.length(x.gap) + F.length(x.hit))
        return F.filter(F.zip_with(parts, _starts(sizes), span), lambda s: F.length(s.value) >= least)

    gaps = F.split(text, pattern, -1)
    hits, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"), hits.alias("hit"), values.alias("value"))
    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(none)


def entropy(value: Column) -> Column:
    """Bits a character of the value's own character counts."""
    chars = F.array_remove(F.split(value, ""), "")
    each = lambda cs: F.aggregate(F.array_distinct(cs), F.lit(0.0), lambda a, c: a - let(F.size(F.filter(cs, lambda x: x == c)) / F.size(cs), lambda p: p * F.log2(p)))
    return let(chars, each)


def ownership(candidates: DataFrame, most: int = 3) -> DataFrame:
    """(hash, repos, owners, n): how many repositories and owners hold each value of candidates (hash, repo, owner, likeness), and in how many rows.

    Owners are counted up to most + 1. Within a repository, owners whose likeness (a SimHash) differs in NEAR bits at most from a
    leading one's count as one: a copy of a document in its own repository is no other owner, one in another repository is. Each
    round takes a leading owner of every value and all that count as one with it. An owner in several places counts once. Distinct
    pairs come first, with partial aggregation, so a value that many hold makes no task large. A null repository or owner counts as one.
    """
    each = candidates.select("hash", "owner", F.struct(F.coalesce(F.col("repo").cast("string"), F.lit("\x00")).alias("repo"), "likeness").alias("x"))
    spread = each.groupBy("hash", F.col("x.repo").alias("repo")).agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    rest = cut(each.groupBy("hash", "owner").agg(F.min("x").alias("x")).select("hash", "x.*").distinct())
    found = None
    for _ in range(most + 1):
        lead = rest.groupBy("hash").agg(F.min(F.struct("repo", "likeness")).alias("lead"))
        one = lead.select("hash", F.lit(1).alias("owners"))
        found = one if found is None else found.unionByName(one)
        near = (F.col("repo") == F.col("lead.repo")) & (F.bit_count(F.col("likeness").bitwiseXOR(F.col("lead.likeness"))) <= NEAR)
        rest = cut(rest.join(lead, "hash").filter(~near).drop("lead"))
    return found.groupBy("hash").agg(F.sum("owners").alias("owners")).join(spread, "hash")


def _named(each: DataFrame, held: DataFrame) -> DataFrame:
    """each with what held says of its hash. Values in over HOT rows, of which there are at most 1/HOT as many as rows, are broadcast."""
    hot = held.filter(F.col("n") > HOT)
    both = each.join(F.broadcast(hot.select("hash", F.struct("repos", "owners").alias("h"))), "hash", "left")
    rest = both.filter("h IS NULL").drop("h").join(held.filter(F.col("n") <= HOT).select("hash", "repos", "owners"), "hash")
    return rest.unionByName(both.filter("h IS NOT NULL").select(*each.columns, "h.repos", "h.owners"))


def scan(docs: DataFrame, repo: str = "source", owner: str = "doc_id", most_owners: int = 3, most_repos: int = 2, least_bits: float = 3.0) -> DataFrame:
    """All columns of docs but text, with base and added: arrays of spans (start, kind, end, value, live).

    A row that repeats keeps its place; null text is empty; a long text is one row as any other. Columns of docs named base,
    bare, added, n_live, n_example, __row, __h, __like are replaced. Live: held by most_owners and in most_repos repositories at
    most, with least_bits of entropy a character or more; any other value is an example. All base spans stay, whatever they are;
    of the bare ones only live ones are added. n_live and n_example count the row's distinct candidate values by verdict.
    """
    docs = docs.drop("base", "bare", "added", "n_live", "n_example", "__row", "__h", "__like")
    text = F.coalesce("text", F.lit(""))
    base = F.array_sort(F.concat(*[spans_of(text, i, p, g, n) for i, (_, p, g, n) in enumerate(BASE)]))
    mixed = lambda s: s.value.rlike("[0-9]") & s.value.rlike("[A-Za-z]")
    bare = F.filter(spans_of(text, len(BASE), *BARE[1:]), mixed)
    found = docs.withColumns({"base": base, "bare": bare, "__row": F.monotonically_increasing_id()})
    some = (F.size("base") > 0) | (F.size("bare") > 0)
    found = found.withColumn("__h", F.when(some, shingle_hashes(text, 3))).withColumn("__like", F.when(some, F.when(F.size("__h") > 0, simhash("__h")).otherwise(F.xxhash64(text)))).drop("text", "__h")
    clear = F.filter("bare", lambda b: ~F.exists("base", lambda s: (s.start < b.end) & (b.start < s.end)))
    found = cut(found.withColumn("bare", clear))
    each = found.filter((F.size("base") > 0) | (F.size("bare") > 0)).select(
        "__row", F.col(f"`{repo}`").alias("repo"), F.col(f"`{owner}`").alias("owner"), F.col("__like").alias("likeness"), F.explode(F.concat("base", "bare")).alias("s")
    )
    each = each.withColumn("hash", F.sha2("s.value", 256))
    judged = _named(each.select("__row", "s", "hash"), cut(ownership(each, most_owners)))
    live = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos) & (entropy(F.col("s.value")) >= least_bits)
    judged = judged.withColumn("live", live)
    by_row = judged.groupBy("__row").agg(
        F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", "s.value", "live"))).alias("all"),
        F.size(F.collect_set(F.when(F.col("live"), F.col("hash")))).cast("long").alias("n_live"),
        F.size(F.collect_set(F.when(~F.col("live"), F.col("hash")))).cast("long").alias("n_example"),
    )
    out = found.drop("base", "bare", "__like").join(by_row, "__row", "left").drop("__row")
    every = F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,end:int,value:string,live:boolean>>"))
    bare_no, zero = len(BASE), F.lit(0).cast("long")
    return out.withColumns(
        {
            "base": F.filter(every, lambda s: s.kind < bare_no), "added": F.filter(every, lambda s: (s.kind == bare_no) & s.live),
            "n_live": F.coalesce("n_live", zero), "n_example": F.coalesce("n_example", zero),
        }
    ).drop("all")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s.kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s.start.cast("string"), s.end.cast("string"))), ",")


def op10(docs: DataFrame) -> DataFrame:
    out = scan(docs.select("doc_id", "text", "source"))
    count = lambda no: F.size(F.filter("base", lambda s: s.kind == no)).cast("long")
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)],
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.array_join(F.transform(F.array_sort(F.concat("base", "added")), lambda s: F.when(s.live, "live").otherwise("example")), ",").alias("verdicts"),
        "n_live",
        "n_example",
    )
