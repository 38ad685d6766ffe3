"""Reads over the evidence model: pages with totals, latest rows, subjects, evidence, documents, images, boards, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import dealt, numbered, running


def page_with_total(rows: DataFrame, order: list, size: int = 50, offset: int = 0) -> DataFrame:
    """A page in order, with position (from 1, within the page) and total (of all rows). order ends in a key, so that pages never overlap."""
    total = rows.count()
    top = rows.orderBy(*order).offset(max(0, offset)).limit(size)
    return top.withColumns({"position": F.row_number().over(Window.orderBy(*order)), "total": F.lit(total).cast("long")})


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in this order: the latest derivative, review, revision or state."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def subjects(refs: DataFrame, entities: DataFrame, identifiers: DataFrame, relationships: DataFrame) -> DataFrame:
    """refs (subject_kind, subject_id) with label; each kind is looked up in its own table (id, label), unknown subjects are left out."""
    found = None
    for kind, table in (("entity", entities), ("identifier", identifiers), ("relationship", relationships)):
        one = refs.filter(F.col("subject_kind") == kind).join(table.select(F.col("id").alias("subject_id"), "label"), "subject_id")
        found = one if found is None else found.unionByName(one)
    return found


def evidence_artifacts(links: DataFrame, observations: DataFrame, captures: DataFrame) -> DataFrame:
    """links (evidence_kind, evidence_id, ...) with artifact_id: itself, that of the observation, or the first one of the capture.

    observations: id, artifact_id. captures: id, artifact_id, row_seq.
    """
    rest = links.columns
    own = links.filter("evidence_kind = 'artifact'").withColumn("artifact_id", F.col("evidence_id"))
    seen = links.filter("evidence_kind = 'observation'").join(observations.select(F.col("id").alias("evidence_id"), "artifact_id"), "evidence_id")
    first = captures.groupBy(F.col("id").alias("evidence_id")).agg(F.min_by("artifact_id", "row_seq").alias("artifact_id"))
    held = links.filter("evidence_kind = 'capture'").join(first, "evidence_id")
    return own.select(*rest, "artifact_id").unionByName(seen.select(*rest, "artifact_id")).unionByName(held.select(*rest, "artifact_id"))


def evidence_of_clusters(links: DataFrame, merges: DataFrame) -> DataFrame:
    """links to entities with canonical_id and place (from 1), in order of time, then id, within the merged entity."""
    who = links.filter("subject_kind = 'entity'").join(merges.select(F.col("entity_id").alias("subject_id"), F.col("canonical_id").alias("__c")), "subject_id", "left")
    named = who.withColumn("canonical_id", F.coalesce("__c", "subject_id")).drop("__c")
    return numbered(named, ["canonical_id"], ["created_utc", "id"], "place").withColumn("place", F.col("place").cast("int"))


def entity_views(entities: DataFrame, merges: DataFrame, identifiers: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each canonical entity: id, display_name, aliases and identifiers (sorted), neighbours (distinct others, merged ones as one)."""
    root = merges.select(F.col("entity_id").alias("id"), F.col("canonical_id").alias("__c"))
    who = entities.select("id", "display_name").join(root, "id", "left").withColumn("canonical_id", F.coalesce("__c", "id")).drop("__c")
    base = who.groupBy("canonical_id").agg(
        F.max(F.when(F.col("id") == F.col("canonical_id"), F.col("display_name"))).alias("display_name"),
        F.array_sort(F.collect_list(F.when(F.col("id") != F.col("canonical_id"), F.col("display_name")))).alias("aliases"),
    )
    of = who.select(F.col("id"), "canonical_id")
    known = identifiers.join(of.withColumnRenamed("id", "entity_id"), "entity_id").groupBy("canonical_id").agg(F.array_sort(F.collect_set("normalized")).alias("identifiers"))
    ends = edges.select(F.col("from_entity").alias("a"), F.col("to_entity").alias("b"))
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    one = both.join(of.select(F.col("id").alias("a"), "canonical_id"), "a").join(of.select(F.col("id").alias("b"), F.col("canonical_id").alias("__o")), "b", "left")
    near = one.withColumn("other", F.coalesce("__o", "b")).filter("other <> canonical_id").groupBy("canonical_id").agg(F.countDistinct("other").alias("neighbours"))
    out = base.join(known, "canonical_id", "left").join(near, "canonical_id", "left")
    return out.select(F.col("canonical_id").alias("id"), "display_name", "aliases", F.coalesce("identifiers", F.array().cast("array<string>")).alias("identifiers"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def document_states(artifacts: DataFrame, blobs: DataFrame, files: DataFrame, head_bytes: int = 2 << 20) -> DataFrame:
    """(artifact_id, state, head): unrecorded (no blob), shredded (no key), lost (no file), damaged (other content), readable; head only of the last.

    artifacts: artifact_id, content_hash. blobs: content_hash, wrapped_key. files: content_hash, content (binary). The hash is worked out again.
    """
    b = blobs.select("content_hash", F.lit(True).alias("known"), F.col("wrapped_key").isNotNull().alias("key"))
    f = files.select("content_hash", "content", F.sha2("content", 256).alias("actual"))
    j = artifacts.join(b, "content_hash", "left").join(f, "content_hash", "left")
    state = (
        F.when(F.col("known").isNull(), "unrecorded").when(~F.col("key"), "shredded").when(F.col("content").isNull(), "lost")
        .when(F.col("actual") != F.col("content_hash"), "damaged").otherwise("readable")
    )
    return j.select("artifact_id", state.alias("state"), F.when(state == "readable", F.substring("content", 1, head_bytes)).alias("head"))


def gap_rows(extractions: DataFrame) -> DataFrame:
    """(run_id, artifact_id, gap_kind, magnitude, unit) from extraction counters: bytes of text left out, values left out; none where they are 0."""
    part = lambda column, kind, unit: extractions.filter(F.col(column) > 0).select("run_id", "artifact_id", F.lit(kind).alias("gap_kind"), F.col(column).cast("long").alias("magnitude"), F.lit(unit).alias("unit"))
    return part("text_truncated_bytes", "text_truncated", "bytes").unionByName(part("skipped_oversize", "value_oversize", "values"))


def pointer_value(document: Column, pointer: Column) -> Column:
    """The value at an RFC 6901 pointer of a JSON text, scalars as text; null if there is none. Whole numbers in it are places of a list."""
    parts = F.filter(F.split(pointer, "/"), lambda p: p != "")
    name = lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    step = F.transform(parts, lambda p: F.when(p.rlike("^(0|[1-9][0-9]*)$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("['"), name(p), F.lit("']"))))
    return F.call_function("get_json_object", document, F.concat(F.lit("$"), F.array_join(step, "")))


def nearest_rank(rows: DataFrame, column: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """(percent, value): the value at place floor((n - 1) * percent / 100) of the sorted column, from 0. Counts by value are summed up, not rows."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    counts = dealt(counts, [], ["v"])
    n = counts.agg(F.sum("c")).first()[0] or 0
    placed = running(counts, [], ["v"], F.col("c"), "last").withColumn("n", F.lit(n).cast("long"))
    wanted = placed.select("v", "c", "last", "n", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"))
    at = F.floor((F.col("n") - 1) * F.col("percent") / 100)
    return wanted.filter((at < F.col("last")) & (at >= F.col("last") - F.col("c"))).select("percent", F.col("v").alias("value"))


def images(candidates: DataFrame, domains: tuple = (), date_from: str = "", date_to: str = "", title: str = "", least_bytes: int = 0, most_bytes: int | None = None, eligible: tuple = ("image/",)) -> DataFrame:
    """Image candidates (domain, indexed, title, media_type, byte_length) that all given filters allow; title is a part of it in any case."""
    ok = F.lit(False)
    for e in eligible:
        ok = ok | F.col("media_type").startswith(e)
    if domains:
        ok = ok & F.col("domain").isin(*domains)
    if date_from:
        ok = ok & (F.substring("indexed", 1, 10) >= date_from)
    if date_to:
        ok = ok & (F.substring("indexed", 1, 10) <= date_to)
    if title:
        ok = ok & F.contains(F.lower("title"), F.lit(title.lower()))
    ok = ok & (F.col("byte_length") >= least_bytes)
    return candidates.filter(ok & (F.col("byte_length") <= most_bytes) if most_bytes is not None else ok)


def group_sizes(matches: DataFrame, key: str = "domain") -> DataFrame:
    """(key, n) of all matches, before any page is cut."""
    return matches.groupBy(key).agg(F.count("*").alias("n"))


def words_filter(rows: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose column holds every word of the query, in any case and order."""
    ok = F.lit(True)
    for w in query.lower().split():
        ok = ok & F.contains(F.lower(column), F.lit(w))
    return rows.filter(ok)


def hydrated_board(board: DataFrame, entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(node_id, canonical_id, name, notice) of a board's nodes (node_id, name): names as they are now; notice is merged, renamed, missing or null."""
    now = entities.select(F.col("id").alias("node_id"), F.col("display_name").alias("__own"))
    j = board.join(now, "node_id", "left").join(merges.select(F.col("entity_id").alias("node_id"), F.col("canonical_id").alias("__c")), "node_id", "left")
    j = j.withColumn("canonical_id", F.when(F.col("__own").isNotNull(), F.coalesce("__c", "node_id")))
    j = j.join(entities.select(F.col("id").alias("canonical_id"), F.col("display_name").alias("__now")), "canonical_id", "left")
    notice = F.when(F.col("__own").isNull(), "missing").when(F.col("__c").isNotNull(), "merged").when(F.col("__now") != F.col("name"), "renamed")
    return j.select("node_id", "canonical_id", F.coalesce("__now", "name").alias("name"), notice.alias("notice"))


def resolution_history(decisions: DataFrame) -> DataFrame:
    """Decisions (id, left_entity, right_entity, action, reverses_id, row_seq), newest first by place, with reversed: whether a later one takes it back."""
    back = decisions.filter("reverses_id IS NOT NULL").select(F.col("reverses_id").alias("id"), F.lit(True).alias("__b")).distinct()
    j = decisions.join(back, "id", "left").withColumn("reversed", F.coalesce("__b", F.lit(False))).drop("__b")
    pair = Window.partitionBy(F.least("left_entity", "right_entity"), F.greatest("left_entity", "right_entity")).orderBy(F.desc("row_seq"))
    return j.withColumn("place", F.row_number().over(pair))


def split(decisions: DataFrame) -> DataFrame:
    """Pairs that stand merged once splits count: the latest decision that no later one reverses is a merge."""
    left = resolution_history(decisions).filter("NOT reversed AND action IN ('merge', 'reject')")
    last = left.groupBy(F.least("left_entity", "right_entity").alias("a"), F.greatest("left_entity", "right_entity").alias("b")).agg(F.max_by("action", "row_seq").alias("action"))
    return last.filter("action = 'merge'").select(F.col("a").alias("left_entity"), F.col("b").alias("right_entity"))


def with_latest_review(suggestions: DataFrame, reviews: DataFrame) -> DataFrame:
    """suggestions (id, ...) with decision: that of the latest review (suggestion_id, decision, row_seq), pending without one."""
    last = reviews.groupBy(F.col("suggestion_id").alias("id")).agg(F.max_by("decision", "row_seq").alias("decision"))
    return suggestions.join(last, "id", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def accepted_links(reviews: DataFrame, merges: DataFrame) -> DataFrame:
    """(item_id, canonical_id): items whose latest review (item_id, entity_id, decision, row_seq) links them to an entity, merged ones resolved."""
    last = reviews.groupBy("item_id").agg(F.max_by(F.struct("entity_id", "decision"), "row_seq").alias("r")).filter("r.decision = 'accepted'").select("item_id", "r.entity_id")
    return last.join(merges, "entity_id", "left").select("item_id", F.coalesce("canonical_id", "entity_id").alias("canonical_id")).distinct()


def mark_stale(items: DataFrame, sampled: DataFrame) -> DataFrame:
    """items (artifact_id, at, run_seq, ...) with stale: whether a later run (artifact_id, at, run_seq) sampled the same place, found something or not."""
    last = sampled.groupBy("artifact_id", "at").agg(F.max("run_seq").alias("__last"))
    return items.join(last, ["artifact_id", "at"], "left").withColumn("stale", F.coalesce(F.col("__last") > F.col("run_seq"), F.lit(False))).drop("__last")


def live_groups(groups: DataFrame, items: DataFrame, excluded: DataFrame) -> DataFrame:
    """(group_id, members): groups (group_id, item_id) without stale items (item_id, stale), their members without excluded ones (group_id, item_id)."""
    bad = groups.join(items.filter("stale").select("item_id"), "item_id", "left_semi").select("group_id").distinct()
    kept = groups.join(bad, "group_id", "left_anti").join(excluded.select("group_id", "item_id"), ["group_id", "item_id"], "left_anti")
    return kept.groupBy("group_id").agg(F.count("*").alias("members"))


def group_ids(members: DataFrame, model: str) -> DataFrame:
    """(group, group_id, members): the id of a group (group, item_id) is the hash of the model and its sorted members, so it names them."""
    of = members.groupBy("group").agg(F.array_sort(F.collect_set("item_id")).alias("m"))
    return of.select("group", F.sha2(F.concat(F.lit(model + ":"), F.array_join("m", ",")), 256).alias("group_id"), F.size("m").alias("members"))


def index_status(observations: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """One row: observations (id, value), indexed, stale (value has another hash now, or another model), missing. embedded: observation_id, model_identity, value_hash."""
    o = observations.select(F.col("id").alias("observation_id"), F.sha2("value", 256).alias("now"))
    j = o.join(embedded, "observation_id", "left")
    fresh = F.coalesce((F.col("value_hash") == F.col("now")) & (F.col("model_identity") == model), F.lit(False))
    return j.agg(F.count("*").alias("observations"), F.count_if(fresh).alias("indexed"), F.count_if(F.col("value_hash").isNotNull() & ~fresh).alias("stale"), F.count_if(F.col("value_hash").isNull()).alias("missing"))


def to_embed(observations: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Observations whose vector is missing, of another model, or of a value that has changed since: all that a rebuild must work out."""
    same = embedded.filter(F.col("model_identity") == model).select(F.col("observation_id").alias("id"), F.col("value_hash").alias("__h"))
    o = observations.withColumn("__n", F.sha2("value", 256)).join(same, "id", "left")
    return o.filter(F.col("__h").isNull() | (F.col("__h") != F.col("__n"))).drop("__h", "__n")


def guide_status(**counts: DataFrame) -> DataFrame:
    """One row: how many rows each table has, by name. Each is one aggregate, stacked and pivoted."""
    rows = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.max(F.when(F.col("name") == k, F.col("n"))).alias(k) for k in counts])


def best_model(models: DataFrame, gate: float) -> DataFrame:
    """The model (id, quality, bytes) over the gate that is best, then smallest, then first by id; none if none is."""
    return models.filter(F.col("quality") >= gate).orderBy(F.desc("quality"), "bytes", "id").limit(1)


def call_bounds(tasks: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, calls, credits): at most so many calls and credits for tasks (source) by what each source (source, calls_each, credits_each) takes."""
    n = tasks.groupBy("source").agg(F.count("*").alias("n"))
    return n.join(sources, "source").select("source", (F.col("n") * F.col("calls_each")).alias("calls"), (F.col("n") * F.col("credits_each")).alias("credits"))


#: Fixed value: the largest latitude that a web map shows.
MOST_LATITUDE = 85.0511


def on_map(locations: DataFrame, words: str = "") -> DataFrame:
    """Locations (label, uncertainty, latitude, ...) whose label or uncertainty has the words, in any case, with mapped: whether a map can show them."""
    said = F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("uncertainty", F.lit(""))))
    return locations.filter(F.contains(said, F.lit(words.lower()))).withColumn("mapped", F.coalesce(F.abs("latitude") <= MOST_LATITUDE, F.lit(False)))


def submitted_keys(runs: DataFrame, parent: str) -> DataFrame:
    """(kind, normalized): the distinct selectors in the plans of runs (plan: JSON with selectors and parent) of one import. Broken plans have none."""
    plan = F.from_json("plan", "parent struct<id:string>, selectors array<struct<kind:string,normalized:string>>")
    rows = runs.select(plan.alias("p")).filter(F.col("p.parent.id") == parent)
    return rows.select(F.inline("p.selectors")).distinct()
