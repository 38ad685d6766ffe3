"""Mixing sources to target weights with a low-discrepancy schedule.

Slot k of the mix is the point frac(k * golden ratio); the source whose interval of cumulative weights holds it gets the slot.
A source's slots are ranked, and slot r takes the r-th block of the source's shuffled word stream. All blocks have equally many
words; a stream starts again when it ends, so a block may span two epochs. The points alone decide how many slots a source gets:
for so even a sequence that is its share of all slots but for a few, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, word_count

#: Fixed values of the contract: weights by rank of source, and how often a source may be repeated at most.
WEIGHTS, REPEATS = (5, 2, 1), 3
GOLDEN = 0.6180339887498949
#: A table of at most so many sources is broadcast.
MOST_BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target double) from (source, source_size).

    Targets share the sum of all sizes by weight; one that exceeds repeats times its source's size stops there, and the others
    share the excess by weight until none is above. The result is min(repeats * size, level * weight) for one level, which
    is found by one pass over sources in order of the level at which each stops. Null is a source of its own, the last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    given = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    given = given.withColumn("stop", F.lit(float(repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    given = given.withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "stopped": F.coalesce(F.sum("stop").over(before), F.lit(0.0)),
            "open": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    # sources before the first whose stop is not reached at the level they would all share are the ones that stop
    given = given.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open"))
    given = given.withColumn("free", F.col("level") * F.col("w") <= F.col("stop"))
    given = given.withColumn("at", F.min_by("level", F.when(F.col("free"), F.struct(F.col("stop") / F.col("w"), F.coalesce("source", F.lit("")), F.col("source").isNull()))).over(everything))
    target = F.when(F.col("at").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("at") * F.col("w")))
    return given.select("source", "source_size", target.alias("target"))


def _running(df: DataFrame, key: str, bucket: str, order: list, amount: Column, out: str) -> DataFrame:
    """df with the sum of amount over the earlier rows of the same key, in two levels: no task needs all rows of a key."""
    within = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key, bucket).agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(key).alias("__key"), F.col(bucket).alias("__bucket"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    placed = df.withColumn("__in", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    joined = placed.join(starts, placed[key].eqNullSafe(starts["__key"]) & (placed[bucket] == starts["__bucket"]))
    return joined.withColumn(out, (F.col("__start") + F.col("__in")).cast("long")).drop("__key", "__bucket", "__start", "__in")


def _place(rows: DataFrame) -> DataFrame:
    """rows with start (words before it in its source's stream) and row_no (its number there), in the order of the shuffle."""
    order = Window.partitionBy("source_no", "__bucket").orderBy("__mix")
    rows = rows.withColumn("row_no", F.row_number().over(order).cast("long")).withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = rows.groupBy("source_no", "__bucket").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_no", "__bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"))
    rows = rows.join(starts, ["source_no", "__bucket"])
    return rows.withColumns({"start": F.col("start") + F.col("__s0"), "row_no": F.col("row_no") + F.col("__n0") - 1})


def _point(k: Column) -> Column:
    """frac(k * golden ratio), with k in two parts so that large k keep their precision."""
    high = (GOLDEN * (1 << 20)) % 1.0
    part = F.shiftright(k, 20).cast("double") * F.lit(high) + (k % (1 << 20)).cast("double") * F.lit(GOLDEN)
    return part - F.floor(part)


def schedule(targets: DataFrame, slots: int, point=_point, cells: int = 4096) -> DataFrame:
    """(source_no, rank, slot): which slot of the mix takes which block of which source. targets: (source_no, target).

    point gives a number from 0 to 1 for each slot. Points find their interval of cumulative weights by an equal cell first, then
    by the interval's bounds.
    """
    spark = targets.sparkSession
    order = Window.orderBy("source_no")
    share = targets.filter("target > 0").withColumn("high", F.sum("target").over(order) / F.sum("target").over(Window.partitionBy()))
    share = share.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0))).withColumn("high", F.when(F.lead("high").over(order).isNull(), F.lit(1.5)).otherwise(F.col("high")))
    last = F.lit(cells - 1)
    by_cell = share.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("low") * cells), last).cast("int"), F.least(F.floor(F.col("high") * cells), last).cast("int"))))
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * cells).cast("int"))
    hit = points.join(by_cell.select("cell", "low", "high", "source_no"), "cell").filter("u >= low AND u < high").select("slot", "source_no")
    hit = hit.withColumn("stretch", F.shiftright("slot", 14))
    return _running(hit, "source_no", "stretch", ["slot"], F.lit(1).cast("long"), "rank").select("source_no", "rank", "slot")


def _hashes(docs: DataFrame, seed: int) -> tuple[Column, Column]:
    """Two hashes of each whole row: 128 bits, in which no two rows that differ agree."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(F.lit(seed), *cols).alias("__mix"), F.xxhash64(F.lit(seed + 100), *cols).alias("__mix2")


def mix(docs: DataFrame, slots: int = 1 << 18, most_block: int = 1 << 16, seed: int = 11, rows_a_bucket: int = 20_000, point=_point) -> tuple[DataFrame, DataFrame]:
    """(streams, pieces): documents placed in their source's shuffled stream, and what each slot of the mix takes of them.

    streams: the columns of docs but text, with size, source_size, target, source_no and row_no (unique for each row of a source).
    pieces: slot, source_no, row_no, epoch (0 to 2), from_word, to_word (in the document; the end is exclusive).
    The mix has about as many words as docs, in `slots` slots, or as many as keep a block at most_block words. Texts are read once;
    what follows works on their sizes. A source's stream ends after REPEATS epochs, and a slot past its end takes nothing. Null
    text has size 0 and no piece; null source is a source; repeated rows are rows of their own; an empty table gives two empty
    tables. Columns of docs named like those added are replaced. Windows without a partition run over sources only.
    """
    cols = [c for c in docs.columns if c not in ("text", "size", "source_size", "target", "source_no", "row_no", "start", "__mix", "__mix2", "__bucket")]
    rows = cut(docs.select(*[F.col(f"`{c}`") for c in cols], word_count(F.col("text")).alias("size"), *_hashes(docs, seed)))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    targets = cut(targets.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")))
    sums = targets.agg(F.sum("source_size"), F.sum("target")).first()
    buckets = max(16, rows.count() // rows_a_bucket)
    block = max(1, min(most_block, -(-(sums[0] or 0) // slots)))
    named = targets.select(F.col("source").alias("__s"), "source_size", "target", "source_no")
    streams = rows.join(F.broadcast(named) if named.count() <= MOST_BROADCAST_SOURCES else named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    streams = _place(streams.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__mix"), F.lit(buckets))))
    streams = cut(streams.drop("__bucket"))
    epochs = streams.filter("size > 0").select("source_no", "row_no", "size", "start", "source_size")
    epochs = epochs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))).withColumn("p", F.col("start") + F.col("epoch") * F.col("source_size"))
    epochs = epochs.withColumn("end", F.col("p") + F.col("size"))
    split = epochs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("p") / block), F.floor((F.col("end") - 1) / block))))
    split = split.withColumns(
        {"from_word": F.greatest(F.col("p"), F.col("rank") * block) - F.col("p"), "to_word": F.least(F.col("end"), (F.col("rank") + 1) * block) - F.col("p")}
    )
    plan = schedule(targets, round((sums[1] or 0) / block), point)
    pieces = split.join(plan, ["source_no", "rank"]).select("slot", "source_no", "row_no", "epoch", "from_word", "to_word")
    return streams.drop("start"), pieces


def takes(streams: DataFrame, pieces: DataFrame) -> DataFrame:
    """streams with taken, the words that the mix takes of each document, repeats counted, and first_slot, the first slot that does (or null)."""
    got = pieces.groupBy("source_no", "row_no").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"))
    return streams.join(got, ["source_no", "row_no"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, seed: int = 11, with_slot: bool = False, **options) -> DataFrame:
    """The mix as documents: a row with the columns of docs for each epoch of each document taken, its text cut to the words taken.

    In one epoch the words taken of a document are one run from its first word, as ranks are taken in order; only where a source's
    slots end is it shorter than the document. A shorter text keeps everything up to the last word taken, blanks as they were. A
    text without words has no place in the mix. Texts move once, to the runs taken of them. with_slot adds the column slot: the
    first slot of the mix that a run fills, by which the mix is in order.
    """
    streams, pieces = mix(docs, seed=seed, **options)
    runs = pieces.groupBy("source_no", "row_no", "epoch").agg(F.max("to_word").alias("b"), F.min("slot").alias("__slot"))
    runs = streams.select("source_no", "row_no", "size", "__mix", "__mix2").join(runs, ["source_no", "row_no"])
    runs = runs.select("__mix", "__mix2", F.col("size").alias("__size"), F.col("b").alias("__b"), "__slot")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    one = docs.select(F.struct(*cols).alias("row"), *_hashes(docs, seed)).dropDuplicates(["__mix", "__mix2"])
    gaps, said = F.split("row.text", WORD, -1), F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    b = F.col("__b").cast("int")
    cut_text = F.array_join(F.zip_with(F.slice(gaps, F.lit(1), b), F.slice(said, F.lit(1), b), lambda x, y: F.concat(x, y)), "")
    text = F.when(F.col("__b") == F.col("__size"), F.col("row.text")).otherwise(cut_text).alias("text")
    out = one.join(runs, ["__mix", "__mix2"])
    return out.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns], *([F.col("__slot").alias("slot")] if with_slot else []))


def op2(docs: DataFrame) -> DataFrame:
    streams, pieces = mix(docs.select("doc_id", "source", "text"))
    return takes(streams, pieces).select("doc_id", "size", "source_size", "target", "taken", "first_slot")
