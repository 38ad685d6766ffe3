"""Groups of texts that share most of their five-word shingles, for the corpus pipeline.

SimHash fingerprints within 3 bits, found by the pivot tables of simhash, are candidates. At a Jaccard similarity of 0.8 two
64-bit fingerprints differ in 10 bits on average, which no index over 3 bits finds; so equal bands of min-hashes give the other
candidates. All candidates are verified by their shingle sets (64 bits a shingle): first by two pairs of each text in a bucket,
then, where these leave a bucket in several groups, by every pair of texts that no link has joined yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .simhash import fingerprint, fingerprint_links, hashes

BANDS, ROWS = 24, 5
#: A bucket with more shingles than this is compared in cells of about this many; every two texts meet in one cell.
CELL_SHINGLES = 4_000_000
_DRAW = np.random.default_rng(7)
_MULTIPLY = _DRAW.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _DRAW.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def bands(h: np.ndarray) -> np.ndarray:
    """A hash of the least values of each band's ROWS permutations; of no shingles: all alike."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        for j in range(BANDS * ROWS):
            low[j] = min(low[j], (part * _MULTIPLY[j] + _ADD[j]).min())
    mixed = np.zeros(BANDS, np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        mixed = (mixed ^ (column >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15) + column
    return mixed.view(np.int64)


def _sketches(text: Column, n: int) -> Column:
    @F.pandas_udf("f long, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            f, b = [], []
            for t in texts:
                f.append(fingerprint(hashes(t, 3)))
                b.append(bands(hashes(t, n)))
            yield pd.DataFrame({"f": np.array(f, np.uint64).view(np.int64), "bands": b})

    return of(text)


def shingle_sets(text: Column, n: int) -> Column:
    """array<long>: the hash of each distinct shingle."""

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(hashes(t, n)).view(np.int64) for t in texts])

    return of(text)


def _cell_links(root: np.ndarray, offsets: np.ndarray, values: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between the roots of alike texts of a cell: all pairs of different roots are compared, but for those linked by then.

    values[offsets[i] : offsets[i + 1]] is the set of text i. Each shingle's list of texts gives the common counts of one text
    with all others at once.
    """
    size = np.diff(offsets)
    _, token = np.unique(values, return_inverse=True)
    holders = np.repeat(np.arange(len(size)), size)[np.argsort(token, kind="stable")]
    ends = np.cumsum(np.bincount(token)) if len(token) else np.empty(0, np.int64)
    names, group = np.unique(root, return_inverse=True)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    left, out = np.ones(len(size), bool), []
    for first in range(len(names)):
        if not left[members[first][0]]:
            continue
        front = members[first].tolist()
        left[front] = False
        while front and left.any():
            x = front.pop()
            lists = [holders[ends[t - 1] if t else 0 : ends[t]] for t in token[offsets[x] : offsets[x + 1]]]
            common = np.bincount(np.concatenate(lists), minlength=len(size)) if lists else np.zeros(len(size), np.int64)
            for y in np.unique(group[left & (common >= least * (size[x] + size - common))]):
                out.append((int(names[first]), int(names[y])))
                left[members[y]] = False
                front += members[y].tolist()
    return out


def _cells_links(least: float):
    """Over rows (band, value, part, root, set) in order of the first three: the links of each cell."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: pa.Table) -> pa.RecordBatch:
            sets = rows.column("set").combine_chunks()
            sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
            offsets = np.asarray(sets.offsets).astype(np.int64)
            values = np.asarray(sets.values)[offsets[0] : offsets[-1]]
            x = np.array(_cell_links(np.asarray(rows.column("root")), offsets - offsets[0], values, least), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

        kept: list[pa.Table] = []
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            keys = np.stack([np.asarray(rows.column(c)).astype(np.int64) for c in ("band", "value", "part")])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), rows.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                here = tuple(keys[:, s].tolist())
                if kept and here != last:
                    yield linked(pa.concat_tables(kept))
                    kept = []
                kept.append(rows.slice(s, e - s))
                last = here
        if kept:
            yield linked(pa.concat_tables(kept))

    return of


def _rest_links(each: DataFrame, found: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links between the roots (node, root) of texts that share a bucket (k, band, value, n) and are alike.

    In buckets of three or fewer all pairs were compared before; buckets within one group need nothing more.
    """
    rooted = cut(each.filter("n > 3").select("k", "band", "value").join(found.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")))
    several = rooted.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band", "value")
    sized = cut(rooted.join(several, ["band", "value"]).join(sets.select("k", F.size("set").alias("size")), "k"))
    sized = sized.join(sized.groupBy("band", "value").agg(F.sum("size").alias("total")), ["band", "value"])
    parts = F.greatest(F.ceil(F.col("total") / (CELL_SHINGLES // 2)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("k"), parts).cast("int")
    pair = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j))
    cells = sized.select("k", "band", "value", "root", F.explode(F.when(F.col("total") <= CELL_SHINGLES, F.array(F.lit(-1))).otherwise(pair)).alias("part"))
    cells = cells.join(sets, "k").select("band", "value", "part", "root", "set").repartition("band", "value", "part").sortWithinPartitions("band", "value", "part")
    return cells.mapInArrow(_cells_links(least), "a long, b long")


def groups(docs: DataFrame, n: int = 5, least: float = 0.8) -> DataFrame:
    """(text_key, check, root): every distinct text with the least key of its group; text_key and check are hashes of the text.

    Texts meet in buckets: of equal bands (a pair of similar texts meets in about eight of the 24), and of fingerprints that
    links within the radius connect. In a bucket each text is compared with the least and the greatest key; where that leaves
    several groups, all other pairs between them are compared too. A bucket's numbers are aggregates, joined back to it, so a
    bucket that a third of all texts share is no single task. Null counts as the empty text, and texts without words are alike.
    Of two texts with one text_key, the one with the lesser check is compared, the other is in no row.
    """
    rows = docs.select(*_text_keys(F.col("text")), _sketches(F.col("text"), n).alias("s"))
    nodes = cut(rows.groupBy("k").agg(F.min(F.struct("check", "s.f", "s.bands")).alias("x")).select("k", "x.*"))
    near = components(fingerprint_links(nodes.select("f").distinct()))
    same = nodes.select("k", "f").join(near, nodes["f"] == near["node"], "left").select("k", F.lit(-1).alias("band"), F.coalesce("root", "f").alias("value"))
    each = cut(nodes.select("k", F.posexplode("bands").alias("band", "value")).unionByName(same))
    shared = each.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last")).filter("n > 1")
    each = cut(each.join(shared, ["band", "value"]))
    pairs = each.select("k", F.explode(F.array("first", "last")).alias("o")).filter("o <> k")
    pairs = cut(pairs.select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b")).distinct())
    need = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    texts = docs.select(*_text_keys(F.col("text")), "text").join(need.join(nodes.select("k", "check"), "k"), ["k", "check"], "left_semi").dropDuplicates(["k"])
    sets = cut(texts.select("k", shingle_sets(F.col("text"), n).alias("set")))
    both = pairs.join(sets.select(F.col("k").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("k").alias("a"), F.col("set").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    alike = both.filter((common >= least * (F.size("x") + F.size("y") - common)) | ((F.size("x") == 0) & (F.size("y") == 0)))
    found = components(alike.select("a", "b"))
    joined = components(_rest_links(each, found, sets, least)).select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    rooted = nodes.join(found, nodes["k"] == found["node"], "left").select(F.col("k").alias("text_key"), "check", F.coalesce("root", "k").alias("root"))
    return rooted.join(joined, rooted["root"] == joined["__n"], "left").select("text_key", "check", F.coalesce("__r", "root").alias("root"))


def _text_keys(text: Column) -> tuple[Column, Column]:
    """k and check: two hashes of a text, 128 bits in all; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), text).alias("check")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the least doc_id (null last), of these the least text key.

    Columns and all other rows stay as they are. Of rows alike in doc_id and text one stays, that with the least hash of all its
    columns. Null and empty texts are one group. Texts move once.
    """
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("w")
    keyed = docs.select("doc_id", *_text_keys(F.col("text")), whole)
    found = groups(docs, **options).select(F.col("text_key").alias("k"), F.col("check").alias("own"), "root")
    # a text that shares only its first hash with the one compared is a group of its own
    named = keyed.join(found, "k").withColumn("other", F.when(F.col("check") != F.col("own"), F.col("check")))
    best = named.groupBy("root", "other").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "check", "w")).alias("b"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_text_keys(F.col("text")), whole)
    return rows.join(best.select("b.k", "b.check", "b.w"), ["k", "check", "w"], "left_semi").dropDuplicates(["k", "check"]).select("row.*")
