"""SimHash near-duplicates: pivot distance tables discard pairs of fingerprints, exact distances verify the rest.

A fingerprint's coordinates are its Hamming distances to many reference fingerprints. Two fingerprints within the radius differ by
no more than it in any coordinate. So the first coordinates deal fingerprints into cells: each halves a cell at a threshold, and
what lies within the radius below it goes to both sides. Pairs that share no cell are discarded by a coordinate without being
formed. In a cell, pairs that agree in 3 of 6 bit blocks, as all within 3 bits do, are discarded by the largest difference over
further coordinates, and the exact distance verifies what is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: A cell is wanted to hold about 1/16 of all fingerprints, within these bounds; one with over twice as many is compared in parts.
LEAST_CELL, MOST_CELL = 64, 1 << 20
#: By how much a coordinate shrinks the cell of a fingerprint, as the logarithm; its copies grow by a quarter.
SHRINK = 0.42
_REFERENCES = np.random.default_rng(2024).integers(0, 2**64, 88, dtype=np.uint64)
#: References of the coordinates that make cells, and of those that discard pairs in a cell.
_DEALERS, _PIVOTS = _REFERENCES[24:], _REFERENCES[:24]
_MASKS = np.array([sum(((1 << width) - 1) << at for at, width in some) for some in combinations(BLOCKS, 3)], np.uint64)


def hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of every n-word shingle, repeats included; of fewer words: of the whole sequence; of none: empty."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and the six blanks of the contract
    if not w:
        return np.empty(0, np.uint64)
    joined, sizes = b" ".join(w), np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = max(1, len(w) - n + 1)
    last = ends[n - 1 :] if len(w) >= n else ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:k].tolist(), last.tolist(), strict=True)), np.uint64, k)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; of no hashes: 0."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        bits = np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, n: int = SHINGLE) -> Column:
    """64-bit fingerprint of each whole text, as a signed long. Null: as the empty text, 0."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(hashes(t, n)) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _near(f: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) are within the radius: by the pivot table first, then by themselves."""
    ok = np.flatnonzero(np.abs(p[i] - p[j]).max(axis=1) <= RADIUS)
    return ok[np.bitwise_count(f[i[ok]] ^ f[j[ok]]) <= RADIUS]


def _group_links(f: np.ndarray, p: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected among many fingerprints: each component as a star around its first."""
    left, out = np.arange(len(f)), []
    while len(left):
        root, left, front = left[0], left[1:], [left[0]]
        while front and len(left):
            x = front.pop()
            hit = np.zeros(len(left), bool)
            hit[_near(f, p, np.full(len(left), x), left)] = True
            new, left = left[hit], left[~hit]
            front += new.tolist()
            out += [(root, y) for y in new.tolist()]
    return out


def _cell_links(f: np.ndarray) -> np.ndarray:
    """Links (rows a, b) that connect what is connected among the fingerprints of a cell."""
    found = []
    for mask in _MASKS:
        order = np.argsort(f & mask, kind="stable")
        g, key = f[order], (f & mask)[order]
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(g)]])
        size = np.diff(cuts)
        shared = np.repeat(size > 1, size)
        if not shared.any():
            continue
        # only what shares its blocks gets coordinates
        g, size = g[shared], size[size > 1]
        cuts = np.concatenate([[0], np.cumsum(size)])
        p = np.bitwise_count(g[:, None] ^ _PIVOTS[None, :]).astype(np.int8)
        small, where = np.repeat(size, size) <= 16, np.repeat(np.arange(len(size)), size)
        for d in range(1, 16):
            i = np.flatnonzero(small[:-d] & (where[:-d] == where[d:])) if len(g) > d else np.empty(0, np.int64)
            if not len(i):
                break
            ok = i[_near(g, p, i, i + d)]
            found.append(np.stack([g[ok], g[ok + d]]))
        for s, e in zip(cuts[:-1][size > 16], cuts[1:][size > 16], strict=True):
            if got := _group_links(g[s:e], p[s:e]):
                found.append(g[s:e][np.array(got).T])
    return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.uint64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (cell, part, f) in order of cell and part: links (a, b) of each."""

    def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
        got = _cell_links(np.concatenate(rows).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in got], names=["a", "b"])

    kept: list[np.ndarray] = []
    last = None
    for batch in batches:
        cell, part, f = (np.asarray(batch.column(i)).astype(np.int64) for i in range(3))
        ends = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
        for s, e in zip([0, *ends.tolist()], [*ends.tolist(), len(f)], strict=True):
            if s == e:
                continue
            if kept and (cell[s], part[s]) != last:
                yield linked(kept)
                kept = []
            kept.append(f[s:e].copy())
            last = (cell[s], part[s])
    if kept:
        yield linked(kept)


def cells(distinct: DataFrame, wanted: int) -> DataFrame:
    """(cell, f): each fingerprint in the cells that its coordinates name, one at least; two within the radius share a cell.

    A coordinate is cut at its mean over all fingerprints. What lies in the radius below the cut is on both sides of it.
    """
    n = distinct.count()
    levels = min(len(_DEALERS), max(0, math.ceil(math.log(max(1, n) / wanted) / SHRINK)))
    if not levels:
        return distinct.select(F.lit(0).cast("long").alias("cell"), "f")
    at = [F.bit_count(F.col("f").bitwiseXOR(F.lit(int(d) - (1 << 64) if d >= 1 << 63 else int(d)))) for d in _DEALERS[:levels].tolist()]
    means = distinct.agg(*[F.avg(d) for d in at]).first()
    coordinates = F.array(*[F.struct(d.alias("d"), F.lit(math.ceil(m)).alias("cut")) for d, m in zip(at, means, strict=True)])
    low, high = (lambda a: F.transform(a, lambda c: c * 2)), (lambda a: F.transform(a, lambda c: c * 2 + 1))
    deal = lambda a, x: F.when(x.d >= x.cut, high(a)).when(x.d < x.cut - RADIUS, low(a)).otherwise(F.concat(low(a), high(a)))
    return distinct.select(F.explode(F.aggregate(coordinates, F.array(F.lit(0).cast("long")), deal)).alias("cell"), "f")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints (f long) that connect all that are connected by distances within the radius.

    Cells of one are left out. A cell that holds over twice what is wanted (fingerprints close to each other that no coordinate
    tells apart) is cut into parts, and each pair of parts is compared by itself; there, fingerprints that are linked leave the
    search as soon as they are found, so dense groups cost about as much as they have members. The table of such cells has at
    most one row for each wanted number of rows.
    """
    distinct = cut(distinct)
    wanted = min(MOST_CELL, max(LEAST_CELL, distinct.count() // 16))
    dealt = cells(distinct, wanted)
    large = dealt.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * wanted)
    parts = large.select("cell", F.ceil(F.col("n") / wanted).cast("int").alias("parts"))
    named = dealt.join(F.broadcast(parts), "cell", "left").withColumn("own", F.pmod(F.xxhash64("f"), F.col("parts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least("own", j) * F.col("parts") + F.greatest("own", j))
    each = named.select("cell", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(pair)).alias("part"), "f")
    return each.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """docs' doc_id with fingerprint (long) and component_id, the least doc_id that the document's links reach.

    Every row counts, repeated ones too. Null and empty texts have fingerprint 0 and are linked like any other. A component
    in which every doc_id is null has a null id. An empty table gives an empty table. Columns other than doc_id and text are ignored.
    """
    rows = cut(docs.select("doc_id", fingerprints(F.col("text"), n).alias("f")))
    nodes = cut(rows.groupBy("f").agg(F.min("doc_id").alias("id")))
    found = components(fingerprint_links(nodes.select("f")))
    rooted = nodes.join(found, nodes["f"] == found["node"], "left").select("f", "id", F.coalesce("root", "f").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select("f", "component_id")
    return rows.join(named, "f").select("doc_id", F.col("f").alias("fingerprint"), "component_id")


def op5(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
