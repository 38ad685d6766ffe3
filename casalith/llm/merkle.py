"""Document fingerprints as Merkle trees: pieces make paragraphs, paragraphs sections, sections the document.

Where pieces and sections end depends on what stands there alone, so an edit changes the branches it touches and no others.
Equal roots mean equal texts; unequal ones are compared branch by branch from the root, which locates the edits.
"""

from __future__ import annotations

import hashlib
import re
from base64 import urlsafe_b64decode, urlsafe_b64encode
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import power_of_two

_CLAUSE = re.compile(r"[^.,;:!?]*[.,;:!?]+\s*|[^.,;:!?]+")
_FINE = re.compile(r"(?s).{1,32}?(?:[dnst]\s|$)|.{1,32}")
LONG_CLAUSE = 40
#: Bytes of a leaf.
LEAF = 5


def pieces(paragraph: str) -> list[str]:
    """A paragraph cut after marks; longer clauses also after words that end in some letters, or else after 32 characters."""
    out = []
    for c in _CLAUSE.findall(paragraph):
        if len(c) <= LONG_CLAUSE:
            out.append(c)
        else:
            out += _FINE.findall(c)
    return out


def _digits(hashes: list[int], size: int) -> str:
    return urlsafe_b64encode(b"".join((x & (1 << 8 * size) - 1).to_bytes(size, "big") for x in hashes)).rstrip(b"=").decode()


def fingerprint(text: str | None) -> str:
    """root|section/section..., a section being its hash, a colon, and its paragraphs joined by dots; a paragraph is its leaves.

    A leaf is 40 bits of a piece's hash, a section's hash has 64 bits, the root 64; leaves and sections are in base 64. Paragraphs
    are lines. A section ends with an empty line or with a paragraph whose hash is a multiple of 8. A tree names each of its
    leaves, so it grows with the text, to about half its size; the root has one size. Null: the empty text's.
    """
    h, sections, now, digest, of = xxhash.xxh3_64_intdigest, [], [], [], hashlib.blake2b(digest_size=8)
    for line in (text or "").split("\n"):
        each = [h(p.encode("utf-8", "surrogatepass")) for p in pieces(line)]
        para = h(b"".join(x.to_bytes(8, "big") for x in each))
        now.append(_digits(each, LEAF))
        digest.append(para.to_bytes(8, "big"))
        if not line or para % 8 == 0:
            sections.append((digest, now))
            digest, now = [], []
    if now:
        sections.append((digest, now))
    out = []
    for d, paras in sections:
        own = h(b"".join(d))
        of.update(own.to_bytes(8, "big"))
        out.append(f"{_digits([own], 8)}:{'.'.join(paras)}")
    return f"{of.hexdigest()}|{'/'.join(out)}"


def sections(fp: str) -> list[tuple[str, list[str]]]:
    """(hash, paragraphs) of each section."""
    return [(h, body.split(".")) for h, _, body in (s.partition(":") for s in fp.split("|", 1)[1].split("/"))]


def leaves(paragraph: str) -> list[bytes]:
    raw = urlsafe_b64decode(paragraph + "=" * (-len(paragraph) % 4))
    return [raw[i : i + LEAF] for i in range(0, len(raw), LEAF)]


def _left(items: list, key, other: list) -> tuple[list, list]:
    """The items, and the others, that have no partner of the same key on the other side; each partner counts once, the first first."""
    there = Counter(map(key, other))
    mine = []
    for x in items:
        if there[key(x)] > 0:
            there[key(x)] -= 1
        else:
            mine.append(x)
    gone = Counter(map(key, other)) - there
    rest = []
    for x in other:
        if gone[key(x)] > 0:
            gone[key(x)] -= 1
        else:
            rest.append(x)
    return mine, rest


def differences(a: str, b: str) -> tuple[list[tuple[int, int, int]], int]:
    """((section, paragraph, piece) of each leaf of a that b lacks, number of leaves of b that a lacks).

    Goes down from the roots: equal sections are passed over whole, then equal paragraphs of the sections left, and only the
    paragraphs left are looked at leaf by leaf. What stands several times counts as often.
    """
    if a[:16] == b[:16]:
        return [], 0
    flat = lambda some: [(i, j, p) for i, (_, paras) in some for j, p in enumerate(paras)]
    mine, other = _left(list(enumerate(sections(a))), lambda s: s[1][0], list(enumerate(sections(b))))
    mine, other = _left(flat(mine), lambda p: p[2], flat(other))
    there = Counter(x for _, _, p in other for x in leaves(p))
    found = []
    for i, j, p in mine:
        for k, x in enumerate(leaves(p)):
            if there.get(x, 0) > 0:
                there[x] -= 1
            else:
                found.append((i, j, k))
    return found, sum(there.values())


def n_leaves(fp: str) -> int:
    return sum(len(p) * 3 // 4 // LEAF for _, paras in sections(fp) for p in paras)


def likeness(a: str, b: str, found: tuple | None = None) -> float:
    """1 for equal roots, else the share of leaves on both sides that the descent finds alike; of two trees without leaves, 0."""
    if a[:16] == b[:16]:
        return 1.0
    n = n_leaves(a) + n_leaves(b)
    mine, other = found or differences(a, b)
    return (n - len(mine) - other) / n if n else 0.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of a in which something is that b lacks."""
    return list(dict.fromkeys(x[:2] for x in differences(a, b)[0]))


def fingerprints(text: Column) -> Column:
    """Column of fingerprints of whole texts."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(fingerprint, na_action=None) if len(texts) else texts

    return of(text)


def in_order(docs: DataFrame, rows_a_bucket: int = 256, coarse: int = 128, most_fine: int = 8192) -> DataFrame:
    """(bucket, head, doc_id, text) such that in each bucket, by (head, doc_id descending, text), the last row is the first one of the next bucket.

    Buckets are ranges of doc_id: up to 128 by approximate quantiles, each cut evenly. Null ids are the last. The row with head 1
    after the last bucket's rows is the first row of all. There are at most coarse * most_fine + 1 heads (40 bytes each) to broadcast, whatever the input.
    """
    n = docs.count()
    coarse = power_of_two(n / rows_a_bucket, 1, coarse)
    fine = power_of_two(n / rows_a_bucket / coarse, 1, most_fine)
    marks = docs.approxQuantile("doc_id", [i / coarse for i in range(coarse + 1)], 1 / (8 * coarse)) if n else []
    marks = sorted({int(m) for m in marks}) or [0]

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(F.col("doc_id") >= marks[mid], search(mid, hi)).otherwise(search(lo, mid - 1))

    at = search(0, len(marks) - 1)
    low = F.element_at(F.array(*[F.lit(float(m)) for m in marks]), at + 1)
    width = F.element_at(F.array(*[F.lit(float(max(1, b - a))) for a, b in zip(marks, [*marks[1:], marks[-1] + 1], strict=True)]), at + 1)
    inner = F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor((F.col("doc_id") - low) / width * fine).cast("int")))
    rows = docs.select(F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(-(at * fine + inner)).alias("bucket"), F.lit(0).alias("head"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("first"))
    order = Window.orderBy("bucket")
    heads = heads.select("bucket", "first", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("to"))
    heads = heads.select(F.col("bucket").alias("__b"), F.col("first").alias("__f"), F.col("to").alias("__to"))
    extra = rows.join(F.broadcast(heads), rows["bucket"].eqNullSafe(heads["__b"]) & rows["doc_id"].eqNullSafe(heads["__f"]))
    extra = extra.select(F.col("__to").alias("bucket"), F.lit(1).alias("head"), "doc_id", "text")
    both = rows.unionByName(extra).repartition("bucket")
    return both.sortWithinPartitions("bucket", "head", F.col("doc_id").desc_nulls_last(), "text")


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_edits", "first_edit"]

    def rows():
        for b in batches:
            yield from zip(b["bucket"].tolist(), b["head"].tolist(), b["doc_id"].astype("Int64").tolist(), b["text"].tolist(), strict=True)

    def results():
        for _, group in groupby(rows(), key=lambda r: r[0]):
            before = None
            for _, head, doc_id, text in group:
                own = fingerprint(text)
                if before:
                    yield compare(*before, text, own)
                before = (doc_id, text, own)
                if head:
                    break

    def compare(doc_id, text, own, after, after_fp):
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        changed = own if edited == text else fingerprint(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        found = differences(own, changed)
        first = ".".join(map(str, found[0][0])) if found[0] else None
        return doc_id, n, sha, own, changed, likeness(own, changed, found), likeness(own, after_fp), len(found[0]), first

    some: list = []
    for r in results():
        some.append(r)
        if len(some) == 2000:
            yield frame(some, names)
            some = []
    if some:
        yield frame(some, names)


def frame(rows: list, names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    out["doc_id"] = pd.array([None if r[0] is pd.NA else r[0] for r in rows], dtype="Int64")
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how alike its fingerprint is to that one and to the next document's.

    n_edits and first_edit are what the comparison with the edited text locates: how many leaves of the row's tree that one lacks,
    and the first of them as section.paragraph.piece (null if there is none).

    Next: by doc_id descending (null last), then text; after the last, the first. Repeated rows are rows of their own. Null text
    is empty: it has no characters, and its edited text is empty. An empty table gives an empty table; other columns are ignored.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_edits long, first_edit string"
    return in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInPandas(_compared, schema)


def op9(docs: DataFrame) -> DataFrame:
    return with_next(docs)
