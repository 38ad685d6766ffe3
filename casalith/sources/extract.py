"""HTML and JSON extraction: observations with their places. Failures are rows, never failed tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of one extraction.
CHUNK, MOST_DEPTH, MOST_NODES = 4096, 32, 20_000
_SILENT = {"script", "style", "textarea", "noscript", "template"}
_REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_SPACE = re.compile(r"[\t\n\f\r ]+")
_SECTION = re.compile(r"<!\[(?:[^<>]|<(?![A-Za-z/!?]))*>?")
#: Unicode's space separators, which a title doesn't begin or end with.
_SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def decode(text: str, names: tuple[str, ...] | None = None) -> str:
    """text with its character references decoded, or those of names only; unknown ones and those that no semicolon ends stay as written."""
    if names is not None:
        return _REFERENCE.sub(lambda m: html5[f"{m[1]};"] if m[1] in names else m[0], text)
    return _REFERENCE.sub(lambda m: _numbered(m[1]) if m[1][0] == "#" else html5.get(f"{m[1]};", m[0]), text)


def _numbered(reference: str) -> str:
    """The character of #65 or #x41. Eight digits are past the last one, and int() refuses thousands."""
    digits = reference.lstrip("#xX").lstrip("0")[:8] or "0"
    return unescape(f"&#{'x' if reference[1] in 'xX' else ''}{digits};")


class Reader(HTMLParser):
    """Collects (kind, value): the first title, meta:<key>, links, e-mail addresses, domains, and visible text in chunks.

    Source is fed with every & escaped, so that the parser hands references on as written and `decode` reads them.
    """

    def __init__(self, names: tuple[str, ...] | None = None, unbroken: bool = False):
        super().__init__(convert_charrefs=True)
        self.names = names
        self.unbroken = unbroken
        self.found: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.title: list[str] | None = None
        self.titled = False
        self.silent = 0

    def parse_marked_section(self, i, report=1):
        """End of what <![ opens: a comment to the next >, as in HTML, but no further than the next markup. The parser's own raises on all but a few keywords."""
        if self.unbroken and self.title is not None:
            self.text += self.title
            self.title = None
        return _SECTION.match(self.rawdata, i).end()

    def handle_starttag(self, tag, attrs):
        a = {k: decode(v or "", self.names) for k, v in attrs}
        if tag == "title" and self.title is None and not self.titled:
            self.title = []
        elif tag == "meta" and (a.get("property") or a.get("name")) and "content" in a:
            self.found.append((f"meta:{(a.get('property') or a['name']).lower()}", a["content"]))
        elif tag == "a" and a.get("href"):
            self.link(a["href"].strip())
        self.silent += tag in _SILENT
        self.text.append(" ")

    def link(self, href: str):
        self.found.append(("link.href", href))
        if m := re.match(r"(?i)mailto:([^?,]*)", href):
            if "@" in m[1]:
                self.found.append(("email.address", m[1].strip()))
        elif m := re.match(r"(?i)https?://(?:[^/?#@]*@)?([^/?#:@]+)", href):
            self.found.append(("domain.mention", m[1].lower()))

    def handle_endtag(self, tag):
        self.silent -= tag in _SILENT and self.silent > 0
        if tag == "title" and self.title is not None:
            self.found.append(("page.title", _SPACE.sub(" ", "".join(self.title)).strip(_SEPARATORS)))
            self.title, self.titled = None, True
        self.text.append(" ")

    def handle_data(self, data):
        data = decode(data, self.names)
        if self.title is not None:
            self.title.append(data)
        elif not self.silent:
            self.text.append(data)


def read_html(source: str, names: tuple[str, ...] | None = None, unbroken: bool = False) -> list[tuple[str, str]]:
    r = Reader(names, unbroken)
    r.feed(source.replace("&", "&amp;"))
    r.close()
    text = " ".join("".join(r.text).split())
    return r.found + [("page.text", text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]


def read_json(source: str) -> list[tuple[str, str]]:
    """(RFC 6901 pointer, scalar as text) of every scalar; past a bound it ends with a gap."""
    out: list[tuple[str, str]] = []
    stack = [("", json.loads(source), 0)]
    seen = 0
    while stack:
        pointer, v, depth = stack.pop()
        seen += 1
        if depth > MOST_DEPTH or seen > MOST_NODES:
            out.append(("gap", pointer))
            if seen > MOST_NODES:
                break
        elif isinstance(v, dict):
            stack += [(f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", x, depth + 1) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{pointer}/{i}", x, depth + 1) for i, x in reversed(list(enumerate(v)))]
        else:
            out.append((pointer, v if isinstance(v, str) else json.dumps(v)))
    return out


def _extract(df: DataFrame, key: str, column: str, read) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, source in zip(b[key], b[column], strict=True):
                try:
                    out += [(i, n, k, v, None) for n, (k, v) in enumerate(read(source or ""))]
                except (ValueError, AssertionError) as e:
                    out.append((i, None, None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=[key, "row_seq", "kind", "value", "error"])

    return df.select(key, column).mapInPandas(run, f"{key} {kind}, row_seq long, kind string, value string, error string")


def html_observations(pages: DataFrame, key: str = "page_id", column: str = "html", names: tuple[str, ...] | None = None, unbroken: bool = False) -> DataFrame:
    """(key, row_seq, kind, value, error) of each page; null html is an empty page. names: see decode. unbroken: a title with <![ in it is text, not the title."""
    return _extract(pages, key, column, partial(read_html, names=names, unbroken=unbroken))


def json_observations(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, row_seq, kind (the pointer), value, error) of each JSON text."""
    return _extract(rows, key, column, read_json)


def decode_references(df: DataFrame, column: str) -> DataFrame:
    """df with character references in a column decoded."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(unescape, na_action="ignore")

    return df.withColumn(column, of(F.col(column)))
