"""Public sources: request plans as rows, recorded responses by their key, search responses, tool directories. Nothing here opens a socket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import selectors as S
from ..functions.web import canonical_url

#: What is asked of DNS, how many rows of a search response count, and the longest title, address and snippet.
DNS_TYPES = ("A", "AAAA", "CNAME", "MX", "NS", "TXT", "SOA")
MOST_HITS, MOST_TITLE, MOST_URL, MOST_SNIPPET = 100, 1000, 4096, 4000


def requests(domains: DataFrame, resolver: str, registry: str, logs: str, archive: str, pages: int = 100) -> DataFrame:
    """(domain, kind, url): what would be asked about each valid domain: a row for each DNS type, registration, certificates, archive.

    resolver, registry, logs and archive are addresses with {domain}, and {type} or {limit} where they have one.
    """
    d = domains.withColumn("domain", S.domain(F.col("domain"))).filter("domain IS NOT NULL").select("domain").distinct()
    put = lambda address, **more: F.replace(F.lit(_filled(address, **more)), F.lit("{domain}"), F.col("domain"))
    rows = [F.struct(F.lit(f"dns:{t}").alias("kind"), put(resolver, type=t).alias("url")) for t in DNS_TYPES]
    rows += [F.struct(F.lit(k).alias("kind"), put(a, limit=str(min(100, pages))).alias("url")) for k, a in (("rdap", registry), ("certificates", logs), ("archive", archive))]
    return d.select("domain", F.inline(F.array(*rows)))


def _filled(address: str, **more: str) -> str:
    for k, v in more.items():
        address = address.replace(f"{{{k}}}", v)
    return address


def fixture_key(method: Column, url: Column, body: Column) -> Column:
    """What a recorded response is filed under: a hash of method, canonical address and body; null body is empty."""
    return F.sha2(F.concat_ws("\n", F.upper(method), F.coalesce(canonical_url(url), url), F.coalesce(body, F.lit(""))), 256)


def replay(asked: DataFrame, recorded: DataFrame) -> DataFrame:
    """asked (method, url, body, ...) with status and response of the recorded ones (key, status, response), null where there is none."""
    return asked.withColumn("key", fixture_key(F.col("method"), F.col("url"), F.col("body"))).join(recorded, "key", "left")


def search_hits(responses: DataFrame) -> DataFrame:
    """(id, position, title, url, snippet) of search responses (id, body): the first hits whose address is one, cut to what is kept."""
    rows = F.from_json("body", "results array<struct<title:string,url:string,content:string>>")["results"]
    each = responses.select("id", F.posexplode(F.slice(rows, 1, MOST_HITS)).alias("position", "r")).filter(canonical_url(F.col("r.url")).isNotNull())
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return each.select("id", "position", cut(F.col("r.title"), MOST_TITLE).alias("title"), cut(F.col("r.url"), MOST_URL).alias("url"), cut(F.col("r.content"), MOST_SNIPPET).alias("snippet"))


def tool_rows(tree: dict, flags: dict[str, str]) -> list[tuple]:
    """(no, name, category, url, flags set) of the leaves of a directory tree: a leaf has a url, a branch children; categories join by " > "."""
    out: list[tuple] = []
    todo = [(c, "") for c in reversed(tree.get("children") or [])]
    while todo:
        node, path = todo.pop()
        name = node.get("name") or ""
        if isinstance(node.get("url"), str):
            out.append((len(out) + 1, name, path, node["url"], sorted(k for k, mark in flags.items() if node.get(k) is True or mark in name)))
        else:
            below = f"{path} > {name}" if path else name
            todo += [(c, below) for c in reversed(node.get("children") or [])]
    return out


def ingest(files: DataFrame, known: DataFrame) -> DataFrame:
    """New artifacts from files (path, content; Spark's binaryFile): locator, content_hash, byte_length, media_type; one a locator, none that is known (locator)."""
    from ..functions.web import media_type_of_path

    locator = F.regexp_replace("path", "^file:/+", "file:///")
    rows = files.select(locator.alias("locator"), F.sha2("content", 256).alias("content_hash"), F.octet_length("content").alias("byte_length"), media_type_of_path(F.col("path")).alias("media_type"))
    return rows.dropDuplicates(["locator"]).join(known.select("locator").distinct(), "locator", "left_anti")
