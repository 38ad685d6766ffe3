"""URLs, hosts, addresses and media types as column expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query parameters that only track, and prefixes of such.
TRACKING = ("gclid dclid gbraid wbraid fbclid msclkid twclid igshid mc_cid mc_eid yclid ttclid li_fat_id vero_id s_cid ref_src ref_url spm scm").split()
TRACKING_PREFIXES = ("utm_", "pk_", "mtm_", "piwik_", "_hs", "hsa_")
#: Media types by file extension.
MEDIA_TYPES = {
    "html": "text/html", "htm": "text/html", "txt": "text/plain", "json": "application/json", "csv": "text/csv", "pdf": "application/pdf", "tif": "image/tiff", "tiff": "image/tiff",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime",
    "webm": "video/webm", "mkv": "video/x-matroska", "avi": "video/x-msvideo",
}
OTHER = "application/octet-stream"
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no tracking parameters, the others sorted; an empty path is /.

    Null where it isn't scheme://host. Escapes stay as they are written.
    """
    part = lambda i: F.regexp_extract(url, _URL, i)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    prefix = "|".join(TRACKING_PREFIXES)
    tracked = f"^(?:(?:{'|'.join(TRACKING)})(?:=|$)|(?:{prefix}))"
    kept = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(p).rlike(tracked)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.when(url.rlike(_URL) & (part(2) != ""), F.concat(scheme, F.lit("://"), host, path, query))


def host(url: Column) -> Column:
    """Host of an http(s) URL in lower case, without credentials and port; else null."""
    h = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(h != "", h)


def browser_handoff(url: Column) -> Column:
    """Whether a browser may be sent there: http(s), a host, no credentials, no control characters, 8192 bytes at most."""
    return url.rlike(r"(?i)^https?://[^/?#@]+([/?#].*)?$") & ~url.rlike(r"\p{Cc}") & (F.octet_length(url) <= 8192)


def mail_recipient(href: Column) -> Column:
    """The first recipient of a mailto link; null without an @."""
    first = F.trim(F.regexp_extract(href, r"(?i)^mailto:([^?,]*)", 1))
    return F.when(first.contains("@"), first)


def address_class(ip: Column) -> Column:
    """loopback, link_local, private, carrier_nat, not_global or public of an IPv4 address; null of anything else."""
    o = [F.regexp_extract(ip, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in range(1, 5)]
    a, b, c, _ = o
    valid = (a <= 255) & (b <= 255) & (c <= 255) & (o[3] <= 255)
    test_net = ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    return (
        F.when(~valid | a.isNull(), None).when(a == 127, "loopback").when((a == 169) & (b == 254), "link_local").when(private, "private")
        .when((a == 100) & b.between(64, 127), "carrier_nat").when((a == 0) | (a >= 224) | test_net, "not_global").otherwise("public")
    )


def address_class6(ip: Column) -> Column:
    """The same classes for IPv6 (null of anything else); addresses that hold an IPv4 one are judged by that."""

    def one(text: str | None) -> str | None:
        try:
            a = ipaddress.IPv6Address((text or "").strip().strip("[]"))
        except ValueError:
            return None
        n = int(a)
        if a.is_loopback:
            return "loopback"
        if n >> 118 == 0xFE80 >> 6:
            return "link_local"
        if n >> 121 == 0xFC00 >> 9:
            return "private"
        if n == 0 or n >> 120 == 0xFF or n >> 96 == 0x20010DB8:
            return "not_global"
        if n >> 32 in (0, 0xFFFF):
            return f"v4:{ipaddress.IPv4Address(n & 0xFFFFFFFF)}"
        return "public"

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(one, na_action=None) if len(s) else s

    found = of(ip)
    return F.when(found.startswith("v4:"), address_class(F.substr(found, F.lit(4)))).otherwise(found)


def allowed_hosts(hosts: DataFrame, allowed: list[str]) -> DataFrame:
    """hosts (host) with allowed: an entry is that host alone, or with a leading dot that domain and all below it."""
    h = F.lower(F.regexp_replace("host", r"\.+$", ""))
    ok = F.lit(False)
    for entry in (a.rstrip(".").lower() for a in allowed):
        ok = ok | ((h == entry[1:]) | h.endswith(entry) if entry.startswith(".") else h == entry)
    return hosts.withColumn("allowed", ok)


def media_type_of_path(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), ext), F.lit(OTHER))


def media_type_of_header(header: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1)))), F.lit(OTHER))


def spreadsheet_cell(text: Column) -> Column:
    """A quoted CSV cell; an apostrophe keeps a spreadsheet from reading it as a formula."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(F.lit('"'), F.when(t.rlike(r"^\s*[=+\-@]"), "'").otherwise(""), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def glob_pattern(glob: str) -> str:
    """A case-sensitive glob as a regular expression: * any run, ? one character, [..] and [^..] sets."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        end = glob.find("]", i + 2) if ch == "[" else -1
        if end > 0:
            out, i = out + glob[i : end + 1].replace("\\", "\\\\"), end
        else:
            out += {"*": ".*", "?": "."}.get(ch, ch if ch.isalnum() else "\\" + ch)
        i += 1
    return f"(?s)^{out}$"
