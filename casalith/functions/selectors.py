"""Selectors: normalised forms as column expressions, null where a value is not valid."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of names that are not public.
PRIVATE_SUFFIXES = (".local", ".localhost", ".internal", ".lan")
LABELS = "email|e-mail|phone|tel|ip|domain|website|wallet"


def _clean(value: Column) -> Column:
    """Trimmed; null if empty, over 2048 bytes or with a control character."""
    v = F.trim(value)
    return F.when((v != "") & (F.octet_length(v) <= 2048) & ~v.rlike(r"\p{Cc}"), v)


def domain(value: Column) -> Column:
    """A public fully qualified ASCII name in lower case, without the last dot; addresses and URLs are none."""
    v = F.lower(F.regexp_replace(F.trim(value), r"\.+$", ""))
    ok = v.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$") & ~v.rlike(r"(^|\.)(0x[0-9a-f]*|[0-9]+)$") & (F.length(v) <= 253)
    for s in PRIVATE_SUFFIXES:
        ok = ok & ~v.endswith(s)
    return F.when(ok, v)


def email(value: Column) -> Column:
    """The local part as it is, the domain in lower case."""
    v = _clean(value)
    local, host = F.regexp_extract(v, r"(?s)^(.*)@", 1), F.substring_index(v, "@", -1)
    ok = local.rlike(r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*$") & (F.length(local) <= 64) & v.contains("@")
    out = F.concat(local, F.lit("@"), domain(host))
    return F.when(ok & (F.length(out) <= 254), out)


def phone(value: Column) -> Column:
    """+ and 7 to 15 digits, the first not 0; blanks, brackets, hyphens and dots go."""
    v = F.regexp_replace(_clean(value), r"[ ().-]", "")
    return F.when(v.rlike(r"^\+[1-9][0-9]{6,14}$"), v)


def username(value: Column) -> Column:
    v = _clean(value)
    return F.when(v.rlike(r"^[A-Za-z0-9._-]{1,64}$") & v.rlike("[A-Za-z0-9]"), v)


def name(value: Column) -> Column:
    v = F.regexp_replace(_clean(value), r"\s+", " ")
    return F.when(F.length(v) <= 200, v)


def ipv4(value: Column) -> Column:
    """Four decimal octets without leading zeros."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v = _clean(value)
    return F.when(v.rlike(rf"^{octet}(\.{octet}){{3}}$"), v)


def ipv6(value: Column) -> Column:
    """The compressed lower-case form of an IPv6 address."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else ipaddress.IPv6Address(text).compressed
        except ValueError:
            return None

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(one, na_action=None) if len(s) else s

    return of(_clean(value))


def image(value: Column) -> Column:
    v = _clean(value)
    return F.when(v.rlike(r"^[A-Za-z0-9_-]{1,128}$"), v)


def candidate_kind(token: Column) -> Column:
    """What a token could be, by its looks: email, wallet, phone, ip, domain, or null."""
    lower = F.lower(token)
    wallet = token.startswith("0x") | lower.startswith("bc1") | (F.octet_length(token).between(26, 35) & token.rlike("^[13T]"))
    ip = (token.contains(":") & ~token.contains("://")) | token.rlike(r"^[0-9]*\.[0-9]*\.[0-9]*\.[0-9]*$")
    return (
        F.when(token.contains("@"), "email").when(wallet, "wallet").when(token.startswith("+"), "phone").when(ip, "ip").when(token.contains(".") & token.rlike("[A-Za-z]"), "domain")
    )


def candidate_tokens(text: Column) -> Column:
    """array<string>: tokens of a text without marks around them and without a label such as `email:` before them."""
    raw = F.split(F.coalesce(text, F.lit("")), r'[\s,;<>"(){}]')
    bare = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[.,!?]+", ""), r"[.,!?]+$", ""))
    return F.filter(F.transform(bare, lambda x: F.regexp_replace(x, f"(?i)^(?:{LABELS}):", "")), lambda x: x != "")


def phone_candidates(text: Column) -> Column:
    """array<string>: from every +, the run of phone characters, 40 at most, with 7 digits or more. Runs may overlap."""
    tails = F.slice(F.split(F.coalesce(text, F.lit("")), r"(?=\+)"), 1, 1_000_000)
    runs = F.transform(F.filter(tails, lambda x: x.startswith("+")), lambda x: F.trim(F.regexp_extract(x, r"^\+[0-9 ().+-]{0,39}", 0)))
    return F.filter(runs, lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) >= 7)
