"""URL guard as column predicates: which addresses may be fetched, and what of them may be shown."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POLICIES = ("whitelist", "public", "off")


def policy(raw: Column) -> Column:
    """Known policy names; anything else is the strictest."""
    name = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(name.isin(*POLICIES), name).otherwise("whitelist")


def host_list(raw: Column) -> Column:
    """Entries of a list separated by commas, semicolons or blanks, each once."""
    return F.array_distinct(F.filter(F.split(F.coalesce(raw, F.lit("")), "[,;\\s]+"), lambda x: x != ""))


def clean_host(entry: Column) -> Column:
    """Host of an entry that may be a whole URL or carry credentials or a port."""
    bare = F.regexp_replace(F.lower(F.trim(entry)), "^.*://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "/.*$", ""), "^.*@", "")
    return F.regexp_replace(F.regexp_replace(bare, ":.*$", ""), "^\\.+|\\.+$", "")


def host_allowed(host: Column, allowed: Column) -> Column:
    """Whether the host is an entry of the list or below one; borders are dots."""
    target = F.rtrim(F.lower(F.trim(F.coalesce(host, F.lit("")))), F.lit("."))
    below = lambda e: (e != "") & ((target == e) | F.endswith(target, F.concat(F.lit("."), e)))
    return (target != "") & F.exists(F.transform(allowed, clean_host), below)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host without credentials, port and trailing dot."""
    bare = F.regexp_replace(authority(url), "^.*@", "")
    named = F.when(bare.startswith("["), F.regexp_extract(bare, "^\\[([^\\]]*)\\]", 1)).otherwise(F.regexp_replace(bare, ":.*$", ""))
    return F.regexp_replace(F.lower(named), "\\.$", "")


def reject_reason(url: Column, mode: str, allowed: Column) -> Column:
    """Why a URL may not be fetched before its name is resolved; null if nothing speaks against it."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    port = F.regexp_extract(F.regexp_replace(authority(raw), "^.*@", ""), ":([^:\\]]*)$", 1)
    bad_port = (port != "") & (~port.rlike("^[0-9]{1,5}$") | (port.try_cast("int") > 65535))
    reason = (
        F.when(raw == "", "empty_url")
        .when(~scheme(raw).isin("http", "https"), "bad_scheme")
        .when(authority(raw).contains("@"), "userinfo_not_allowed")
        .when(host(raw) == "", "no_host")
        .when(bad_port, "bad_port")
    )
    if mode == "whitelist":
        reason = reason.when(F.size(allowed) == 0, "allowlist_empty").when(~host_allowed(host(raw), allowed), "host_not_allowed")
    return reason


def resolved_reason(ips: Column, allow_private: bool = False) -> Column:
    """Why the resolved addresses rule a URL out; ips null: the name was not found."""
    reason = F.when(ips.isNull(), "dns_failed").when(F.size(ips) == 0, "dns_empty")
    return reason if allow_private else reason.when(~all_public(ips), "non_public_address")


def is_public_ip(text: str | None) -> bool:
    """A public unicast address; IPv4 inside IPv6 counts as IPv4."""
    try:
        ip = ipaddress.ip_address(str(text).strip())
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    special = ("is_multicast", "is_reserved", "is_link_local", "is_loopback", "is_private", "is_unspecified")
    return ip.is_global and not any(getattr(ip, s) for s in special)


def all_public(ips: Column) -> Column:
    @F.pandas_udf("boolean")
    def public(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: x is not None and all(map(is_public_ip, x)))

    return public(ips)


def redact(url: Column) -> Column:
    """Scheme, host and path; a query is only hinted at, a fragment dropped."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    return F.concat(F.regexp_replace(bare, "\\?.*$", ""), F.when(bare.rlike("\\?."), "?<已隐去>").otherwise(""))


def pinned(url: Column, ip: Column) -> Column:
    """struct(url, host): the address in place of the name, and the Host header that keeps the name."""
    at = F.regexp_extract(F.regexp_replace(authority(url), "^.*@", ""), "(:[0-9]+)$", 1)
    literal = F.when(ip.contains(":"), F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip)
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    new = F.concat(scheme(url), F.lit("://"), literal, at, rest)
    return F.struct(F.when(ip.isNull(), url).otherwise(new).alias("url"), F.concat(host(url), at).alias("host"))


#: reason -> what the sender is told (fixed values).
REPLIES: Iterable[tuple[str, str]] = (
    ("empty_url", "no link"),
    ("bad_scheme", "only http and https links are read"),
    ("userinfo_not_allowed", "links with credentials are not read"),
    ("no_host", "the link has no host"),
    ("bad_port", "the link's port is not valid"),
    ("allowlist_empty", "no host is allowed"),
    ("host_not_allowed", "the link's host is not allowed"),
    ("dns_failed", "the link's host is unknown"),
    ("dns_empty", "the link's host has no address"),
    ("non_public_address", "the link leads to a private network"),
)


def reply(reason: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in REPLIES for x in pair))[reason]
