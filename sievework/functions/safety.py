"""Whether a URL may be fetched, from its text alone (no names are resolved), as Column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import urls

# IPv4 networks that are not public, the first that fits decides.
NETWORKS = [
    ("127.0.0.0/8", "loopback"),
    ("169.254.0.0/16", "link_local"),
    ("0.0.0.0/8", "reserved"),
    ("10.0.0.0/8", "private"),
    ("100.64.0.0/10", "carrier_nat"),
    ("172.16.0.0/12", "private"),
    ("192.0.0.0/24", "reserved"),
    ("192.0.2.0/24", "documentation"),
    ("192.88.99.0/24", "reserved"),
    ("192.168.0.0/16", "private"),
    ("198.18.0.0/15", "reserved"),
    ("198.51.100.0/24", "documentation"),
    ("203.0.113.0/24", "documentation"),
    ("224.0.0.0/4", "multicast"),
    ("240.0.0.0/4", "reserved"),
]
# Host names of private networks, and the endings of such names.
PRIVATE_NAMES = ["host-gateway", "host.docker.internal", "metadata.google.internal", "metadata.google"]
PRIVATE_ENDINGS = [".internal", ".private", ".local", ".corp", ".lan", ".home", ".home.arpa", ".invalid", ".test"]


def spans() -> list[tuple[int, int, str]]:
    """(first, last, class) of each network as integers."""
    nets = [(ipaddress.ip_network(n), c) for n, c in NETWORKS]
    return [(int(n.network_address), int(n.broadcast_address), c) for n, c in nets]


def ipv4(host: Column) -> Column:
    """A dotted quad or one decimal number as an integer below 2^32; else null."""
    parts = F.transform(F.split(host, r"\."), lambda p: p.cast("long"))
    quad = F.when(host.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") & ~F.exists(parts, lambda p: p > 255), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))
    one = F.when(host.rlike("^[0-9]{1,10}$"), host.cast("long"))
    number = F.coalesce(quad, one)
    return F.when(number < 1 << 32, number)


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often it stands in the body."""
    return F.get(F.transform(F.array(value), body), 0)


def _network(number: Column) -> Column:
    out = F.when(number.isNull(), None)
    for first, last, name in spans():
        out = out.when(number.between(first, last), name)
    return out.otherwise("public")


def _ipv6(inner: Column) -> Column:
    return (
        F.when(inner == "", None)
        .when(inner.rlike(r"^(0{0,4}:)*0{0,3}1$"), "loopback")
        .when(inner.rlike(r"^[0:]+$"), "reserved")
        .when(inner.rlike("^ff"), "multicast")
        .when(inner.rlike("^f[cd]"), "private")
        .when(inner.rlike("^fe[89ab]"), "link_local")
        .when(inner.rlike("^2001:0?db8:"), "documentation")
        .when(inner.rlike("^(2002:|2001:(0{1,4}|0{0,3}2)?:)"), "reserved")
        .otherwise("public")
    )


def address_class(host: Column) -> Column:
    """loopback, link_local, private, carrier_nat, documentation, multicast, reserved or public for
    an IPv4 address, or an IPv6 one in brackets; null for a name. An IPv6 address that holds an IPv4
    one has its class."""
    inner = F.lower(F.regexp_extract(host, r"^\[([0-9A-Fa-f:.]+)(?:%[^\]]*)?\]$", 1))
    mapped = ipv4(F.regexp_extract(inner, r"^::(?:ffff:)?([0-9.]+\.[0-9]+)$", 1))
    return F.coalesce(_let(ipv4(host), _network), _let(mapped, _network), _let(inner, _ipv6))


def verdict(url: Column, longest: int = 2048) -> Column:
    """empty, invalid, scheme, too_long, credentials, private_name, the class of an address that is
    not public, or allowed; null counts as empty."""
    authority = F.regexp_extract(url, urls.URL, 2)
    bare = F.regexp_replace(authority, "^.*@", "")
    host = F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^(\[[^\]]*\])", 1)).otherwise(F.regexp_replace(bare, ":[0-9]*$", "")))
    known = F.struct(host.alias("host"), address_class(host).alias("kind"))

    def judged(k: Column) -> Column:
        private = (k["host"] == "localhost") | k["host"].isin(PRIVATE_NAMES)
        for e in PRIVATE_ENDINGS:
            private = private | k["host"].endswith(e)
        return (
            F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "empty")
            .when(~url.rlike(urls.URL) | (k["host"] == ""), "invalid")
            .when(~F.lower(F.regexp_extract(url, urls.URL, 1)).isin("http", "https"), "scheme")
            .when(F.octet_length(url) > longest, "too_long")
            .when(F.contains(authority, F.lit("@")), "credentials")
            .when(k["kind"] != "public", k["kind"])
            .when(k["kind"].isNull() & private, "private_name")
            .otherwise("allowed")
        )

    return _let(known, judged)
