"""Canonical URLs and stable identifiers, as Column expressions.

Identifiers are FNV-1a hashes of 64 bits over length-prefixed fields after a namespace and the
name of what is identified. The namespace is a parameter, so that identifiers of one
deployment can be told from those of another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMESPACE = "sievework-id-v1"
# Fixed values of FNV-1a with 64 bits.
OFFSET, PRIME = 14695981039346656037, 1099511628211



def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often it stands in the body."""
    return F.get(F.transform(F.array(value), body), 0)


# Characters that are never encoded, in a character class.
_UNRESERVED = r"A-Za-z0-9._~-"


def _encoded(part: Column, plain: str) -> Column:
    """Characters outside the class ``plain`` percent-encoded in upper case; encodings of unreserved
    characters decoded, others left with upper-case digits."""

    def one(u):
        meant = F.char(F.conv(F.substring(u, 2, 2), 16, 10).cast("int"))
        bytes_ = F.regexp_replace(F.hex(F.encode(u, "UTF-8")), "([0-9A-F]{2})", "%$1")
        return F.when(F.length(u) == 3, F.when(meant.rlike(f"^[{_UNRESERVED}]$"), meant).otherwise(F.upper(u))).when(u.rlike(f"^[{plain}]$"), u).otherwise(bytes_)

    return F.array_join(F.transform(F.regexp_extract_all(part, F.lit(r"%[0-9A-Fa-f]{2}|[\s\S]"), 0), one), "")


def canonical_url(url: Column) -> Column:
    """A URL as it counts for identity: scheme and host in lower case, without www., default port,
    fragment and trailing slashes, with percent-encodings in one form; the order of parameters is
    kept. Text without "://" is a path: without fragment, encoded and trimmed alike."""
    return _let(F.trim(url), lambda u: _let(_split(u), _canonical))


def _split(u: Column) -> Column:
    """struct(scheme, authority, tail): scheme and authority are null for a path alone."""
    whole = F.contains(u, F.lit("://"))
    rest = F.when(whole, F.regexp_replace(u, "(?s)^.*?://", "")).otherwise(u)
    authority = F.when(whole, F.coalesce(F.nullif(F.regexp_extract(rest, "(?s)^([^/]*)/", 1), F.lit("")), F.when(rest.startswith("/"), F.lit("")).otherwise(F.regexp_extract(rest, "^[^?#]*", 0))))
    return F.struct(
        F.when(whole, F.lower(F.substring_index(u, "://", 1))).alias("scheme"),
        authority.alias("authority"),
        F.substring_index(F.substring(rest, F.coalesce(F.length(authority), F.lit(0)) + 1, F.length(rest)), "#", 1).alias("tail"),
    )


def _canonical(x: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.regexp_replace(x["authority"], "(?s)^.*@", "")), r"^www\.", "")
    host = F.when(x["scheme"] == "http", F.regexp_replace(bare, ":80$", "")).when(x["scheme"] == "https", F.regexp_replace(bare, ":443$", "")).otherwise(bare)
    path = F.regexp_replace(_encoded(F.substring_index(x["tail"], "?", 1), "/" + _UNRESERVED), "/+$", "")
    rest = F.concat(_let(path, lambda p: F.when(p == "", "/").otherwise(p)), _encoded(F.regexp_extract(x["tail"], r"\?[\s\S]*$", 0), r"\x00-\x7F"))
    site = F.concat(x["scheme"], F.lit("://"), F.regexp_extract(x["authority"], "(?s)^(.*@)?", 1), host)
    return F.when(x["tail"].isNotNull(), F.concat(F.coalesce(site, F.lit("")), rest))


def _prefixed(field: Column) -> Column:
    """The bytes of a text after their number in four bytes, the lowest first; a null counts as empty."""
    size = lambda d: F.lpad(F.hex(F.octet_length(d)), 8, "0")
    little = lambda n: F.unhex(F.concat(*[F.substring(n, k, 2) for k in (7, 5, 3, 1)]))
    return _let(F.encode(F.coalesce(field.cast("string"), F.lit("")), "UTF-8"), lambda d: F.concat(_let(size(d), little), d))


def line_number(n: Column) -> Column:
    """Four bytes of a line number: 0 for none, the largest for 0, and one byte more after the largest itself."""
    top = F.lit(2**32 - 1)
    size = F.lpad(F.hex(F.when(n.isNull(), F.lit(0)).when(n == 0, top).otherwise(n).cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(size, k, 2) for k in (7, 5, 3, 1)], F.when(n == top, "01").otherwise("")))


def place_number(n: Column) -> Column:
    """Eight bytes of a number, the lowest first."""
    size = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(size, k, 2) for k in range(15, 0, -2)]))


@F.pandas_udf(T.StringType())
def _fnv(data: pd.Series) -> pd.Series:
    """16 hexadecimal digits of the hash of each row's bytes, all rows one byte at a time."""
    import numpy as np

    rows = [bytes(b) if b is not None else b"" for b in data]
    order = np.argsort([-len(b) for b in rows], kind="stable")
    width = np.array([len(rows[i]) for i in order])
    h = np.full(len(rows), OFFSET, dtype=np.uint64)
    joined = np.frombuffer(b"".join(rows[i] for i in order), dtype=np.uint8).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(width)[:-1]]) if len(rows) else width
    for k in range(int(width[0]) if len(rows) else 0):
        n = int(np.searchsorted(-width, -k, side="left"))
        h[:n] = (h[:n] ^ joined[start[:n] + k]) * np.uint64(PRIME)
    out = np.empty(len(rows), dtype=object)
    out[order] = [f"{x:016x}" for x in h.tolist()]
    return pd.Series(out)


def stable_id(prefix: str, entity: str, *fields: Column, namespace: str = NAMESPACE) -> Column:
    """prefix_ and 16 digits for an entity; fields are texts, or bytes of line_number() and place_number()."""
    head = F.unhex(F.lit(f"{namespace}\0{entity}\0".encode().hex()))
    return F.concat(F.lit(f"{prefix}_"), _fnv(F.concat(head, *fields)))


def query_fingerprint(query: Column, namespace: str = NAMESPACE) -> Column:
    """fp_ and 16 digits of a query text, from which it can't be read back."""
    return F.concat(F.lit("fp_"), _fnv(F.concat(F.lit(f"{namespace}-query\0").cast("binary"), F.encode(F.coalesce(query, F.lit("")), "UTF-8"))))


def operation_id(kind: Column, subquery: Column, subject: Column, version: Column, ecosystem: Column, **given) -> Column:
    """What tells one operation of a request from others: the subquery of a search; fingerprints of
    what is looked up for an advisory, a package or a known exploit."""
    fp = lambda c: query_fingerprint(c, **given)
    return (
        F.when(kind == "search", F.concat(F.lit("search:"), subquery))
        .when(kind == "advisory", F.concat(F.lit("advisory-id:"), fp(subject)))
        .when(kind == "package", F.concat(F.lit("advisory-package:"), ecosystem, F.lit(":"), fp(subject), F.lit(":"), F.when(version.isNotNull(), fp(version)).otherwise("none")))
        .when(kind == "kev", F.concat(F.lit("kev:"), fp(subject)))
    )


def plan_key(tool: str, *fields: Column, namespace: str = NAMESPACE) -> Column:
    """16 digits that tell a request's plan from those of other tools and contents."""
    return F.substring(stable_id("", "request_plan", _prefixed(F.lit(tool)), *fields, namespace=namespace), 2, 16)


def source_id(provider: Column, url: Column, title: Column, kind: Column, **given) -> Column:
    return stable_id("src", "source", _prefixed(provider), _prefixed(canonical_url(url)), _prefixed(title), _prefixed(kind), **given)


def document_id(url: Column, title: Column, kind: Column, **given) -> Column:
    return stable_id("doc", "doc", _prefixed(canonical_url(url)), _prefixed(title), _prefixed(kind), **given)


def chunk_id(document: Column, place: Column, headings: Column, **given) -> Column:
    return stable_id("chunk", "chunk", _prefixed(document), place_number(place), _prefixed(headings), **given)


def span_id(locator: Column, first: Column, last: Column, symbol: Column, **given) -> Column:
    return stable_id("span", "code_span", _prefixed(locator), line_number(first), line_number(last), _prefixed(symbol), **given)


def locator_id(host: Column, owner: Column, repo: Column, ref: Column, path: Column, **given) -> Column:
    """Of a place in a repository: letters in lower case, .git and slashes around the path left out."""
    bare = F.regexp_replace(F.lower(repo), r"\.git$", "")
    return stable_id("loc", "locator", _prefixed(F.lower(host)), _prefixed(F.lower(owner)), _prefixed(bare), _prefixed(F.lower(ref)), _prefixed(F.regexp_replace(F.lower(path), "^/+|/+$", "")), **given)
