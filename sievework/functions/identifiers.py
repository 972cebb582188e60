"""Identifiers, injection markers and frames in text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import text as texts

# Shapes of identifiers, by family, in the order in which families are listed.
FAMILIES = {
    "cve": r"(?i)\b(CVE-\d{4}-\d{4,})\b",
    "ghsa": r"(?i)\b(GHSA-[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4})\b",
    "rustsec": r"(?i)\b(RUSTSEC-\d{4}-\d{4,})\b",
    "cwe": r"(?i)\b(CWE-\d{2,4})\b",
}
# Text that tries to speak to a model.
MARKERS = {
    "ignore_previous": r"(?i)\bignore\s+(all|the)\s+(previous|prior|above)\s+(instructions?|prompts?)\b",
    "disregard_all": r"(?im)\bdisregard\s+(all|any|previous|the)\b",
    "system_colon": r"(?m)^\s*system\s*:\s*",
    "assistant_colon": r"(?m)^\s*assistant\s*:\s*",
    "im_start": r"<\|im_start\|>",
    "im_end": r"<\|im_end\|>",
    "chatml_tag": r"</?(system|user|assistant|tool)\s*>",
}
HIDDEN = r"[\u200B-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u206F\uFEFF]"


def found(text: Column, family: str) -> Column:
    """Distinct identifiers of a family in upper case, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(texts.ascii_bounds(FAMILIES[family])), 1), F.upper))


def all_identifiers(text: Column) -> Column:
    """Those of all families, CVE first."""
    return F.array_distinct(F.concat(*[F.coalesce(found(text, f), F.array().cast("array<string>")) for f in FAMILIES]))


def markers(text: Column) -> dict[str, Column]:
    """How often each marker stands in a text. Hidden characters are taken out for a second look,
    and the larger of both counts is given."""
    shown = F.regexp_replace(text, HIDDEN, "")
    return {m: F.greatest(F.regexp_count(text, F.lit(p)), F.regexp_count(shown, F.lit(p))) for m, p in ((m, texts.ascii_bounds(p)) for m, p in MARKERS.items())}


def framed(text: Column, field: str, key: Column) -> Column:
    """A text between marks that name its field and key; marks inside it are broken up."""
    name = F.regexp_replace(key.cast("string"), r"[<>\n\r=]", "")
    body = F.replace(text, F.lit("<<<"), F.lit("< < <"))
    return F.concat(F.lit(f"<<<EXTERNAL_UNTRUSTED field={field} id="), name, F.lit(">>>\n"), body, F.lit("\n<<<END>>>"))


def focus_score(query: Column, text: Column, heading: Column) -> Column:
    """How well a chunk answers a query: ten times the share of query tokens it has, eight for the
    query as a phrase, six for the query as written, three for each query token in its headings;
    zero if they share no token. Repeated query tokens count in the denominator."""
    asked, has = texts.tokens(query), texts.tokens(text)
    shared = F.size(F.array_intersect(asked, has))
    plain = lambda c: F.translate(texts.one_line(c), texts.UPPER, texts.LOWER)
    score = (
        10.0 * shared / F.size(asked)
        + F.when((plain(query) != "") & F.contains(plain(text), plain(query)), 8.0).otherwise(0.0)
        + F.when((F.octet_length(query) >= 3) & F.contains(text, query), 6.0).otherwise(0.0)
        + 3.0 * F.size(F.array_intersect(asked, texts.tokens(heading)))
    )
    return F.when(shared > 0, F.round(score, 9)).otherwise(0.0)
