"""Text clean-up and tokens as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turned into a space, and removed: controls, zero-width and direction marks.
TO_SPACE = r"[\x00\r\u2028\u2029]"
REMOVED = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\u200B-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u206F\uFEFF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_bounds(pattern: str) -> str:
    r"""A pattern whose \b stand where a character of \w meets one outside it, accented letters being outside as
    they are in the SQL. Java's own \b counts them as letters before version 19, but its \w does not. Before a
    letter, or a class or group (all branches) that begins with one, it is enough to look back."""
    begun = re.sub(r"\\b(?=(?:\((?:\?:)?)?(?:[A-Za-z0-9_]|(?:\\w|\[(?:[A-Za-z0-9](?:-[A-Za-z0-9])?|_)+\])(?![*?])))", r"(?<!\\w)", pattern)
    return begun.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def visible(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, TO_SPACE, " "), REMOVED, "")


def n_removed(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, REMOVED, ""))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def bounded(text: Column, n: int) -> Column:
    """At most n characters, the last of a cut text an ellipsis."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, A-Z in lower case."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def package_name(ecosystem: Column, name: Column) -> Column:
    """The canonical spelling: pypi folds runs of - _ . and case, nuget folds case."""
    folded = F.regexp_replace(F.lower(name), "[-_.]+", "-")
    return F.when(ecosystem == "pypi", folded).when(ecosystem == "nuget", F.lower(name)).otherwise(name)
