"""What a query is after, from its words alone, as a Column expression."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import errors, queries
from sievework.functions.text import ascii_bounds

BOUND = 512  # characters of a query that are read: queries are short, and the rest tells nothing more
_FILES = "rs|py|ts|tsx|js|jsx|go|java|kt|rb|php|cs|cpp|cxx|hpp|h|swift|scala|ex|exs|hs"

# Shapes that tell a class for certain.
COMPILER_CODE = r"(?i)\b(?:E0\d{3}|TS\d{4,5}|CS\d{4})\b"
FRAME = rf"\b[\w./-]*\.(?:{_FILES}):\d+(?::\d+)?\b"
VULNERABILITY_ID = r"(?i)\b(?:CVE-\d{4}-\d{4,}|GHSA(?:-[0-9a-z]{4}){2,}|RUSTSEC-\d{4}-\d{4})\b"
VERSIONS = [
    r"(?:\b[a-z][a-z0-9._-]*\s*)?(?:==|>=|<=|~=|\^|~)\s*v?\d+\.\d+(?:\.\d+)?\b",
    r"\b[A-Za-z0-9][A-Za-z0-9_.-]*@\d+\.\d+(?:\.\d+)?\b",
    r"\b[a-z][a-z0-9._-]{1,}\s+v?\d+\.\d+\.\d+\b",
]
COMPARISON = r"(?i)\S+\s+vs\.?\s+\S+"
CODE_TOKENS = [
    r"\b[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)+\b",
    r"\b[a-z][a-z0-9]*_[a-z0-9_]+\b",
    r"\b[a-z][a-z0-9]*(?:[A-Z][a-z0-9]+){2,}\b",
    r"\b[\w.-]+/[\w.-]+/[\w.-]+\b",
    rf"(?i)\b[\w-]+\.(?:{_FILES}|toml|lock|json|yaml|gradle|nix)\b",
    r"\b[a-z_][a-z0-9_]*\(\s*\)",
]
# Words and phrases of each class.
PANICS = ["backtrace", "core dumped", "panic:", "panicked at", "segmentation fault", "stack trace", "thread '", "traceback (most recent call last)"]
VULNERABILITY = "advisories advisory cve exploit exploited exploits ghsa rustsec vulnerabilities vulnerability vulnerable".split()
MIGRATION = "migrate migrated migrates migrating migration migrations upgrade upgraded upgrades upgrading".split()
COMPARISONS = ["alternative to", "alternatives to", "better than", "compared to", "compared with", "difference between"]
RELEASE = "changelog changelogs release released releases releasing".split()
RELEASES = ["release note", "release notes", "version history", "what's new", "whats new"]
ISSUE, ISSUES = "bug bugs issue issues pr prs".split(), ["pull request", "pull requests", "bug report", "bug reports"]
DOCS, DOCS_PHRASES = "doc docs documentation handbook manual tutorial tutorials".split(), ["api docs", "api reference", "getting started", "how to", "howto"]
NEWS, NEWS_PHRASES = "announced announcement headlines latest news recent recently today trending".split(), ["breaking news", "this month", "this week"]


# Reasons that are certain, and spellings of a repository hint.
CERTAIN = [
    "compiler_error_code", "stack_frame", "vulnerability_identifier", "dependency_version", "repo_hint", "symbol_hint",
    "path_hint", "file_hint", "language_hint", "host_hint", "code_token",
]
REPO_HINTS = ["repo:", "repository:", "project:", "repo=", "org:"]


# A pattern is tried only where its sign stands; a sign costs one look at the text.
VERSION_SIGN, FRAME_SIGN, TOKEN_SIGN = r"\d\.\d", r":\d", r"::|_|[a-z0-9][A-Z]|/|\.[A-Za-z]|\("


def _first_class(x: Column) -> Column:
    """struct(intent, reasons) of the first class with a reason, classes after it left alone; null
    if there is none. x: struct(text, low, words, known)."""
    text, low, words = x["text"], x["low"], x["words"]
    shape = lambda sign, *ps: text.rlike(sign) & F.exists(F.array(*[text.rlike(ascii_bounds(p)) for p in ps]), lambda b: b)
    # One look tells whether any of the words of all classes stands in the text.
    has = lambda ws: x["known"] & F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws]))
    says = lambda ps: reduce(or_, [F.contains(low, F.lit(p)) for p in ps])
    why = lambda **rs: F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rs.items()]))

    def hinted(h):
        return why(
            repo_hint=(h["owner"].isNotNull() | h["org"].isNotNull()) & says(REPO_HINTS),
            **{f"{k}_hint": h[k].isNotNull() for k in ("symbol", "path", "file", "language", "host")},
            code_token=shape(TOKEN_SIGN, *CODE_TOKENS),
        )

    frames = F.when(text.rlike(r"\d"), shape(FRAME_SIGN, FRAME) | (errors.n_frames(text) > 0))
    classes = [
        ("code", why(compiler_error_code=text.rlike(ascii_bounds(COMPILER_CODE)), error_vocabulary=errors.any_code(text), stack_frame=frames, panic_marker=says(PANICS))),
        ("security", why(vulnerability_identifier=text.rlike(ascii_bounds(VULNERABILITY_ID)), vulnerability_vocabulary=has(VULNERABILITY))),
        ("code", why(dependency_version=shape(VERSION_SIGN, *VERSIONS))),
        ("releases", why(migration_vocabulary=has(MIGRATION))),
        ("web", why(comparison_vocabulary=(F.contains(low, F.lit("vs")) & text.rlike(COMPARISON)) | says([*COMPARISONS, " versus "]) | low.startswith("versus "))),
        ("releases", why(release_vocabulary=has(RELEASE) | says(RELEASES))),
        ("issues", why(issue_vocabulary=has(ISSUE) | says(ISSUES))),
        ("code", F.get(F.transform(F.array(F.when(text.rlike("[:=/]"), queries.repo_hints(text))), hinted), 0)),
        ("docs", why(docs_vocabulary=has(DOCS) | says(DOCS_PHRASES))),
        ("news", why(news_vocabulary=has(NEWS) | says(NEWS_PHRASES))),
    ]
    told = lambda name, reasons: F.get(F.filter(F.array(F.struct(F.lit(name).alias("intent"), reasons.alias("reasons"))), lambda c: F.size(c["reasons"]) > 0), 0)
    return F.coalesce(*[told(name, reasons) for name, reasons in classes])


def derive(query: Column) -> Column:
    """struct(intent, confidence, reasons): the first class that anything in the query speaks for, with
    all that speaks for it; high if one of the reasons is certain, else medium; web with low
    confidence if nothing does or the query is null."""
    text = F.substring(query, 1, BOUND)
    low = F.lower(text)
    words = F.split(low, "[^a-z0-9']+")
    known = F.arrays_overlap(words, F.array(*[F.lit(w) for ws in (VULNERABILITY, MIGRATION, RELEASE, ISSUE, DOCS, NEWS) for w in ws]))
    bound = F.struct(text.alias("text"), low.alias("low"), words.alias("words"), known.alias("known"))
    first = F.get(F.transform(F.array(bound), _first_class), 0)
    confidence = lambda c: F.when(F.arrays_overlap(c["reasons"], F.array(*[F.lit(r) for r in CERTAIN])), "high").otherwise("medium")
    is_ = lambda c: F.struct(c["intent"].alias("intent"), confidence(c).alias("confidence"), c["reasons"].alias("reasons"))
    none = F.struct(F.lit("web").alias("intent"), F.lit("low").alias("confidence"), F.array(F.lit("no_signal")).alias("reasons"))
    return F.get(F.transform(F.array(first), lambda c: F.when(c.isNull(), none).otherwise(is_(c))), 0)
