"""Pieces of a query text: error codes, frames and packages, repository hints, domains and package
coordinates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import ascii_bounds

# Shapes in error messages.
SECRET = r"(?i)(?:api[_-]?key|api[_-]?token|access[_-]?key|secret[_-]?key|secret|token|password|passwd|authorization)\s*[=:]\s*(?:bearer\s+|basic\s+|token\s+)?[\"']?([A-Za-z0-9_\-.=+/]{16,})[\"']?"
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
ADDRESS = r"(?i)0x[0-9a-f]{8,}"
CODES = r"(?i)\b(E0\d{3}|TS\d{4,5})\b"
HTTP_STATUS = r"\b([45]\d{2})\s+(?:Not Found|Internal Server Error|Bad Request|Unauthorized|Forbidden|Service Unavailable|Gateway Timeout)"
CARGO_PACKAGE = r"(?:package|crate)\s+`([^`]+)`"
PYTHON_FRAME = r"File \"([^\"]+)\", line (\d+), in (\w+)"
MODULE_PATH = r"\b(\w+::[\w:]+)\b"
SOURCE_FILE = r"\b([\w/_-]+\.(?:rs|py|js|ts|tsx|jsx|go|java|cpp|c|h|hpp))\b"
PRIMARY = r"(?i)\b[ET]\d{3,5}\b|error|exception|panicked|failed"

# Names of a hint, and the hint.
HINTS = {"repo": "repo", "repository": "repo", "project": "repo", "org": "org", "owner": "org", "path": "path", "file": "file", "lang": "language", "language": "language", "symbol": "symbol", "host": "host"}

# Aliases of package ecosystems, their names at the advisory database, and where their packages are shown.
ECOSYSTEMS = {
    "crates_io": (["crates_io", "crates.io", "cargo", "rust"], "crates.io", "https://crates.io/crates/"),
    "pypi": (["pypi", "python"], "PyPI", "https://pypi.org/project/"),
    "npm": (["npm", "javascript", "node"], "npm", "https://www.npmjs.com/package/"),
    "go": (["go", "go_modules"], "Go", "https://pkg.go.dev/"),
    "maven": (["maven", "gradle", "jvm"], "Maven", "https://central.sonatype.com/artifact/"),
    "nuget": (["nuget", "dotnet", ".net"], "NuGet", "https://www.nuget.org/packages/"),
    "rubygems": (["rubygems", "ruby", "gem"], "RubyGems", "https://rubygems.org/gems/"),
    "packagist": (["packagist", "composer", "php"], "Packagist", "https://packagist.org/packages/"),
}


def redacted(text: Column) -> Column:
    """Secrets, identifiers and addresses of memory replaced by what they are."""
    out = F.when(text.rlike("[=:]"), F.regexp_replace(text, SECRET, "<secret>")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(out, UUID, "<uuid>"), ADDRESS, "<address>")


def error_parts(text: Column) -> Column:
    """struct(codes, statuses, packages, files, modules, frames, primary): distinct pieces in order of
    first appearance; primary is the first line that speaks of an error, else the first that is not blank."""
    none = F.array().cast("array<string>")

    def every(p, k=1, sign=None):
        """All matches; where a plain sign that each of them holds is missing, the pattern is not tried."""
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(ascii_bounds(p)), k))
        return found if sign is None else F.when(F.contains(text, F.lit(sign)), found).when(text.isNotNull(), none)

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    wrong = F.filter(lines, lambda x: x.rlike(ascii_bounds(PRIMARY)))
    return F.struct(
        F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ascii_bounds(CODES)), 1), F.upper)).alias("codes"),
        every(HTTP_STATUS).alias("statuses"),
        every(CARGO_PACKAGE, sign="`").alias("packages"),
        every(SOURCE_FILE, sign=".").alias("files"),
        every(MODULE_PATH, sign="::").alias("modules"),
        every(PYTHON_FRAME, 0, sign="File \"").alias("frames"),
        F.coalesce(F.get(wrong, 0), F.get(lines, 0)).alias("primary"),
    )


def repo_hints(query: Column) -> Column:
    """struct(owner, repo, org, path, file, language, symbol, host, residual) of a query: the last of
    each name:value token (repo=owner/name too); owner/repo also from the first bare word of that
    form; the residual is what no hint was taken from, in order."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    shape = {k: rf'(?i)^(?:{"|".join(n for n, x in HINTS.items() if x == k)}){"[:=]" if k == "repo" else ":"}"*([^"].*?)?"*$' for k in dict.fromkeys(HINTS.values())}
    value = lambda w, kind: F.nullif(F.regexp_extract(w, shape[kind], 1), F.lit(""))
    pair = "^[^/]+/.+$"

    def last(kind):
        mine = F.filter(F.transform(words, lambda w: value(w, kind)), lambda v: v.isNotNull() & (v.rlike(pair) if kind == "repo" else F.lit(True)))
        return F.when(F.size(mine) > 0, F.element_at(mine, -1))

    bare_shape = r"^[\p{L}\p{N}_-]+/[\p{L}\p{N}_-]+$"
    bare = F.get(F.filter(words, lambda w: w.rlike(bare_shape)), 0)
    hints = {k: F.lower(last(k)) if k in ("language", "host") else last(k) for k in shape}
    where = F.coalesce(hints["repo"], bare)
    taken = lambda w: F.exists(F.array(*[(F.lower(value(w, k)) if k in ("language", "host") else value(w, k)) == hints[k] for k in shape], w.rlike(bare_shape) & (w == where)), lambda x: F.coalesce(x, F.lit(False)))
    return F.struct(
        F.substring_index(where, "/", 1).alias("owner"),
        F.regexp_replace(where, "^[^/]*/", "").alias("repo"),
        *[hints[k].alias(k) for k in ("org", "path", "file", "language", "symbol", "host")],
        F.array_join(F.filter(words, lambda w: ~taken(w)), " ").alias("residual"),
    )


def domain(raw: Column) -> Column:
    """A domain filter in lower case without white space around it; null if it is none: no scheme,
    port, path or wildcard, at most 253 characters, labels of 1 to 63 letters, digits and inner hyphens."""
    d = F.lower(F.trim(raw))
    return F.when((F.length(d) <= 253) & d.rlike(r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*$"), d)


def ecosystem(name: Column) -> Column:
    """The ecosystem that an alias names; null if none."""
    m = F.create_map(*[F.lit(x) for e, (aliases, _, _) in ECOSYSTEMS.items() for a in aliases for x in (a, e)])
    return F.try_element_at(m, F.lower(F.trim(name)))


def advisory_name(eco: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for e, (_, osv, _) in ECOSYSTEMS.items() for x in (e, osv)]), eco)


def package_url(eco: Column, name: Column) -> Column:
    """Where a package is shown: segments percent-encoded, those of one or two dots too."""
    base = F.try_element_at(F.create_map(*[F.lit(x) for e, (_, _, u) in ECOSYSTEMS.items() for x in (e, u)]), eco)
    seg = lambda s: F.when(s.isin(".", ".."), F.replace(s, F.lit("."), F.lit("%2E"))).otherwise(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")))
    return F.concat(base, F.array_join(F.transform(F.split(name, "/"), seg), "/"))
