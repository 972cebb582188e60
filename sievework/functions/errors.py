"""What an error text tells: codes, tools, language, packages, frames and the subqueries they make, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import text as texts
from sievework.functions.sources import holds

# Shapes of codes, and texts that stand for one.
RUST_CODE = r"(?i)\b(E0\d{3})\b"
TYPESCRIPT_CODE = r"(?i)\b(TS\d{4,5})\b"
HTTP_STATUS = r"\b([45]\d{2})\s+(?:Not Found|Internal Server Error|Bad Request|Unauthorized|Forbidden|Service Unavailable|Gateway Timeout)"
PYTHON_EXCEPTIONS = (
    "TypeError ValueError KeyError IndexError AttributeError ImportError ModuleNotFoundError FileNotFoundError PermissionError RuntimeError RecursionError"
    " StopIteration AssertionError NotImplementedError OSError IOError SyntaxError IndentationError TabError OverflowError ZeroDivisionError MemoryError"
    " UnboundLocalError NameError UnicodeDecodeError UnicodeEncodeError ConnectionError TimeoutError JSONDecodeError"
).split()
NPM_ERRORS = ["ERESOLVE", "ENOENT", "EACCES", "EEXIST", "ENOTDIR", "ENOTEMPTY"]
CARGO_ERRORS = ["failed to select a version", "no matching package found", "could not find `"]
# Words that tell a tool, and the languages of tools.
TOOL_WORDS = {
    "cargo": ["cargo", "crate"], "docker": ["docker"], "linker": ["gcc", "clang", "linker", "ld:"], "npm": ["npm", "node"], "pnpm": ["pnpm"],
    "python": ["python", "pip"], "rustc": ["rustc", "rust"], "typescript": ["typescript", "tsc"], "yarn": ["yarn"],
}
LANGUAGES = {"rustc": "rust", "cargo": "rust", "typescript": "typescript", "python": "python", "npm": "javascript", "yarn": "javascript", "pnpm": "javascript"}
# Shapes of package names and frames.
NPM_PACKAGE = r"(?:package |install |resolve )([a-z@][a-z0-9._/-]+(?:@[0-9.]+)?)"
CARGO_PACKAGE = r"(?:package|crate)\s+`([^`]+)`"
CARGO_NO_MATCH = r"no matching package found:\s*(\S+)"
PIP_PACKAGE = r"(?:Package|Requirement) ([a-z][a-z0-9_-]+)"
PYTHON_FRAME = r"File \"([^\"]+)\", line (\d+), in (\w+)"
RUST_FRAME = r"(?m)^\s+(?:at\s+)?([\w:/._-]+):(\d+)$"
PRIMARY_CODE = r"(?i)\b[ET]\d{3,5}\b"

CODES = "array<struct<code:string,tool:string>>"


def codes(text: Column) -> Column:
    """array of (code, tool), distinct: those of compilers, exceptions, package managers and HTTP."""
    every = lambda p, f, tool: F.transform(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(texts.ascii_bounds(p)), 1), f)), lambda c: F.struct(c.alias("code"), F.lit(tool).alias("tool")))
    words = lambda ws, tool, before="": F.filter(F.array(*[F.struct(F.when(F.contains(text, F.lit(w)), F.lit(before + w)).alias("code"), F.lit(tool).alias("tool")) for w in ws]), lambda c: c["code"].isNotNull())
    return F.concat(
        every(RUST_CODE, F.upper, "rustc"),
        every(TYPESCRIPT_CODE, F.upper, "typescript"),
        words(PYTHON_EXCEPTIONS, "python"),
        words(NPM_ERRORS, "npm"),
        words(CARGO_ERRORS, "cargo", "cargo:"),
        every(HTTP_STATUS, lambda c: F.concat(F.lit("HTTP "), c), "http"),
    ).cast(CODES)


def any_code(text: Column) -> Column:
    """Whether codes() finds any, with the first sign of one."""
    out = text.rlike(texts.ascii_bounds(RUST_CODE)) | text.rlike(texts.ascii_bounds(TYPESCRIPT_CODE))
    for w in [*PYTHON_EXCEPTIONS, *NPM_ERRORS, *CARGO_ERRORS]:
        out |= F.contains(text, F.lit(w))
    return out | text.rlike(texts.ascii_bounds(HTTP_STATUS))


def tools(text: Column, found: Column) -> Column:
    """Tools of the codes and those that words speak of, sorted."""
    said = F.array_compact(F.array(*[F.when(holds(F.lower(text), ws), F.lit(t)) for t, ws in TOOL_WORDS.items()]))
    return F.array_sort(F.array_distinct(F.concat(F.transform(found, lambda c: c["tool"]), said)))


def language(found: Column, used: Column) -> Column:
    """The language of the first code that has one, else of the first tool."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    first = lambda names: F.get(F.filter(F.transform(names, lambda t: F.try_element_at(known, t)), lambda x: x.isNotNull()), 0)
    return F.coalesce(first(F.transform(found, lambda c: c["tool"])), first(used))


def packages(text: Column) -> Column:
    """Names of packages in a text, sorted; scoped names of npm are passed over."""
    every = lambda p: F.regexp_extract_all(text, F.lit(p), 1)
    npm = F.transform(F.filter(every(NPM_PACKAGE), lambda p: ~p.startswith("@") & (F.length(p) > 1)), lambda p: F.substring_index(p, "@", 1))
    return F.array_sort(F.array_distinct(F.concat(npm, every(CARGO_PACKAGE), every(CARGO_NO_MATCH), every(PIP_PACKAGE))))


def n_frames(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PYTHON_FRAME)) + F.regexp_count(text, F.lit(RUST_FRAME))


def primary_line(text: Column) -> Column:
    """The first line with a code, or with "error" and 11 to 199 bytes; else the first of that
    length; else the first 200 characters; white space folded."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    fits = lambda x: (F.octet_length(x) > 10) & (F.octet_length(x) < 200)
    told = F.filter(lines, lambda x: x.rlike(texts.ascii_bounds(PRIMARY_CODE)) | (F.contains(F.lower(x), F.lit("error")) & fits(x)))
    return F.coalesce(texts.one_line(F.get(told, 0)), texts.one_line(F.get(F.filter(lines, fits), 0)), F.substring(texts.one_line(text), 1, 200))


def subqueries(text: Column, most: int = 8) -> Column:
    """array of (label, query, target): what is asked about an error text, at most ``most``."""
    kind = "array<struct<label:string,query:string,target:string>>"
    one = lambda label, query, target: F.struct(F.lit(label).alias("label"), query.alias("query"), F.lit(target).alias("target"))

    def made(p):
        found, names, lang, exact = p["codes"], p["packages"], p["language"], p["exact"]
        when = lambda c, x: F.when(c, F.array(x)).otherwise(F.array().cast(kind))
        code = F.transform(found, lambda c: one("error_code", F.concat_ws(" ", c["code"], F.coalesce(lang, c["tool"])), "official_docs"))
        both = lambda label, end, target: F.flatten(F.transform(names, lambda n: F.transform(found, lambda c: one(label, F.concat(n, F.lit(" "), c["code"], F.lit(end)), target))))
        docs = F.transform(F.filter(found, lambda c: lang.isNotNull()), lambda c: one("docs", F.concat(c["code"], F.lit(" "), lang, F.lit(" docs documentation")), "official_docs"))
        parts = [
            when(exact != "", one("exact_phrase", F.concat(F.lit('"'), exact, F.lit('"')), "official_docs")),
            code,
            both("package_error", "", "issues"),
            docs,
            when(exact != "", one("issues", F.concat(exact, F.lit(" issues github")), "issues")),
            both("releases", " release notes changelog", "releases"),
        ]
        return F.slice(F.concat(*[x.cast(kind) for x in parts]), 1, most)

    first = F.get(F.transform(F.array(codes(text)), lambda c: F.struct(c.alias("codes"), language(c, tools(text, c)).alias("language"), packages(text).alias("packages"), primary_line(text).alias("exact"))), 0)
    return F.get(F.transform(F.array(first), made), 0)
