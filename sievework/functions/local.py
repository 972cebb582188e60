"""Files of a workspace, links of pages and remotes of repositories, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import urls
from sievework.functions.sources import holds, low

# Files and folders that are not indexed.
SKIPPED = [".git", "target", "node_modules", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", "__pycache__", ".next", ".turbo", "coverage"]
BINARY = (
    "exe dll so dylib o a lib png jpg jpeg gif bmp ico svg webp mp3 mp4 wav avi mov mkv flac zip tar gz bz2 xz 7z rar pdf doc docx xls xlsx ppt pptx"
    " bin dat db sqlite woff woff2 ttf otf wasm"
).split()
GENERATED = [".lock", ".min.js", ".min.css", ".map"]
ROLE_SCORES = {"implementation": 10.0, "test": 5.0, "example": 5.0, "documentation": 8.0, "readme": 12.0}

# Endings of paths and what they link to, in order.
LINK_ENDINGS = {
    "pdf": [".pdf"],
    "image": [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico"],
    "source_code": [
        ".rs", ".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".c", ".cpp", ".h", ".java", ".rb", ".json", ".toml", ".yaml", ".yml", ".xml", ".css", ".scss", ".sh", ".bash",
    ],
    "download": [".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".exe", ".dmg", ".msi", ".deb", ".rpm", ".apk", ".war", ".jar"],
    "feed": [".rss", ".atom", "/feed", "/rss"],
}
DOCS_HOSTS = ["docs.rs", "doc.rust-lang.org", "docs.python.org", "developer.mozilla.org", "pkg.go.dev", "docs.npmjs.com", "docs.docker.com", "docs.github.com"]
DOCS_PATHS = ["/docs/", "/documentation/", "/guide/", "/manual/", "/reference/"]

# What pages say that ask for a proof instead of giving the document.
CHALLENGES = {
    "anubis": ([], ["anubis_challenge", "anubis_version", "anubis_base_prefix", "anubis could not load its javascript"]),
    "altcha": ([], ["captcha-wrap", "javascript is required to complete this challenge", "captcha/challenge"]),
    "interactive": (
        ["access denied", "security check", "verify you are human"],
        ["cf-turnstile", "g-recaptcha", "h-captcha", "challenge-platform", "verify you are human", "interactive challenge"],
    ),
    "verification": (["just a moment", "checking your browser", "verifying your browser", "security verification"],) * 2,
}


def ends(text: Column, endings: list[str]) -> Column:
    return text.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")


def eligible(path: Column, size: Column, most: int, hidden: bool = False) -> Column:
    """Whether a file is indexed: no binary ending, no folder that is skipped or hidden, not too large."""
    parts = F.split(path, "/")
    skipped = F.exists(parts, lambda p: p.isin(SKIPPED) | (p.startswith(".") & (p != ".") & (p != "..") if not hidden else F.lit(False)))
    ending = F.lower(F.regexp_extract(F.element_at(parts, -1), r"[^.]\.([^.]*)$", 1))
    return ~skipped & ~ending.isin(BINARY) & (size <= most)


def file_score(path: Column, query: Column, tokens: Column, language: Column, role: Column) -> Column:
    """How well a file fits a query by its path alone."""
    whole = F.lower(path)
    name = F.element_at(F.split(whole, "/"), -1)
    found = F.when(name == query, 100.0).otherwise(0.0) + 20.0 * F.size(F.filter(tokens, lambda t: F.contains(whole, t)))
    dull = sum((F.when(name.endswith(e), 150.0).otherwise(0.0) for e in GENERATED), F.lit(0.0))
    by_role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_SCORES.items() for x in kv]), role), F.lit(0.0))
    return found + F.when((found > 0) & language.isNotNull(), 5.0).otherwise(0.0) - dull + by_role


def remote(url: Column) -> Column:
    """struct(kind, host, owner, repo) of a remote in URL or scp form; null for what is neither."""
    u = F.trim(url)
    shape, scp = r"^(?i:https?|ssh|git)://(?:[^/@]*@)?([^/:]+)(?::[0-9]+)?/+(.*?)/*$", r"^(?:.*@)?([^:@]+):/*(.+)$"
    is_url = u.rlike(shape)
    is_scp = ~F.contains(u, F.lit("://")) & u.rlike(scp)
    host = F.when(is_url, F.lower(F.regexp_extract(u, shape, 1))).when(is_scp, F.regexp_extract(u, scp, 1))
    path = F.regexp_replace(F.when(is_url, F.regexp_extract(u, shape, 2)).when(is_scp, F.regexp_extract(u, scp, 2)), r"\.git$", "")
    bare = F.regexp_replace(F.lower(host), r"^(?:www\.)+", "")
    kind = (
        F.when(bare == "github.com", "github")
        .when(bare == "gitlab.com", "gitlab")
        .when(bare == "codeberg.org", "codeberg")
        .when(F.contains(bare, F.lit("gitlab")), "gitlab")
        .when(holds(bare, ["gitea", "forgejo"]), "gitea")
        .otherwise("unknown")
    )
    return F.when(F.contains(path, F.lit("/")), F.struct(kind.alias("kind"), host.alias("host"), F.regexp_replace(path, "/[^/]*$", "").alias("owner"), F.regexp_extract(path, "([^/]*)$", 1).alias("repo")))


def link_kind(page: Column, link: Column) -> Column:
    """What a link of a page leads to, by host and path."""
    there, here = F.coalesce(urls.host(link), F.lit("")), F.coalesce(urls.host(page), F.lit(""))
    raw = lambda u: F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), r"^(?=\?|$)", "/")
    path = F.lower(F.substring_index(raw(link), "?", 1))
    forge = there.isin("github.com", "gitlab.com")
    docs = there.isin(DOCS_HOSTS) | there.rlike(r"(?:^|\.)readthedocs\.io$")
    out = F.when((there == here) & (raw(link) == raw(page)), "same_page_anchor")
    for kind, endings in LINK_ENDINGS.items():
        out = out.when(ends(path, endings), kind)
    return (
        out.when(forge & holds(path, ["/issues/"]), "issue")
        .when(forge & holds(path, ["/pull/", "/merge_requests/"]), "pull_request")
        .when(forge & holds(path, ["/releases/", "/tags/"]), "release")
        .when(holds(path, ["/advisories/", "/security/", "/ghsa/"]), "security_advisory")
        .when(docs, F.when(holds(path, ["/api/", "/api-reference/"]), "api_reference").otherwise("documentation"))
        .when(holds(path, DOCS_PATHS), "documentation")
        .otherwise(F.when(here == there, "same_domain").otherwise("external"))
    )


def challenge(title: Column, body: Column) -> Column:
    """The family of a page that asks for a proof; null for any other page."""
    t, b = low(title), low(body)
    out = F
    for kind, (titles, bodies) in CHALLENGES.items():
        out = out.when(holds(t, titles) | holds(b, bodies), kind)
    return out.otherwise(F.lit(None).cast("string"))


def timestamp(raw: Column) -> Column:
    """RFC 3339 or a calendar date as a timestamp; null for anything else."""
    t = F.trim(raw)
    full = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})$"
    return F.when(t.rlike(full) | t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(F.upper(t)))
