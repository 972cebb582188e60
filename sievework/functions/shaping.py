"""Which model a request is judged by, what is known of a code location, and how texts are cut to a size, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import paths
from sievework.functions.sources import named

# Models of coverage by the profile of a repository search and the domain of research.
PROFILES = {"security": "security_review", "research": "comparative_research", "coding": "repo_architecture"}
DOMAINS = {
    "architecture_decision": "comparative_research", "api_design": "comparative_research", "error_investigation": "error_investigation", "version_migration": "version_migration",
    "security_review": "security_review", "security": "security_review", "performance_investigation": "performance_investigation", "performance": "performance_investigation",
}
DEFAULTS = {"repo_search": "repo_architecture", "research_search": "comparative_research", "security_search": "security_review"}
FRAME, END = "<<<EXTERNAL_UNTRUSTED", "<<<END>>>"


def workflow_model(tool: Column, workflow: Column, exact_error: Column, profile: Column, domain: Column) -> Column:
    """struct(model, by): the coverage model of a request and what decided it; null for a web search."""
    by = lambda m, why: F.struct(m.alias("model"), F.lit(why).alias("by"))
    repo, research = tool == "repo_search", tool == "research_search"
    return (
        F.when(workflow.isNotNull(), by(workflow, "explicit_workflow"))
        .when(repo & F.coalesce(exact_error, F.lit(False)), by(F.lit("error_investigation"), "mode"))
        .when(repo & named(PROFILES, profile).isNotNull(), by(named(PROFILES, profile), "profile"))
        .when(research & named(DOMAINS, domain).isNotNull(), by(named(DOMAINS, domain), "domain"))
        .when(named(DEFAULTS, tool).isNotNull(), by(named(DEFAULTS, tool), "default"))
    )


def code_evidence(host: Column, owner: Column, repo: Column, ref: Column, path: Column, url: Column, language: Column, symbol: Column) -> Column:
    """struct(raw_url, browser_url, permalink, language, role, reasons) of a file of a repository; null
    without owner, repository or path. The branch is main where none is given."""
    at = F.coalesce(ref, F.lit("main"))
    blob = F.concat_ws("/", F.lit("https://github.com"), owner, repo, F.lit("blob"), at, path)
    raw = F.when(host == "github", F.concat_ws("/", F.lit("https://raw.githubusercontent.com"), owner, repo, at, path)).when(host == "gitlab", F.concat_ws("/", F.lit("https://gitlab.com"), owner, repo, F.lit("-/raw"), at, path))
    role, lang = paths.source_role(path), F.coalesce(language, paths.language(path))
    told = [("raw_url_derived", raw.isNotNull()), ("source_role_inferred", role != "unknown"), ("language_match", lang.isNotNull()), ("provider_text_match", symbol.isNotNull())]
    return F.when(
        owner.isNotNull() & repo.isNotNull() & path.isNotNull(),
        F.struct(
            raw.alias("raw_url"),
            F.when(host == "github", F.coalesce(url, blob)).otherwise(url).alias("browser_url"),
            F.when(host == "github", blob).when(host == "gitlab", url).alias("permalink"),
            lang.alias("language"),
            role.alias("role"),
            F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in told])).alias("reasons"),
        ),
    )


def clipped(text: Column, most: Column) -> Column:
    """At most so many characters of a text; of one in a frame the body is cut and the frame stays whole."""
    head = F.regexp_extract(text, r"(?s)^(<<<EXTERNAL_UNTRUSTED.*?>>>)", 1)
    framed = (head != "") & F.contains(text, F.lit(END))
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)^<<<EXTERNAL_UNTRUSTED.*?>>>(.*)<<<END>>>", 1), r"^\n+|\n+$", "")
    room = F.greatest(most - (F.length(head) + len(END) + 2), F.lit(0))
    return F.when(most <= 0, "").when(framed, F.concat(head, F.lit("\n"), F.substring(body, F.lit(1), room), F.lit("\n" + END))).otherwise(F.substring(text, F.lit(1), most))


def clipped_warning(text: Column, most: Column) -> Column:
    """The code of a warning, cut to so many characters; where none are left, only a code that a colon ends."""
    code = F.substring_index(text, ":", 1)
    return F.when(most == 0, F.when(F.contains(text, F.lit(":")), code).otherwise("")).otherwise(F.substring(code, F.lit(1), most))


# Bounds of what is read for imports, and how a line of a language imports.
SCANNED, MOST_IMPORTS, IMPORT_CHARS = 50, 30, 200
IMPORTS = {
    "rust": "^(?:pub )?use ", "python": "^(?:import |from .* import )", "typescript": r"^(?:import |from |require\()", "javascript": r"^(?:import |from |require\()", "go": '^(?:import |".*"$)',
}


def imports(text: Column, language: Column) -> Column:
    """The lines at the top of a source text that import something, comments passed over."""
    lines = F.transform(F.slice(F.split(text, "\r?\n"), 1, SCANNED), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    shape = named(IMPORTS, language)
    own = F.filter(lines, lambda x: ~x.rlike(r"^(?://|#|/\*|\*|$)") & F.coalesce(F.regexp_like(x, shape), F.lit(False)))
    return F.transform(F.slice(own, 1, MOST_IMPORTS), lambda x: F.substring(x, 1, IMPORT_CHARS))


def markdown(blocks: Column) -> Column:
    """Blocks (kind, level, language, text) as Markdown."""
    def lines(b):
        fence = F.concat(F.lit("```"), F.coalesce(b["language"], F.lit("")), F.lit("\n"), b["text"], F.lit("\n```"))
        body = (
            F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(b["level"], F.lit(1))), F.lit(" "), b["text"]))
            .when(b["kind"] == "list_item", F.concat(F.lit("- "), b["text"]))
            .when(b["kind"] == "code", fence)
            .when(b["kind"] == "quote", F.regexp_replace(b["text"], "(?m)^", "> "))
            .when(b["kind"] == "definition", F.concat(F.lit("**"), b["text"], F.lit("**")))
            .when(b["kind"] == "rule", "---")
            .when(b["kind"].isin("paragraph", "table"), b["text"])
            .otherwise(F.nullif(b["text"], F.lit("")))
        )
        empty = (b["kind"] == "quote") & (b["text"] == "")
        return F.concat(F.when(empty, "").otherwise(body), F.when((b["kind"] == "list_item") | empty, "\n").otherwise("\n\n"))

    return F.regexp_replace(F.array_join(F.transform(blocks, lines), ""), r"\n+$", "")


def bad_url(url: Column) -> Column:
    """Why a URL can't be fetched; null if it can."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(u == "", "empty").when(~F.lower(u).rlike("^https?://"), "scheme")


def bad_path(path: Column) -> Column:
    """Why a path of a repository is refused; null if it is not."""
    p = F.coalesce(path, F.lit(""))
    return F.when(F.trim(p) == "", "empty").when(p.rlike(r"(?:^|/)\.\.(?:/|$)"), "parent").when(p.startswith("/"), "absolute")


def bad_package(ecosystem: Column, name: Column, namespace: Column) -> Column:
    """Why the coordinate of a package is refused; null if it is not."""
    n = F.coalesce(name, F.lit(""))
    delimiter, segment = r"[?#&\"<>\\\p{Cntrl}]", r"(?:^|/)\.{0,2}(?:/|$)"
    return (
        F.when(F.trim(n) == "", "empty")
        .when(F.contains(n, F.lit(" ")), "space")
        .when(n.rlike(delimiter), "delimiter")
        .when(n.rlike(segment), "segment")
        .when(F.contains(namespace, F.lit("..")) | namespace.startswith("/") | namespace.endswith("/"), "traversal")
        .when(namespace.rlike(delimiter), "delimiter")
        .when(namespace.rlike(segment), "segment")
        .when((ecosystem == "maven") & F.contains(n, F.lit(":")), "colon")
        .when((ecosystem == "oci") & F.contains(n, F.lit("..")), "traversal")
    )
