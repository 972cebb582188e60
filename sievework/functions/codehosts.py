"""Pieces of URLs of code hosts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import urls

HOSTS = {"github.com": "github", "gitlab.com": "gitlab", "codeberg.org": "codeberg"}
# The first segment after the repository, and the kind of page it leads to.
KINDS = {
    "tree": "source_directory", "blob": "source_file", "raw": "source_file", "src": "source_file",
    "issues": "issue_thread", "discussions": "issue_thread", "pull": "pull_request", "pulls": "pull_request",
    "merge_requests": "pull_request", "releases": "release_notes", "tags": "tag", "commit": "commit", "commits": "commit",
}


def parts(url: Column) -> Column:
    """struct(host, owner, repo, kind, ref, path, line_start, line_end, raw_url) of a URL of GitHub,
    GitLab (whose marker segment "-" is passed over) or Codeberg (whose src is followed by branch,
    tag or commit); null for other hosts. A host without owner and repository is a source_repository."""
    host = urls.host(url)
    segs = F.filter(F.split(F.regexp_extract(url, urls.URL, 3), "/"), lambda s: s != "")
    rest = F.filter(F.slice(segs, 3, 1 << 20), lambda s, i: ~((s == "-") & (i == 0)))
    rest = F.filter(rest, lambda s, i: ~((F.get(rest, 0) == "src") & (i == 1) & s.isin("branch", "tag", "commit")))
    word = F.get(rest, 0)
    known = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    names = F.create_map(*[F.lit(x) for kv in HOSTS.items() for x in kv])
    kind = (
        F.when(F.size(segs) < 2, "source_repository")
        .when(F.size(segs) == 2, "repository_root")
        .otherwise(F.coalesce(F.try_element_at(known, word), F.lit("unknown")))
    )
    filed = word.isin("tree", "blob", "raw", "src")
    path = F.when(filed & (F.size(rest) > 2), F.array_join(F.slice(rest, 3, 1 << 20), "/"))
    ref = F.when(filed | word.isin("commit", "commits"), F.get(rest, 1)).when((word == "releases") & F.get(rest, 1).isin("tag"), F.get(rest, 2))
    lines = lambda k: F.when(filed, F.regexp_extract(url, r"#L([0-9]{1,9})(?:-L?([0-9]{1,9}))?$", k)).otherwise("")
    number = lambda k: F.nullif(lines(k), F.lit("")).cast("int")
    owner, repo = F.get(segs, 0), F.when(F.size(segs) > 1, F.get(segs, 1))
    raw = F.when(host == "github.com", F.concat_ws("/", F.lit("https://raw.githubusercontent.com"), owner, repo, ref, path)).when(
        host == "gitlab.com", F.concat_ws("/", F.lit("https://gitlab.com"), owner, repo, F.lit("-/raw"), ref, path)
    ).otherwise(F.concat_ws("/", F.lit("https://codeberg.org"), owner, repo, F.lit("raw"), ref, path))
    out = F.struct(
        F.try_element_at(names, host).alias("host"),
        owner.alias("owner"),
        repo.alias("repo"),
        kind.alias("kind"),
        ref.alias("ref"),
        path.alias("path"),
        number(1).alias("line_start"),
        number(2).alias("line_end"),
        F.when((kind == "source_file") & path.isNotNull(), raw).alias("raw_url"),
    )
    return F.when(host.isin(list(HOSTS)), out)
