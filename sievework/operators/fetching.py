"""What to fetch next and how fetched things fit together: suggested fetches, merged metadata of one address,
totals of folders in listed trees, and references that are told from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators import selection

# Reasons by group, groups and kinds that are read as Markdown, what is suggested beside a file of a role.
REASONS = {
    "official_docs": "official_docs", "package_registry": "database_record", "repository": "source_evidence", "readme": "readme_source", "examples": "example_evidence", "tests": "test_evidence", "source_files": "source_evidence",
    "issues": "issue_context", "pull_requests": "issue_context", "releases": "release_notes", "migration_notes": "changelog_source", "changelog": "changelog_source",
}
MARKDOWN_GROUPS = "official_docs package_registry readme releases migration_notes changelog".split()
MARKDOWN_KINDS = "docs registry".split()
RAW = {"github": "https://raw.githubusercontent.com/%s/%s/%s/%s", "gitlab": "https://gitlab.com/%s/%s/-/raw/%s/%s", "codeberg": "https://codeberg.org/%s/%s/raw/branch/%s/%s"}
#: role: (reason, group, path of the file suggested; %s is the name of the card's file).
BESIDE = {
    "implementation": [("nearby_test_candidate", "tests", "tests/%s"), ("example_candidate", "examples", "examples/%s"), ("manifest_context", "repository", "Cargo.toml")],
    "test": [("implementation_candidate", "source_files", "src/%s")],
    "configuration": [("manifest_context", "repository", "Cargo.toml")],
}
_LINKS = "raw_permalink raw_url permalink browser_url url".split()
_PLACE = "host owner repo ref path".split()


def raw_address(host: Column, owner: Column, repo: Column, ref: Column, path: Column) -> Column:
    """Where the text of a file stands on a host (GitHub where none is named)."""
    out = F.format_string("https://github.com/%s/%s/blob/%s/%s", owner, repo, ref, path)
    for name, shape in RAW.items():
        got = F.format_string(shape, owner, repo, ref, path)
        if name == "gitlab":
            got = F.when(owner == "", F.format_string("https://gitlab.com/%s/-/raw/%s/%s", repo, ref, path)).otherwise(got)
        out = F.when(F.coalesce(host, F.lit("github")) == name, got).otherwise(out)
    return out


def suggested(cards: DataFrame, per_domain: int = 2, per_group: int = 2, total: int = 8, most_beside: int = 8) -> DataFrame:
    """query_id, place, url, reason, group, tool, mode, gain, score, pos: what to fetch for each request.

    cards: query_id, pos (unique in a request), group, kind, role, score, url, the links
    raw_permalink, raw_url, permalink, browser_url and host, owner, repo, ref, path, each of which may
    be null. A card is fetched by its best link. Cards of one link share a locator, that of the first
    of them; only the first pick of the link uses it. Picks go down the score under all caps at once;
    after them follow files beside those of known roles, in order of cards, most_beside at most."""
    rows = cards.withColumn("link", F.coalesce(*_LINKS)).withColumn("domain", F.lower(F.regexp_extract("link", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    whole = F.lit(True)
    for c in _PLACE:
        whole &= F.col(c).isNotNull()
    first = Window.partitionBy("query_id", "link").orderBy("pos")
    rows = rows.withColumn("located", F.first(whole).over(first))
    picked = selection.diverse(rows.select("query_id", "pos", "domain", "group", "score"), per_domain, per_group, total).select("query_id", "pos", "place", "gain")
    held = picked.join(rows.select("query_id", "pos", "group", "kind", "score", "link", "located"), ["query_id", "pos"])
    again = F.row_number().over(Window.partitionBy("query_id", "link").orderBy("place")) > 1
    reason = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col("group")), F.lit("suggested_evidence"))
    mode = F.when(F.coalesce(F.col("group").isin(MARKDOWN_GROUPS), F.lit(False)) | F.coalesce(F.col("kind").isin(MARKDOWN_KINDS), F.lit(False)), "markdown")
    names = ["query_id", "place", "url", "reason", "group", "tool", "mode", "gain", "score", "pos"]
    best = held.select("query_id", F.col("place").cast("int").alias("place"), F.col("link").alias("url"), reason.alias("reason"), "group", F.when(F.col("located") & ~again, "repo_fetch").otherwise("web_fetch").alias("tool"), mode.alias("mode"), "gain", F.col("score").cast("double").alias("score"), "pos")
    n = picked.groupBy("query_id").agg(F.max("place").alias("taken"))
    file, known = F.substring_index("path", "/", -1), F.col("owner").isNotNull() & F.col("repo").isNotNull() & F.col("path").isNotNull()
    offers = []
    for role, held_ in BESIDE.items():
        for k, (why, group, path) in enumerate(held_):
            fits = (F.col("role") == role) & known & (F.col("path").contains("/") if "%s" in path else F.lit(True))
            there = F.concat(F.lit(path[: path.index("%s")]), file) if "%s" in path else F.lit(path)
            offers.append(F.when(fits, F.struct(F.lit(k).alias("k"), raw_address(F.col("host"), F.col("owner"), F.col("repo"), F.coalesce("ref", F.lit("main")), there).alias("url"), F.lit(why).alias("reason"), F.lit(group).alias("group"), F.lit("repo_fetch").alias("tool"), F.lit(None).cast("string").alias("mode"))))
    notes = F.struct(F.lit(0).alias("k"), F.col("url").alias("url"), F.lit("changelog_source").alias("reason"), F.lit("changelog").alias("group"), F.lit("web_fetch").alias("tool"), F.lit("markdown").alias("mode"))
    offers.append(F.when(F.col("role").isin("changelog", "migration") & known, notes))
    beside = rows.select("query_id", "pos", F.explode(F.array_compact(F.array(*offers))).alias("o")).select("query_id", "pos", "o.*")
    beside = beside.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "k"))).filter(F.col("r") <= most_beside)
    beside = beside.join(n, "query_id", "left").select("query_id", (F.coalesce("taken", F.lit(0)) + F.col("r")).cast("int").alias("place"), "url", "reason", "group", "tool", "mode", F.lit(None).cast("double").alias("gain"), F.lit(None).cast("double").alias("score"), "pos")
    return best.select(*names).unionByName(beside.select(*names))


def merged_metadata(rows: DataFrame, keys: list[str], order: str, kind: str, fields: list[str], lists: list[str]) -> DataFrame:
    """keys, kind, fields and lists: what all rows of a key know together.

    The kind is that of the first row (by order, unique in a key) that has one, and rows of that kind alone count.
    A field is the first that is not null, lists are put end to end without repeats. Nothing depends on
    the order in which rows come. Fields are least pairs, taken in the tasks first; elements of lists
    are made distinct before they meet, so a key may have any number of rows."""
    known = rows.filter(F.col(kind).isNotNull())
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v")))).alias(c)
    by_kind = known.groupBy(*keys, kind).agg(F.min(order).alias("_o"), *[first(c) for c in fields])
    held = by_kind.groupBy(*keys).agg(F.min_by(F.struct(kind, *[F.col(f"{c}.v").alias(c) for c in fields]), "_o").alias("m")).select(*keys, "m.*")
    for c in lists:
        each = known.select(*keys, kind, F.col(order).alias("_o"), F.posexplode(c).alias("_p", "_e")).groupBy(*keys, kind, "_e").agg(F.min(F.struct("_o", "_p")).alias("_at"))
        own = each.groupBy(*keys, kind).agg(F.sort_array(F.collect_list(F.struct("_at", "_e"))).alias("_l")).select(*keys, kind, F.transform("_l", lambda x: x["_e"]).alias(c))
        held = held.join(own, [*keys, kind], "left").withColumn(c, F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    every = rows.select(*keys).distinct()
    return every.join(held, keys, "left").select(*keys, kind, *fields, *lists)


def folder_totals(entries: DataFrame, most_deep: int = 32) -> DataFrame:
    """repo, folder, depth, n_files, n_bytes, n_folders: what lies below every folder ('' is the top).

    entries: repo, path, size. Files are counted in their own folder first; folders are then
    handed to their ancestors, so a tree of many files in few folders is few rows. Entries below more
    than most_deep segments are left out; empty segments count for nothing."""
    parts = F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda x: x != "")
    held = entries.withColumn("_p", parts).filter((F.size("_p") > 0) & (F.size("_p") <= most_deep))
    own = held.groupBy("repo", F.slice("_p", 1, F.size("_p") - 1).alias("_p")).agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("b"))
    up = own.select("repo", F.explode(F.sequence(F.lit(0), F.size("_p"))).alias("depth"), "_p", "n", "b")
    up = up.groupBy("repo", "depth", F.expr("slice(_p, 1, depth)").alias("_f")).agg(F.sum("n").alias("n_files"), F.sum("b").cast("long").alias("n_bytes"))
    # Every folder once; those below it are told by their own ancestors, not by files.
    inner = up.filter("depth > 0").select("repo", F.explode(F.expr("sequence(0, depth - 1)")).alias("depth"), "_f")
    inner = inner.groupBy("repo", "depth", F.expr("slice(_f, 1, depth)").alias("_f")).agg(F.count("*").alias("n_folders"))
    return up.join(inner, ["repo", "depth", "_f"], "left").select("repo", F.array_join("_f", "/").alias("folder"), "depth", "n_files", "n_bytes", F.coalesce("n_folders", F.lit(0)).alias("n_folders"))


def told_apart(asked: DataFrame, refs: DataFrame) -> DataFrame:
    """asked plus ref and path: 'ref/path' cut at the end of the longest reference that the repository has.

    asked: repo, spec; refs: repo, ref, both of which may hold slashes. Each spec is looked up by its own
    beginnings at slashes, at most as many as it has segments. Without a known reference the first
    segment is one, if something follows it. Null or empty specs have neither."""
    rows = asked.withColumn("_id", F.xxhash64("repo", "spec")).withColumn("_s", F.split(F.regexp_replace(F.coalesce("spec", F.lit("")), "^/+|/+$", ""), "/"))
    specs = rows.select("repo", "spec", "_s").distinct()
    heads = specs.select("repo", "spec", F.posexplode(F.transform("_s", lambda x, i: F.array_join(F.slice("_s", 1, i + 1), "/"))).alias("n", "ref"))
    hit = heads.join(refs.select("repo", "ref").distinct(), ["repo", "ref"]).groupBy("repo", "spec").agg(F.max("n").alias("_n"))
    both = rows.drop("_id").join(hit, ["repo", "spec"], "left")
    n = F.coalesce(F.col("_n"), F.lit(0)) + 1
    some = F.element_at("_s", 1) != ""
    known = F.col("_n").isNotNull() | (F.size("_s") > 1)
    rest = F.expr("slice(_s, coalesce(_n, 0) + 2, size(_s))")
    both = both.withColumns({"ref": F.when(some & known, F.array_join(F.slice("_s", 1, n), "/")), "path": F.when(some & known, F.nullif(F.array_join(rest, "/"), F.lit("")))})
    return both.select(*asked.columns, "ref", "path")
