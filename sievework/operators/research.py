"""Coverage, gaps, claims and conflicts of grouped sources, and what is missing from a bundle of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import sources

# Which workflows need a kind of evidence, in the order in which gaps are told.
NEEDS = {
    "no_primary_sources": ("primary", ["architecture_decision", "api_evaluation", "security_review"]),
    "no_recent_sources": ("recent", ["ecosystem_survey", "performance_investigation"]),
    "no_counterpoints": ("counterpoints", None),
    "no_implementation_evidence": ("implementation", ["architecture_decision", "api_evaluation", "library_comparison"]),
    "no_benchmarks": ("benchmarks", ["performance_investigation", "library_comparison"]),
    "no_security_discussion": ("security", ["security_review"]),
    "no_migration_docs": ("primary", ["migration_planning"]),
}
# Groups and the counter of each.
COUNTED = {
    "primary": ["primary_sources", "official_docs"], "implementation": ["reference_implementations"], "benchmarks": ["benchmarks"],
    "security": ["security_considerations"], "counterpoints": ["counterpoints"], "recent": ["recent_news"],
}
BEST, WORST = ["official_docs", "standard_spec", "security_advisory"], ["forum_thread", "news_article"]
PRIMARY = ["official_docs", "security_advisory", "paper", "standard_spec"]
MOST_CLAIMS, MOST_ROLES = 10, 30

# What implementation files should have beside them, and the gap if they don't; kinds
# of sources that call for a changelog.
BESIDE = {"test": "missing_tests", "example": "missing_examples", "manifest": "missing_manifest"}
VERSIONED = ["release_notes", "tag", "commit"]


def coverage(cards: DataFrame) -> DataFrame:
    """query_id and the number of sources of each kind; cards: query_id, group."""
    return cards.groupBy("query_id").agg(*[F.count_if(F.col("group").isin(groups)).alias(n) for n, groups in COUNTED.items()])


def gaps(covered: DataFrame) -> DataFrame:
    """query_id, place, kind: what a request lacks. covered: coverage() with workflow, wants_counterpoints and n_providers."""
    lacks = [F.when((F.col(n) == 0) & (F.col("workflow").isin(flows) if flows else F.coalesce("wants_counterpoints", F.lit(False))), F.lit(kind)) for kind, (n, flows) in NEEDS.items()]
    one = F.when(F.col("n_providers") <= 1, F.lit("provider_coverage_limited"))
    return covered.select("query_id", F.posexplode(F.array_compact(F.array(*lacks, one))).alias("place", "kind"))


def claims(cards: DataFrame) -> DataFrame:
    """query_id, place, group, type, confidence, n_sources, n_primary, missing: a claim for each group
    of at least two sources, MOST_CLAIMS of a request at most, in the order of the groups.

    cards: query_id, group, group_no, class, confidence, authority."""
    has = lambda *ks: F.bool_or(F.col("class").isin(*ks))
    g = cards.groupBy("query_id", "group", "group_no").agg(
        F.count("*").alias("n_sources"),
        F.count_if(F.col("class").isin(PRIMARY)).alias("n_primary"),
        F.bool_or(F.col("confidence") == "high").alias("sure"),
        F.bool_or(F.col("authority").isin("primary", "official", "maintainer")).alias("first_hand"),
        has("benchmark").alias("measured"),
        has("security_advisory").alias("advised"),
        has("release_notes").alias("released"),
        has("official_docs", "reference_docs").alias("documented"),
    )
    kind = sources.claim_type(F.col("group"))
    lacks = lambda t, c, what: F.when((kind == t) & ~F.col(c), F.lit(what))
    missing = F.array_compact(F.array(lacks("performance", "measured", "benchmark data"), lacks("security", "advised", "security advisory"), lacks("maintenance", "released", "release notes"), F.when(~F.col("documented"), F.lit("official documentation"))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("group_no", "group"))
    return (
        g.filter("n_sources >= 2")
        .withColumn("place", place)
        .filter(F.col("place") <= MOST_CLAIMS)
        .select("query_id", "place", "group", kind.alias("type"), F.when(F.col("sure"), "high").when(F.col("first_hand"), "medium").otherwise("unknown").alias("confidence"), "n_sources", "n_primary", F.array_join(missing, ", ").alias("missing"))
    )


def conflicts(cards: DataFrame, most: int = 5) -> DataFrame:
    """query_id, place, kind, group: counterpoints first, then groups that mix good and poor sources. cards: query_id, group, group_no, class."""
    g = cards.groupBy("query_id", "group", "group_no").agg(F.count("*").alias("n"), F.bool_or(F.col("class").isin(BEST)).alias("best"), F.bool_or(F.col("class").isin(WORST)).alias("worst"))
    counter = g.filter(F.col("group") == "counterpoints").select("query_id", F.lit(0).alias("o"), "group_no", F.lit("counterpoints").alias("kind"), "group")
    mixed = g.filter("n >= 2 AND best AND worst").select("query_id", F.lit(1).alias("o"), "group_no", F.lit("quality").alias("kind"), "group")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("o", "group_no", "group"))
    return counter.unionByName(mixed).withColumn("place", place).filter(F.col("place") <= most).select("query_id", "place", "kind", "group")


def role_summary(cards: DataFrame) -> DataFrame:
    """query_id, place, role, n: the most frequent roles of evidence, those of equal number by name. cards: query_id, role."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "role"))
    return cards.groupBy("query_id", "role").agg(F.count("*").alias("n")).withColumn("place", place).filter(F.col("place") <= MOST_ROLES)


def group_quality(cards: DataFrame) -> DataFrame:
    """Counts of a group's sources by quality, and warnings. cards: query_id, group, confidence, authority, strength."""
    g = cards.groupBy("query_id", "group").agg(
        F.count_if(F.col("confidence") == "high").alias("high"),
        F.count_if(F.col("confidence").isin("low", "unknown")).alias("low"),
        F.count_if(F.col("authority").isin("primary", "official", "maintainer")).alias("primary"),
        F.count_if(F.col("strength").isin("exact_code_span", "exact_identifier")).alias("exact"),
        F.count("*").alias("n"),
    )
    said = F.array_compact(F.array(F.when((F.col("low") > 0) & (F.col("low") == F.col("n")), F.lit("all results have low or unknown confidence")), F.when((F.col("n") > 3) & (F.col("exact") == 0), F.lit("no exact evidence matches in group"))))
    return g.select("query_id", "group", "high", "low", "primary", "exact", F.array_join(said, "; ").alias("warnings"))


def bundle_gaps(cards: DataFrame, fetches: DataFrame) -> DataFrame:
    """query_id, kind, source: what a bundle lacks. cards: query_id, source, source_kind, role, trust, dull
    (generated or from a vendor); fetches: query_id, source, fetched."""
    none = F.lit(None).cast("long").alias("source")
    got = fetches.filter("source IS NOT NULL").select("query_id", "source").distinct()
    unfetched = cards.join(got, ["query_id", "source"], "left_anti")
    local = F.col("trust") == "local_trusted"
    whole = cards.groupBy("query_id").agg(
        F.bool_and(F.col("trust") == "external_untrusted").alias("external"),
        F.bool_or(local).alias("has_local"),
        F.bool_and(~local | F.coalesce("dull", F.lit(False))).alias("all_dull"),
        *[F.bool_or(F.coalesce(F.col("role") == r, F.lit(False))).alias(r) for r in ["implementation", *BESIDE, "changelog", "security_policy"]],
        F.bool_or(F.coalesce(F.col("source_kind").isin(VERSIONED), F.lit(False))).alias("versioned"),
        F.bool_or(F.coalesce(F.col("source_kind") == "security_advisory", F.lit(False))).alias("advised"),
    )
    said = [F.when(F.col("has_local") & F.col("all_dull"), F.lit("local_generated_or_vendor_only")), F.when(F.col("external"), F.lit("all_results_external_untrusted")), *[F.when(F.col("implementation") & ~F.col(r), F.lit(k)) for r, k in BESIDE.items()]]
    said += [F.when(F.col("versioned") & ~F.col("changelog"), F.lit("missing_changelog")), F.when(F.col("advised") & ~F.col("security_policy"), F.lit("missing_security_policy"))]
    return (
        unfetched.select("query_id", F.lit("source_unfetched").alias("kind"), "source")
        .unionByName(unfetched.filter(local).select("query_id", F.lit("local_source_unfetched").alias("kind"), "source"))
        .unionByName(fetches.filter("NOT fetched").select("query_id", F.lit("fetch_failed").alias("kind"), "source"))
        .unionByName(whole.select("query_id", F.explode(F.array_compact(F.array(*said))).alias("kind"), none))
    )


def provenance_fit(ecosystem: Column, version: Column, reference: Column, provenance: Column, path: Column) -> Column:
    """Whether advisories of a registry can speak of a finding: compatible, incompatible or unverified."""
    # References and parts of a provenance that no registry vouches for.
    away = ["replace =>", "workspace", "path:", "git:", "source git", "source path", "source filesystem", "source url", "type: git", "type: directory", "type: file", "type: url", "link:"]
    p = sources.low(provenance)
    fits = (
        F.when(ecosystem == "crates_io", p.startswith("registry+https://github.com/rust-lang/crates.io-index") | p.startswith("registry+https://index.crates.io/"))
        .when(ecosystem == "go", F.coalesce(path.endswith("vendor/modules.txt"), F.lit(False)))
        .when(ecosystem == "npm", (p == "") | F.contains(p, F.lit("registry.npmjs.org")))
        .when(ecosystem == "pypi", (p == "") | sources.holds(p, ["https://pypi.org/", "http://pypi.org/"]))
        .when(ecosystem == "rubygems", F.contains(p, F.lit("rubygems.org")))
        .otherwise(F.lit(False))
    )
    return (
        F.when(version.isNull(), "unverified")
        .when(F.coalesce(reference.isin("path", "workspace", "local", "git", "url"), F.lit(False)) | p.startswith("git+") | sources.holds(p, away), "incompatible")
        .when(fits, "compatible")
        .otherwise("unverified")
    )


def distinct_advisories(advisories: DataFrame) -> DataFrame:
    """query_id, pos: the advisories of a request that share no identifier with one kept before them.

    advisories: query_id, pos, ids (identifiers of all families, each with the family's name in
    it). What is dropped does not count for later ones; a request's advisories are folded in order."""
    ordered = advisories.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("rows"))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda s, r: F.when(F.arrays_overlap(s["seen"], r["ids"]), s).otherwise(F.struct(F.array_union(s["seen"], r["ids"]).alias("seen"), F.array_append(s["kept"], r["pos"]).alias("kept")))
    return ordered.select("query_id", F.explode(F.aggregate("rows", start, step)["kept"]).alias("pos"))


def windows_of(advisories: DataFrame) -> DataFrame:
    """advisory_id, place, spec, fixed: a row for each affected window of an advisory, one without a
    window where only fixed or vulnerable versions are known. advisories: advisory_id, ecosystem,
    package, affected, patched (versions and expressions), vulnerable."""
    known = advisories.filter("ecosystem IS NOT NULL AND coalesce(package, '') <> ''")
    fixed = F.array_distinct(F.filter("patched", lambda p: ~p.rlike("^[<>=!]")))
    rows = known.withColumn("fixed", fixed).withColumn(
        "specs", F.when(F.size("affected") > 0, F.col("affected")).when((F.size("fixed") > 0) | (F.size("vulnerable") > 0), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    )
    return rows.select("advisory_id", F.posexplode("specs").alias("place", "spec"), F.array_join("fixed", ",").alias("fixed"))


def focused(chunks: DataFrame, most: int, most_chars: int) -> DataFrame:
    """doc_id, pos, n_chars, truncated: chunks of a document that answer a query, the best and those
    right beside it first, ``most`` of them, in order, cut off where ``most_chars`` would be passed.

    chunks: doc_id, pos (0, 1, ...), score, n_chars."""
    docs = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "score", "n_chars"))).alias("rows"))
    ranked = F.array_sort(F.transform(F.filter("rows", lambda r: r["score"] > 0), lambda r: F.struct((-r["score"]).alias("o"), r["pos"].alias("pos"))))
    scored = F.transform(F.filter("rows", lambda r: r["score"] > 0), lambda r: r["pos"])
    add = lambda s, p, ok: F.when((F.size(s) < most) & ok & ~F.array_contains(s, p), F.array_append(s, p)).otherwise(s)

    def step(s, r):
        one = add(s, r["pos"], F.lit(True))
        two = add(one, r["pos"] - 1, F.array_contains(F.col("scored"), r["pos"] - 1))
        return F.when(F.size(s) >= most, s).otherwise(add(two, r["pos"] + 1, F.array_contains(F.col("scored"), r["pos"] + 1)))

    picked = docs.withColumns({"ranked": ranked, "scored": scored}).withColumn("picked", F.array_sort(F.aggregate("ranked", F.array().cast("array<bigint>"), step)))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = picked.select("doc_id", (F.size("picked") < F.size("ranked")).alias("fewer"), F.explode(F.filter("rows", lambda r: F.array_contains(F.col("picked"), r["pos"]))).alias("r"))
    run = rows.select("doc_id", "fewer", F.col("r.pos").alias("pos"), F.col("r.n_chars").alias("n_chars")).withColumn("before", F.coalesce(F.sum("n_chars").over(w), F.lit(0)))
    first = run.withColumn("cut", (F.col("before") == 0) & (F.col("n_chars") > most_chars))
    fits = first.withColumn("ok", F.col("cut") | (F.col("before") + F.col("n_chars") <= most_chars))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = fits.withColumns({"all_ok": F.bool_and("ok").over(upto), "any_bad": F.bool_or(~F.col("ok") | F.col("cut")).over(Window.partitionBy("doc_id"))})
    return kept.filter("all_ok").select("doc_id", "pos", F.least("n_chars", F.lit(most_chars)).alias("n_chars"), (F.col("fewer") | F.col("any_bad")).alias("truncated"))
