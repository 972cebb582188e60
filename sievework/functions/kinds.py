"""Classification of URLs by host and path, first rule that fits wins, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import urls

# Hosts and the kinds they stand for.
DOCS = "docs.rs doc.rust-lang.org doc.python.org docs.python.org developer.mozilla.org go.dev pkg.go.dev doc.npmjs.com".split()
REGISTRIES = "crates.io npmjs.com www.npmjs.com pypi.org rubygems.org".split()
ADVISORIES = "osv.dev nvd.nist.gov security.snyk.io cve.mitre.org".split()
TUTORIALS = "dev.to medium.com stackoverflow.com stackexchange.com".split()
NEWS = "arstechnica.com theverge.com techcrunch.com".split()


def source_kind(url: Column) -> Column:
    """docs, registry, advisory, release_notes, tutorial, forum, news or unknown."""
    host, path = F.coalesce(urls.host(url), F.lit("")), F.regexp_extract(url, urls.URL, 3)
    return (
        F.when(host == "", "unknown")
        .when(host.isin(DOCS) | host.rlike(r"\.readthedocs\.(io|org)$"), "docs")
        .when(host.isin(REGISTRIES), "registry")
        .when(host.isin(ADVISORIES), "advisory")
        .when(path.rlike("CHANGELOG|changelog|CHANGES"), "release_notes")
        .when(host.isin(TUTORIALS) | host.rlike("tutorial|learn"), "tutorial")
        .when((host == "discourse.org") | host.rlike(r"forum|\.discourse\.app$"), "forum")
        .when(host.isin(NEWS) | host.rlike("news|blog"), "news")
        .otherwise("unknown")
    )
