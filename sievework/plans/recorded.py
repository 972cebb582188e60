"""Queries over recorded bodies of providers, with their DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sievework.plans import cases
from sievework.sources import records

#: provider, body, the hits it holds: title, url, snippet, date.
_BODIES = [
    ("searxng", {"results": [{"title": " A  b ", "url": "https://a.example/x", "content": "some <b>bold</b> text", "publishedDate": "2024-01-02"}, {"title": "no url"}, {"title": "", "url": "http://b.example/last/", "content": " "}]}, [("A b", "https://a.example/x", "some bold text", "2024-01-02"), ("last", "http://b.example/last/", None, None)]),
    ("brave_api", {"web": {"results": [{"title": "T", "url": "https://c.example", "description": "D", "page_age": "2024-05-06T07:08:09Z"}]}}, [("T", "https://c.example", "D", "2024-05-06")]),
    ("exa", {"results": [{"title": "E", "url": "ftp://x"}, {"title": "F", "url": "https://f.example", "publishedDate": "soon"}]}, [("F", "https://f.example", None, None)]),
    ("serpapi", {"organic_results": [{"title": None, "link": "https://g.example/page", "snippet": "S"}]}, [("page", "https://g.example/page", "S", None)]),
    ("wikipedia", {"query": {"search": [{"title": "Raft (algorithm)/Notes", "snippet": "a <span>consensus</span>", "timestamp": "2024-01-01T00:00:00Z"}]}}, [("Raft (algorithm)/Notes", "https://en.wikipedia.org/wiki/Raft_%28algorithm%29/Notes", "a consensus", "2024-01-01")]),
    ("hn_algolia", {"hits": [{"title": "Ask", "objectID": "42", "created_at": "2024-02-03T00:00:00Z"}, {"title": "U", "url": "https://u.example", "objectID": "43"}, {"title": "none"}]}, [("Ask", "https://news.ycombinator.com/item?id=42", None, "2024-02-03"), ("U", "https://u.example", None, None)]),
    ("github_issues", {"items": [{"title": "Bug", "html_url": "https://github.com/a/b/issues/1", "body": "it\nfails", "updated_at": "2024-03-01T10:00:00Z"}]}, [("Bug", "https://github.com/a/b/issues/1", "it fails", "2024-03-01")]),
    ("gitlab_issues", [{"title": "Bug", "web_url": "https://gitlab.com/a/b/-/issues/1", "description": None}], [("Bug", "https://gitlab.com/a/b/-/issues/1", None, None)]),
    ("crates_io", {"crates": [{"name": "serde", "description": "ser"}, {"name": ""}]}, [("serde", "https://crates.io/crates/serde", "ser", None)]),
    ("npm", {"objects": [{"package": {"name": "left-pad", "description": "pad"}}]}, [("left-pad", "https://www.npmjs.com/package/left-pad", "pad", None)]),
    ("crossref", {"message": {"items": [{"title": ["Paper"], "DOI": "10.1/x", "abstract": "<p>About</p>"}]}}, [("Paper", "https://doi.org/10.1/x", "About", None)]),
    ("semantic_scholar", {"data": [{"title": "P", "url": "https://s.example/1", "abstract": "w" * 295 + " cut here"}]}, [("P", "https://s.example/1", "w" * 295 + " cut…", None)]),
    ("kagi", {"data": []}, []),
    ("tavily", "not json", []),
    ("unknown", {"results": [{"title": "x", "url": "https://x"}]}, []),
]
_TEXTS = [b if isinstance(b, str) else json.dumps(b) for _, b, _ in _BODIES]

_OSV = [
    ({"id": "OSV-1", "aliases": ["CVE-2024-1", "GHSA-aaaa-bbbb-cccc"], "published": "2024-01-02T03:04:05Z", "severity": [{"score": "CVSS HIGH"}], "affected": [{"package": {"name": "tokio", "ecosystem": "crates.io"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.2"}]}, {"events": [{"introduced": "2.0"}, {"last_affected": "2.3"}]}]}]},
     ("OSV-1", "CVE-2024-1", "GHSA-AAAA-BBBB-CCCC", "crates.io", "tokio", "high", "<1.2|>=2.0, <=2.3", "1.2", "2024-01-02")),
    ({"id": "OSV-2", "severity": [{"score": "9.8"}]}, ("OSV-2", "", "", None, None, "critical", "", "", None)),
    ({"id": "OSV-3", "affected": [{"versions": ["1"]}, {"package": {"name": "p", "ecosystem": "PyPI"}, "ranges": [{"events": [{"introduced": "1.0"}]}]}], "severity": [{"score": "base 5.5 x"}]}, ("OSV-3", "", "", "PyPI", "p", "medium", ">=1.0", "", None)),
    ({"id": "OSV-4", "aliases": [], "severity": []}, ("OSV-4", "", "", None, None, "unknown", "", "", None)),
    ({"summary": "none"}, None),
    ("junk", None),
]


def recorded_hits(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", {"provider": [p for p, _, _ in _BODIES], "body": _TEXTS})
    found = records.hits(c.withColumnRenamed("p_partkey", "query_id"))
    return found.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd"))


def recorded_advisories(spark, sf_dir):
    c = cases.given(spark, sf_dir, "part", "p_partkey", {"body": [b if isinstance(b, str) else json.dumps(b) for b, _ in _OSV]})
    joined = lambda x, by="|": F.array_join(x, by).alias(x)
    return records.advisories(c).groupBy("advisory_id", joined("cve"), joined("ghsa"), "ecosystem", "package", "severity", joined("affected"), joined("fixed"), F.date_format("published_at", "yyyy-MM-dd").alias("published")).agg(F.count("*").alias("n"))


QUERIES = {"recorded_hits": recorded_hits, "recorded_advisories": recorded_advisories}

_VALUES = ", ".join(f"({k}, {cases.literal(p)}, {i + 1}, " + ", ".join(cases.literal(x) for x in hit) + ")" for k, (p, _, hits) in enumerate(_BODIES) for i, hit in enumerate(hits))
_ADVISED = ", ".join(f"({k}, " + ", ".join(cases.literal(x) for x in out) + ")" for k, (_, out) in enumerate(_OSV) if out)
ORACLES = {
    "recorded_hits": f'WITH h(k, provider, "rank", title, url, snippet, published_at) AS (VALUES {_VALUES}) SELECT p_partkey AS query_id, provider, "rank", title, url, snippet, published_at FROM part JOIN h ON p_partkey % {len(_BODIES)} = k',
    "recorded_advisories": f"WITH a(k, advisory_id, cve, ghsa, ecosystem, package, severity, affected, fixed, published) AS (VALUES {_ADVISED}) SELECT a.* EXCLUDE (k), count(*) AS n FROM part JOIN a ON p_partkey % {len(_OSV)} = k GROUP BY ALL",
}
