"""What rows of the given tables hold beside the cases: for each query SQL of both engines over a row's
own columns, and DuckDB SQL of the answers, worked out from the rules."""

from __future__ import annotations

_LOCATION = "concat('src/', replace(p_name, ' ', '/'), '.rs')"
_BLOB = "concat('https://github.com/', lower(p_type), '/r/blob/v1/src/', replace(p_name, ' ', '/'), '.rs')"
_MONTH = "concat('2024-01-', lpad(CAST(1 + p_size % 28 AS string), 2, '0'))"
_TIER = "CASE WHEN contains(url, 'blog') THEN 'news_or_blog' ELSE 'unknown' END"

REAL: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "canonical_urls": ({"u": "url"}, {"url": "regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '://www[.]', '://'), '/+$', ''), '/+[?]', '?')"}),
    "link_kinds": ({"page": "url", "link": "concat(url, 'x')"}, {"kind": "CASE WHEN contains(url, '#') THEN 'same_page_anchor' ELSE 'same_domain' END"}),
    "challenges": ({"t": "regexp_extract(html, '<title>([^<]*)', 1)", "b": "html"}, {"kind": "NULL"}),
    "security_tiers": ({"url": "url"}, {"tier": _TIER}),
    "severities": ({"s": "p_type"}, {"level": "CASE WHEN p_type = 'MEDIUM' THEN 'medium' ELSE 'unknown' END", "rank": "CASE WHEN p_type = 'MEDIUM' THEN 2 ELSE 0 END"}),
    "remotes": ({"u": "concat('https://github.com/', replace(p_name, ' ', '/'), '.git')"}, {"kind": "'github'", "host": "'github.com'", "owner": "split_part(p_name, ' ', 1)", "repo": "split_part(p_name, ' ', 2)"}),
    "domain_checks": ({"d": "concat(replace(p_name, ' ', '-'), '.', lower(p_type))"}, {"valid": "true"}),
    "important_paths": ({"p": "replace(p_name, ' ', '/')", "d": "replace(p_name, ' ', '/')"}, {"kind": "'unknown'", "reason": "NULL", "folder": "'unknown'"}),
    "source_imports": ({"lang": "'rust'", "t": "concat('use ', replace(p_name, ' ', '::'), ';', chr(10), p_name)"}, {"imports": "concat('use ', replace(p_name, ' ', '::'), ';')"}),
    "address_faults": ({"u": "p_name", "p": "p_name", "e": "'npm'", "n": "p_name"}, {"url": "'scheme'", "path": "NULL", "package": "'space'"}),
    "cut_texts": ({"t": "p_name", "n": "p_size", "w": "concat(p_brand, ': ', p_name)"}, {"text": "substr(p_name, 1, p_size)", "warning": "substr(p_brand, 1, p_size)"}),
    "version_orders": ({"ecosystem": "'npm'", "a": "concat('1.', p_size, '.0')", "b": "'1.20'"}, {"order": "CAST(sign(p_size - 20) AS INT)"}),
    "range_cases": ({"v": "concat('1.', p_size)", "s": "'>=1.10, <1.30'"}, {"inside": "p_size BETWEEN 10 AND 29", "inside_maven": "p_size BETWEEN 10 AND 29"}),
    "timestamps": ({"t": _MONTH}, {"at": f"{_MONTH} || ' 00:00:00'"}),
    "generic_queries": ({"q": "p_name", "intent": "'docs'"}, {"query": "p_name"}),
    "error_contexts": ({"t": "p_name"}, {"codes": "''", "tools": "''", "packages": "''", "frames": "0", "primary_line": "p_name"}),
    "error_subqueries": ({"t": "p_name"}, {"subqueries": "'exact_phrase=\"' || p_name || '\"|issues=' || p_name || ' issues github'"}),
    "repo_subqueries": (
        {"q": "p_name"},
        {"subqueries": "concat_ws('|', " + ", ".join(f"'{k}=' || p_name || ' {v}'" for k, v in {"docs": "docs documentation api reference", "registry": "crates.io docs.rs pypi npm", "source": "github gitlab source", "examples": "examples sample usage demo", "issues": "issues discussions", "releases": "releases changelog migration"}.items()) + ")"},
    ),
    "code_evidence": (
        {"host": "'github'", "owner": "lower(p_type)", "repo": "'r'", "ref": "'v1'", "path": _LOCATION},
        {"raw_url": "replace(replace(" + _BLOB + ", 'github.com', 'raw.githubusercontent.com'), '/blob/', '/')", "browser_url": _BLOB, "permalink": _BLOB, "language": "'rust'", "role": "'implementation'", "reasons": "'raw_url_derived,source_role_inferred,language_match'"},
    ),
    "result_limits": (
        {"asked": "p_size", "usual": "10", "most": "20", "filtered": "p_size % 2 = 0"},
        {"n": "least(p_size, 20)", "warning": "CASE WHEN p_size > 20 THEN 'Requested max_results=' || p_size || ' exceeded server cap=20; using 20.' END", "pool": "least(least(p_size, 20) * 3 * CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END, 30)"},
    ),
    "intent_reasons": ({"q": "concat(event_type, ' ', props)"}, {"intent": "'web'", "confidence": "'low'", "reasons": "'no_signal'"}),
    "error_classes": ({"kind": "event_type", "status": "CAST(floor(value) AS int)", "reason": "props"}, {"class": "'unknown'"}),
    "dimension_states": ({"outcome": "event_type"}, {"state": "NULL"}),
    "effective_states": ({"state": "event_type"}, {"state": "event_type"}),
    "evidence_roles": ({"kind": "event_type", "provider": "event_type", "label": "props"}, {"role": "'unknown_or_weak_context'", "intended": "'unknown_or_weak_context'"}),
    "workflow_models": ({"tool": "'repo_search'", "workflow": "event_type"}, {"model": "event_type", "by": "'explicit_workflow'"}),
}
