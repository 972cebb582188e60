"""Queries over coverage, streaks, caches, snapshots, symbols, conflicts and advisories, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import advisories, coverage, state
from sievework.plans.classify import _PATH, _q
from sievework.plans.retrieval import _vkey
from sievework.session import table

_ROLES = sorted({r for both in coverage.MODELS.values() for roles in both for r in roles.split()})
_MODEL = "CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(coverage.MODELS)) + " END"
_ROLE = f"CASE {{k}} % {len(_ROLES)} " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_ROLES)) + " END"
_KIND = "CASE l_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate([*coverage.HIDING, coverage.INDETERMINATE])) + " ELSE 'rate_limited' END"
_CALL = ["user_id % 8 AS provider", "event_id AS call_id", "ts", "event_type IN ('error', 'click', 'view') AS failed", "CASE event_id % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'timeout' ELSE 'network' END AS class"]
_SYMBOL = ["p_partkey AS symbol_id", "p_partkey % 100 AS file", "p_partkey * 13 % 700 AS first", "p_partkey * 13 % 700 + p_size * 5 AS last"]
_PLACE = ["event_id AS place_id", "user_id % 100 AS file", "event_id % 700 AS line"]
_RULES = ["# folders", "node_modules/", "*.lock", "!Cargo.lock", "/docs/*.md", "examples/**/main.rs", "test_*", ""]
_ECO = "CASE {k} % 3 WHEN 0 THEN 'pypi' WHEN 1 THEN 'nuget' ELSE 'npm' END"


def covered(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return coverage.covered(
        table(spark, sf_dir, "orders").selectExpr("o_orderkey AS query_id", f"{_MODEL} AS model"),
        lines.selectExpr("l_orderkey AS query_id", f"{_ROLE.format(k='l_partkey')} AS role"),
        lines.filter("l_quantity > 40").selectExpr("l_orderkey AS query_id", f"{_ROLE.format(k='(l_partkey + 3)')} AS role", f"{_KIND} AS kind"),
    )


def coverage_status(spark, sf_dir):
    return covered(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("missing_required", "missing_recommended")})


def calls(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*_CALL)


def cooldowns(spark, sf_dir):
    return state.cooldowns(calls(spark, sf_dir)).select(F.col("provider").cast("long").alias("provider"), "call_id", (F.unix_seconds("until") - F.unix_seconds("start")).alias("seconds"))


def cached(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    asked = events.filter("event_id % 2 = 0").selectExpr("event_id AS request_id", "user_id % 20 AS key", "cast(ts AS timestamp) AS ts")
    stored = events.filter("event_id % 2 = 1").selectExpr("event_id AS stored_id", "user_id % 20 AS key", "cast(ts AS timestamp) AS ts", "event_type <> 'error' AS complete")
    return state.cached(asked, stored, 7200).select("request_id", "stored_id")


def snapshots(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    shot = lambda skip, size: part.filter(f"p_partkey % {skip} <> 0").selectExpr("p_partkey AS path", f"{size} AS size", "p_partkey % 5 AS mtime")
    return state.changed(shot(10, "p_size"), shot(7, "p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END"))


def applicable(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS finding_id", f"{_ECO.format(k='l_partkey')} AS ecosystem", "concat('Pkg_', l_partkey) AS name", "concat(cast(l_quantity AS int), '.', l_linenumber) AS version"
    )
    window = lambda fixed, last, spec: f"named_struct('fixed', {fixed}, 'last_affected', {last}, 'spec', {spec})"
    none, last, fixed = "cast(array() AS array<string>)", "array('5.1', '6.2')", "array('7.1', '8.2')"
    ranges = (
        f"CASE WHEN p_partkey % 7 = 0 THEN array({window(none, last, _q('<40'))})"
        f" WHEN p_partkey % 4 = 0 THEN array({window(none, none, _q('<25'))}) WHEN p_partkey % 4 = 1 THEN array({window(none, none, _q('<10'))}, {window(none, none, _q('>=30, <40'))})"
        f" WHEN p_partkey % 4 = 2 THEN array({window(fixed, none, _q('>=5, junk'))}) ELSE NULL END AS ranges"
    )
    part = table(spark, sf_dir, "part")
    known = part.selectExpr("p_partkey AS advisory_id", f"{_ECO.format(k='p_partkey')} AS ecosystem", "CASE WHEN p_partkey % 3 = 0 THEN concat('pkg.-', p_partkey) WHEN p_partkey % 3 = 1 THEN concat('PKG_', p_partkey) ELSE concat('Pkg_', p_partkey) END AS name", ranges)
    return advisories.applicable(found, known, part.filter("p_size % 9 = 0").selectExpr("p_partkey AS advisory_id"))


QUERIES = {
    "coverage_status": coverage_status,
    "next_actions": lambda spark, d: coverage.next_actions(covered(spark, d)),
    "failure_streaks": lambda spark, d: state.streaks(calls(spark, d)).select("provider", "call_id", "streak"),
    "provider_cooldowns": cooldowns,
    "cached_answers": cached,
    "snapshot_changes": snapshots,
    "enclosing_symbols": lambda spark, d: state.enclosing(table(spark, d, "events").selectExpr(*_PLACE), table(spark, d, "part").selectExpr(*_SYMBOL)),
    "source_disagreements": lambda spark, d: state.disagreements(table(spark, d, "lineitem").selectExpr("l_partkey AS entity", "l_suppkey AS source", "cast(cast(l_linenumber AS int) AS string) AS value")),
    "ignored_files": lambda spark, d: state.ignored(table(spark, d, "part").selectExpr("p_partkey", f"{_PATH} AS path"), _RULES),
    "advisory_verdicts": applicable,
}

_NEEDS = ", ".join(f"('{m}', '{r}', '{n}')" for m, both in coverage.MODELS.items() for n, roles in zip(("required", "recommended"), both) for r in roles.split())
_COVER = f"""needs(model, role, need) AS (VALUES {_NEEDS}),
rq AS (SELECT o_orderkey AS query_id, {_MODEL} AS model FROM orders),
fd AS (SELECT DISTINCT l_orderkey AS query_id, {_ROLE.format(k="l_partkey")} AS role FROM lineitem),
fl AS (SELECT l_orderkey AS query_id, {_ROLE.format(k="(l_partkey + 3)")} AS role, {_KIND} AS kind FROM lineitem WHERE l_quantity > 40),
x AS (SELECT query_id, model, role, need = 'required' AS req, EXISTS (SELECT 1 FROM fd WHERE fd.query_id = rq.query_id AND fd.role = needs.role) AS has,
  EXISTS (SELECT 1 FROM fl WHERE fl.query_id = rq.query_id AND fl.role = needs.role AND kind IN ('capability_unavailable', 'skipped_by_policy')) AS una,
  EXISTS (SELECT 1 FROM fl WHERE fl.query_id = rq.query_id AND fl.role = needs.role AND kind IN ('provider_failed', 'deadline', 'capability_unavailable', 'skipped_by_policy')) AS hid,
  EXISTS (SELECT 1 FROM fl WHERE fl.query_id = rq.query_id AND kind = 'role_indeterminate') AS uns FROM rq JOIN needs USING (model)),
c AS (SELECT query_id, model, coalesce(list_sort(list(role) FILTER (req AND NOT has)), []) AS mr, coalesce(list_sort(list(role) FILTER (NOT req AND NOT has)), []) AS mc,
  avg(CASE WHEN req THEN has::INT END) AS sr, avg(CASE WHEN NOT req THEN has::INT END) AS sc, bool_or(req AND una) OR bool_or(uns) AS unsure, bool_or(req AND hid) AS hidden FROM x GROUP BY query_id, model)"""
_STREAK = f"""k AS (SELECT {", ".join(_CALL)} FROM events),
i AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY provider ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS isl FROM k),
st AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY provider, isl ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)"""
_V = lambda x: _vkey(f"'{x}'")

ORACLES = {
    "coverage_status": f"""WITH {_COVER} SELECT query_id, model, CASE WHEN unsure THEN 'indeterminate' WHEN len(mr) = 0 AND len(mc) = 0 THEN 'sufficient' WHEN len(mr) = 0 THEN 'usable_with_gaps'
  WHEN hidden THEN 'indeterminate' ELSE 'insufficient' END AS status, round(0.6::DOUBLE * sr + 0.3::DOUBLE * sc + 0.1::DOUBLE, 9) AS confidence, array_to_string(mr, ',') AS missing_required, array_to_string(mc, ',') AS missing_recommended FROM c""",
    "next_actions": f"""WITH {_COVER}, a AS (SELECT query_id, list_concat(mr, mc)[1:5] AS r FROM c), e AS (SELECT query_id, unnest(r) AS role, generate_subscripts(r, 1) AS place FROM a)
SELECT query_id, place, role, CASE role {" ".join(f"WHEN '{r}' THEN '{t}'" for r, t in coverage.TOOLS.items())} ELSE 'web_search' END AS tool FROM e""",
    "failure_streaks": f"WITH {_STREAK} SELECT provider, call_id, streak FROM st",
    "provider_cooldowns": f"""WITH RECURSIVE {_STREAK},
o AS (SELECT *, CASE class WHEN 'blocked' THEN 60 WHEN 'timeout' THEN 15 ELSE 30 END AS rest, row_number() OVER (PARTITION BY provider ORDER BY ts, call_id) AS n FROM st WHERE failed AND streak >= 3),
s AS (SELECT DISTINCT provider, 0::BIGINT AS n, NULL::BIGINT AS call_id, TIMESTAMP '1970-01-01' AS until, false AS ok, 0 AS rest FROM o
  UNION ALL SELECT s.provider, o.n, o.call_id, CASE WHEN o.ts >= s.until THEN o.ts + to_seconds(o.rest) ELSE s.until END, o.ts >= s.until, o.rest FROM s JOIN o ON o.provider = s.provider AND o.n = s.n + 1)
SELECT provider, call_id, rest AS seconds FROM s WHERE ok""",
    "cached_answers": """WITH r AS (SELECT event_id AS request_id, user_id % 20 AS key, ts FROM events WHERE event_id % 2 = 0), s AS (SELECT event_id AS stored_id, user_id % 20 AS key, ts FROM events WHERE event_id % 2 = 1 AND event_type <> 'error')
SELECT request_id, max({'ts': s.ts, 'id': stored_id}).id AS stored_id FROM r LEFT JOIN s ON s.key = r.key AND s.ts <= r.ts AND s.ts >= r.ts - INTERVAL 7200 SECOND GROUP BY request_id""",
    "snapshot_changes": """SELECT p_partkey AS path, CASE WHEN p_partkey % 10 = 0 THEN 'added' WHEN p_partkey % 7 = 0 THEN 'removed' WHEN p_partkey % 3 = 0 THEN 'changed' ELSE 'same' END AS change
FROM part WHERE p_partkey % 10 <> 0 OR p_partkey % 7 <> 0""",
    "enclosing_symbols": f"""WITH p AS (SELECT {", ".join(_PLACE)} FROM events), s AS (SELECT {", ".join(_SYMBOL)} FROM part)
SELECT place_id, p.file, line, min({{'n': last - first, 'f': -first, 'id': symbol_id}}).id AS symbol FROM p LEFT JOIN s ON s.file = p.file AND line BETWEEN first AND last GROUP BY place_id, p.file, line""",
    "source_disagreements": """WITH s AS (SELECT l_partkey AS entity, l_suppkey AS source, array_to_string(list_sort(list(DISTINCT l_linenumber::INT::VARCHAR)), ', ') AS v FROM lineitem GROUP BY 1, 2),
c AS (SELECT entity, v, min(source) AS first_source, count(*) AS n_sources FROM s GROUP BY entity, v),
w AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n_sets, sum(n_sources) OVER (PARTITION BY entity) AS n_all FROM c)
SELECT entity, v AS "values", first_source, n_sources, n_all - n_sources AS n_against FROM w WHERE n_sets > 1""",
    "ignored_files": f"""SELECT p_partkey, path, CASE WHEN regexp_matches(path, '(^|/)test_[^/]*(/|$)') THEN true WHEN regexp_matches(path, '^examples/(.*/)?main[.]rs$') THEN true WHEN regexp_matches(path, '^docs/[^/]*[.]md$') THEN true
  WHEN regexp_matches(path, '(^|/)Cargo[.]lock$') THEN false WHEN regexp_matches(path, '[.]lock$') THEN true ELSE regexp_matches(path, '(^|/)node_modules/') END AS ignored FROM (SELECT p_partkey, {_PATH} AS path FROM part)""",
    "advisory_verdicts": f"""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS finding_id, l_partkey, concat(l_quantity::INT, '.', l_linenumber) AS version FROM lineitem), k AS (SELECT *, {_vkey("version")} AS v FROM f)
SELECT finding_id, p_partkey AS advisory_id, CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN version IN ('5.1', '6.2') THEN 'affected' ELSE 'not_affected' END
  WHEN p_partkey % 4 = 0 THEN CASE WHEN v < {_V("25")} THEN 'affected' ELSE 'not_affected' END
  WHEN p_partkey % 4 = 1 THEN CASE WHEN v < {_V("10")} OR (v >= {_V("30")} AND v < {_V("40")}) THEN 'affected' ELSE 'not_affected' END
  WHEN p_partkey % 4 = 2 THEN CASE WHEN version IN ('7.1', '8.2') OR v < {_V("5")} THEN 'not_affected' ELSE 'unknown' END ELSE 'unknown' END AS verdict,
  CASE WHEN p_partkey % 7 = 0 OR p_partkey % 4 IN (0, 2) THEN 'high' WHEN p_partkey % 4 = 1 THEN 'medium' ELSE 'low' END AS confidence, p_size % 9 = 0 AS known_exploited
FROM k JOIN part ON p_partkey = l_partkey""",
}
