"""Queries over groups, caps, budgets and excerpts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import selection
from sievework.plans.retrieval import _key_sql
from sievework.session import table

_CARDS = ["user_id AS query_id", "event_id AS pos", "concat('d', event_id * 7 % 5) AS domain", "concat('g', event_id * 3 % 4) AS `group`", "event_id * 31 % 23 AS score"]
_ITEMS = ["conv_id AS query_id", "turn AS pos", "text"]
_CARD, _ITEM = ", ".join(_CARDS).replace("`", '"'), ", ".join(_ITEMS)
_KINDS = ["purchase", "click", "view"]


def cards(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*_CARDS, "event_type")


def card_groups(spark, sf_dir):
    got = selection.grouped(cards(spark, sf_dir), F.col("event_type"), _KINDS, 2, 4, [F.desc("score")])
    return got.select("query_id", "kind", "group_no", "place", "pos", "truncated")


def richest_sources(spark, sf_dir):
    made = table(spark, sf_dir, "pages").selectExpr("page_id AS pos", "CASE WHEN page_id % 7 = 0 THEN NULL ELSE regexp_replace(url, '[0-9]+', cast(page_id % 40 AS string)) END AS url", "page_id % 3 AS n_reasons")
    return selection.richest(made).select("pos", "key", "n_reasons")


def merged_excerpts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id AS card", "turn % 3 AS list_no", "turn AS pos", "length(text) % 7 AS score", "text", "CASE WHEN turn % 2 = 0 THEN concat(text, '  ') END AS snippet")
    return selection.excerpts(turns)


QUERIES = {
    "card_groups": card_groups,
    "diverse_cards": lambda spark, d: selection.diverse(cards(spark, d)),
    "clipped_items": lambda spark, d: selection.clipped(table(spark, d, "conversations").selectExpr(*_ITEMS), 4, 300),
    "richest_sources": richest_sources,
    "merged_excerpts": merged_excerpts,
    "unlike_passages": lambda spark, d: selection.unlike(table(spark, d, "conversations").selectExpr("conv_id % 40 AS query_id", "conv_id * 1000 + turn AS pos", "text"), most=None),
    "batch_waves": lambda spark, d: selection.waves(table(spark, d, "events").selectExpr("user_id AS query_id", "event_id AS pos", "event_type = 'error' AS failed", "cast(value AS bigint) AS n_chars"), 3, 500),
}

_NORM = "lower(trim(regexp_replace({c}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"
_TOKENS = "list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
ORACLES = {
    "card_groups": f"""WITH c AS (SELECT {_CARD}, event_type AS kind FROM events),
g AS (SELECT query_id, kind, min(pos) AS first, count(*) AS n, coalesce(list_position({_KINDS}, kind), 99) AS given FROM c GROUP BY query_id, kind),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY given, first) AS group_no FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, pos) AS place FROM c)
SELECT query_id, kind, group_no, place, pos, n > 2 AS truncated FROM p JOIN o USING (query_id, kind) WHERE place <= 2 AND group_no <= 4""",
    "diverse_cards": f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS n FROM (SELECT {_CARD} FROM events)),
s AS (SELECT DISTINCT query_id, 0::BIGINT AS n, []::VARCHAR[] AS ds, []::VARCHAR[] AS gs, []::BIGINT[] AS ps FROM o
  UNION ALL SELECT query_id, n, CASE WHEN ok THEN list_append(ds, domain) ELSE ds END, CASE WHEN ok THEN list_append(gs, "group") ELSE gs END, CASE WHEN ok THEN list_append(ps, pos) ELSE ps END
  FROM (SELECT s.query_id, o.n, ds, gs, ps, domain, "group", pos, len(ps) < 8 AND len(list_filter(ds, lambda x: x = domain)) < 2 AND len(list_filter(gs, lambda x: x = "group")) < 2 AS ok
        FROM s JOIN o ON o.query_id = s.query_id AND o.n = s.n + 1)),
e AS (SELECT query_id, arg_max(ds, n) AS ds, arg_max(gs, n) AS gs, arg_max(ps, n) AS ps FROM s GROUP BY query_id),
x AS (SELECT query_id, i AS place, ps[i] AS pos, ds[i] AS domain, gs[i] AS "group", len(list_filter(ds[1:i], lambda y: y = ds[i])) AS a, len(list_filter(gs[1:i], lambda y: y = gs[i])) AS b FROM e, range(1, 9) r(i) WHERE i <= len(ps))
SELECT query_id, place, pos, domain, "group", CASE WHEN a = 1 AND b = 1 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS gain FROM x""",
    "clipped_items": f"""WITH r AS (SELECT {_ITEM}, row_number() OVER w AS r, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT *, min(CASE WHEN b + length(text) > 300 THEN r END) OVER (PARTITION BY query_id) AS f FROM r WHERE r <= 4)
SELECT query_id, pos, coalesce(r = f, false) AS clipped, CASE WHEN r = f THEN CASE WHEN b >= 300 THEN NULL ELSE substr(text, 1, (300 - b - 1)::BIGINT) || '…' END ELSE text END AS text FROM f""",
    "richest_sources": f"""WITH s AS (SELECT page_id AS pos, CASE WHEN page_id % 7 = 0 THEN NULL ELSE regexp_replace(url, '[0-9]+', (page_id % 40)::VARCHAR, 'g') END AS url, page_id % 3 AS n_reasons FROM pages),
k AS (SELECT *, {_key_sql("url")} AS key FROM s)
SELECT pos, key, n_reasons FROM k WHERE key IS NULL OR NOT EXISTS (SELECT 1 FROM k o WHERE o.key = k.key AND (o.n_reasons > k.n_reasons OR (o.n_reasons = k.n_reasons AND o.pos < k.pos)))""",
    "merged_excerpts": f"""WITH t AS (SELECT conv_id AS card, turn % 3 AS list_no, turn AS pos, length(text) % 7 AS score, text, CASE WHEN turn % 2 = 0 THEN concat(text, '  ') END AS snippet, {_NORM.format(c="text")} AS norm FROM conversations),
k AS (SELECT * FROM t WHERE norm <> '' AND norm IS DISTINCT FROM {_NORM.format(c="snippet")}),
f AS (SELECT *, row_number() OVER (PARTITION BY card, norm ORDER BY list_no, score DESC, pos) AS r FROM k),
p AS (SELECT card, text, row_number() OVER (PARTITION BY card ORDER BY list_no, score DESC, pos) AS place FROM f WHERE r = 1)
SELECT card, place, text FROM p WHERE place <= 3""",
    "unlike_passages": f"""WITH RECURSIVE t AS (SELECT conv_id % 40 AS query_id, conv_id * 1000 + turn AS pos, {_TOKENS} AS w FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)),
o AS (SELECT query_id, pos, array_to_string(w, ' ') AS said, CASE WHEN len(w) < 4 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g,
      row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM t),
s AS (SELECT DISTINCT query_id, 0::BIGINT AS n, []::STRUCT(said VARCHAR, g VARCHAR[])[] AS kept, NULL::BIGINT AS pos, false AS ok FROM o
  UNION ALL SELECT query_id, n, CASE WHEN ok THEN list_append(kept, {{'said': said, 'g': g}}) ELSE kept END, pos, ok
  FROM (SELECT s.query_id, o.n, kept, o.pos, said, g, len(list_filter(kept, lambda k: k.said <> '' AND said <> '' AND (k.said = said OR (least(len(k.g), len(g)) >= 4 AND len(list_intersect(k.g, g)) >= 0.8 * least(len(k.g), len(g)))))) = 0 AS ok
        FROM s JOIN o ON o.query_id = s.query_id AND o.n = s.n + 1))
SELECT query_id, pos, ok AS kept FROM s WHERE n > 0""",
    "batch_waves": """WITH w AS (SELECT user_id AS query_id, event_id AS pos, event_type = 'error' AS failed, value::BIGINT AS n_chars, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 AS wave FROM (SELECT * REPLACE (trunc(value) AS value) FROM events)),
g AS (SELECT query_id, wave, bool_or(failed) AS f, sum(n_chars) AS s FROM w GROUP BY query_id, wave),
e AS (SELECT query_id, wave, coalesce(bool_or(f) OVER p, false) AS f, coalesce(sum(s) OVER p, 0) AS s FROM g WINDOW p AS (PARTITION BY query_id ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT w.query_id, w.pos, w.failed, w.n_chars, w.wave, NOT e.f AND e.s <= 500 AS runs FROM w JOIN e USING (query_id, wave)""",
}
