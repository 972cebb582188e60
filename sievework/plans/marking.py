"""Queries over blocks of pages, result pages and payloads, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sievework.operators import markup
from sievework.session import table, written
from sievework.sources import derived

#: Put after the title of every third page, as the given pages hold titles and paragraphs alone.
_MORE = (
    '<ul><li>item\n<ol><li>in</ol><li hidden>no<li>two<p>more</ul><pre class="lang-py">a\n  b</pre><table><tr><th>k|v<td>1<tbody><tr><td>2</table>'
    "<dl><dt>t<dd>d<dd>e</dl><hr><aside><p>no</aside><blockquote><p>q</blockquote><h2 id=own>Sub &lt;head</h2><h3>A slug, too</h3>"
)
_MORE_ROWS = [
    ("list_item", None, None, None, "itemin"), ("list_item", None, None, None, "in"), ("list_item", None, None, None, "twomore"), ("code", None, None, "python", "a\n  b"), ("table", None, None, None, "| k\\|v | 1 |\n| --- | --- |\n| 2 | |"),
    ("definition", None, None, None, "t: d"), ("definition", None, None, None, "t: e"), ("horizontal_rule", None, None, None, ""), ("block_quote", None, None, None, "q"), ("heading", 2, "own", None, "Sub <head"), ("heading", 3, "a-slug-too", None, "A slug, too"),
]


def page_blocks(spark, sf_dir):
    more = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("</h1>"), F.lit("</h1>" + _MORE))).otherwise(F.col("html"))
    return markup.blocks(markup.tree(table(spark, sf_dir, "pages").select("page_id", more.alias("html")), keep=markup.block_part)).withColumnRenamed("page", "page_id")


#: A row of a result page of each engine, around a link, its percent-encoded form, a title and a snippet.
_ROWS = {
    "duckduckgo": ("<div class=\"result x\"><h2><a class=\"result__a\" href=\"/l/?uddg=", "e", "&rut=1\">", "t", "</a></h2><a class=\"result__snippet\">", "s", "</a></div>"),
    "brave": ("<div data-type=\"web\"><a class=\"l1\" href=\"", "u", "\"><div class=\"search-snippet-title\">", "t", "</div></a><div class=\"generic-snippet\">", "s", "</div></div>"),
    "startpage": ("<div class=\"result\"><a class=\"result-title result-link\" href=\"", "u", "\"><h2 class=\"wgl-title\">", "t", "</h2></a><p class=\"description\">", "s", "</p></div>"),
    "mojeek": ("<li><h2><a class=\"title\" href=\"", "u", "\">", "t", "</a></h2><p class=\"s\">", "s", "</p>"),
    "yahoo": ("<div class=\"dd algo-sr\"><div class=\"compTitle\"><a href=\"https://r.x/RU=", "e", "/RK=2/\"><h3><span>", "t", "</span></h3></a></div><div class=\"compText\">", "s", "</div></div>"),
}
_ENGINES = list(_ROWS)
_ODD = {3: "<p>No results. We did not find results for it. No pages found. No search results were found. Not many great matches came back for your search</p>", 4: "<div id=challenge-form></div><p>Please verify you are a human. Access Denied - Startpage. Before you continue to Yahoo</p><div class=captcha-wrap></div>", 5: "<p>changed</p>"}


def _lists(spark, sf_dir):
    """page (request and engine), engine and the recorded result page of every ranked list."""
    hits = derived.hits(spark, sf_dir).withColumn("engine", F.substring("provider", 2, 1).cast("int"))
    cells = {"e": F.url_encode("url"), "u": F.col("url"), "t": F.col("title"), "s": F.concat(F.lit("about "), F.col("rank").cast("string"), F.lit(" <b>it</b>"))}
    row = reduce(lambda out, kv: out.when(F.col("engine") == kv[0], F.concat(*[cells.get(x, F.lit(x)) for x in _ROWS[kv[1]]])), enumerate(_ENGINES), F)
    body = hits.groupBy("query_id", "engine").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", row.alias("row")))), lambda r: r.row), "\n").alias("body"))
    odd = reduce(lambda out, kv: out.when(F.col("query_id") % 11 == kv[0], F.lit(kv[1])), _ODD.items(), F).otherwise(F.concat(F.lit("<ul class=results-standard>"), F.col("body"), F.lit("</ul>")))
    return body.select(F.concat_ws("-", F.col("query_id").cast("string"), F.col("engine").cast("string")).alias("page_id"), "engine", F.concat(F.lit("<html><body><script>'No results.'</script>"), odd).alias("html"))


def _per_engine(spark, sf_dir, one):
    # Every selector reads the nodes again, so they are made once.
    lists = _lists(spark, sf_dir).select(F.concat_ws("-", "page_id", "engine").alias("page_id"), "html")
    nodes = written(markup.tree(lists), "nodes").withColumn("engine", F.substring_index("page", "-", -1)).withColumn("page", F.expr("substring(page, 1, length(page) - 2)"))
    return reduce(lambda a, b: a.unionByName(b), [one(nodes.filter(F.col("engine") == str(k)).drop("engine"), name).withColumn("engine", F.lit(name)) for k, name in enumerate(_ENGINES)])


def result_rows(spark, sf_dir):
    return _per_engine(spark, sf_dir, markup.result_page_hits)


def result_states(spark, sf_dir):
    return _per_engine(spark, sf_dir, lambda nodes, name: markup.result_page_states(nodes, markup.result_page_hits(nodes, name), name))


def payload_rows(spark, sf_dir):
    """Lists of hits as payloads: titles with braces, quotes and markup, some payloads cut or broken."""
    hits = derived.hits(spark, sf_dir)
    entry = F.to_json(F.struct(F.col("url").alias("clickUrl"), F.concat(F.lit('{"<b>'), F.col("title"), F.lit("</b>")).alias("title"), F.when(F.col("rank") % 2 == 0, F.concat(F.lit("\\ } "), F.repeat(F.lit("word "), F.col("rank").cast("int") * 10))).alias("description")))
    body = hits.groupBy("query_id", "provider").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", entry.alias("row")))), lambda r: r.row), ",").alias("rows"))
    kind = F.when(F.col("provider") == "p4", "ads").otherwise("web-google")
    whole = F.concat(F.lit('{"render":{"presenter":{"regions":{"mainline":[{"display_type":"'), kind, F.lit('","results":['), "rows", F.lit("]}]}}}}"))
    given = F.when(F.col("provider") == "p3", F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    page = F.concat(F.lit("<html><script>x(React.createElement(UIStartpage.AppSerpWeb, "), given, F.lit(")); y({})</script>"))
    return markup.embedded_hits(body.select(F.concat_ws("-", F.col("query_id").cast("string"), "provider").alias("page_id"), page.alias("html")))


def _sql(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


_DECODED = "replace(replace(regexp_replace({0}, '&amp;?', '&', 'g'), '&quot;', '\"'), '&lt;', '<')"
_TITLED = "trim(regexp_replace(" + _DECODED.format("title") + ", '\\s+', ' ', 'g'))"
_CUT = "CASE WHEN length(d) > 500 THEN regexp_replace(d[1:500], '\\s\\S*$', '') ELSE d END"
QUERIES = {"page_blocks": page_blocks, "result_rows": result_rows, "result_states": result_states, "payload_rows": payload_rows}
ORACLES = {
    "page_blocks": f"""WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS x FROM pages),
tok AS (SELECT page_id, unnest(ts) AS t, unnest(range(len(ts))) AS p FROM (SELECT page_id, regexp_extract_all(x, '<[^>]*>|[^<]+') AS ts FROM a)),
run AS (SELECT *, sum(CASE WHEN regexp_matches(t, '^<(p|h1)') THEN 1 ELSE 0 END) OVER w AS b, last(CASE WHEN regexp_matches(t, '^</?(p|h1)') THEN NOT contains(t, '/') END IGNORE NULLS) OVER w AS inside FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
blk AS (SELECT page_id, b, bool_or(t = '<h1>') AS head, regexp_replace(coalesce(string_agg({_DECODED.format("trim(t, ' \t\n\r')")}, '' ORDER BY p) FILTER (WHERE NOT starts_with(t, '<') AND inside), ''), '\\s+', ' ', 'g') AS text FROM run WHERE b > 0 GROUP BY ALL),
kept AS (SELECT page_id, b * 100 AS o, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN head THEN 1 END AS level, CASE WHEN head THEN nullif(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\s', '-', 'g'), '[^\\p{{L}}\\p{{N}}_-]', '', 'g'), '(^-+|-+$)', '', 'g'), '') END AS anchor, NULL AS language, text
  FROM blk WHERE head OR text <> ''
  UNION ALL SELECT page_id, 101 + i, kind, level, anchor, language, text FROM pages, (VALUES {', '.join(f"({i}, " + ', '.join(_sql(v) for v in r) + ")" for i, r in enumerate(_MORE_ROWS))}) m(i, kind, level, anchor, language, text) WHERE page_id % 3 = 0)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) AS block, kind, level, CASE WHEN kind = 'heading' AND o % 100 = 0 THEN regexp_replace(anchor, '-+', '-', 'g') ELSE anchor END AS anchor, language, text FROM kept""",
    "result_rows": f"""WITH {derived.HITS}
SELECT query_id || '-' || provider[2:] AS page, row_number() OVER (PARTITION BY query_id, provider ORDER BY rank) AS rank, url, {_TITLED} AS title, 'about ' || rank || ' it' AS snippet, CASE provider {' '.join(f"WHEN 'p{k}' THEN '{e}'" for k, e in enumerate(_ENGINES))} END AS engine
FROM hits WHERE query_id % 11 NOT IN (3, 4, 5) AND {_TITLED} <> '' QUALIFY row_number() OVER (PARTITION BY query_id, provider ORDER BY rank) <= 10""",
    "result_states": f"""WITH {derived.HITS}
SELECT query_id || '-' || provider[2:] AS page, CASE provider {' '.join(f"WHEN 'p{k}' THEN '{e}'" for k, e in enumerate(_ENGINES))} END AS engine, CASE query_id % 11 WHEN 3 THEN 'empty' WHEN 4 THEN 'blocked' WHEN 5 THEN 'drifted' ELSE 'hits' END AS state,
  CASE WHEN query_id % 11 IN (3, 4, 5) THEN 0 ELSE least(10, n) END AS n_hits FROM (SELECT query_id, provider, count(*) FILTER (WHERE {_TITLED} <> '') AS n FROM hits GROUP BY ALL)""",
    "payload_rows": f"""WITH {derived.HITS},
h AS (SELECT *, trim(regexp_replace('{{" ' || {_DECODED.format("title")}, '\\s+', ' ', 'g')) AS shown, CASE WHEN rank % 2 = 0 THEN trim('\\ }} ' || repeat('word ', rank * 10)) END AS d FROM hits WHERE provider NOT IN ('p3', 'p4'))
SELECT query_id || '-' || provider AS page, row_number() OVER (PARTITION BY query_id, provider ORDER BY rank) AS rank, url, shown AS title, {_CUT} AS snippet FROM h QUALIFY row_number() OVER (PARTITION BY query_id, provider ORDER BY h.rank) <= 10""",
}
