"""Pages as tables of nodes, and what is read off them: typed blocks, selected elements, hits of result pages.

A small reader turns a page into nodes with implied end tags put in; from there on all is joins and
groups over (page, node). Nodes are numbered in page order, and each has the numbers of its
ancestors, so that what lies inside what is an equality."""

from __future__ import annotations

import re

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import written

cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])

# Elements that are passed over, that hold no others, that stand in a head, that end a paragraph; names of languages.
SKIPPED = frozenset("script style noscript svg nav footer header form aside template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "sh": "bash", "shell": "bash", "md": "markdown"}
#: An opening tag ends open elements of these, down to the nearest of the stops.
IMPLIED = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr td th", "table"), "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "thead": ("tbody thead tfoot tr td th caption colgroup", "table"), "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"),
}
IMPLIED = {tag: tuple(frozenset(x.split()) for x in both) for tag, both in IMPLIED.items()}
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An end tag ends no element that lies around one of these; td and th for tags that are not named here.
STOPS = {"li": ("ul", "ol"), "table": ()} | dict.fromkeys("td th tr tbody thead tfoot".split(), ("table",))
#: Deeper nodes are left out; their end tags still count.
MOST_DEEP = 256
KINDS = {"p": "paragraph", "pre": "code", "blockquote": "block_quote", "hr": "horizontal_rule", "ul ol": "list_item", "dl": "definition", "table": "table"}
NODE = ("node", "path", "tags", "veils", "tag", "attrs", "text")


def read_nodes(html: str | None, keep=None) -> list[tuple]:
    """The nodes of one page: (node, ancestors, their tags, passed-over ones among them and itself, tag, attributes, text).
    keep(tags, tag, attributes): whether a node is handed out; it is numbered anyway."""
    from html.parser import HTMLParser

    out, stack, fresh = [], [], [0]  # stack: (node, tag, path, tags, veils); path, tags and veils with the element itself

    def emit(tag, attrs, text):
        node, (path, tags, veils) = fresh[0], stack[-1][2:] if stack else ([], [], [])
        fresh[0] += 1
        if tag and (tag in SKIPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true"):
            veils = [*veils, node]
        if len(path) < MOST_DEEP and (keep is None or keep(tags, tag, attrs)):
            out.append((node, path, tags, veils, tag, attrs, text))
        return node, path, tags, veils

    def open_(tag, attrs):
        node, path, tags, veils = emit(tag, attrs, None)
        if tag not in VOID:
            deep = len(path) >= MOST_DEEP
            stack.append((node, tag, path if deep else [*path, node], tags if deep else [*tags, tag], veils))

    def close(names, stops=(), every=False):
        """End the innermost open element of these (or all of them), unless a stop lies within."""
        least = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][1] in names:
                least = k
                if not every:
                    break
            elif stack[k][1] in stops:
                break
        if least is not None:
            del stack[least:]

    def body():
        if len(stack) < 2 or stack[1][1] != "body":
            del stack[1:]
            open_("body", {})

    class Reader(HTMLParser):
        def updatepos(self, i, j):
            return j  # lines are not asked for

        def handle_starttag(self, tag, attrs):
            held = {}
            for k, v in attrs:
                held.setdefault(k, v or "")
            if tag == "html":
                return
            if tag == "head":
                if len(stack) == 1:
                    open_(tag, held)
                return
            if tag == "body":
                if not any(s[1] == "body" for s in stack[:2]):
                    del stack[1:]
                    open_(tag, held)
                return
            if tag not in HEAD or len(stack) > 1 and stack[1][1] == "body":
                body()
            if tag in IMPLIED:
                close(*IMPLIED[tag], every=True)
            elif tag in ENDS_P:
                close(("p",), ("td", "th", "caption", "table", "button"))
            if tag in TITLES and stack[-1][1] in TITLES:
                stack.pop()
            open_(tag, held)

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag in ("svg", "path", "circle", "rect", "g", "use", "line"):
                self.handle_endtag(tag)

        def handle_endtag(self, tag):
            if tag == "head" and len(stack) > 1 and stack[1][1] == "head":
                del stack[1:]
            elif tag in ("html", "body", "head"):
                return
            elif tag in TITLES:
                close(TITLES)
            else:
                close((tag,), STOPS.get(tag, ("td", "th")))

        def handle_data(self, data):
            if len(stack) < 3 and not (len(stack) == 2 and stack[1][1] != "head"):
                if not data.strip():
                    return
                if stack[-1][1] in ("html", "head"):
                    body()
            emit(None, None, data)

    open_("html", {})
    reader = Reader(convert_charrefs=True)
    reader.feed(html or "")
    reader.close()
    body()
    return out


def tree(pages: DataFrame, page: str = "page_id", html: str = "html", at_once: int = 20_000, keep=None) -> DataFrame:
    """page, node, path, tags (ancestors, from the root), veils (passed-over ones among them and
    itself), tag and attrs (of an element) or text, of every node. pages has page unique. A null
    page has a root and a body. at_once: nodes handed back together, a page more at most. keep: as in
    read_nodes; block_part leaves what blocks() reads."""
    rows = pages.select(F.col(page).alias("page"), F.col(html).cast("string").alias("html"))
    kind = rows.schema["page"].dataType.simpleString()

    def read(batches):
        import pyarrow as pa

        types = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

        def told(keys, held, like):
            columns = list(zip(*held, strict=True))
            columns[5] = [None if c is None else list(c.items()) for c in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(keys, like), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["page", *NODE])

        for batch in batches:
            keys, held, like = [], [], batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = read_nodes(text.as_py(), keep)
                keys += [key] * len(got)
                held += got
                if len(held) >= at_once:
                    yield told(keys, held, like)
                    keys, held = [], []
            if held:
                yield told(keys, held, like)

    return rows.mapInArrow(read, f"page {kind}, node int, path array<int>, tags array<string>, veils array<int>, tag string, attrs map<string,string>, text string")


_HEADS = "h1 h2 h3 h4 h5 h6 p pre table blockquote dl hr ul ol".split()
_PARTS = frozenset([*_HEADS, *"li dt dd td th code main article body".split()])
_HEAD_SET = frozenset(_HEADS)
#: Numbers of the elements that hold the text of a row with ids, tgs (the path and, for an element, itself),
#: head at place h: the head itself, items of a list and of lists in items, terms
#: and definitions, cells and their table.
_HOLDERS = """CASE WHEN get(tgs, h) IN ('ul', 'ol') THEN aggregate(filter(sequence(0, size(ids) - 1), i -> i > h), named_struct('ok', true, 'l', CAST(array() AS array<int>)),
  (a, i) -> CASE WHEN a.ok AND (i - h) % 2 = 1 AND get(tgs, i) = 'li' THEN named_struct('ok', true, 'l', concat(a.l, array(get(ids, i)))) WHEN a.ok AND (i - h) % 2 = 0 AND get(tgs, i) IN ('ul', 'ol') THEN a ELSE named_struct('ok', false, 'l', a.l) END, a -> a.l)
WHEN get(tgs, h) = 'dl' THEN CASE WHEN get(tgs, h + 1) IN ('dt', 'dd') THEN array(get(ids, h + 1)) ELSE array() END
WHEN get(tgs, h) = 'table' THEN concat(array(get(ids, h)), transform(filter(sequence(0, size(ids) - 1), i -> i > h + 1 AND get(tgs, i) IN ('td', 'th') AND get(tgs, i - 1) = 'tr'), i -> get(ids, i)))
ELSE array(get(ids, h)) END"""


#: What a page's content may be, in order.
_ROOTS = "main", "article", "role", "body"
#: The roots (0 to 3) that hold a row with path, ids and tgs (the path and, for an element, itself), each with the
#: place h of the first head below it, unless an element that is passed over lies between them or is the head.
_SEEN = f"""filter(transform(roots, (r, i) -> named_struct('place', i, 'root', r, 'h', CASE WHEN array_contains(path, r) THEN
  array_min(filter(sequence(0, size(tgs) - 1), j -> j >= array_position(path, r) AND get(tgs, j) IN ({', '.join(f"'{t}'" for t in _HEADS)}))) END)),
  s -> s.h IS NOT NULL AND NOT exists(veils, v -> v > s.root AND v <= get(ids, s.h)))"""
#: What (?U)\s of a pattern finds.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _stands(role: Column) -> Column:
    """An element that blocks() reads: a head, what stands inside one, or what may be a root."""
    return F.col("tag").isin(*_PARTS) | F.coalesce(role == "main", F.lit(False))


def block_part(tags: list, tag: str | None, attrs: dict | None) -> bool:
    """The nodes that blocks() reads, for tree()."""
    return tag in _PARTS or attrs.get("role") == "main" if tag else not _HEAD_SET.isdisjoint(tags)


def _roots(nodes: DataFrame) -> DataFrame:
    """nodes with roots (the first main, article, element of role main and body, or nulls) and fallback, the last there is."""
    along = Window.partitionBy("page")
    first = lambda c: F.min(F.when(c, F.col("node"))).over(along)
    found = F.array(first(F.col("tag") == "main"), first(F.col("tag") == "article"), first((F.col("role") == "main") & F.col("tag").isNotNull()), first(F.col("tag") == "body"))
    return nodes.withColumn("roots", found).withColumn("fallback", F.array_max(F.transform("roots", lambda r, i: F.when(r.isNotNull(), i))))


def blocks(nodes: DataFrame, least_chars: int = 50) -> DataFrame:
    """page, block (from 1), kind, level, anchor, language, text: the blocks of each page's content.

    The content is the first of main, article, an element of role main and body that gives a block
    and least_chars characters, or else the last there is. Text parts of a block are trimmed and joined
    as they stand; code keeps its white space. Items of lists are flattened, cells make rows of a
    table, terms go before their definitions."""
    # Texts under a block, and elements that are or hold one; all others are known to these by their paths.
    own, attr = F.col("tag").isNotNull(), lambda name: F.try_element_at("attrs", F.lit(name))
    each = nodes.filter(own & _stands(attr("role")) | F.col("text").isNotNull() & F.arrays_overlap("tags", F.array(*[F.lit(t) for t in _HEADS])))
    each = _roots(each.select("page", "node", "path", "tags", "veils", "tag", "text", *[attr(k).alias(k) for k in ("role", "id", "class")]))
    each = each.withColumns({"ids": F.when(own, F.concat("path", F.array("node"))).otherwise(F.col("path")), "tgs": F.when(own, F.concat("tags", F.array("tag"))).otherwise(F.col("tags"))})
    each = each.withColumn("seen", F.expr(_SEEN)).withColumn("h", F.explode(F.array_distinct(F.col("seen.h"))))
    # Roots that see a block are told by the block alone, so its rows go on once, whatever their number.
    each = each.select(
        "page", "fallback", F.expr("aggregate(seen, 0, (a, s) -> a + CASE WHEN s.h = h THEN shiftleft(1, s.place) ELSE 0 END)").alias("places"), F.expr("get(ids, h)").alias("head"),
        F.expr("get(tgs, h)").alias("head_tag"), "node", F.element_at("path", -1).alias("up"), "veils", "tag", "id", "class", "text", F.explode(F.expr(_HOLDERS)).alias("holder"),
    )
    mine, shown = own & (F.col("node") == F.col("holder")), F.col("text").isNotNull() & F.expr("NOT exists(veils, v -> v >= holder)")
    each = each.filter(mine | shown | (F.col("tag") == "code"))
    piece = F.when(F.col("head_tag") == "pre", F.col("text")).otherwise(F.trim("text", F.lit(SPACES)))
    got = each.groupBy("page", "fallback", "places", "head", "head_tag", "holder").agg(
        F.max(F.when(mine, F.struct("tag", "id", "class", "up"))).alias("own"),
        F.min(F.when(F.col("tag") == "code", F.struct("node", "class"))).alias("code"),
        F.sort_array(F.collect_list(F.when(shown, F.struct("node", piece.alias("text"))))).alias("parts"),
    )
    joined = F.array_join("parts.text", "")
    folded = F.when(F.col("head_tag") == "pre", joined).otherwise(F.regexp_replace(joined, r"(?U)[^\S ]\s*| \s+", " "))
    got = got.select("page", "fallback", "places", "head", "head_tag", "holder", "own.*", "code", folded.alias("text"))
    # Rows of a table are the parents of its cells; all else is a row of its own. Grouped by page still.
    head, along = F.col("head_tag"), Window.partitionBy("page", "head").orderBy("holder").rowsBetween(Window.unboundedPreceding, -1)
    cell = (head == "table") & (F.col("holder") != F.col("head"))
    got = got.withColumn("term", F.when(head == "dl", F.coalesce(F.last(F.when(F.col("tag") == "dt", F.col("text")), ignorenulls=True).over(along), F.lit(""))))
    rows = got.groupBy("page", "fallback", "places", "head", "head_tag", F.when(cell, F.col("up")).otherwise(F.col("holder")).alias("row")).agg(
        F.first("tag").alias("tag"), F.first("id").alias("id"), F.first("class").alias("class"), F.first("code.class").alias("code"), F.first("term").alias("term"), F.first("text").alias("text"),
        F.sort_array(F.collect_list(F.when(cell, F.struct("holder", F.replace("text", F.lit("|"), F.lit("\\|")).alias("text"))))).alias("cells"),
    )
    table = rows.groupBy("page", "fallback", "places", "head", "head_tag", F.when(head == "table", F.col("head")).otherwise(F.col("row")).alias("node")).agg(
        *[F.min_by(c, "row").alias(c) for c in ("tag", "id", "class", "code", "term", "text")],
        F.sort_array(F.collect_list(F.when(F.size("cells") > 0, F.struct("row", F.transform("cells", lambda c: c.text).alias("cells"))))).alias("grid"),
    )
    wide = F.array_max(F.transform("grid", lambda r: F.size(r.cells)))
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r.cells, lambda c: F.concat(F.lit(" "), c, F.lit(" |"))), ""), F.repeat(F.lit(" |"), wide - F.size(r.cells)))
    lines = F.transform("grid", line)
    ruled = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), wide))), F.slice(lines, 2, F.size(lines))), "\n")
    defined = F.when(F.col("term") == "", F.col("text")).when(F.col("text") == "", F.col("term")).otherwise(F.concat("term", F.lit(": "), "text"))
    text = F.when((head == "table") & (F.size("grid") > 0), ruled).when(head == "dl", defined).otherwise(F.col("text"))
    kind = F.when(head.rlike("^h[1-6]$"), "heading")
    for tags, name in KINDS.items():
        kind = kind.when(head.isin(*tags.split()), name)
    every = table.filter((head != "dl") | (F.col("tag") == "dd")).withColumns({"text": text, "kind": kind})
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("text"), r"(?U)\s", "-"), r"[^\p{L}\p{N}_-]", ""), "^-+|-+$|(?<=-)-+", "")
    anchor = F.when(F.col("kind") == "heading", F.coalesce("id", F.when(F.col("text") != "", slug)))
    spoken = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?:^|\s)lang(?:uage)?-(\S+)", 1), F.lit(""))
    lang = F.coalesce(spoken(F.col("code")), spoken(F.col("class")))
    lang = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), lang), lang)
    # One sort serves both windows. What gives no block is dropped between them, as its text would be made again below them.
    page = Window.partitionBy("page").orderBy("node")
    block, whole = F.expr("kind IN ('heading', 'code', 'table', 'horizontal_rule') OR text <> ''"), page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    every = every.withColumns({f"_n{k}": F.sum(F.when(block & (F.getbit("places", F.lit(k)) == 1), F.length("text"))).over(whole) for k in range(len(_ROOTS))})
    good = F.coalesce(*[F.when(F.col(f"_n{k}") >= least_chars, k) for k in range(len(_ROOTS))], F.col("fallback"))
    every = every.filter(block & (F.getbit("places", good) == 1))
    return every.select(
        "page", F.row_number().over(page).alias("block"), "kind", F.when(F.col("kind") == "heading", F.substring("head_tag", 2, 1).cast("int")).alias("level"),
        anchor.alias("anchor"), F.when(F.col("kind") == "code", lang).alias("language"), "text",
    )


def is_like(simple: str) -> Column:
    """An element (tag, attrs) is like a tag, #id, .class or [name=value], or several of them in one."""
    out, attr = F.col("tag").isNotNull(), lambda n: F.try_element_at("attrs", F.lit(n))
    for tag, ident, cls, name, value in re.findall(r"^([a-z][a-z0-9]*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=['\"]?([^'\"\]]*)['\"]?)?\]", simple):
        if tag:
            out &= F.col("tag") == tag
        elif ident:
            out &= F.coalesce(attr("id") == ident, F.lit(False))
        elif cls:
            out &= F.array_contains(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), cls)
        else:
            out &= F.coalesce(attr(name) == value if value else attr(name).isNotNull(), F.lit(False))
    return out


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """page, node, path, attrs of elements that a selector finds: alternatives by comma, ancestors by space."""
    out = None
    for one in selector.split(","):
        *above, last = one.split()
        found = nodes.filter(is_like(last)).select("page", "node", "path", "attrs")
        if above:
            # Ancestors in order, from the root down: an ancestor that itself lies in what stands before it.
            outer = select(nodes, " ".join(above)).select("page", F.col("node").alias("_up"))
            found = found.withColumn("_up", F.explode("path")).join(outer, ["page", "_up"], "left_semi").select("page", "node", "path", "attrs").dropDuplicates(["page", "node"])
        out = found if out is None else out.unionByName(found)
    return out if "," not in selector else out.dropDuplicates(["page", "node"])


# Where result pages hold their rows, and what tells empty and blocked ones.
SHAPES = {
    "duckduckgo": {"row": "div.result", "ad": "result--ad", "link": "a.result__a", "title": "a.result__a", "snippet": "a.result__snippet", "url": "uddg", "empty": ["div.no-results", "'No results."], "blocked": ["#challenge-form", "div.anomaly-modal", "'Unfortunately, bots use DuckDuckGo too."]},
    "brave": {"row": "div[data-type='web']", "ad": None, "link": "a.l1", "title": "div.search-snippet-title", "snippet": "div.generic-snippet", "url": "href", "empty": ["#bad-results-info-banner", "div.fallback-snippet", "'Not many great matches came back for your search"], "blocked": ["'Please verify you are a human"]},
    "startpage": {"row": "div.result", "ad": None, "link": "a.result-title", "title": "h2.wgl-title", "snippet": "p.description", "url": "href", "empty": ["div.no-results", "'No search results were found", "'No results found for"], "blocked": ["'Access Denied - Startpage", "#anubis_challenge", "#anubis_version"]},
    "mojeek": {"row": "ul.results-standard li, ol.results-standard li", "ad": None, "link": "h2 a", "title": "h2 a", "snippet": "p.s", "url": "href", "empty": ["div.no-results", "'No pages found"], "blocked": ["div.captcha-wrap", "'JavaScript is required to complete this challenge", "'your network appears to be sending automated queries"]},
    "yahoo": {"row": "div.algo-sr", "ad": None, "link": "div.compTitle a", "title": "div.compTitle a h3 span", "snippet": "div.compText", "url": "RU", "empty": ["'We did not find results for"], "blocked": ["'Before you continue to Yahoo"]},
}


def _target(href: Column, rule: str) -> Column:
    """Where a link of a result page leads; null where it leads nowhere on the web."""
    decoded = lambda c: F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))
    if rule == "uddg":
        held = F.regexp_extract(href, r"[?&]uddg=([^&#]*)", 1)
        return F.when(href.startswith("/") & (held != ""), decoded(held))
    if rule == "RU":
        inner = F.regexp_extract(href, r"/RU=.*?(http.*?)(?:/R[SK]=|$)", 1)
        href = F.when(inner != "", decoded(F.replace(inner, F.lit("+"), F.lit("%2B")))).otherwise(href)
    return F.when(href.rlike("^(?i)https?://"), href)


def _texts(nodes: DataFrame, picked: DataFrame) -> DataFrame:
    """page, node, text: the whole text inside picked elements, white space folded."""
    inside = nodes.filter("text IS NOT NULL").select("page", F.col("node").alias("at"), "text", F.explode("path").alias("node")).join(picked.select("page", "node").distinct(), ["page", "node"])
    got = inside.groupBy("page", "node").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("t"))
    return got.select("page", "node", F.trim(F.regexp_replace(F.array_join(F.transform("t", lambda t: t.text), ""), r"(?U)\s+", " ")).alias("text"))


def result_page_hits(nodes: DataFrame, engine: str, most: int = 10) -> DataFrame:
    """page, rank, url, title, snippet: the rows of recorded result pages of one engine, in page order."""
    shape = SHAPES[engine]
    rows = select(nodes, shape["row"])
    if shape["ad"]:
        rows = rows.filter(~F.array_contains(F.split(F.try_element_at("attrs", F.lit("class")), r"\s+"), shape["ad"]))
    rows = rows.select("page", F.col("node").alias("row"))

    def first(selector):
        found = select(nodes, selector).withColumn("row", F.explode("path")).join(rows, ["page", "row"])
        return found.groupBy("page", "row").agg(F.min(F.struct("node", F.try_element_at("attrs", F.lit("href")).alias("href"))).alias("f")).select("page", "row", "f.node", "f.href")

    link = first(shape["link"]).select("page", "row", _target(F.coalesce("href", F.lit("")), shape["url"]).alias("url"))
    title, snippet = (first(shape[k]).select("page", "row", "node") for k in ("title", "snippet"))
    texts = _texts(nodes, title.unionByName(snippet))
    title = title.join(texts, ["page", "node"]).select("page", "row", F.col("text").alias("title"))
    snippet = snippet.join(texts, ["page", "node"]).select("page", "row", F.nullif("text", F.lit("")).alias("snippet"))
    got = link.filter("url <> ''").join(title.filter("title <> ''"), ["page", "row"]).join(snippet, ["page", "row"], "left")
    rank = F.row_number().over(Window.partitionBy("page").orderBy("row"))
    return got.select("page", rank.alias("rank"), "url", "title", "snippet").filter(F.col("rank") <= most)


def result_page_states(nodes: DataFrame, hits: DataFrame, engine: str) -> DataFrame:
    """page, state, n_hits: hits, blocked, empty, or unparsed (rows without hits) and drifted (no rows)."""
    shape = SHAPES[engine]
    bare = F.when(~F.arrays_overlap("tags", F.array(F.lit("script"), F.lit("style"))), F.struct("node", "text"))
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), bare))), lambda t: t.text), " ")
    parts = {"blocked": shape["blocked"], "empty": shape["empty"]}
    signs = {f"_{k}": F.lit(False) for k in parts}
    for k, held in parts.items():
        for mark in held:
            if not mark.startswith("'"):
                signs[f"_{k}"] |= is_like(mark)
    simple = [x.split()[0] for x in shape["row"].split(",")] if " " in shape["row"] else [shape["row"]]
    boxed = F.lit(False)
    for s in simple:
        boxed |= is_like(s)
    page = nodes.groupBy("page").agg(shown.alias("shown"), *[F.bool_or(c).alias(k) for k, c in signs.items()], F.bool_or(boxed).alias("_row"))
    said = lambda k: F.col(f"_{k}") | F.exists(F.array(*[F.lit(m[1:]) for m in parts[k] if m.startswith("'")]), lambda m: F.contains("shown", m))
    count = hits.groupBy("page").agg(F.count("*").alias("n"))
    state = F.when(F.col("n") > 0, "hits").when(said("blocked"), "blocked").when(said("empty"), "empty").when(F.col("_row"), "unparsed").otherwise("drifted")
    return page.join(count, "page", "left").select("page", state.alias("state"), F.coalesce("n", F.lit(0)).alias("n_hits"))


#: A payload that a page hands to its own script: what stands before it, and a scan of it that passes over strings.
PAYLOAD = r"(?s)React\.createElement\(UIStartpage\.AppSerp[A-Za-z0-9_]+\s*,\s*(\{.*)"
PIECES = r'"[^"\\]*+(?:(?s:\\.)[^"\\]*+)*+"?|[{}]|[^"{}]++'
PAYLOAD_SCHEMA = (
    "render struct<presenter struct<regions struct<mainline array<struct<display_type string, results array<struct<clickUrl string, title string, description string>>>>>>>"
)
SNIPPET_CHARS = 500


def embedded_object(text: Column) -> Column:
    """The object that stands first in a text that starts with its brace; null where it does not end."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    none = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a, p):
        depth = a.depth + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)
        shut = (a.end == 0) & (p == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), (a.at + 1).alias("at"), F.when(shut, a.at + 1).otherwise(a.end).alias("end"))

    end = F.aggregate(pieces, none, step, lambda a: a.end)
    return F.when(end > 0, F.array_join(F.slice(pieces, 1, end), ""))


def embedded_hits(pages: DataFrame, most: int = 10, page: str = "page_id", html: str = "html") -> DataFrame:
    """page, rank, url, title, snippet: rows of the payload that a result page hands to its script.

    The object ends at the brace that closes it, strings and escapes passed over. Regions of web
    results count alone; rows without a web address or a title do not. Broken payloads give none."""
    own = F.col(html)
    held = pages.select(F.col(page).alias("page"), F.from_json(embedded_object(F.nullif(F.regexp_extract(own, PAYLOAD, 1), F.lit(""))), PAYLOAD_SCHEMA).alias("o"))
    region = held.select("page", F.posexplode("o.render.presenter.regions.mainline").alias("i", "r")).filter("startswith(r.display_type, 'web')")
    rows = region.select("page", "i", F.posexplode("r.results").alias("j", "e")).select("page", "i", "j", F.trim(F.col("e.clickUrl")).alias("url"), "e.title", "e.description").filter("rlike(url, '^(?i)https?://')")
    # Read three times: with its titles and its descriptions, which are markup themselves.
    rows = written(rows, "payload-rows")
    keys = F.concat_ws("/", F.col("page").cast("string"), "i", "j")
    both = rows.select("page", "i", "j", "url", F.explode(F.array(F.struct(F.concat(keys, F.lit("/t")).alias("key"), F.col("title").alias("html")), F.struct(F.concat(keys, F.lit("/d")).alias("key"), F.col("description").alias("html")))).alias("p"))
    read = tree(both.select("p.key", "p.html").filter("html IS NOT NULL"), "key", "html").filter("text IS NOT NULL").filter(~F.arrays_overlap("tags", F.array(F.lit("script"), F.lit("style"))))
    text = read.groupBy(F.col("page").alias("key")).agg(F.sort_array(F.collect_list(F.struct("node", "text"))).alias("t"))
    text = written(text.select("key", F.trim(F.regexp_replace(F.array_join(F.transform("t", lambda t: t.text), " "), r"(?U)[\s\p{Cntrl}]+", " ")).alias("text")), "payload-texts")
    found = rows.withColumn("key", F.concat(keys, F.lit("/t"))).join(text.filter("text <> ''").withColumnRenamed("text", "shown"), "key").drop("key")
    found = found.withColumn("key", F.concat(keys, F.lit("/d"))).join(text.withColumnRenamed("text", "snippet"), "key", "left")
    cut = F.regexp_replace(F.substring("snippet", 1, SNIPPET_CHARS), r"\s\S*$", "")
    short = F.when(F.length("snippet") > SNIPPET_CHARS, cut).otherwise(F.nullif("snippet", F.lit("")))
    rank = F.row_number().over(Window.partitionBy("page").orderBy("i", "j"))
    return found.select("page", rank.alias("rank"), "url", F.col("shown").alias("title"), short.alias("snippet")).filter(F.col("rank") <= most)
