"""Trees of pages against a tree that was known before it was written out, and their blocks, selectors and payloads."""

import random

from pyspark.sql import functions as F

from sievework.operators import markup

PAGES = "page_id long, html string"
INLINE = "b i span a em".split()


def random_tree(rnd, deep=0):
    """(tag, children) with texts as strings; and the same written out, with end tags left out where they may be."""
    kind = rnd.choice(["div", "p", "ul", "table", "dl", "section"] if deep < 3 else ["p"])
    text = lambda: rnd.choice(["one", " two ", "x &lt; y", "ü", "a&amp;b"])
    drop = lambda end: "" if rnd.random() < 0.6 else end
    plain = lambda t: t.replace("&lt;", "<").replace("&amp;", "&")
    if kind == "p":
        t, tag, u = text(), rnd.choice(INLINE), text()
        return ("p", [plain(t), (tag, [plain(u)])]), f"<p>{t}<{tag}>{u}</{tag}>" + drop("</p>")
    if kind == "ul":
        items = [text() for _ in range(rnd.randint(1, 3))]
        return ("ul", [("li", [plain(t)]) for t in items]), "<ul>" + "".join(f"<li>{t}" + drop("</li>") for t in items) + "</ul>"
    if kind == "dl":
        pairs = [(text(), text()) for _ in range(2)]
        return ("dl", [(g, [plain(t)]) for p in pairs for g, t in zip(("dt", "dd"), p, strict=True)]), "<dl>" + "".join(f"<dt>{a}" + drop("</dt>") + f"<dd>{b}" + drop("</dd>") for a, b in pairs) + "</dl>"
    if kind == "table":
        grid = [[text() for _ in range(rnd.randint(1, 3))] for _ in range(2)]
        return ("table", [("tr", [("td", [plain(t)]) for t in row]) for row in grid]), "<table>" + "".join("<tr>" + "".join(f"<td>{t}" + drop("</td>") for t in row) + drop("</tr>") for row in grid) + "</table>"
    own = [random_tree(rnd, deep + 1) for _ in range(rnd.randint(1, 3))]
    return (kind, [t for t, _ in own]), f"<{kind}>" + "".join(h for _, h in own) + f"</{kind}>"


def paths(tree, above=()):
    """(tags from the body down, text) of every text."""
    tag, children = tree
    for c in children:
        if isinstance(c, str):
            yield (*above, tag), c
        else:
            yield from paths(c, (*above, tag))


def test_trees_with_end_tags_left_out(spark):
    rnd, rows, want = random.Random(28), [], {}
    for k in range(60):
        made = [random_tree(rnd) for _ in range(4)]
        rows.append((k, rnd.choice(["<!DOCTYPE html><title>t</title><body>", "", "<html><head></head>"]) + "".join(h for _, h in made)))
        want[k] = [p for t, _ in made for p in paths(t)]
    nodes = markup.tree(spark.createDataFrame(rows, PAGES)).filter("text IS NOT NULL AND NOT array_contains(tags, 'title')").orderBy("page", "node").collect()
    got = {k: [(tuple(n.tags[2:]), n.text) for n in nodes if n.page == k] for k in want}
    assert got == want and all(n.tags[:2] == ["html", "body"] and len(n.path) == len(n.tags) for n in nodes)


def kinds(spark, html, **more):
    df = spark.createDataFrame([(1, html)], PAGES)
    return [(r.kind, r.text) for r in markup.blocks(markup.tree(df), **more).orderBy("block").collect()]


def test_blocks_of_odd_pages(spark):
    long = "Body content that is long enough to be the content of a page."
    assert kinds(spark, f"<main></main><p>{long}") == [("paragraph", long)]
    assert kinds(spark, f"<main>\n<p>{long}</main><p>no") == [("paragraph", long)]
    assert kinds(spark, f"<main><p>tiny</main><article><p>{long}</article><p>no") == [("paragraph", long)]
    assert kinds(spark, f"<div role=main><p>{long}</div><p>no") == [("paragraph", long)]
    assert kinds(spark, f"<nav><p>a</nav><header><p>b</header><p>{long}<p hidden>c<div aria-hidden=true><p>d</div><script>var p = '<p>e'</script>") == [("paragraph", long)]
    assert kinds(spark, "<table><tr><td>1<td>2<tr><td>3<table><tr><td>in|ner</table></table>") == [("table", "| 1 | 2 |\n| --- | --- |\n| 3in\\|ner | |\n| in\\|ner | |")]
    assert kinds(spark, "<table><caption>loose</table><h3></h3><hr>") == [("table", "loose"), ("heading", ""), ("horizontal_rule", "")]
    assert kinds(spark, "<p>a<!-- x --></b>&nbsp; b</p></p></div>tail<blockquote><p>q<p>r</blockquote>") == [("paragraph", "ab"), ("block_quote", "qr")]
    assert kinds(spark, None) == [] and kinds(spark, "") == [] and kinds(spark, "<") == []
    deep = "<div>" * 200 + f"<p>{long}" + "<i>" * 3000 + "lost" + "</i>" * 3000
    assert kinds(spark, deep) == [("paragraph", long)]
    code = spark.createDataFrame([(1, "<pre class='language-ts'>a\n b</pre><pre><code class='x lang-sh'>c</code></pre><pre>d</pre><h2>Ä b!--c</h2>")], PAGES)
    got = markup.blocks(markup.tree(code)).orderBy("block").collect()
    assert [(r.language, r.anchor, r.level) for r in got] == [("typescript", None, None), ("bash", None, None), (None, None, None), (None, "ä-b-c", 2)]


def test_selectors(spark):
    html = "<div class='a b' id=x><p class=b><a href=u rel='n'>1</a></p></div><p><a class=b>2</a></p><ul><li><a>3"
    nodes = markup.tree(spark.createDataFrame([(1, html)], PAGES)).cache()
    found = lambda s: sorted(r.node for r in markup.select(nodes, s).collect())
    tags = {r.node: r.tag for r in nodes.collect()}
    at = lambda tag: [n for n in sorted(tags) if tags[n] == tag]
    assert found("a") == at("a") and found("#x") == at("div") and found("div.a.b#x") == at("div") and found(".b") == [at("div")[0], at("p")[0], at("a")[1]]
    assert found("p a, li a") == at("a") and found("div p.b a") == at("a")[:1] and found("p div a") == [] and found("ul a, a") == at("a")
    assert found("a[rel]") == at("a")[:1] and found("a[rel=n]") == at("a")[:1] and found("a[rel='m']") == [] and found("table") == []


def test_result_pages_that_fail(spark):
    row = '<div class="result {}"><a class="result__a" href="{}">{}</a></div>'
    good = row.format("", "/l/?uddg=https%3A%2F%2Fa.x%2F%3Fq%3D1%252B2&rut=z", "Title <b>it</b>")
    pages = {
        1: row.format("result--ad ", "/l/?uddg=https%3A%2F%2Fad.x", "Ad") + row.format("", "/relative", "No") + row.format("", "/l/?uddg=https%3A%2F%2Fb.x", " ") + good * 3,
        2: row.format("", "/relative", "No"), 3: "<script>No results.</script>", 4: "<p>No results.", 5: "<div class='no-results'></div>", 6: "<form id='challenge-form'></form>No results.", 7: None,
    }
    nodes = markup.tree(spark.createDataFrame(list(pages.items()), PAGES)).cache()
    hits = markup.result_page_hits(nodes, "duckduckgo", most=2)
    assert [tuple(r) for r in hits.orderBy("rank").collect()] == [(1, 1, "https://a.x/?q=1%2B2", "Title it", None), (1, 2, "https://a.x/?q=1%2B2", "Title it", None)]
    states = {r.page: (r.state, r.n_hits) for r in markup.result_page_states(nodes, hits, "duckduckgo").collect()}
    assert states == {1: ("hits", 2), 2: ("unparsed", 0), 3: ("drifted", 0), 4: ("empty", 0), 5: ("empty", 0), 6: ("blocked", 0), 7: ("drifted", 0)}


def test_objects_end_where_their_braces_do(spark):
    cases = ['{"a":1}', '{"a":"}"} {', '{"a":"\\"}"}x', '{"a":{"b":{}}},{}', '{"a":"\\\\"}', "{", '{"a":"', "{}", "}", "", None, '{"a":"' + "\\n{" * 50_000 + '"}']

    def plain(s):
        depth, quoted, skip = 0, False, False
        for k, c in enumerate(s or ""):
            if quoted:
                skip, quoted = (c == "\\" and not skip), not (c == '"' and not skip)
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth <= 0:
                    return s[: k + 1] if depth == 0 else None
        return None

    df = spark.createDataFrame(list(enumerate(cases)), "k int, s string").withColumn("got", markup.embedded_object(F.col("s")))
    assert {r.k: r.got for r in df.collect()} == {k: plain(s) for k, s in enumerate(cases)}


def test_broken_payloads_give_no_rows(spark):
    page = lambda p: f"<script>React.createElement(UIStartpage.AppSerpWeb, {p})</script>"
    whole = '{"render":{"presenter":{"regions":{"mainline":[{"display_type":"web-x","results":[%s]}]}}}}'
    good = '{"clickUrl":" https://e.x/a ","title":"<b>Ex</b> Title","description":"one&nbsp;two <script>no</script>"}'
    rows = [(1, page(whole % good)), (2, page((whole % good)[:-1])), (3, page(whole % '{"clickUrl":"ftp://x","title":"t"},{"clickUrl":"https://x","title":" "}')), (4, page(whole.replace("web-x", "ads") % good)), (5, page("{}")), (6, None), (7, page(whole % ",".join([good] * 30)))]
    got = [tuple(r) for r in markup.embedded_hits(spark.createDataFrame(rows, PAGES)).orderBy("page", "rank").collect()]
    hit = ("https://e.x/a", "Ex Title", "one two")
    assert got == [(1, 1, *hit)] + [(7, k, *hit) for k in range(1, 11)]
