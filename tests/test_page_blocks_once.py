"""Blocks of pages with several roots: nodes that no block needs stay in the reader, and the others go on once."""

from sievework.operators import markup

LONG = "Body content that is long enough to be the content of a page."


def test_nodes_go_on_once_and_only_those_that_blocks_read(spark):
    inner = f"<h1>T</h1><p><b>{LONG}</b><br>more<ul><li>a<ol><li>b</ol></ul><dl><dt>t<dd>d</dl><pre><code class=lang-sh> c\n</code></pre><table><tr><td>1<td>2</table>"
    pages = [
        "<head><title>t</title></head><nav><a>n</a></nav><article>" + inner + "</article><p>out",
        "<main><p>tiny</main><div role=main><p>tiny</div><article><p>tiny</article>" + inner,
        "<ul><li>x<article>" + inner + "</article></ul>", "<div hidden><article>" + inner + "</article></div>", "<aside><main>" + inner + "</main></aside>",
        "<p role=main>loose<i>in</i></p>" + inner, "<dl><dd>y<article><dl><dt>t<dd>d</dl>" + inner + "</article><dt>u<dd>v</dl>", "", "<span>no block</span>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    whole, few = markup.tree(df), markup.tree(df, keep=markup.block_part)
    for least in (0, 50, 10_000):
        want, got = ([tuple(r) for r in markup.blocks(t, least).orderBy("page", "block").collect()] for t in (whole, few))
        assert got == want and got
    tags = {r.tag for r in few.collect()}
    assert not tags & {"html", "head", "title", "a", "b", "br", "i", "span", "nav"} and {None, "p", "li", "code", "div"} <= tags
    assert "posexplode" not in markup.blocks(whole)._jdf.queryExecution().optimizedPlan().toString()  # no copy for each root


def test_white_space_is_what_patterns_take_for_it(spark):
    odd = "\x85\xa0       　"
    df = spark.createDataFrame([(1, f"<p>{odd} a \n{odd}b​ c\x1f <i>{odd}d{odd}</i></p>")], "page_id long, html string")
    assert [r.text for r in markup.blocks(markup.tree(df)).collect()] == ["a b​ c\x1fd"]
