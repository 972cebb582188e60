"""Text beside and inside svg, noscript and iframe stays, scripts and styles go."""

from sievework.llm import dom


def test_svg_and_noscript():
    text = lambda html: [b[0] for b in dom.blocks(html)]
    assert text("<article><svg class='i'/><p>One.</p><svg><path d='x'/></svg><p>Two.</p></article>") == ["One.", "Two."]
    assert text("<p>a</p><svg/><p>b</p>") == ["a", "b"]
    assert dom.blocks("<article><noscript><p>kept</p></noscript></article>")[0][:2] == ("kept", (("article", ()), ("noscript", ()), ("p", ())))
    assert text("<script>x</script><style>y</style><p>z</p>") == ["z"]
