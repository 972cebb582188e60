"""Character references that the end of a title cuts off, against what HTML makes of them: some names need no semicolon."""

from sievework.plans import marking

CUT = {
    "&quot;": ('say "', "say"), "&quot": ('say "', "say"), "&quo": ("say &quo", "say-quo"), "&q": ("say &q", "say-q"), "&amp;": ("say &", "say"), "&amp": ("say &", "say"), "&am": ("say &am", "say-am"), "&": ("say &", "say"),
    "&lt": ("say <", "say"), "&l": ("say &l", "say-l"), "&gt;": ("say >", "say"), "&gt": ("say >", "say"), "&amp;quot": ("say &quot", "say-quot"),
}


def test_titles_that_end_inside_a_reference(spark, tmp_path):
    pages = [(k, "https://example.org", f"<article><h1>Say {cut}</h1><p>Body content that is long enough to be the content of a page.</article>") for k, cut in enumerate(CUT)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.text.lower(), r.anchor) for r in marking.page_blocks(spark, str(tmp_path)).filter("block = 1").collect()}
    assert got == dict(enumerate(CUT.values()))
