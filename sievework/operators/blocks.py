"""Documents as blocks: kinds, heading paths, chunks, symbols of code, and the parts of a page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sievework.functions.text import ascii_bounds

LEVELS = 6
# How lines of code open a symbol, by language; the last group is its name.
SYMBOLS = {
    "rust": r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|mod|type)\s+(\w+)",
    "python": r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)",
    "javascript": r"^(\s*)(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|interface)\s+(\w+)",
    "go": r"^(\s*)(func|type)\s+(?:\([^)]*\)\s*)?(\w+)",
}
# Elements whose text is not the page's own.
SKIPPED = "script style noscript svg nav footer header form aside".split()


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, kind, level, text: lines of Markdown that are not blank, as heading (with its
    level), code (within fences, which are left out), list_item, quote, table_row or text.

    Fences open and close in turn; whether a line lies within is a running count over the lines of
    its document, which Spark sorts and spills. Null text has no lines."""
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    fence = F.trim("line").startswith("```")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("inside", F.sum(F.when(fence, 1).otherwise(0)).over(w) % 2 == 1).filter(~fence & (F.trim("line") != ""))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    kind = (
        F.when(F.col("inside"), "code").when(level > 0, "heading").when(F.col("line").rlike(r"^\s*([-*+]|[0-9]+[.)])\s"), "list_item").when(F.col("line").rlike(r"^\s*>"), "quote").when(F.col("line").rlike(r"^\s*\|.*\|\s*$"), "table_row").otherwise("text")
    )
    text = F.when(kind == "heading", F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))).when(kind == "list_item", F.regexp_replace("line", r"^\s*([-*+]|[0-9]+[.)])\s+", "")).when(kind == "quote", F.regexp_replace("line", r"^\s*>\s?", "")).otherwise(F.col("line"))
    return line.select("doc_id", "pos", kind.alias("kind"), F.when(kind == "heading", level).otherwise(0).alias("level"), text.alias("text"))


def heading_paths(blocks: DataFrame) -> DataFrame:
    """blocks with path: the headings a block lies under, a heading's own included, outermost first.

    For each level, the last heading of that level or above is looked up by a window; it is in the
    path if it is of just that level."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda n: F.last(F.when((F.col("level") > 0) & (F.col("level") <= n), F.struct("level", "text")), ignorenulls=True).over(w)
    out = blocks.withColumns({f"h{n}": last(n) for n in range(1, LEVELS + 1)})
    path = F.array_compact(F.array(*[F.when(F.col(f"h{n}.level") == n, F.col(f"h{n}.text")) for n in range(1, LEVELS + 1)]))
    return out.withColumn("path", path).drop(*[f"h{n}" for n in range(1, LEVELS + 1)])


@F.pandas_udf(ArrayType(IntegerType()))
def _packed(sizes: pd.Series, breaks: pd.Series, most_chars: pd.Series, most_blocks: pd.Series) -> pd.Series:
    def one(ns, bs, chars, n_blocks):
        out, chunk, used, held = [], 0, 0, 0
        for n, b in zip(ns, bs):
            if held and (b or used + n > chars or held >= n_blocks):
                chunk, used, held = chunk + 1, 0, 0
            out.append(chunk)
            used, held = used + n, held + 1
        return out

    return pd.Series([None if s is None else one(s, b, c, n) for s, b, c, n in zip(sizes, breaks, most_chars, most_blocks)])


def chunks(docs: DataFrame, most_chars: int = 4096, most_blocks: int = 8) -> DataFrame:
    """doc_id, chunk, n_blocks, text: lines that are not blank, packed in order until the next would
    make more than most_chars characters or most_blocks lines, or is a heading. A line that is longer
    by itself is a chunk of its own. Each step depends on the last, so sizes (not texts) go through
    an Arrow function, within the row of their document: nothing is shuffled or gathered."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    sized = docs.select("doc_id", lines.alias("lines"))
    place = _packed(F.transform("lines", lambda x: F.length(x)), F.transform("lines", lambda x: x.rlike(r"^#{1,6}\s")), F.lit(most_chars), F.lit(most_blocks))
    sized = sized.withColumn("place", place)
    ids = sized.select("doc_id", "lines", "place", F.explode(F.array_distinct("place")).alias("chunk"))
    first, n = F.array_position("place", F.col("chunk")), F.size(F.filter("place", lambda p: p == F.col("chunk")))
    return ids.select("doc_id", "chunk", n.alias("n_blocks"), F.array_join(F.slice("lines", first.cast("int"), n), "\n").alias("text"))


def symbols(files: DataFrame) -> DataFrame:
    """file, symbol_kind, name, first, last: symbols that lines of code open (from 1), each up to the
    line before the next that is indented no deeper, or the end of the file.

    files: file, language, content; other languages have none. The next such line is the least of
    one look-ahead window for each depth that is told apart (8 and deeper count as one)."""
    line = files.select("file", "language", F.size(F.split("content", "\n")).alias("n"), F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    depth = kind = name = None
    for lang, shape in SYMBOLS.items():
        hit = (F.col("language") == lang) & F.col("line").rlike(shape)
        got = [F.when(hit, F.regexp_extract("line", shape, k)) for k in (1, 2, 3)]
        depth, kind, name = got if depth is None else (F.coalesce(depth, got[0]), F.coalesce(kind, got[1]), F.coalesce(name, got[2]))
    rows = line.select("file", "n", "pos", kind.alias("symbol_kind"), name.alias("name"), F.least(F.length(depth), F.lit(8)).alias("depth")).filter("name is not null")
    after = Window.partitionBy("file").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({f"n{d}": F.min(F.when(F.col("depth") <= d, F.col("pos"))).over(after) for d in range(9)})
    end = F.coalesce(F.element_at(F.array(*[F.col(f"n{d}") for d in range(9)]), F.col("depth") + 1), F.col("n"))
    return rows.select("file", "symbol_kind", "name", (F.col("pos") + 1).alias("first"), end.cast("int").alias("last"))


def page_parts(html: Column) -> Column:
    """struct(title, description, n_links, text) of a page: text without elements that are not its
    own, tags as spaces, white space folded. Null is an empty page."""
    h = F.coalesce(html, F.lit(""))
    fold = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    body = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    for tag in [*SKIPPED, "head", "title"]:
        body = F.regexp_replace(body, ascii_bounds(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"), " ")
    return F.struct(
        fold(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.regexp_extract(h, r"(?is)<meta\s+name=[\"']description[\"']\s+content=[\"'](.*?)[\"']", 1).alias("description"),
        F.least(F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"']+)[\"']"), 1))), F.lit(100)).alias("n_links"),
        fold(F.regexp_replace(body, r"<[^>]*>", " ")).alias("text"),
    )
