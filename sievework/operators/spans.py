"""Spans of code: which lines of a file answer a request for a symbol, a text or a range of lines.

Files become tables of lines and of brackets with their depth; requests meet those tables by file
and line, or by file and depth, never the contents. A bracket block is found by two looks along
the brackets of one depth (the last before a line, the first after it), each a window over one
depth of one file. Blocks by indentation, headings or keys are least and greatest lines of the
file, taken in the tasks before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import written

# Names of languages by family, and shapes of definitions with their kinds and confidence.
FAMILIES = {
    "rust": "rust rs", "python": "python py", "javascript": "javascript js typescript ts tsx jsx", "go": "go",
    "other": "java kotlin kt scala sc sbt c cpp cc cxx c++ h hpp csharp cs ruby rb php swift",
    "markdown": "markdown md", "toml": "toml", "yaml": "yaml yml",
}
DEFINITIONS = {
    "rust": [
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "function", "exact"), (r"(?:pub\s+)?struct\s+(\w+)", "struct", "exact"), (r"(?:pub\s+)?enum\s+(\w+)", "enum", "exact"),
        (r"(?:pub\s+)?trait\s+(\w+)", "trait", "exact"), (r"impl(?:<[^>]*>)?\s+(?:dyn\s+)?(\w+)", "struct", "strong"), (r"(?:pub\s+)?mod\s+(\w+)", "module", "strong"),
        (r"macro_rules!\s+(\w+)", "macro", "strong"), (r"(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(\w+)", "constant", "strong"), (r"(?:pub\s+)?type\s+(\w+)", "type_alias", "strong"),
    ],
    "python": [(r"class\s+(\w+)", "class", "exact"), (r"(?:async\s+)?def\s+(\w+)", "function", "exact")],
    "javascript": [
        (r"(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function", "exact"), (r"(?:export\s+)?class\s+(\w+)", "class", "exact"), (r"(?:export\s+)?interface\s+(\w+)", "interface", "strong"),
        (r"(?:export\s+)?type\s+(\w+)", "type_alias", "strong"), (r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\(|[a-zA-Z_$])", "function", "strong"),
    ],
    "go": [(r"type\s+(\w+)\s+(?:struct|interface)", "struct", "exact"), (r"func\s+(?:\([^)]*\)\s+)?(\w+)", "function", "exact")],
    "other": [(r"(?:public|private|protected|internal)\s+(?:static\s+)?(?:class|interface|enum)\s+(\w+)", "class", "strong"), (r"(?:typedef\s+)?(?:struct|class)\s+(\w+)", "struct", "weak")],
}
HEADING, TABLE = r"^(#{1,6})\s+", r"^\[[^\]]+\]"

#: What a scanner that knows strings and comments passes over, by family. Possessive, so that a long
#: literal takes no stack.
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
LITERALS = {
    "rust": rf"//[^\n]*+|/\*(?s:.*?)\*/|{_QUOTED}|'(?:\\.|[^'\\\n])'",
    "javascript": rf"//[^\n]*+|/\*(?s:.*?)\*/|{_QUOTED}|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`",
    "go": rf"//[^\n]*+|/\*(?s:.*?)\*/|{_QUOTED}|'(?:\\.|[^'\\\n])'|`[^`]*+`",
    "python": rf"#[^\n]*+|\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|{_QUOTED}|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'",
    "other": rf"//[^\n]*+|/\*(?s:.*?)\*/|{_QUOTED}|'(?:\\.|[^'\\\n])'",
}


def family(language: Column) -> Column:
    """The family of a language; brackets alone tell blocks of an unknown one."""
    lower, out = F.lower(F.coalesce(language, F.lit(""))), F.lit("unknown")
    for name, words in FAMILIES.items():
        out = F.when(lower.isin(*words.split()), F.lit(name)).otherwise(out)
    return out


def lines(files: DataFrame) -> DataFrame:
    """file, family, line (from 0), text, total of each line. A last newline ends a line and opens none."""
    held = F.split(F.regexp_replace("content", "\r?\n\\z", ""), "\r?\n")
    # Split once for each file, before its lines are dealt out.
    whole = files.filter("content <> ''").select("file", family(F.col("language")).alias("family"), held.alias("held")).withColumn("total", F.size("held"))
    got = whole.select("file", "family", "total", F.posexplode("held").alias("line", "text"))
    return got.select("file", "family", "line", "text", "total")


def brackets(files: DataFrame, literals: bool = True) -> DataFrame:
    """file, idx (from 1), line, token, depth (after it) of every { and } and of every end of line.
    literals: count brackets that stand in strings and comments, as a plain scan does."""
    fam, text = family(F.col("language")), F.concat(F.regexp_replace(F.regexp_replace("content", "\r?\n\\z", ""), "\r\n", "\n"), F.lit("\n"))
    tokens = F.regexp_extract_all(text, F.lit("[{}\n]"), F.lit(0))
    if not literals:
        for name, shape in LITERALS.items():
            tokens = F.when(fam == name, F.regexp_extract_all(text, F.lit(rf"{shape}|[{{}}\n]"), F.lit(0))).otherwise(tokens)
        # A literal over several lines leaves its ends of lines.
        tokens = F.flatten(F.transform(tokens, lambda t: F.when(F.length(t) == 1, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit("\n"), F.lit(0)))))
    each = files.filter("content <> ''").select("file", F.posexplode(tokens).alias("idx", "token"))
    along = Window.partitionBy("file").orderBy("idx")
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    end = F.when(F.col("token") == "\n", 1).otherwise(0)
    return each.select("file", (F.col("idx") + 1).alias("idx"), (F.sum(end).over(along) - end).cast("int").alias("line"), "token", F.sum(step).over(along).cast("int").alias("depth"))


def block_tree(files: DataFrame, literals: bool = False) -> DataFrame:
    """file, block (the idx of its bracket), parent (null at the top), depth, first, last: every
    bracket block, from the line of its { to that of its } (or the last line, if it stays open)."""
    b = brackets(files, literals)
    own = F.when(F.col("token") == "{", F.col("depth")).otherwise(F.col("depth") + 1)
    held = b.filter("token <> '\n'").withColumn("level", own)
    # At one level brackets open and close in turn.
    along = Window.partitionBy("file", "level").orderBy("idx")
    shut = held.select("file", "idx", "line", "token", "level", F.lead("line").over(along).alias("shut"), F.lead("token").over(along).alias("next"))
    end = b.groupBy("file").agg(F.max("line").alias("end"))
    # The parent is the last block opened a level up: the greatest idx of each level so far, by level.
    opened = shut.filter("token = '{'").join(end, "file")
    parent = _last_before(opened.select("file", F.col("level").alias("key"), "idx"), opened.select("file", (F.col("level") - 1).alias("key"), "idx"))
    out = opened.join(parent, ["file", "idx"], "left")
    return out.select(
        "file", F.col("idx").alias("block"), "parent", F.col("level").alias("depth"), (F.col("line") + 1).alias("first"),
        (F.when(F.col("next") == "}", F.col("shut")).otherwise(F.col("end")) + 1).alias("last"),
    )


def _last_before(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """file, idx, parent: for each (file, key, idx) asked for the greatest idx of rows before it, of its key."""
    both = rows.select("file", "key", "idx", F.col("idx").alias("parent"), F.lit(0).alias("asked")).unionByName(asked.select("file", "key", "idx", F.lit(None).cast("int").alias("parent"), F.lit(1).alias("asked")))
    along = Window.partitionBy("file", "key").orderBy("idx", F.desc("asked")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("parent", F.max("parent").over(along)).filter("asked = 1 AND parent IS NOT NULL").select("file", "idx", "parent")


def definitions(rows: DataFrame) -> DataFrame:
    """file, name, line, order, kind, confidence of every definition that a line may be."""
    start = F.ltrim("text")
    spoken = ~start.startswith("//") | start.startswith("///") | start.startswith("//!")
    shapes = [
        F.when((F.col("family") == fam) & spoken & F.col("text").rlike(f"(?U){shape}"), F.struct(F.regexp_extract("text", f"(?U){shape}", 1).alias("name"), F.lit(k).alias("order"), F.lit(kind).alias("kind"), F.lit(conf).alias("confidence")))
        for fam, held in DEFINITIONS.items()
        for k, (shape, kind, conf) in enumerate(held)
    ]
    found = rows.select("file", "line", F.explode(F.array_compact(F.array(*shapes))).alias("d"))
    return found.select("file", "d.name", "line", "d.order", "d.kind", "d.confidence")


def _bracket_blocks(asked: DataFrame, files: DataFrame) -> DataFrame:
    """request, start, end of each (request, file, at): the innermost open { up to the end of the
    line, and the first } that brings the depth back to that before its line; a line that ends at that
    depth without one is a block by itself."""
    b = written(brackets(files.join(asked.select("file").distinct(), "file", "left_semi")), "brackets")
    # Before the first bracket the depth is 0.
    marks = b.select("file", "idx", "token", "depth", (F.col("line") + F.when(F.col("token") == "\n", 1).otherwise(0)).alias("next"))
    zero = asked.select("file").distinct().selectExpr("file", "0 AS idx", "'\n' AS token", "0 AS depth", "0 AS next")
    marks = marks.unionByName(zero)
    ends = marks.filter("token = '\n'").selectExpr("file AS _f", "next AS _line", "idx AS _idx", "depth AS _depth")
    at = asked.join(ends, (F.col("file") == F.col("_f")) & (F.col("_line") == F.col("at") + 1)).select("request", "file", "at", F.col("_idx").alias("idx"), (F.col("_depth") - 1).alias("depth"))
    both = marks.selectExpr("file", "depth", "idx", "next", "CAST(NULL AS string) AS request", "CAST(NULL AS int) AS at", "0 AS asked").unionByName(at.selectExpr("file", "depth", "idx", "CAST(NULL AS int) AS next", "request", "at", "1 AS asked"))
    back = Window.partitionBy("file", "depth").orderBy("idx", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = written(both.withColumn("start", F.last("next", ignorenulls=True).over(back)).filter("asked = 1").select("request", "file", F.coalesce("start", "at").alias("start")), "block-starts")
    at = start.join(ends, (F.col("file") == F.col("_f")) & (F.col("_line") == F.col("start"))).select("request", "file", "start", F.col("_idx").alias("idx"), F.col("_depth").alias("depth"))
    stops = marks.filter("token <> '{' AND idx > 0").select("file", "depth", "idx", F.when(F.col("token") == "}", F.col("next")).otherwise(-1).alias("stop"))
    both = stops.selectExpr("file", "depth", "idx", "stop", "CAST(NULL AS string) AS request", "CAST(NULL AS int) AS start", "0 AS asked").unionByName(at.selectExpr("file", "depth", "idx", "CAST(NULL AS int) AS stop", "request", "start", "1 AS asked"))
    ahead = Window.partitionBy("file", "depth").orderBy(F.desc("idx"), F.desc("asked")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("stop", F.last("stop", ignorenulls=True).over(ahead)).filter("asked = 1")
    total = marks.groupBy("file").agg((F.max("next") - 1).alias("final"))
    end = F.when(F.col("stop") == -1, F.col("start")).otherwise(F.coalesce("stop", "final"))
    return found.join(total, "file").select("request", "start", end.alias("end"))


def _marked(rows: DataFrame) -> DataFrame:
    """Lines with indentation, what they are, the last full line before and the top of the run of
    decorators (Python) or attributes and doc comments (Rust) that ends with the line."""
    t, bare = F.col("text"), F.trim(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    lead = F.regexp_extract("text", "^[ \t]*", 0)
    out = rows.select(
        "file", "line", "total", "family", "text", F.length(F.regexp_replace(lead, "\t", "    ")).alias("indent"),
        (bare != "").alias("full"), (bare.startswith("@") | bare.startswith("#")).alias("deco"),
        bare.rlike("^(def|async|class) ").alias("opens"), bare.rlike("[;{}]$").alias("closed"), bare.rlike("(;$)|^[{}]$").alias("ends"),
        F.when(t.rlike(f"(?U){HEADING}"), F.length(F.regexp_extract(t, f"(?U){HEADING}", 1))).alias("head"), bare.rlike(TABLE).alias("table"),
        bare.rlike(r"^(#!?\[|///|//!)").alias("attr"), t.rlike("[{}]").alias("braces"),
    )
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = F.when(F.col("family") == "python", F.col("deco")).otherwise(F.col("attr"))
    top = F.when(above, F.coalesce(F.max(F.when(~above, F.col("line"))).over(upto) + 1, F.lit(0)))
    return out.withColumns({"prior": F.max(F.when(F.col("full"), F.col("line"))).over(before), "top": top})


def _other_blocks(asked: DataFrame, marked: DataFrame) -> DataFrame:
    """request, start, end of requests on files whose blocks brackets do not tell."""
    at = asked.join(marked.select("file", F.col("line").alias("at"), F.col("indent").alias("base"), F.coalesce("head", F.lit(6)).alias("level"), F.col("closed").alias("done")), ["file", "at"])
    both = at.join(marked.drop("total", "family", "text"), "file")
    line, before, after = F.col("line"), F.col("line") < F.col("at"), F.col("line") > F.col("at")
    shallow = F.col("full") & (F.col("indent") <= F.col("base"))
    got = both.groupBy("request", "file", "family", "at", "base", "level", "done").agg(
        F.max(F.when(before & shallow & ~F.col("deco"), F.struct("line", "indent", "opens"))).alias("stop"),
        F.max(F.when(before & shallow, F.struct("line", "indent"))).alias("key"),
        F.min(F.when(before & F.col("deco"), line)).alias("decorated"),
        F.min(F.when(after & shallow, F.struct("line", "prior"))).alias("next"),
        F.max(F.when(F.col("full"), line)).alias("last_full"),
        F.min(F.when(after & (F.col("head") <= F.col("level")), line)).alias("next_head"),
        F.max(F.when((before | (line == F.col("at"))) & F.col("table"), line)).alias("own_table"),
        F.max(F.when(before & (~F.col("full") | F.col("closed")), line)).alias("shut"),
        F.min(F.when(after & (F.col("ends") | ~F.col("full")), F.struct(line, "ends"))).alias("until"),
        F.max("line").alias("final"),
    )
    fam = F.col("family")
    python = F.when(F.col("stop").isNull(), F.coalesce("decorated", "at")).when((F.col("stop.indent") == F.col("base")) & F.col("stop.opens"), F.col("stop.line")).otherwise(F.col("stop.line") + 1)
    yaml = F.when(F.col("key").isNull(), F.col("at")).when(F.col("key.indent") < F.col("base"), F.col("key.line")).otherwise(F.col("key.line") + 1)
    start = F.when(fam == "python", python).when(fam == "yaml", yaml).when(fam == "toml", F.coalesce("own_table", "at")).when(fam == "javascript", F.coalesce(F.col("shut") + 1, F.lit(0))).otherwise(F.col("at"))
    indented = F.greatest("at", F.coalesce(F.when(F.col("next").isNotNull(), F.coalesce("next.prior", "at")), "last_full", "at"))
    statement = F.when(F.col("done"), F.col("at")).when(F.col("until").isNull(), F.col("final")).when(F.col("until.ends"), F.col("until.line")).otherwise(F.col("until.line") - 1)
    end = F.when(fam == "python", indented).when(fam == "markdown", F.coalesce(F.col("next_head") - 1, "final")).when(fam == "javascript", statement)
    first = got.select("request", "file", "family", start.cast("int").alias("start"), end.alias("end"), "final", "last_full")
    # Tables and keys end by what follows their start, not the line that was asked for.
    late = first.filter(fam.isin("toml", "yaml")).select("request", "file", "family", "start", "final", "last_full")
    head = late.join(marked.select("file", F.col("line").alias("start"), F.col("indent").alias("base")), ["file", "start"])
    wide = head.join(marked.drop("total", "family", "text"), "file").filter("line > start")
    stop = wide.groupBy("request").agg(
        F.min(F.when(F.col("table"), F.struct("line", "prior"))).alias("table"), F.min(F.when(shallow, F.struct("line", "prior"))).alias("key")
    )
    found = late.join(stop, "request", "left")
    ended = F.when(fam == "toml", F.coalesce("table.prior", "last_full")).otherwise(F.coalesce("key.prior", "last_full"))
    late = found.select("request", "file", "start", F.greatest("start", ended).alias("end"))
    return first.filter(~fam.isin("toml", "yaml")).select("request", "file", "start", "end").unionByName(late)


def spans(files: DataFrame, requests: DataFrame) -> DataFrame:
    """request, selection, first, last (from 1), symbol_kind, confidence, cut: one row for each request
    that its file answers.

    files: file (unique), language, content. requests: request (a string, unique), file, symbol,
    text, first, last, expand, most. A range of lines is taken as it is or widened to the block
    about its middle; else the symbol's definition is sought and its block taken; else the first
    line with the text, with lines about it; else, if nothing was asked for, the whole file. cut:
    the block was longer than most lines. Empty files answer nothing. Lines with what they are, and
    brackets, are written out once, as every kind of request reads them."""
    marked = written(_marked(lines(files)), "lines")
    rows = marked.select("file", "family", "line", "text", "total")
    known = rows.groupBy("file").agg(F.first("family").alias("family"), F.first("total").alias("total"))
    asked = requests.join(known, "file")
    ranged = F.col("first").isNotNull() & F.col("last").isNotNull()
    middle = F.least(F.greatest(F.floor((F.col("first") + F.col("last")) / 2) - 1, F.lit(0)), F.col("total") - 1).cast("int")
    low = F.least(F.greatest("first", F.lit(1)), F.col("total"))
    plain = asked.filter(ranged & ~F.col("expand")).select("request", F.lit("explicit_range").alias("selection"), low.alias("first"), F.least(F.greatest("last", low), F.col("total")).alias("last"), F.lit(None).cast("string").alias("symbol_kind"), F.lit("exact").alias("confidence"), F.lit(False).alias("cut"))
    named = asked.filter(~ranged & F.col("symbol").isNotNull()).select("request", "file", "symbol")
    hit = named.join(definitions(rows).select(F.col("file"), F.col("name").alias("symbol"), "line", "order", "kind", "confidence"), ["file", "symbol"])
    hit = hit.groupBy("request").agg(F.min(F.struct("line", "order", "kind", "confidence")).alias("d"))
    free = asked.filter(~ranged).join(hit, "request", "left")
    sought = free.filter("d IS NULL AND text IS NOT NULL").select("request", "file", "most", "total", F.col("text").alias("needle"))
    ascii_lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = sought.join(rows.select("file", "line", "text"), "file").filter(F.contains(ascii_lower(F.col("text")), ascii_lower(F.col("needle"))))
    seen = seen.groupBy("request", "most", "total").agg(F.min("line").alias("line"))
    about = F.floor(F.least(F.coalesce("most", F.lit(10)), F.lit(20)) / 2).cast("int")
    texts = seen.select("request", F.lit("match_text").alias("selection"), F.greatest(F.col("line") - about, F.lit(0)).alias("start"), F.least(F.col("line") + about, F.col("total") - 1).alias("end"), F.lit(None).cast("string").alias("symbol_kind"), F.lit("strong").alias("confidence"), "most")
    whole = free.filter("d IS NULL AND symbol IS NULL AND text IS NULL").select("request", F.lit("whole_file").alias("selection"), F.lit(0).alias("start"), (F.col("total") - 1).alias("end"), F.lit(None).cast("string").alias("symbol_kind"), F.lit("unknown").alias("confidence"), "most")
    wide = asked.filter(ranged & F.col("expand")).select("request", "file", "family", middle.alias("at"), F.lit("expanded_range").alias("selection"), F.lit(None).cast("string").alias("symbol_kind"), F.lit("strong").alias("confidence"), "most")
    found = free.filter("d IS NOT NULL").select("request", "file", "family", F.col("d.line").alias("at"), F.lit("symbol_definition").alias("selection"), F.col("d.kind").alias("symbol_kind"), F.col("d.confidence").alias("confidence"), "most")
    blocks = wide.unionByName(found)
    bare = marked.groupBy("file").agg(F.bool_or("braces").alias("braces"))
    told = blocks.join(bare, "file").withColumn("by", F.when(F.col("family").isin("python", "markdown", "toml", "yaml"), "other").when((F.col("family") == "javascript") & ~F.col("braces"), "other").otherwise("brackets"))
    told = written(told, "asked-blocks")
    by_bracket = _bracket_blocks(told.filter("by = 'brackets'").select("request", "file", "at"), files)
    by_other = _other_blocks(told.filter("by = 'other'").select("request", "file", "family", "at"), marked)
    held = told.join(by_bracket.unionByName(by_other.select("request", "start", "end")), "request")
    above = marked.filter("top IS NOT NULL").select("file", (F.col("line") + 1).alias("start"), "top")
    held = held.join(above, ["file", "start"], "left").withColumn("start", F.when(F.col("family").isin("rust", "python"), F.coalesce("top", "start")).otherwise(F.col("start")))
    names = ["request", "selection", "start", "end", "symbol_kind", "confidence", "most"]
    every = held.select(*names).unionByName(texts.select(*names)).unionByName(whole.select(*names))
    cut = F.coalesce(F.col("end") - F.col("start") + 1 > F.col("most"), F.lit(False))
    last = F.when(cut, F.col("start") + F.greatest("most", F.lit(1))).otherwise(F.col("end") + 1)
    return plain.unionByName(every.select("request", "selection", (F.col("start") + 1).alias("first"), last.alias("last"), "symbol_kind", "confidence", cut.alias("cut")))
