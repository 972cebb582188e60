"""Fetched bodies as documents: their kind and language, lines of diffs with their places in both versions,
cells of notebooks, previews of tables, and paragraphs of plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds by content type, languages that content types name, kinds and languages by ending of an address.
TYPES = {
    "markdown": "text/markdown text/x-markdown", "pdf": "application/pdf", "json": "application/json application/ld+json", "toml": "text/toml application/toml",
    "yaml": "text/x-yaml text/yaml application/x-yaml application/yaml", "diff": "text/x-diff text/x-patch", "csv": "text/csv text/tab-separated-values application/csv application/tsv",
    "xml": "application/xml text/xml application/rss+xml application/atom+xml application/soap+xml",
    "code": "text/x-rust text/x-c text/x-c++ text/x-java text/x-python text/x-shellscript text/x-ruby text/x-php text/x-go text/x-kotlin text/x-scala text/x-sql text/x-swift text/x-lua text/x-typescript"
    " text/javascript text/x-csrc application/javascript application/x-javascript application/typescript application/x-sh",
}
TYPE_LANGUAGES = {
    "rust": "text/x-rust", "c": "text/x-c text/x-csrc", "c++": "text/x-c++", "java": "text/x-java", "python": "text/x-python", "bash": "text/x-shellscript application/x-sh", "ruby": "text/x-ruby", "php": "text/x-php",
    "go": "text/x-go", "kotlin": "text/x-kotlin", "scala": "text/x-scala", "sql": "text/x-sql", "swift": "text/x-swift", "lua": "text/x-lua", "typescript": "text/x-typescript application/typescript",
    "javascript": "text/javascript application/javascript application/x-javascript", "yaml": "text/x-yaml text/yaml application/x-yaml application/yaml", "toml": "text/toml application/toml", "json": "application/json application/ld+json",
}
ENDINGS = {
    "code": "rs py js ts tsx jsx go c h cpp cc cxx hpp java kt kts scala sh bash zsh fish sql html htm css scss less lua rb php swift m mm r dart ex exs erl hs ml fs clj vim el lisp",
    "json": "json jsonl geojson ndjson", "toml": "toml", "yaml": "yaml yml", "diff": "diff patch", "markdown": "md mdx markdown mkd", "notebook": "ipynb", "csv": "csv tsv", "xml": "xml rss atom", "asciidoc": "adoc asciidoc", "rst": "rst", "pdf": "pdf",
}
ENDING_LANGUAGES = {
    "rust": "rs", "python": "py", "javascript": "js jsx", "typescript": "ts tsx", "go": "go", "c": "c h", "c++": "cpp cc cxx hpp", "java": "java", "kotlin": "kt kts", "scala": "scala", "bash": "sh bash zsh fish", "sql": "sql", "html": "html htm",
    "css": "css scss less", "lua": "lua", "ruby": "rb", "php": "php", "swift": "swift", "r": "r", "dart": "dart", "elixir": "ex exs", "erlang": "erl", "haskell": "hs", "ocaml": "ml", "json": "json jsonl geojson ndjson", "toml": "toml", "yaml": "yaml yml",
    "markdown": "md mdx markdown mkd", "xml": "xml", "diff": "diff patch",
}
BY_LINES = "code json toml yaml diff markdown".split()
#: Lines that look like code; two of them make a text code. Only the head of a body is looked at.
SIGNS = [r"^(use |import |from .*import|require\(|include!)", r"^(fn |func |def |function |pub fn |async fn )", r"^(struct |class |pub struct |enum |trait |interface )"]
HEAD, HEAD_LINES = 8192, 200
CELLS, TABLE_ROWS = 200, 100


def _of(table: dict[str, str], key: Column) -> Column:
    names = F.create_map(*[F.lit(x) for value, keys in table.items() for k in keys.split() for x in (k, value)])
    return F.try_element_at(names, key)


def _fits(pattern: str):
    return lambda x: x.rlike(pattern)


def code_language(body: Column) -> Column:
    """The language that the head of a text looks like, 'code' for code of no known one, null for prose:
    what the first line names as its interpreter, else what two lines or more give away."""
    head = F.substring(body, 1, HEAD)
    lines = F.transform(F.slice(F.split(head, r"\r?\n"), 1, HEAD_LINES), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    first = F.get(lines, 0)
    has = lambda s: F.contains(head, F.lit(s))
    named = F.when(first.contains("python"), "python").when(first.rlike("node|bash|sh"), "bash").when(first.contains("ruby"), "ruby").when(first.contains("perl"), "perl").when(first.contains("env"), F.get(F.split(first, r"\s+"), 2))
    signs = sum((F.size(F.filter(lines, _fits(s))) for s in SIGNS), F.lit(0))
    looks = (
        F.when(has("fn main()") | (has("fn ") & has("-> ") & has("Option<")), "rust")
        .when(has("def ") & has(":") & (has("self") | has("__init__")), "python")
        .when(has("func ") & has(":="), "go")
        .when(has("class ") & has("extends"), "typescript")
        .when(has("public class ") | has("private "), "java")
        .otherwise("code")
    )
    return F.coalesce(F.when(first.startswith("#!"), named), F.when(signs >= 2, looks))


def kind(content_type: Column, url: Column, body: Column) -> Column:
    """struct(kind, language, by_lines) of a body: by the bytes that open a PDF, then by its content
    type, the ending of its address, and what its head looks like. Any column may be null."""
    base = F.trim(F.lower(F.substring_index(content_type, ";", 1)))
    by_type = F.coalesce(_of(TYPES, base), F.when(base.endswith("+json"), "json"))
    type_language = F.coalesce(_of(TYPE_LANGUAGES, base), F.when(base.rlike(r"\+(json|yaml|toml)$"), F.regexp_extract(base, r"\+(\w+)$", 1)))
    ending = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*?([^.?#]*)(?:[?#].*)?$", 1))
    by_ending, looks = _of(ENDINGS, ending), code_language(body)
    pdf = F.coalesce(body.startswith("%PDF-"), F.lit(False))
    found = F.when(pdf, "pdf").otherwise(F.coalesce(by_type, by_ending, F.when(looks.isNotNull(), "code"), F.lit("plain_text")))
    language = F.when(~pdf, F.when(by_type.isNotNull(), type_language).when(by_ending.isNotNull(), _of(ENDING_LANGUAGES, ending)).otherwise(looks))
    return F.struct(found.alias("kind"), language.alias("language"), found.isin(BY_LINES).alias("by_lines"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """doc_id, pos, path, hunk, change (added, removed, kept), old_line, new_line, text: the lines of the
    hunks of unified diffs. diffs: doc_id (unique), text.

    pos counts lines of the diff from 0, hunks from 1 within it. A hunk runs from its header until both
    counts of the header are used up, so lines that look like headers inside it are content, and what
    stands between hunks is not. Its path is the new one, or the old one of a file that went. A hunk that is
    cut short ends with the text; '\\ No newline' notes and broken headers have no lines. All is one sort of
    the lines of each diff, with running sums that Spark spills."""
    header = r"^@@ -(\d{1,9})(?:,(\d{1,9}))? \+(\d{1,9})(?:,(\d{1,9}))? @@"
    line = diffs.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    part = lambda k: F.regexp_extract("line", header, k)
    count = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).cast("int"), F.lit(1))
    head = F.when(F.col("line").rlike(header), F.struct(part(1).cast("int").alias("old"), count(2).alias("olds"), part(3).cast("int").alias("new"), count(4).alias("news"), F.col("pos").alias("at")))
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    upto = by_pos.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.substring("line", 1, 1)
    row = line.withColumns({"head": F.last(head, ignorenulls=True).over(upto), "mark": F.when(F.col("line") == "", " ").otherwise(mark), "opens": head.isNotNull()})
    inside = Window.partitionBy("doc_id", "head.at").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    used = lambda marks: F.coalesce(F.sum(F.when(~F.col("opens") & F.col("mark").isin(marks), 1).otherwise(0)).over(inside), F.lit(0))
    row = row.withColumns({"old_used": used([" ", "-"]), "new_used": used([" ", "+"])})
    left = (F.col("old_used") < F.col("head.olds")) | (F.col("new_used") < F.col("head.news"))
    row = row.withColumn("held", F.coalesce(~F.col("opens") & left, F.lit(False)))
    name = F.when(~F.col("held"), F.regexp_replace(F.regexp_extract("line", r"^(?:\+\+\+|---) ([^\t]*)", 1), "^[ab]/", ""))
    kept = lambda sign: F.last(F.when(F.col("line").startswith(sign) & ~F.col("held"), F.nullif(name, F.lit(""))), ignorenulls=True).over(upto)
    row = row.withColumns({"was": kept("--- "), "now": kept("+++ "), "hunk": F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(upto)})
    change = F.when(F.col("mark") == "+", "added").when(F.col("mark") == "-", "removed").when(F.col("mark") == " ", "kept")
    return row.filter("held").withColumn("change", change).filter("change IS NOT NULL").select(
        "doc_id", "pos", F.when(F.col("now") == "/dev/null", F.col("was")).otherwise(F.col("now")).alias("path"), F.col("hunk").cast("int").alias("hunk"), "change",
        F.when(F.col("mark") != "+", F.col("head.old") + F.col("old_used")).cast("int").alias("old_line"), F.when(F.col("mark") != "-", F.col("head.new") + F.col("new_used")).cast("int").alias("new_line"),
        F.expr("substring(line, 2)").alias("text"),
    )


def notebook_cells(notebooks: DataFrame, most: int = CELLS) -> DataFrame:
    """doc_id, cell, kind, language, text: the cells of notebooks that have a source, counted from 1 before
    empty ones are left out; the first ``most`` of each are read. notebooks: doc_id, text.

    A source is a list of lines; one that is a single text counts as none, as the rules have it. A text that
    is no JSON, or has no list of cells, is one block of raw text without a number. Null has no blocks."""
    cells = F.from_json(F.get_json_object("text", "$.cells"), "array<struct<cell_type: string, source: string>>")
    listed = F.when(F.ltrim(F.get_json_object("text", "$.cells")).startswith("["), cells)
    row = notebooks.filter("text IS NOT NULL").select("doc_id", "text", listed.alias("cells"))
    each = row.select("doc_id", F.posexplode(F.slice("cells", 1, most)).alias("i", "c")).withColumns({"cell": F.col("i") + 1, "type": F.coalesce("c.cell_type", F.lit("unknown")), "said": F.array_join(F.from_json("c.source", "array<string>"), "")})
    shown = F.concat(F.lit("[cell "), F.col("cell").cast("string"), F.lit(" ("), F.col("type"), F.lit(")]\n"), F.col("said"))
    found = F.when(F.col("type") == "markdown", "paragraph").when(F.col("type") == "code", "code").otherwise("raw_text")
    read = each.filter(F.trim(F.regexp_replace("said", r"\s+", " ")) != "").select("doc_id", "cell", found.alias("kind"), F.when(F.col("type") == "code", "python").alias("language"), shown.alias("text"))
    null = lambda t: F.lit(None).cast(t)
    return read.unionByName(row.filter("cells IS NULL").select("doc_id", null("int").alias("cell"), F.lit("raw_text").alias("kind"), null("string").alias("language"), "text"))


def table_previews(tables: DataFrame, most: int = TABLE_ROWS) -> DataFrame:
    """doc_id, line, n_columns, n_rows, text: the first ``most`` lines of comma or tab separated texts with
    their numbers in front. The header tells the delimiter (a tab, if it has one) and the number of columns;
    delimiters in quotes do not count. n_rows is null for longer texts. tables: doc_id, text."""
    lines = F.split(F.regexp_replace("text", r"\r?\n$", ""), r"\r?\n")
    head = F.regexp_replace(F.get(F.col("lines"), 0), r'"[^"]*(?:"|$)', "")
    tab = F.contains(F.get(F.col("lines"), 0), F.lit("\t"))
    n = 1 + F.when(tab, F.length(head) - F.length(F.replace(head, F.lit("\t"), F.lit("")))).otherwise(F.length(head) - F.length(F.replace(head, F.lit(","), F.lit(""))))
    row = tables.filter("text <> ''").select("doc_id", lines.alias("lines")).withColumns({"n_columns": n, "n_rows": F.when(F.size("lines") <= most, F.size("lines"))})
    each = row.select("doc_id", "n_columns", "n_rows", F.posexplode(F.slice("lines", 1, most)).alias("i", "line"))
    shown = F.concat(F.lit(" "), F.lpad((F.col("i") + 1).cast("string"), F.greatest(F.lit(3), F.length((F.col("i") + 1).cast("string"))), " "), F.lit(" | "), F.col("line"))
    return each.select("doc_id", (F.col("i") + 1).alias("line"), "n_columns", "n_rows", F.when(F.col("i") == 0, F.concat(F.lit("  1 | "), F.col("line"))).otherwise(shown).alias("text"))


def paragraphs(texts: DataFrame) -> DataFrame:
    """doc_id, first, last, text: paragraphs of plain text, apart by blank lines, with the lines (from 1)
    they stand on; lines keep their indentation. texts: doc_id (unique), text. Null and blank texts have none."""
    line = texts.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).withColumn("blank", F.regexp_replace("line", r"\s+", "") == "")
    by_pos = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    told = line.withColumn("after", F.sum(F.when(F.col("blank"), 1).otherwise(0)).over(by_pos)).filter("NOT blank")
    held = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return told.groupBy("doc_id", "after").agg((F.min("pos") + 1).alias("first"), (F.max("pos") + 1).alias("last"), F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("text")).drop("after")
