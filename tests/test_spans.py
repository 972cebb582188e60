"""Spans of code against a plain scan of each file, over all families of languages."""

import random
import re

from pyspark.sql import functions as F

from sievework.operators import spans

FILES = "file long, language string, content string"
ASKED = "request string, file long, symbol string, text string, first int, last int, expand boolean, most int"


def indent(line):
    lead = re.match("[ \t]*", line)[0]
    return lead.count(" ") + 4 * lead.count("\t")


def brackets(lines, at):
    """The block about a line, by counting outwards from it."""
    depth, start = 0, at
    for i in range(at, -1, -1):
        for ch in reversed(lines[i]):
            depth += (ch == "}") - (ch == "{")
            if depth < 0:
                break
        if depth < 0:
            start = i
            break
    depth = 0
    for i in range(start, len(lines)):
        for ch in lines[i]:
            depth += (ch == "{") - (ch == "}")
            if ch == "}" and depth == 0:
                return start, i
        if depth == 0:
            return start, start
    return start, len(lines) - 1


def indented(lines, at):
    base, start = indent(lines[at]), at
    is_deco = lambda i: lines[i].strip()[:1] in ("@", "#") and lines[i].strip() != ""
    for i in range(at - 1, -1, -1):
        if not lines[i].strip():
            continue
        if is_deco(i):
            start = i
        elif indent(lines[i]) <= base:
            start = i if indent(lines[i]) == base and lines[i].strip().startswith(("def ", "async ", "class ")) else i + 1
            break
    while start and is_deco(start - 1):
        start -= 1
    end = at
    for i in range(at + 1, len(lines)):
        if lines[i].strip():
            if indent(lines[i]) <= base:
                break
            end = i
    return start, end


def headed(lines, at):
    level = lambda x: len(m[1]) if (m := re.match(r"(#{1,6})\s+", x)) else None
    mine = level(lines[at]) or 6
    after = [i for i in range(at + 1, len(lines)) if (level(lines[i]) or 9) <= mine]
    return at, (after[0] - 1 if after else len(lines) - 1)


def tabled(lines, at):
    heads = [i for i, x in enumerate(lines) if re.match(r"\[[^\]]+\]", x.strip())]
    start = max((i for i in heads if i <= at), default=at)
    end = min((i for i in heads if i > start), default=len(lines)) - 1
    while end > start and not lines[end].strip():
        end -= 1
    return start, end


def keyed(lines, at):
    own, start = indent(lines[at]), at
    for i in range(at - 1, -1, -1):
        if lines[i].strip() and indent(lines[i]) <= own:
            start = i if indent(lines[i]) < own else i + 1
            break
    base, end = indent(lines[start]), start
    for i in range(start + 1, len(lines)):
        if lines[i].strip():
            if indent(lines[i]) <= base:
                break
            end = i
    return start, end


def stated(lines, at):
    if any(c in x for x in lines for c in "{}"):
        return brackets(lines, at)
    start = at
    while start and lines[start - 1].strip() and lines[start - 1].strip()[-1] not in ";{}":
        start -= 1
    if lines[at].strip()[-1:] == ";":
        return start, at
    for i in range(at + 1, len(lines)):
        x = lines[i].strip()
        if x.endswith(";") or x in ("{", "}"):
            return start, i
        if not x:
            return start, i - 1
    return start, len(lines) - 1


def attributed(lines, at):
    start, end = brackets(lines, at)
    while start and lines[start - 1].strip().startswith(("#[", "#![", "///", "//!")):
        start -= 1
    return start, end


BLOCKS = {"rust": attributed, "py": indented, "ts": stated, "Go": brackets, "java": brackets, "md": headed, "toml": tabled, "yml": keyed, None: brackets, "json": brackets}


def random_file(rnd, language):
    pieces = {
        "rust": ["#[test]", "/// doc", "fn f() {", "  }", "}", "  let x = 1;", "", "if a { b } else {", "// }", "{{", "} }"],
        "py": ["@deco", "# note", "def f():", "    x = 1", "  y", "", "class A:", "\tz", "async def g():"],
        "md": ["# one", "## two", "text", "", "### three", "#none"],
        "toml": ["[a]", "[[b]]", "x = 1", "", "  [c.d]", "y = [1]"],
        "yml": ["a:", "  b: 1", "    c:", "", "  d:", "e: 2", "      f: 3"],
        "ts": ["const f = x =>", "  x + 1;", "", "y", "z;"] + (["{", "}", "if (a) {"] if rnd.random() < 0.5 else []),
    }
    words = pieces.get(language, ["func f() {", "}", "x", "", "{ a }", "} else {"])
    return [rnd.choice(words) for _ in range(rnd.randint(1, 25))]


def test_blocks_against_a_plain_scan(spark):
    rnd = random.Random(26)
    files, asked, want = [], [], {}
    for k in range(200):
        language = rnd.choice(list(BLOCKS))
        held = random_file(rnd, language)
        end = rnd.choice(["\n", "\r\n"])
        files.append((k, language, end.join(held) + rnd.choice(["", end])))
        lines = files[-1][2].replace("\r\n", "\n").removesuffix("\n").split("\n")
        for j in range(4):
            at, most = rnd.randint(0, len(lines) - 1), rnd.choice([None, 1, 3, 0])
            asked.append((f"{k}-{j}", k, None, None, at + 1, at + 1, True, most))
            start, stop = BLOCKS[language](lines, at)
            cut = most is not None and stop - start + 1 > most
            want[f"{k}-{j}"] = (start + 1, start + max(most, 1) if cut else stop + 1, cut)
    got = spans.spans(spark.createDataFrame(files, FILES).filter("content <> ''"), spark.createDataFrame(asked, ASKED)).collect()
    empty = {f for f, _, c in files if not c}
    assert {r.request: (r["first"], r["last"], r.cut) for r in got} == {k: v for k, v in want.items() if int(k.split("-")[0]) not in empty}


DEFINED = [
    ("rust", "pub(crate) async fn run<T>(x: T) {", "run", "function", "exact"), ("rust", "impl<T> dyn Shape for X {", "Shape", "struct", "strong"), ("rs", "macro_rules! all {", "all", "macro", "strong"), ("rust", "// fn gone() {", "gone", None, None),
    ("rust", "pub static MAX: u8 = 1;", "MAX", "constant", "strong"), ("python", "class A(B):", "A", "class", "exact"), ("ts", "export type Key = string", "Key", "type_alias", "strong"), ("js", "let go = async (x) => x", "go", "function", "strong"),
    ("go", "func (s *S) Do() {", "Do", "function", "exact"), ("kotlin", "public static class K {", "K", "class", "strong"), ("cpp", "typedef struct node {", "node", "struct", "weak"), ("rust", "fn Foo() {", "foo", None, None), ("md", "# fn x", "x", None, None),
]


def test_definitions(spark):
    files = spark.createDataFrame([(k, c[0], f"first\n{c[1]}\n  body\n}}\n") for k, c in enumerate(DEFINED)], FILES)
    asked = spark.createDataFrame([(str(k), k, c[2], None, None, None, True, None) for k, c in enumerate(DEFINED)], ASKED)
    got = {r.request: (r.symbol_kind, r.confidence, r["first"]) for r in spans.spans(files, asked).collect()}
    assert got == {str(k): (kind, confidence, 2) for k, (*_, kind, confidence) in enumerate(DEFINED) if kind}


def test_what_is_asked_for(spark):
    text = "\n".join(f"line {k}" for k in range(1, 51))
    files = spark.createDataFrame([(1, None, text), (2, "rust", ""), (3, "rust", None)], FILES)
    rows = [
        ("a", 1, None, None, 0, 900, False, None), ("b", 1, None, "LINE 20", None, None, True, None), ("c", 1, "none", "line 2", None, None, True, 4), ("d", 1, None, None, None, None, False, 7), ("e", 1, "none", None, None, None, True, None),
        ("f", 1, None, "nowhere", None, None, True, None), ("g", 2, None, None, None, None, False, None), ("h", 3, None, None, 1, 2, False, None), ("i", 9, None, None, 1, 2, False, None), ("j", 1, None, None, 2**31 - 1, 2**31 - 1, False, None), ("k", 1, None, None, 7, None, False, None),
    ]
    got = {r.request: (r.selection, r["first"], r["last"], r.cut) for r in spans.spans(files, spark.createDataFrame(rows, ASKED)).collect()}
    assert got == {
        "a": ("explicit_range", 1, 50, False), "b": ("match_text", 15, 25, False), "c": ("match_text", 1, 4, False), "d": ("whole_file", 1, 7, True), "j": ("explicit_range", 50, 50, False), "k": ("whole_file", 1, 50, False),
    }


def test_tree_knows_strings_and_comments(spark):
    code = {
        "rust": 'fn a() { // {\n  let s = "{ \\" {"; /* {\n { */ if b {\n  c(\'{\');\n  }\n}\nfn d<\'a>() {}\n}\nmod m {',
        "go": "func a() {\n s := `{\n{`\n}\n",
        "python": 'x = {"{": """{\n}"""}\ny = \'{\' # }',
    }
    files = spark.createDataFrame([(k, lang, c) for k, (lang, c) in enumerate(code.items())], FILES)
    got = spans.block_tree(files).orderBy("file", "block").collect()
    shown = [(r.file, r["first"], r["last"], r.depth) for r in got]
    assert shown == [(0, 1, 6, 1), (0, 3, 5, 2), (0, 7, 7, 1), (0, 9, 9, 0), (1, 1, 4, 1), (2, 1, 2, 1)]
    assert [r.parent is not None for r in got] == [False, True, False, False, False, False]
    assert spans.block_tree(files, literals=True).filter("file = 1").count() == 3
    long = spark.createDataFrame([(1, "rust", "fn a() {\n" + '"' + "\\\"{" * 100_000 + '"\n}')], FILES)
    assert [(r["first"], r["last"]) for r in spans.block_tree(long).collect()] == [(1, 3)]
    assert spans.block_tree(files.filter(F.lit(False))).count() == 0
