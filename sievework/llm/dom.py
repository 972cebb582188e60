"""Leaf blocks of an HTML page: one linear pass over its tags, with a stack of open elements.

A block is the text between two block-level tags. Inline tags and line breaks do not end
one; scripts, styles, templates and comments give no text, while svg, noscript and iframe
are elements like any other. Character references are
decoded, white space inside a block becomes one space, and blocks without text are none.
Broken markup never raises: an unknown end tag is passed over, open elements end with the
page.
"""

from __future__ import annotations

import re
from html import unescape

from sievework.llm import common

common.by_value(__name__)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these, down to the nearest of the stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}


def blocks(html: str | None) -> list[tuple[str, tuple, int]]:
    """(text, ancestors, characters inside links) in page order; an ancestor is (tag, name words)."""
    out: list[tuple[str, tuple, int]] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    linked: list[str] = []
    links = 0

    def flush():
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append((text, tuple(x for x in stack if x[0] not in ("html", "body")), len(" ".join(unescape("".join(linked)).split()))))
        parts.clear()
        linked.clear()

    def close(names, stops=frozenset()):
        nonlocal links
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                links -= sum(x[0] == "a" for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in stops:
                return

    def add(text):
        if text:
            parts.append(text)
            if links:
                linked.append(text)

    html, at = html or "", 0
    for m in TAG.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag, ending, attrs = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            add(" ")
        if ending:
            close((tag,))
            continue
        if tag in ENDS:
            close(*ENDS[tag])
        elif tag in BLOCKS:
            close(("p",), BLOCKS - {"p"})
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        names = tuple(NAME.findall(" ".join(a or b or c for a, b, c in ATTR.findall(attrs)).lower())) if "=" in attrs else ()
        links += tag == "a"
        stack.append((tag, names))
    add(html[at:])
    flush()
    return out
