"""HTML main-text extraction by a linear-chain conditional random field.

A page is a sequence of leaf blocks; each is text of the article or not. Features of a
block are the tags and the class, id and role words of its ancestors, and its text: length,
share of letters in links, end marks, notices' signs, and what its neighbours are. Two
labels, weights for features and for label pairs are trained by gradient ascent on the
conditional likelihood of labelled pages, and a page is decoded by Viterbi.

The labelled pages are laid out by ``labelled_pages``: menus, headers, notices, adverts,
sidebars, forms and comments around, and some inside, articles under many names, so that
the label of each block is known. Training runs once for each query in the driver, on
those pages alone, always with the same result. Pages are read once and not shuffled.

Cases: a null or empty page, or one without text, has an empty text; so has a page of
which no block is the article's. Repeated rows are extracted each. Columns that clash with
the result's are replaced, others kept. Very long pages cost time in proportion.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import common
from sievework.llm.dom import blocks

common.by_value(__name__)

HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())


def features(page: list[tuple[str, tuple, int]]) -> list[list[str]]:
    """Names of the features of each block."""
    own = []
    for text, path, linked in page:
        f = {"bias"}
        for tag, names in path:
            f.add(f"<{tag}>")
            f.update(f".{n}" for n in names)
        f.add(f"leaf:{path[-1][0] if path else ''}")
        n = text.count(" ") + 1
        f.add(f"words:{min(7, n.bit_length())}")
        f.add(f"links:{min(4, linked * 5 // max(1, len(text)))}")
        f.add(f"end:{text[-1] in '.!?:;'}")
        if text[0] in "©®" or "©" in text[:12] or "copyright" in text[:24].lower():
            f.add("sign")
        own.append(f)
    out = []
    for i, f in enumerate(own):
        path = page[i][1]
        near = {f"{where}:{kind}" for j, where in ((i - 1, "before"), (i + 1, "after")) for kind in [_kind(page, j)]}
        same = i > 0 and page[i - 1][1][:-1] == path[:-1]
        out.append(sorted(f | near | {f"same:{same}"}))
    return out


def _kind(page, j) -> str:
    if not 0 <= j < len(page):
        return "none"
    path = page[j][1]
    tag = path[-1][0] if path else ""
    return "head" if tag in HEADS else "long" if page[j][0].count(" ") > 12 else "short"


def labelled_pages(n: int, seed: int = 1) -> list[list[tuple[str, bool]]]:
    """n pages as lists of (html, article text or not); the pieces of a page make up its html."""
    rnd = random.Random(seed)
    vowels, others = "aeiouéöñ", "bcdfglmnprstvwz"

    def word():
        return "".join(rnd.choice(others) + rnd.choice(vowels) for _ in range(rnd.randint(1, 4)))

    def words(a, b):
        junk = rnd.choice(["", "", "", "", "###", "!!", "%%%", " |"])
        return " ".join(word() + (junk if rnd.random() < 0.9 else "") for _ in range(rnd.randint(a, b)))

    def sentence(a=3, b=25):
        return words(a, b).capitalize() + rnd.choice([".", ".", ".", "!", "?", ""])

    def prose():
        return " ".join(sentence() for _ in range(rnd.choice([1, 1, 2, 4, 8])))

    def pick(*xs):
        return rnd.choice(xs)

    def around(tag_and_name: str, pieces: list[tuple[str, bool]]):
        tag = tag_and_name.split()[0]
        return [(f"<{tag_and_name}>", False), *pieces, (f"</{tag}>", False)]

    def menu():
        kind = pick("nav", "nav", 'nav class="menu"', 'div class="menu"', 'div id="navigation"', 'ul class="nav"', 'div class="breadcrumbs"', 'div role="navigation"')
        items = [(f'<li><a href="/{word()}">{words(1, 3)}</a></li>', False) for _ in range(rnd.randint(2, 9))]
        return around(kind, [("<ul>", False), *items, ("</ul>", False)])

    def box(kind: str, texts: int):
        tags = [pick("p", "div", "span", "h3", "li") for _ in range(texts)]
        return around(kind, [(f"<{t}>{pick(prose, sentence)()}</{t}>", False) for t in tags])

    def advert():
        return box(pick('div class="ad"', 'div class="ads"', 'div class="advert"', 'div id="banner"', 'div class="promo"', 'div class="sponsored"', 'aside class="ad"'), rnd.randint(1, 2))

    def notice():
        return box(pick('div class="cookie notice"', 'div id="cookie-banner"', 'div class="notice"', 'div class="consent"', 'div class="alert"', 'div role="alert"', 'div class="newsletter"'), rnd.randint(1, 2))

    def sidebar():
        return box(pick("aside", "aside", "aside", 'aside class="sidebar"', 'div id="sidebar"', 'div class="related"', 'section class="related"', 'div class="share"', 'div class="widget"'), rnd.randint(1, 5))

    def form():
        return around(pick("form", 'form class="search"', 'form id="subscribe"'), [(f"<label>{words(1, 3)}</label>", False), (f"<p>{sentence()}</p>", False), (f"<button>{words(1, 2)}</button>", False)])

    def comments():
        one = [(f"<{t}>{pick(prose, sentence)()}</{t}>", False) for t in (pick("p", "div", "li", "p") for _ in range(rnd.randint(1, 6)))]
        return around(pick('section class="comments"', 'div id="comments"', 'ol class="commentlist"', 'div class="comment"', 'section id="discussion"', 'div class="replies"'), [(f"<h3>{words(1, 3)}</h3>", False), *one])

    def header():
        return around(pick("header", 'div id="header"', 'div class="masthead"', 'header class="site"', 'div class="topbar"'), [(f"<{t}>{words(1, 6)}</{t}>", False) for t in (pick("h1", "p", "div", "span") for _ in range(rnd.randint(1, 2)))])

    def footer():
        text = pick("&copy; ", "&copy; ", "© 2020 ", "Copyright ", "") + f"www.{word()}.com &middot; {prose()}"
        return around(pick("footer", "footer", 'div id="footer"', 'div class="footer"', 'div class="copyright"'), [(text if rnd.random() < 0.5 else f"<p>{text}</p>", False)])

    def article():
        kind = pick("article", "article", "article", "main", 'div class="article"', 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry"', 'section class="story"', 'div class="body"', 'div role="main"', "div")
        inner: list[tuple[str, bool]] = [(f"<h1>{words(1, 9).capitalize()}</h1>", True)] if rnd.random() < 0.85 else []
        for _ in range(pick(1, 1, 2, 3, 5, 9)):
            x = rnd.random()
            if x < 0.7:
                inner.append((pick(f"<p>{prose()}</p>", f"<p><b>{prose()}<br>", f"<p>{sentence(1, 4)}</p>", f"<p>{words(1, 1)}.</p>", f'<p>{prose()} <a href="/{word()}">{words(1, 4)}</a> {prose()}</p>', f"<div>{prose()}</div>"), True))
            elif x < 0.85:
                inner += [(f"<{t}>{sentence()}</{t}>", True) for t in [pick("h2", "h3", "blockquote", "pre", "figcaption")]]
            elif x < 0.93:
                inner += [("<ul>", False), *[(f"<li>{sentence()}</li>", True) for _ in range(rnd.randint(1, 5))], ("</ul>", False)]
            else:
                inner += [("<table>", False), *[(f"<tr><td>{words(1, 5)}</td></tr>", True) for _ in range(rnd.randint(1, 4))], ("</table>", False)]
            if rnd.random() < 0.2:
                inner += pick(advert, sidebar, sidebar, form, notice, menu, comments)()
        if rnd.random() < 0.15:
            inner += pick(comments, footer)()
        return around(kind, inner)

    pages = []
    for _ in range(n):
        page = [("<html><head><title>", False), (words(2, 8), False), ("</title></head><body>", False)]
        for part, chance in ((notice, 0.25), (header, 0.35), (menu, 0.8), (advert, 0.5), (sidebar, 0.2)):
            if rnd.random() < chance:
                page += part()
        wrap = rnd.random() < 0.25
        page += around('div class="container"', article()) if wrap else article()
        for part, chance in ((comments, 0.35), (sidebar, 0.25), (advert, 0.15), (form, 0.25), (menu, 0.15), (notice, 0.15), (footer, 0.8)):
            if rnd.random() < chance:
                page += part()
        pages.append(page)
    return pages


MARK = "\ue000"  # a private character: no text has it


def sequences(pages: list[list[tuple[str, bool]]]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the blocks; a mark in the article's pieces carries the label through the parser."""
    out = []
    for page in pages:
        found = blocks("".join(h.replace(">", f">{MARK}", 1) if keep else h for h, keep in page))
        labels = [int(MARK in t) for t, _, _ in found]
        clean = [(t.replace(MARK, "").strip() or "x", p, n) for t, p, n in found]
        out.append((features(clean), labels))
    return out


def train(pages: int = 600, rounds: int = 250, seed: int = 1) -> dict:
    """{"w": feature -> weight for the article, "t": label pair weights}."""
    import numpy as np

    data = sequences(labelled_pages(pages, seed))
    counts: dict[str, int] = {}
    for fs, _ in data:
        for f in fs:
            for x in f:
                counts[x] = counts.get(x, 0) + 1
    index = {x: k for k, x in enumerate(sorted(x for x, n in counts.items() if n >= 3))}
    longest = max(len(y) for _, y in data)
    x = np.zeros((len(data), longest, len(index)), dtype=np.float32)
    y = np.zeros((len(data), longest), dtype=int)
    on = np.zeros((len(data), longest), dtype=bool)
    for i, (fs, labels) in enumerate(data):
        on[i, : len(labels)] = True
        y[i, : len(labels)] = labels
        for j, f in enumerate(fs):
            x[i, j, [index[n] for n in f if n in index]] = 1
    w, t = np.zeros(len(index), dtype=np.float32), np.zeros((2, 2))
    mean = [np.zeros_like(w), np.zeros_like(t)]
    square = [np.zeros_like(w), np.zeros_like(t)]
    pair = on[:, 1:]
    seen = np.array([[(pair & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    total = on.sum()
    xs = x[on]
    score = np.zeros(on.shape, dtype=np.float32)
    for k in range(1, rounds + 1):
        score[on] = xs @ w
        s = np.stack([np.zeros(on.shape), score], axis=2)
        fwd = np.zeros_like(s)
        fwd[:, 0] = s[:, 0]
        for j in range(1, longest):
            step = np.logaddexp(fwd[:, j - 1, :1] + t[:1], fwd[:, j - 1, 1:] + t[1:]) + s[:, j]
            fwd[:, j] = np.where(on[:, j, None], step, fwd[:, j - 1])
        bwd = np.zeros_like(s)
        both = np.zeros((2, 2))
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        for j in range(longest - 1, 0, -1):
            ahead = (s[:, j] + bwd[:, j])[:, None, :] + t
            p = np.exp(fwd[:, j - 1, :, None] + ahead - z[:, None, None]) * on[:, j, None, None]
            both += p.sum(axis=0)
            bwd[:, j - 1] = np.where(on[:, j, None], np.logaddexp(ahead[..., 0], ahead[..., 1]), bwd[:, j])
        p1 = np.exp(fwd[..., 1] + bwd[..., 1] - z[:, None]) * on
        gw = (y - p1)[on].astype(np.float32) @ xs / total - 1e-4 * w
        gt = (seen - both) / total - 1e-4 * t
        for v, g, m, q in ((w, gw, mean[0], square[0]), (t, gt, mean[1], square[1])):
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            v += 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(q / (1 - 0.99**k)) + 1e-8)
    return {"w": {n: float(w[i]) for n, i in index.items()}, "t": t.tolist()}


def viterbi(scores: list[float], t: list[list[float]]) -> list[int]:
    """The best labels, for scores of label 1 against 0."""
    if not scores:
        return []
    a, b, back = 0.0, scores[0], []
    for s in scores[1:]:
        from0, from1 = a + t[0][0] >= b + t[1][0], a + t[0][1] >= b + t[1][1]
        back.append((0 if from0 else 1, 0 if from1 else 1))
        a, b = (a + t[0][0] if from0 else b + t[1][0]), (a + t[0][1] if from1 else b + t[1][1]) + s
    out = [int(b > a)]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


def main_text(html: str | None, model: dict) -> str:
    page = blocks(html)
    w = model["w"]
    labels = viterbi([sum(w.get(n, 0.0) for n in f) for f in features(page)], model["t"])
    return "\n\n".join(text for (text, _, _), keep in zip(page, labels, strict=True) if keep)


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """pages plus text and n_chars."""
    common.small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model or train())

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, held.value) for h in html], dtype=object)

    kept = [c for c in pages.columns if c.lower() not in {"text", "n_chars"}]
    out = pages.select(*[F.col(f"`{c}`") for c in kept], text_of("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
