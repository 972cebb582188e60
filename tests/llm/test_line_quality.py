"""Quality rules on lines: against SQL, a plain count and the odd cases."""

import random
import re
from collections import Counter

from sievework.llm import line_quality

from oracle import same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, Kept string, n_words string"


def plain(rows, many, share):
    """(doc_id, n_words, repeated words, lines removed, words removed, kept text) of rows (doc_id, text, source)."""
    norm = lambda x: " ".join(re.sub("[0-9]+", "0", x.lower()).split())
    lines = {(s, t or ""): [norm(x) for x in (t or "").split("\n")] for _, t, s in rows}
    docs = Counter((s, x) for (s, _), own in lines.items() for x in set(own) if x)
    hosts = Counter(s for s, _ in lines)
    gone = {k for k, n in docs.items() if n > many and n > hosts[k[0]] * share}
    for i, t, s in rows:
        raw, own = (t or "").split("\n"), lines[(s, t or "")]
        w, hit = (t or "").split(), set()
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        for k in range(len(w) - 4):
            if seen[tuple(w[k : k + 5])] > 1:
                hit |= set(range(k, k + 5))
        off = [x for x in own if (s, x) in gone]
        yield i, len(w), len(hit), len(off), sum(len(x.split()) for x in off), "\n".join(r for r, x in zip(raw, own, strict=True) if (s, x) not in gone)


def test_against_sql(spark):
    same(spark, SF, line_quality.query, line_quality.SQL)


def test_lines_of_many_documents(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    line = lambda n: " ".join(word() for _ in range(n))
    menu, rows = "Home  | About | page 12", []
    for k in range(60):
        body = "\n".join(line(12) for _ in range(3))
        rows.append((k, f"{menu.replace('12', str(k))}\n{body}" if k % 2 else body, "h1" if k < 40 else None))
    rows += [(100 + k, rows[0][1], "h1") for k in range(30)]  # copies of a clean text are no boilerplate
    rows += [(200, f"home | ABOUT | Page 7\n{line(3)}", "h1"), (201, None, "h1"), (202, "", None), (203, " \n\t\n", "h1"), (None, line(30), "h2")]
    rows += [(204, "HOME | about | page 9\n" * 50 + line(60_000), "h1"), (205, "same words here again now " * 20, "h3")]
    rows += [(1, rows[1][1], "h1")] * 40  # a repeated row
    docs = spark.createDataFrame([(*r, "old", "x") for r in rows], SCHEMA)
    got = line_quality.judge(docs, many=5, share=0.2)
    assert Counter(c.lower() for c in got.columns)["kept"] == 1
    held = got.collect()
    assert Counter((r.doc_id, r.n_words, r.n_repeat_words, r.n_lines_removed, r.n_words_removed, r.kept_text) for r in held) == Counter(plain(rows, 5, 0.2))
    kept = {r.doc_id: r.kept for r in held}
    assert all(kept[k] for k in [*range(60), *range(100, 130), None, 204])
    assert not any(kept[k] for k in (200, 201, 202, 203, 205))
    bare = line_quality.judge(docs, many=5, share=0.2, texts=False)
    assert "text" not in bare.columns and Counter((r.doc_id, r.kept) for r in bare.collect()) == Counter((r.doc_id, r.kept) for r in held)
    assert line_quality.judge(docs.limit(0)).count() == 0


def test_repeated_words():
    rnd = random.Random(3)
    for n in [*range(14), 300]:
        words = [rnd.choice("ab" if n < 100 else "abcde") for _ in range(n)]
        seen = Counter(tuple(words[k : k + 5]) for k in range(n - 4))
        hit = {p for k in range(n - 4) if seen[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
        assert line_quality.repeated_words(" ".join(words)) == len(hit)
    assert line_quality.repeated_words(None) == 0 and line_quality.repeated_words("a b " * 10) == 10
