"""Substring dedup against a plain computation of chunks, first copies, runs and growth."""

import random
from collections import Counter

from sievework.llm import chunk_dedup


def brute(rows, least=96, reach=chunk_dedup.REACH):
    """(id, text) -> (kept text, bytes removed, runs) over rows with distinct ids or equal texts."""
    table = chunk_dedup.gear()
    data = {(i, t): (t or "").encode() for i, t in rows}
    edges = {k: [0, *chunk_dedup.cuts(d, table)] for k, d in data.items()}
    order = sorted(data, key=lambda k: (k[0] is not None, k[0] or 0))
    first = {}
    for k in order:
        for n, (a, b) in enumerate(zip(edges[k], edges[k][1:], strict=False)):
            first.setdefault(data[k][a:b], (k, n))
    out = {}
    for k in order:
        d, e = data[k], edges[k]
        copy = [first[d[a:b]] != (k, n) for n, (a, b) in enumerate(zip(e, e[1:], strict=False))]
        gone = bytearray(len(d))
        n = 0
        spans = []
        while n < len(copy):
            m = n
            while m < len(copy) and copy[m]:
                m += 1
            if m > n:
                a, b = e[n], e[m]
                (f, p), (g, q) = first[d[e[n] : e[n + 1]]], first[d[e[m - 1] : e[m]]]
                x = edges[f][p]
                before, after = data[f][max(0, x - reach) : x], data[g][edges[g][q + 1] : edges[g][q + 1] + reach]
                for c in reversed(before):
                    if a == 0 or d[a - 1] != c:
                        break
                    a -= 1
                while a < e[n] and d[a] & 0xC0 == 0x80:
                    a += 1
                for c in after:
                    if b == len(d) or d[b] != c:
                        break
                    b += 1
                while e[m] < b < len(d) and d[b] & 0xC0 == 0x80:
                    b -= 1
                if spans and a <= spans[-1][1]:
                    spans[-1] = [min(a, spans[-1][0]), max(b, spans[-1][1])]
                else:
                    spans.append([a, b])
            n = max(m, n + 1)
        spans = [s for s in spans if s[1] - s[0] >= least]
        for a, b in spans:
            gone[a:b] = b"\1" * (b - a)
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g).decode()
        out[k] = (None if k[1] is None else kept, sum(gone), len(spans))
    return Counter((i, *out[(i, t)]) for i, t in rows)


def test_all_rows_equal_brute_force(spark):
    """Shared passages at shifted places, whole copies, repeated rows, nulls, text without spaces, clashing columns."""
    rnd = random.Random(12)
    words = lambda n, a="abcdefgh": " ".join("".join(rnd.choice(a) for _ in range(rnd.randint(1, 8))) for _ in range(n))
    passages = [words(rnd.randint(20, 120)) for _ in range(12)] + [words(80, "αβγδé"), "".join(rnd.choice("xyzXYZ") for _ in range(600))]
    rows = []
    for k in range(120):
        parts = [words(rnd.randint(0, 60)) for _ in range(3)]
        rows.append((k, parts[0] + rnd.choice(["", " ", "\n"]) + rnd.choice(passages) + " " + parts[1] + rnd.choice(passages) + parts[2]))
    rows += [(200, rows[3][1]), (200, rows[3][1]), (201, rows[4][1] + "!"), (202, None), (203, ""), (None, passages[0] + " end"), (204, "la " * 4000), (205, "la " * 4000)]
    docs = spark.createDataFrame([(i, t, "old", -1) for i, t in rows], "doc_id long, text string, KEPT_text string, n_spans int")
    got = chunk_dedup.dedup(docs)
    assert sorted(c.lower() for c in got.columns) == ["doc_id", "kept_text", "n_bytes", "n_removed", "n_spans", "spans", "text"]
    assert Counter((r.doc_id, r.kept_text, r.n_removed, r.n_spans) for r in got.collect()) == brute(rows)
