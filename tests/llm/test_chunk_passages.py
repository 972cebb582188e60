"""Repeated passages go whole, at any offset, with and without spaces."""

import random

from sievework.llm import chunk_dedup


def test_shifted_passages_go_whole(spark):
    rnd = random.Random(4)
    cjk = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n))
    base64 = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    words = lambda n, by=" ": by.join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for k in range(60):
        make, size = [(cjk, 150), (base64, 300), (words, 55), (lambda n: words(n, "\t"), 55)][k % 4]
        passage, by = make(size), " \t"[k % 4 == 3] if k % 4 > 1 else ""
        texts = [make(rnd.randint(30, 90)) + by + passage + by + make(rnd.randint(30, 90)) for _ in range(2)]
        for c, text in enumerate(texts):
            rows.append((2 * k + c, text))
        at = texts[1].index(passage)
        want[2 * k + 1] = (len(texts[1][:at].encode()), len(texts[1][: at + len(passage)].encode()), len(passage.encode()))
    got = {r.doc_id: r for r in chunk_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = 0
    for i, (a, b, n) in want.items():
        assert got[i - 1].n_removed == 0
        # Bytes beyond the passage go only where they agree by chance.
        assert got[i].n_removed <= n + 12, (i, n, got[i].spans)
        whole += any(x <= a and y >= b for x, y in got[i].spans)
    assert whole >= 58, whole
