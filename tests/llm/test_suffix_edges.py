"""Suffix dedup where texts are poor in triggers: strings that hold one trigger or none."""

import hashlib
import random
import re
from collections import Counter

import pytest

from sievework.llm import suffix_dedup


def brute(rows, length):
    """(id, bytes, bytes removed, runs, digest of the rest) of each row."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[s : s + length] for _, d in data for s in range(len(d) - length + 1))
    out = Counter()
    for i, d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out[(i, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("crowd", [5000, 1])
def test_runs_that_end_in_a_trigger(spark, crowd):
    """Pairs share a run of one letter and random letters after it; one of a pair has more of the run before."""
    rnd = random.Random(8)
    rows = []
    for k in range(200):
        tail = "".join(rnd.choice("bcdefghij") for _ in range(rnd.randint(20, 80)))
        shared = "a" * rnd.randint(360, 399) + tail
        rows += [(2 * k, shared + "x"), (2 * k + 1, "a" * rnd.randint(0, 300) + shared + "y")]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()) == brute(rows, 400)


def test_periods_ties_and_clashes(spark):
    """Periodic texts, texts of exactly the length, repeated rows, and columns that clash with the result's."""
    rnd = random.Random(9)
    unit = "".join(rnd.choice("ab") for _ in range(7))
    rows = [(0, unit * 90), (1, unit * 57 + "a"), (2, (unit * 60)[:400]), (3, (unit * 60)[:399]), (3, (unit * 60)[:399]), (4, "é" * 200), (5, "z" + "é" * 200), (None, "q" * 400), (6, None)]
    docs = spark.createDataFrame([(i, t, b"old", "x") for i, t in rows], "doc_id long, text string, kept binary, N_Spans string")
    got = suffix_dedup.dedup(docs)
    assert sorted(c.lower() for c in got.columns) == ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "spans", "text"]
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()) == brute(rows, 400)


@pytest.mark.parametrize("crowd", [5000, 1])
def test_many_copies_of_a_row_are_one_text_where_contexts_meet(spark, crowd, tmp_path, monkeypatch):
    """A row of 10,000 copies and two other texts that share a passage with it: no call sees more texts than with two copies."""
    rnd = random.Random(10)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(600)]
    shared, own = " ".join(words[:200]), [" ".join(words[k : k + 100]) for k in (200, 300, 400)]
    plain, seen = suffix_dedup.marked, str(tmp_path)

    def watched(group, texts, length):
        import os
        import uuid

        with open(os.path.join(seen, uuid.uuid4().hex), "w") as f:
            f.write(str(len(texts)))
        return plain(group, texts, length)

    monkeypatch.setattr(suffix_dedup, "marked", watched)
    most = []
    for n in (2, 10_000):
        rows = [(1, own[0] + " " + shared)] * n + [(2, shared + " " + own[1]), (3, own[2] + shared)]
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), crowd=crowd).collect())
        want = brute([*[(1, rows[0][1])] * 2, *rows[-2:]], 400)
        assert got == Counter({k: n if k[0] == 1 else v for k, v in want.items()})
        most.append(max([int(f.read_text()) for f in tmp_path.iterdir()], default=0))
    assert most[0] == most[1]


def test_a_line_repeated_in_its_text_is_one_row(spark):
    """Texts that repeat a line hundreds of times, alone, between others, and with few triggers: equal contexts of a text meet others once."""
    from sievework.llm.chunk_dedup import gear

    rnd = random.Random(13)
    words = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    lines = [words(12), words(70), "a" * 410 + words(1)]
    rows = [(k, words(rnd.randint(1, 80)) + ("\n" + lines[k % 3]) * rnd.randint(2, 300) + "\n" + words(rnd.randint(1, 80))) for k in range(12)]
    rows += [(12, lines[1]), (13, words(40) + lines[1] * 2), (14, (lines[0] + "\n") * 500)]
    for _, text in rows:
        got = suffix_dedup.contexts(text.encode(), 400, gear())
        own = Counter(r[:2] for r in got if r[4])
        assert max(own.values(), default=1) == 1
        starts = Counter(s for r in got if r[4] != 2 for s in range(r[2], r[3] + 1))
        assert starts == Counter(range(len(text.encode()) - 399))
    for crowd in (5000, 1):
        found = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd)
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found.collect()) == brute(rows, 400)
