"""Importance resampling: against SQL, plain counts for several orders, and the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from sievework.llm import importance

from oracle import same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, order, buckets, percent, least):
    def features(text):
        w = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, order + 1) for k in range(len(w) - n + 1)]

    corpus, wanted = (Counter(b for t in texts for b in features(t)[1]) for texts in ([t for _, t in docs], target))
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((corpus[b] + 1) * (t + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        n, own = features(text)
        weight, score = sum(gain[b] for b in own), None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, n, len(own), weight, score))
    draw = percent * sum(r[1] >= least for r in rows) // 100
    best = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))[:draw]
    ranks = {}
    for k, r in enumerate(best):
        ranks.setdefault(r, []).append(k + 1)
    return Counter((*r, (ranks.get(r) or [None]).pop(0) if ranks.get(r) else None) for r in rows)


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 3)))
    out = [(k, " ".join(word() for _ in range(rnd.choice([3, 19, 20, 40, 90])))) for k in range(120)]
    out += [(7, out[7][1])] * 25 + [(7, "Other WORDS " * 15), (200, None), (201, ""), (202, " .,; "), (None, "ab cd " * 30), (203, "b a " * 40_000)]
    return out


def test_against_sql(spark):
    same(spark, SF, importance.query, importance.SQL)


@pytest.mark.parametrize(("order", "percent"), [(1, 10), (1, 100), (3, 25)])
def test_against_plain_counts(spark, docs, order, percent, monkeypatch):
    monkeypatch.setattr(importance, "RANGE", 9)  # many ranges of scores
    target = ["ab cd ab b a", None, "é a b c d", "ab"]
    df = spark.createDataFrame([(*d, -1, "x") for d in docs], "doc_id long, text string, Rank long, bucket string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, wanted, order=order, buckets=97, percent=percent)
    want = plain(docs, target, order, 97, percent, 20)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == want
    taken = importance.drawn(df, got).collect()
    assert sum(r.times for r in taken) == sum(n for r, n in want.items() if r[5] is not None)
    assert {c.lower() for c in taken[0].asDict()} == {"doc_id", "text", "rank", "bucket", "times"} and all(r.Rank == -1 for r in taken)


def test_empty_tables(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = df.limit(0)
    assert importance.resample(none, df.select("text")).count() == 0
    got = importance.resample(df, none.select("text"), buckets=97)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == plain(docs, [], 1, 97, 10, 20)
    with pytest.raises(ValueError, match="buckets"):
        importance.resample(df, none, buckets=2_000_000)
