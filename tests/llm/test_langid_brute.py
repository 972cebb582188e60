"""Language ID against a plain computation of features, margins and votes, and the odd cases."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.llm import langid


def plain(text, model):
    """(language, score) with dictionaries and loops."""
    letters = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    if not letters or not model:
        return "und", 0.0
    data = f" {letters} ".encode()
    bins = Counter()
    for n in range(1, 5):
        for i in range(len(data) - n + 1):
            code = 0
            for b in data[i : i + n]:
                code = (code * 257 + b) % 2**32
            bins[(code * 2654435761 % 2**32) >> 20] += 1
    norm = math.sqrt(sum(bins.values()))

    def decide(machine):
        classes, pairs, ws = machine
        if len(classes) == 1:
            return classes[0], 1.0
        best = None
        margins = {p: sum(float(w[k]) * math.sqrt(n) / norm for k, n in bins.items()) + float(w[-1]) for p, w in zip(pairs, ws, strict=True)}
        for c in classes:
            own = [m if p[0] == c else -m for p, m in margins.items() if c in p]
            best = max(best or (-1,), (sum(m > 0 for m in own), min(own), c))
        return best[2], 1 / (1 + math.exp(-4 * best[1]))

    family, sure = decide(model["families"])
    lang, also = decide(model[family])
    return lang, sure * also


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("held", langid.held_out(F.col("doc_id")))


def test_predictions_are_the_plain_ones(spark, table):
    model = langid.train(table.filter("not held"))
    odd = [(1000, None), (1001, ""), (1002, "12 34 !"), (1003, "É"), (1004, "la casa " * 20_000), (1004, "la casa " * 20_000)]
    docs = table.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("Score", F.lit("old")).withColumn("lang_pred", F.lit(1))
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count() and rows[0].asDict().keys() == {"doc_id", "text", "lang_pred", "score"}
    for r in rows:
        lang, score = plain(r.text, model)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3, r.doc_id


def test_sample_is_bounded_and_steady(table):
    known = table.filter("not held")
    few = langid.train(known, sample=5)
    assert str(few) == str(langid.train(known.repartition(7), sample=5))
    assert langid.identify(table, langid.train(known, total=40)).filter("lang = lang_pred").count() > 0.8 * table.count()
    assert langid.train(known.filter("lang = 'en'"))["germanic"][0] == ["en"]
