"""Language ID in two steps: the family first, then the language within it.

Features are the counts of letter n-grams (one to four UTF-8 bytes of the lower-cased text,
each run of other characters one space) hashed into ``DIM`` bins, by square root and scaled
to length one. A one-versus-one linear support vector machine tells families apart; within
the family that wins, further machines, one for each pair of languages, vote on the
language. Machines are fitted in the driver by gradient descent on the squared hinge loss,
on the feature vectors of a bounded sample: about ``sample`` documents of each language,
those of the smallest hashes of their ids, and about ``total`` of all languages together. Features are computed in the tasks, over whole
texts; a document's prediction is one narrow pass, without a shuffle.

Cases: a text that is null, empty or without a letter is "und" with score 0, as is every
text if nothing was learned. A language outside the family table is a family of its own.
One language alone is always predicted. Repeated rows are learned and predicted each. A very
long text is read whole and costs time in proportion. Columns that clash with the result's
are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import common

common.by_value(__name__)

DIM = 4096
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi bn mr ur pa gu ne",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
FAMILY = {lang: fam for fam, langs in FAMILIES.items() for lang in langs.split()}


def features(text: str | None):
    """DIM bins as float32; None without a letter."""
    import re

    import numpy as np

    letters = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
    if not letters:
        return None
    b = np.frombuffer(f" {letters} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    code, counts = np.zeros(len(b), dtype=np.uint32), np.zeros(DIM, dtype=np.int64)
    for n in range(1, 5):
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    x = np.sqrt(counts.astype(np.float32))
    return x / np.linalg.norm(x)


def fit_pair(x, y, rounds: int = 300, c: float = 10.0):
    """Weights and bias of a linear machine for labels of 1 and -1."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(rounds):
        at = w + (k / (k + 3)) * (w - v)
        slack = np.maximum(0, 1 - y * (x @ at))
        v, w = w, at - (at / c - 2 * ((share * y * slack) @ x)) / (2 * 2 + 1 / c)
    return w


def pairs_of(classes: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]


def fit(x, langs: list[str]) -> dict:
    """The machines: {"families": ..., family: ...}, each (classes, pairs, weights)."""
    import numpy as np

    def machines(classes: list[str], label: list[str]):
        label = np.array(label)
        ws = []
        for a, b in pairs_of(classes):
            own = (label == a) | (label == b)
            ws.append(fit_pair(x[own], np.where(label[own] == a, 1, -1).astype(np.float32)))
        return classes, pairs_of(classes), np.array(ws, dtype=np.float32).reshape(len(ws), DIM + 1)

    family = [FAMILY.get(lang, lang) for lang in langs]
    out = {"families": machines(sorted(set(family)), family)}
    for f in sorted(set(family)):
        out[f] = machines(sorted({lang for lang, g in zip(langs, family, strict=True) if g == f}), langs)
    return out


def decide(x, machine) -> tuple[str, float]:
    """The class of most votes, then of the largest margin; its smallest margin as a chance."""
    import numpy as np

    classes, pairs, ws = machine
    if len(classes) == 1:
        return classes[0], 1.0
    margins = ws[:, :-1] @ x + ws[:, -1]
    best = max(
        (sum((m > 0) == (a == c) for (a, b), m in zip(pairs, margins, strict=True) if c in (a, b)), min(m if a == c else -m for (a, b), m in zip(pairs, margins, strict=True) if c in (a, b)), c)
        for c in classes
    )
    return best[2], float(1 / (1 + np.exp(-4 * min(50.0, max(-50.0, best[1])))))


def predict(text: str | None, model: dict) -> tuple[str, float]:
    x = features(text) if model else None
    if x is None:
        return "und", 0.0
    family, sure = decide(x, model["families"])
    lang, also = decide(x, model[family])
    return lang, sure * also


def train(docs: DataFrame, sample: int = 400, total: int = 8_000) -> dict:
    """Machines from docs' text and lang; at most about ``sample`` vectors of each language and
    ``total`` in all (64 MB) reach the driver, and no text does. A corpus of over 200 languages is
    refused."""
    import numpy as np

    common.small_batches(docs.sparkSession)
    known = docs.filter("lang is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("_h"))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().limit(201).collect()}
    if len(sizes) > 200:
        raise ValueError("more than 200 languages")
    if not sizes:
        return {}
    each = min(sample, total / len(sizes))
    share = F.create_map(*[F.lit(y) for lang, n in sizes.items() for y in (lang, min(1.0, each / n))])
    place = (F.shiftright("_h", 11) / F.lit(float(2**53))) + 0.5

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (x := features(t)) is None else x.astype("float16").tobytes() for t in texts], dtype=object)

    rows = known.filter(place <= share[F.col("lang")]).select("lang", "_h", vector("text").alias("x")).dropna().collect()
    rows.sort(key=lambda r: (r["lang"], r["_h"]))
    if not rows:
        return {}
    x = np.array([np.frombuffer(r["x"], dtype=np.float16) for r in rows]).astype(np.float32)
    return fit(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """docs plus lang_pred and score."""
    common.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def pred(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(t, held.value) for t in texts], columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c.lower() not in {"lang_pred", "score"}]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], pred("text").alias("_found"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "_found.lang_pred", "_found.score")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.filter("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
