"""Benchmark decontamination with one Aho-Corasick automaton.

The words of every benchmark item are cut into windows of 13 consecutive words; an item
with fewer words is one window. All windows go into one automaton, and every document is
scanned once. Text is normalised at byte level: A-Z to a-z, every other ASCII byte that
is no letter or digit to a space, runs of spaces to one. UTF-8 bytes beyond ASCII stay as
they are, so the bytes match exactly when the words do. A window is stored with a space
on either side, so that it matches whole words only.

Cost: one narrow pass over the documents; no shuffle. The benchmark is broadcast, and its
size is checked against ``max_benchmark_chars`` before it is collected.

Cases: a null or empty text has no words and no hits. A null item text gives no window;
windows of an item with a null id hit, but the id is not listed. Repeated items and
repeated rows each count as they stand. Empty tables give no rows or no hits. Input
columns whose names clash with the result's are replaced; all others are kept.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import common

common.by_value(__name__)

SPACED = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def normalise(text: str | None) -> str:
    """' w1 w2 ... ' with one character for each UTF-8 byte; '' without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(SPACED).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def windows(item: str, size: int) -> list[str]:
    words = item.split(" ")[1:-1]
    n = min(size, len(words))
    return [f" {' '.join(words[i : i + n])} " for i in range(len(words) - n + 1)] if n else []


def automaton(items: list[tuple[str | None, str]], size: int):
    import ahocorasick

    of: dict[str, set[int]] = {}
    for k, (_, norm) in enumerate(items):
        for w in windows(norm, size):
            of.setdefault(w, set()).add(k)
    if not of:
        return None
    auto = ahocorasick.Automaton()
    for w, ks in of.items():
        auto.add_word(w, (len(w), tuple(ks)))
    auto.make_automaton()
    return auto


def word_spans(text: str, hit: list[tuple[int, int]]) -> list[list[int]]:
    """Character offsets in the original text of runs of words [first, last]."""
    at = [m.span() for m in re.finditer(common.WORD_ANY_CASE, text)]
    return [[at[a][0], at[b][1]] for a, b in hit]


def scan_text(text: str | None, auto, items) -> tuple:
    import numpy as np

    norm = normalise(text)
    n_words = norm.count(" ") - 1 if norm else 0
    found = list(auto.iter(norm)) if auto is not None and norm else []
    if not found:
        return n_words, 0, [], []
    spaces = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), dtype=np.uint8) == 32)
    ends = np.array([e for e, _ in found])
    starts = ends - np.array([n for _, (n, _) in found]) + 1
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, np.searchsorted(spaces, starts), 1)
    np.add.at(step, np.searchsorted(spaces, ends), -1)
    covered = np.concatenate([[0], (np.cumsum(step)[:n_words] > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(covered))
    runs = list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))
    ids = {items[k][0] for _, (_, ks) in found for k in ks}
    return n_words, int(covered.sum()), sorted(x for x in ids if x is not None), word_spans(text, runs)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, max_benchmark_chars: int = 64_000_000
) -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window), items (ids with
    occurring windows), spans (character offsets of the hit runs in the original text) and
    contaminated (any hit, and at least ``percent`` percent of the words)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > max_benchmark_chars:
        raise ValueError(f"the benchmark has {size} characters; at most {max_benchmark_chars} go into one automaton")
    rows = benchmark.select(F.col("item_id").cast("string"), "text").collect()
    held = spark.sparkContext.broadcast({"items": sorted({(r[0], normalise(r[1])) for r in rows}, key=str)})

    @F.pandas_udf(SCAN)
    def scan(text: pd.Series) -> pd.DataFrame:
        mine = held.value
        if "auto" not in mine:
            mine["auto"] = automaton(mine["items"], window)
        return pd.DataFrame([scan_text(t, mine["auto"], mine["items"]) for t in text], columns=["n_words", "n_hit", "items", "spans"])

    kept = [F.col(f"d.`{c}`") for c in docs.columns if c.lower() not in {"n_words", "n_hit", "items", "spans", "contaminated"}]
    out = docs.alias("d").select(*kept, scan(F.col("d.text")).alias("found"))
    return out.select(*[F.col(f"`{c}`") for c in out.columns[:-1]], "found.*").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{common.WORD}') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{common.WORD}') AS w
  FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit
          FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
