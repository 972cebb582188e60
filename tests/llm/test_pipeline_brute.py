"""All rows of the pipeline against its five stages in plain Python, on a small corpus."""

import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

import test_chunk_brute
import test_near_dedup
from sievework.llm import langid, mixing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(text, items):
    w = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    hit = set()
    for t in items:
        v = WORD.findall((t or "").translate({k: k + 32 for k in range(65, 91)}))
        n = min(13, len(v))
        windows = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if n else set()
        for p in range(len(w) - n + 1 if n else 0):
            if tuple(w[p : p + n]) in windows:
                hit |= set(range(p, p + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_rows_equal_the_stages_in_python(spark, tmp_path):
    rnd = random.Random(3)
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000").orderBy("doc_id").limit(70).collect()]
    texts = [r[1] for r in given if r[1] and len(r[1].split()) > 120]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()]
    passage = " ".join(rnd.choice(texts).split()[:70])
    more = [None, "", "1234 5678 !", texts[0], texts[0], texts[1] + " and one more", texts[2] + " " + passage + " " + texts[3], passage + " " + texts[4], f"{texts[5]} {items[0][1]}", items[1][1], texts[6].replace(" ", "  ")]
    rows = given + [(5000 + k, t, rnd.choice(["en", None]), rnd.choice(["web", "new", None]), len(t or "")) for k, t in enumerate(more)]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    # 1: documents in a language that was learned; the machines are tested in test_langid_brute.
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    kept = [r for r in rows if (p := langid.predict(r[1], model))[0] != "und" and p[1] >= 0.1]
    assert {5000, 5001, 5002} <= {r[0] for r in rows} - {r[0] for r in kept}
    # 2: the smallest id of each group of near-duplicates.
    ids, _ = test_near_dedup.brute([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if r[0] in set(ids)]
    assert len({5003, 5004, 5005} & {r[0] for r in kept}) == 0
    # 3: passages that an earlier document has go.
    short = {i: t for i, t, *_ in test_chunk_brute.brute([(r[0], r[1]) for r in kept])}
    assert any(short[r[0]] != r[1] for r in kept)
    kept = [(r[0], short[r[0]], r[2], r[3]) for r in kept]
    # 4: documents that the benchmark contaminates go.
    clean = [r for r in kept if not contaminated(r[1], [t for _, t in items])]
    assert len(clean) < len(kept)
    # 5: the mix: sources' streams in the order of a hash, laid end to end twice, cut at the target.
    order = spark.createDataFrame([(r[0], r[1]) for r in clean], "doc_id long, text string").select("doc_id", F.xxhash64("doc_id", "text", F.lit("mix")).alias("o"))
    place = {r.doc_id: r.o for r in order.collect()}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in clean}
    sources = sorted({r[3] for r in clean}, key=lambda s: (s is None, s or ""))
    words = [sum(size[r[0]] for r in clean if r[3] == s) for s in sources]
    goal = mixing.targets(words, [(5, 2, 1)[k % 3] for k in range(len(sources))], 1.5, 2)
    want = Counter()
    for s, n, g in zip(sources, words, goal, strict=True):
        at = 0
        for r in sorted((r for r in clean if r[3] == s), key=lambda r: place[r[0]]):
            taken = sum(max(0, min(at + k * n + size[r[0]], round(g)) - min(at + k * n, round(g))) for k in (0, 1))
            want[(r[0], r[2], s, size[r[0]], n, taken)] += 1
            at += size[r[0]]
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.lang, r.source, r["size"], r.source_size, r.taken) for r in got) == want
