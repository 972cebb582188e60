"""The training-data operators against brute force, on small tables with the odd cases."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.llm import chunk_dedup, decontaminate, dom, html_extract, langid, license_scan, mixing, simhash, spotsigs, suffix_dedup, url_filter
from sievework.llm.components import stars

from oracle import same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_words long, fingerprint string"


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 8)))
    a = " ".join(word() for _ in range(400))
    shared = " ".join(word() for _ in range(120))
    out = [(k, " ".join(word() for _ in range(rnd.randint(1, 200))), "en", f"s{k % 3}") for k in range(12)]
    out += [(20, a, "fr", "s0"), (21, a, "fr", "s0"), (21, a, "fr", "s0"), (22, a + " plus", "fr", None), (23, shared + " " + a[:900], "de", "s1")]
    out += [(24, f"x {shared}", "de", "s1"), (25, None, None, None), (26, "", "en", "s2"), (27, " \n\t", None, "s2"), (None, a[:700], "en", "s1"), (28, "la " * 3000, "es", "s2")]
    out += [(29, "Licensed under CC BY-NC 4.0. All rights reserved.\n" * 40, "en", "s0"), (30, word() + " " + " ".join(word() for _ in range(20_000)), "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*t, -1, "clash") for t in texts], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_decontaminate(spark, texts, docs, empty):
    items = [(1, " ".join(texts[12][1].split()[50:80])), (2, "Licensed under"), (3, None), (4, "..."), (2, "Licensed under"), (5, texts[13][1][:300])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect())
    want = Counter()
    for i, text, *_ in texts:
        w, hit, ids = WORD.findall(lower(text)), set(), set()
        for item, t in items:
            v = WORD.findall(lower(t))
            n = min(13, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(item))
        want[(i, len(w), len(hit), ",".join(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert got == want
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0


@pytest.mark.parametrize("crowd", [5000, 1])
def test_suffix_dedup(texts, docs, empty, crowd):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup(docs, crowd=crowd).collect())
    data = [(t[0], (t[1] or "").encode()) for t in texts]
    seen = Counter(d[s : s + 400] for _, d in data for s in range(len(d) - 399))
    want = Counter()
    for i, d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - 399):
            if seen[d[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        want[(i, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    assert got == want
    assert suffix_dedup.dedup(empty).count() == 0


def test_simhash(texts, docs, empty):
    import xxhash

    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))

    rows = [(t[0], fp(t[1])) for t in texts]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                if (a[1] ^ b[1]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, f"{f:016x}", least.get(g)) for g, (i, f) in zip(group, rows, strict=True))
    out = simhash.near_duplicates(docs)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()) == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(least.values()))
    assert simhash.near_duplicates(empty).count() == 0


def test_tiles_miss_no_link(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(1, 5))) for b in base for _ in range(4)]
    fps = sorted({*base, *near})
    rows = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp % (1 << 64): r.component_id for r in simhash.components(rows).collect()}
    group = {f: k for k, f in enumerate(fps)}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    assert got == group


def test_stars(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    assert {(r.a, r.b) for r in stars(chain).collect()} == {*((k, 0) for k in range(1, 41)), (101, 100)}
    assert stars(chain.limit(0)).count() == 0


def test_chunk_dedup(texts, docs, empty):
    out = {(r.doc_id, r.text): r for r in chunk_dedup.dedup(docs).collect()}
    for (_, text), r in out.items():
        if text is None:
            assert r.kept_text is None
            continue
        data, edges = text.encode(), [0, *[x for s in r.spans for x in s], len(text.encode())]
        assert b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)).decode() == r.kept_text
        assert r.n_removed == len(data) - len(r.kept_text.encode())
    by = {i: r for (i, _), r in out.items()}
    assert by[21].kept_text == "" and by[20].n_removed < by[20].n_bytes and by[24].n_removed > 300
    assert all(by[k].n_removed == 0 for k in range(12))
    assert chunk_dedup.dedup(empty).count() == 0


def test_chunks_resist_shifts():
    table, rnd = chunk_dedup.gear(), random.Random(1)
    data = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)).encode()
    cut = lambda d: {d[a:b] for e in [chunk_dedup.cuts(d, table)] for a, b in zip([0, *e], e, strict=False)}
    assert len(cut(data) - cut(data[:9000] + b"inserted words " + data[9000:])) < 5
    assert b"".join(data[a:b] for e in [chunk_dedup.cuts(data, table)] for a, b in zip([0, *e], e, strict=False)) == data


def test_license_scan(texts, docs, empty):
    for r in license_scan.scan(docs).collect():
        w, at = WORD.findall(lower(r.text)), []
        for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
            p = phrase.split()
            at += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
        places = [k for k, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert license_scan.scan(empty).count() == 0


def test_license_rules(spark):
    assert len(license_scan.rules()) > 200
    cases = {
        "Distributed under the terms of the GNU General Public License, version 2 or (at your option) any later version.": "gpl,gpl-2.0-or-later",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Released under the MIT License. All rights reserved.": "mit,reserved",
        "A licence to nothing": "",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    assert license_scan.scan(df).filter("labels != want").collect() == []


def test_html_extract():
    model = html_extract.train()
    right = total = 0
    for f, labels in html_extract.sequences(html_extract.labelled_pages(150, seed=9)):
        got = html_extract.viterbi([sum(model["w"].get(n, 0.0) for n in x) for x in f], model["t"])
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.97
    page = (
        "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One  two<br>three.</p>"
        "<div class='ad'>Buy this now.</div></article><footer>&copy; x</footer></body></html>"
    )
    assert html_extract.main_text(page, model) == "A & B\n\nOne two three."
    assert html_extract.main_text(None, model) == html_extract.main_text("", model) == html_extract.main_text("<p></p><", model) * 0 == ""
    assert dom.blocks("<p>a<p>b</q>c") == [("a", (("p", ()),), 0), ("bc", (("p", ()),), 0)]


def test_viterbi_is_exact():
    from itertools import product

    rnd = random.Random(3)
    for _ in range(30):
        s, t = [rnd.gauss(0, 1) for _ in range(6)], [[rnd.gauss(0, 1) for _ in range(2)] for _ in range(2)]
        value = lambda y: sum(a * b for a, b in zip(s, y, strict=True)) + sum(t[a][b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        assert abs(value(html_extract.viterbi(s, t)) - max(map(value, product((0, 1), repeat=6)))) < 1e-9


def test_mix(texts, docs, empty):
    mix = mixing.Mix(docs, block=16)
    rows = mix.taken().collect()
    sizes = Counter()
    for _, text, _, source in texts:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5, 2), strict=True))
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.target == want[r.source] and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in order) and len(rows) == len(texts)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.Mix(docs, block=16).taken().collect()))
    assert mixing.Mix(empty).taken().count() == 0
    assert mixing.targets([0, 0], [5, 2], 1.5, 2) == [0, 0]
    assert mixing.targets([10, 100], [5, 1], 1.5, 2) == [20, 145]


def test_language_id(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", langid.held_out(F.col("doc_id")))
    model = langid.train(table.filter("not held"))
    found = langid.identify(table.filter("held"), model)
    assert found.filter("lang = lang_pred").count() >= 0.95 * found.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "die und der das ist nicht")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(odd, model).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert {r.lang_pred for r in langid.identify(docs, langid.train(empty)).collect()} == {"und"}


def test_spotsigs(texts, docs, empty):
    rows = spotsigs.with_next(docs).collect()
    key = lambda t: (t[0] is not None, t[0] or 0)
    assert len(rows) == len(texts)
    order = sorted(texts, key=key)
    follow = {a[0]: b[1] or "" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert all(r.next_text == follow[r.doc_id] for r in rows if r.doc_id != 21)
    assert {r.fingerprint for r in spotsigs.fingerprints(docs).filter("doc_id in (20, 21)").collect()}.__len__() == 1
    assert spotsigs.with_next(empty).count() == 0


def test_url_filter(spark):
    urls = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q", "http://example.com/fr/", "http://com/de/#x", "notorg", None, "http://fororg/", "ftp://x.org:80/"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = [(r.rule, r.verdict) for r in url_filter.judge(pages, rules).orderBy("page_id").collect()]
    assert got == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), *[(None, "allow")] * 4]
    assert url_filter.judge(pages, rules.limit(0)).filter("verdict = 'allow'").count() == len(urls)
    assert url_filter.judge(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("name", ["op1_decontaminate", "op10_url_filter"])
def test_against_sql(spark, name):
    from sievework.llm import queries

    same(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert 0 < corpus_pipeline.run(spark, SF).count() <= docs.count()
