"""The whole SpotSigs query against a plain computation of chains and Jaccard similarity."""

import hashlib
import re

from sievework.llm import spotsigs

SF = "/root/testdata/sf0.001"
ANCHORS = set(spotsigs.ANCHORS)


def chains(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    content = [k for k, w in enumerate(words) if w not in ANCHORS]
    found, at = set(), 0
    for i, w in enumerate(words):
        while at < len(content) and content[at] <= i:
            at += 1
        if w in ANCHORS and at + 1 < len(content):
            found.add(" ".join([w, words[content[at]], words[content[at + 1]]]))
    return found or {" ".join(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_query(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in spotsigs.query(spark, SF).collect()}
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        follow, r = docs[(k + 1) % len(docs)][1], got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert int(r.fingerprint.split("-")[0]) == len(chains(text))
        assert abs(r.near_edited - jaccard(chains(text), chains(edited))) < 1e-12
        assert abs(r.near_next - jaccard(chains(text), chains(follow))) < 1e-12
