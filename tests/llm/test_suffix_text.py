"""Passages planted in other texts are gone from the text that op8_suffix_dedup returns, and clean texts stand as they were."""

import hashlib
import random

from sievework.llm import suffix_dedup


def test_planted_passages_are_gone_from_the_text(spark, tmp_path):
    rnd = random.Random(12)
    words = lambda n: " ".join("".join(rnd.choice("abcdéfghij") for _ in range(rnd.randint(6, 9))) for _ in range(n))
    passages = [words(60) for _ in range(20)]
    assert all(len(p.encode()) >= 400 for p in passages)
    rows, planted = [], {}
    for k in range(200):
        own = [words(rnd.randint(20, 120)), words(30)]
        if k % 3 == 0:
            planted[k] = passages[k // 3 % 20]
        rows.append((k, (own[0] + " " + planted[k] + " " + own[1]) if k in planted else " ".join(own)))
    # Texts that share the second byte of a character, not the first: the cut halves it.
    tail = words(70)
    rows += [(200, "pÀ" + tail), (201, "qĀ" + tail), (202, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    suffix_dedup.query(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    got = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for k, text in rows[:200]:
        assert (planted[k] not in got[k].text and got[k].n_removed >= len(planted[k].encode())) if k in planted else got[k].text == text and got[k].n_removed == 0
        assert hashlib.sha256(got[k].text.encode()).hexdigest() == got[k].kept_sha256 or "�" in got[k].text
    assert (got[200].text, got[201].text, got[202].text) == ("p�", "q�", "")
