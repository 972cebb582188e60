"""License scans against a plain search: every rule at every keyword over the whole text, then suppression."""

import random
import re

from sievework.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = [(n, *r, license_scan.keyword(r[4]), re.compile(f"(?<= ){r[4]}(?= )")) for n, r in enumerate(license_scan.rules())]


def brute(text):
    """(first, last, label, relevance) of the detections that stay, in no order, and all labels."""
    words = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    found, base = set(), set()
    for n, label, priority, relevance, is_base, _, key, shape in RULES:
        for i, w in enumerate(words):
            if w != key:
                continue
            m = shape.search(" " + " ".join([*words[:i], "@" + w, *words[i + 1 :]]) + " ")
            if m:
                first = i - m[0].split("@")[0].count(" ")
                found.add((first, first + m[0].count(" "), n, priority, label, relevance))
                if is_base:
                    base.add(label)
    kept = []
    for s in found:
        beaten = False
        for t in found:
            holds, held = t[0] <= s[0] and t[1] >= s[1], t[0] >= s[0] and t[1] <= s[1]
            if holds and held:
                beaten |= t[3] > s[3] or (t[3] == s[3] and t[2] < s[2])
            elif holds:
                beaten |= t[3] >= s[3]
            elif held:
                beaten |= t[3] > s[3]
        if not beaten:
            kept.append((s[0], s[1], s[4], s[5]))
    return sorted(kept), ",".join(sorted(base | {k[2] for k in kept})), max((k[3] for k in kept), default=0) / 100


def spelt(rnd, rule):
    """Words that a rule matches, or nearly."""
    out = rule.replace("@", "")
    for _ in range(12):
        out = re.sub(r"\(\?:([^()]*)\)([?*]?)(?:\{\d+,\d+\})?", lambda m: rnd.choice(m[1].split("|")) if not m[2] or rnd.random() < 0.5 else "", out)
    out = re.sub(r"\[([^\]]*)\](\{\d\})?", lambda m: {"^ ": "word", "0-9": "7"}.get(m[1], m[1][0]) * (4 if m[2] else 1), out)
    return re.sub(r"[+?]", "", out)


def test_all_detections(spark):
    rnd, rules = random.Random(21), license_scan.rules()
    filler = "this work and its authors may use the terms of public software license version 2 0 or later copyright 1999 any".split()
    texts = [" ".join(x for _ in range(rnd.randint(1, 6)) for x in (spelt(rnd, rnd.choice(rules)[4]), " ".join(rnd.choices(filler, k=rnd.randint(0, 9))))) for _ in range(220)]
    texts += [spelt(rnd, r[4]) for r in rules]
    texts += [
        "licensed under the terms of the do what the fuck you want to public license",
        "distributed under the terms of the university of illinois ncsa open source license",
        "European Union Public Licence v 1 2",
        "MIT License " * 40,
        None,
        "",
        "no keyword here",
    ]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, Labels string").repartition(8)
    for r in license_scan.scan(docs).collect():
        want, labels, score = brute(r.text)
        assert sorted(tuple(d) for d in r.detections) == want, r.text
        assert (r.labels, r.score) == (labels, score)
    by = {t: brute(t) for t in texts[-7:-4]}
    assert [b[2] for b in by.values()] == [0.98, 0.93, 0.95]
    assert by["licensed under the terms of the do what the fuck you want to public license"][0][0][:2] == (0, 14)
