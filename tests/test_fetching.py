"""Suggested fetches, merged metadata, folders and references against plain loops on random rows."""

import random
from collections import Counter, defaultdict

from sievework.operators import fetching

CARD = "query_id long, pos long, `group` string, kind string, role string, score double, url string, raw_permalink string, raw_url string, permalink string, browser_url string, host string, owner string, repo string, ref string, path string"


def plain_picks(cards):
    """(pos, link, gain, tool) of a request, picked one by one."""
    link = lambda c: next((c[k] for k in (7, 8, 9, 10, 6) if c[k] is not None), None)
    domain = lambda c: (link(c) or "").split("://")[-1].split("/")[0].split(":")[0].lower() if "://" in (link(c) or "") else ""
    located = {}
    for c in sorted(cards, key=lambda c: c[1]):
        located.setdefault(link(c), all(x is not None for x in c[11:16]))
    out, ds, gs = [], Counter(), Counter()
    for c in sorted(cards, key=lambda c: (-c[5], c[1])):
        d, g = domain(c), c[2] or ""
        if len(out) < 8 and ds[d] < 2 and gs[g] < 2:
            ds[d] += 1
            gs[g] += 1
            gain = 1.0 if ds[d] == gs[g] == 1 else 0.7
            out.append((c[1], link(c), gain, "repo_fetch" if located.get(link(c)) else "web_fetch"))
            located[link(c)] = False
    return out


def test_suggested_is_the_plain_loop(spark):
    rnd, rows = random.Random(21), []
    maybe = lambda v: v if rnd.random() < 0.8 else None
    for q in range(40):
        for pos in range(rnd.choice([1, 6, 80])):
            url = lambda: f"https://{rnd.choice('ABcd')}.x:80/{rnd.randint(0, 4)}"
            rows.append((q, pos, maybe(rnd.choice(["tests", "issues", "official_docs", "other"])), maybe("docs"), maybe(rnd.choice(["implementation", "test", "changelog", "configuration"])), float(rnd.randint(0, 9)), url(), rnd.choice([None, None, url()]), None, rnd.choice([None, url()]), None, rnd.choice([None, "github", "gitlab", "codeberg"]), maybe("o"), maybe("r"), maybe("v1"), maybe(rnd.choice(["src/a.rs", "top.py"]))))
    df = spark.createDataFrame(rows, CARD)
    got = defaultdict(list)
    for r in fetching.suggested(df).orderBy("query_id", "place").collect():
        got[r.query_id].append(r)
    for q in range(40):
        cards = [r for r in rows if r[0] == q]
        picks = [r for r in got[q] if r.gain is not None]
        assert [(r.pos, r.url, r.gain, r.tool) for r in picks] == plain_picks(cards)
        beside = []
        for c in sorted(cards, key=lambda c: c[1]):
            if None in (c[12], c[13], c[15]):
                continue
            ref, file = c[14] or "main", c[15].split("/")[-1]
            raw = {"gitlab": f"https://gitlab.com/o/r/-/raw/{ref}/", "codeberg": f"https://codeberg.org/o/r/raw/branch/{ref}/"}.get(c[11], f"https://raw.githubusercontent.com/o/r/{ref}/")
            names = {"implementation": [f"tests/{file}", f"examples/{file}"] if "/" in c[15] else [], "test": [f"src/{file}"] if "/" in c[15] else []}.get(c[4], [])
            names += ["Cargo.toml"] if c[4] in ("implementation", "configuration") else []
            beside += [raw + n for n in names] + ([c[6]] if c[4] == "changelog" else [])
        assert [r.url for r in got[q][len(picks) :]] == beside[:8] and [r.place for r in got[q]] == list(range(1, len(got[q]) + 1))
    assert fetching.suggested(df.limit(0)).count() == 0


def test_merge_does_not_depend_on_the_order_of_rows(spark):
    rnd, rows = random.Random(4), []
    for k in range(30):
        for o in rnd.sample(range(50), rnd.randint(1, 12)):
            rows.append((k if k else None, o, rnd.choice([None, "a", "b"]), rnd.choice([None, o]), rnd.choice([None, "", f"x{o}"]), rnd.choice([None, [], [rnd.choice("pqrs") for _ in range(4)]])))
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == k) if k is not None else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        kind = next((r[2] for r in sorted(mine, key=lambda r: r[1]) if r[2] is not None), None)
        own = [r for r in sorted(mine, key=lambda r: r[1]) if r[2] == kind and kind is not None]
        labels = list(dict.fromkeys(x for r in own for x in r[5] or []))
        want[k] = (kind, next((r[3] for r in own if r[3] is not None), None), next((r[4] for r in own if r[4] is not None), None), labels if kind else None)
    want.pop(None, None)
    schema = "key long, o int, kind string, number int, name string, labels array<string>"
    for _ in range(2):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, schema).repartition(5)
        got = fetching.merged_metadata(df, ["key"], "o", "kind", ["number", "name"], ["labels"])
        assert {r.key: (r.kind, r.number, r.name, r.labels) for r in got.filter("key IS NOT NULL").collect()} == want
    assert fetching.merged_metadata(df.limit(0), ["key"], "o", "kind", ["number"], ["labels"]).count() == 0


def test_folders_are_the_sums_of_what_lies_below(spark):
    rnd = random.Random(6)
    rows = [(f"r{rnd.randint(0, 1)}", "/".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) + f"/f{k}", rnd.choice([None, k])) for k in range(400)]
    rows += [("r0", None, 5), ("r0", "", 5), ("r2", "//top", 7), (None, "x/y", 1)]
    want, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    for repo, path, size in rows:
        p = [x for x in (path or "").split("/") if x]
        if not p or len(p) > 4:
            continue
        for d in range(len(p)):
            key = (repo, "/".join(p[:d]))
            want[key][0] += 1
            want[key][1] += size or 0
            below[key] |= {"/".join(p[:j]) for j in range(d + 1, len(p))}
    got = fetching.folder_totals(spark.createDataFrame(rows, "repo string, path string, size long"), most_deep=4).collect()
    assert {(r.repo, r.folder): (r.n_files, r.n_bytes, r.n_folders) for r in got if r.repo} == {k: (*v, len(below[k])) for k, v in want.items() if k[0]}


def test_references_with_slashes(spark):
    refs = spark.createDataFrame([("r", "main"), ("r", "feature/x"), ("r", "feature"), ("q", "v1"), ("r", "main"), (None, "main")], "repo string, ref string")
    asked = [("r", "feature/x/src/a.rs"), ("r", "feature/y/a"), ("r", "feature/xy"), ("r", "main"), ("r", "other/a/b"), ("r", "other"), ("q", "main/a"), ("r", None), ("r", ""), ("r", "/main/a/"), ("r", "main/a"), ("r", "main/a")]
    got = fetching.told_apart(spark.createDataFrame(asked, "repo string, spec string"), refs).collect()
    assert Counter((r.repo, r.spec, r.ref, r.path) for r in got) == Counter([
        ("r", "feature/x/src/a.rs", "feature/x", "src/a.rs"), ("r", "feature/y/a", "feature", "y/a"), ("r", "feature/xy", "feature", "xy"), ("r", "main", "main", None), ("r", "other/a/b", "other", "a/b"), ("r", "other", None, None),
        ("q", "main/a", "main", "a"), ("r", None, None, None), ("r", "", None, None), ("r", "/main/a/", "main", "a"), ("r", "main/a", "main", "a"), ("r", "main/a", "main", "a"),
    ])
