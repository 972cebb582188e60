"""The mix comes from its slots: brute force over schedule and stream, and another constant."""

from collections import Counter

from sievework.llm import mixing


def brute(order, sizes, weights, block, golden):
    """{source: words of each slot of it, in order} from the points of the schedule."""
    goal = [round(t) for t in mixing.targets(sizes, weights, 1.5, 2)]
    total, slots = sum(goal), -(-sum(goal) // block)
    out = {s: [] for s in order}
    for i in range(slots):
        x, cum = i * golden % 2**64, 0
        for k, w in enumerate(goal):
            cum += w
            if x * total < cum * 2**64 or k == len(goal) - 1:
                out[order[k]].append(i)
                break
    late = slots
    for s, w in zip(order, goal, strict=True):
        while len(out[s]) * block < w:
            out[s].append(late)
            late += 1
    return {s: {r: (slot, min(block, w - r * block)) for r, slot in enumerate(out[s]) if r * block < w} for s, w in zip(order, goal, strict=True)}


def test_slots_decide(spark):
    rows = [(k, " ".join(["w"] * (k * 37 % 90)), f"s{min(k % 7, 3)}" if k % 11 else None) for k in range(300)] + [(5, "w w w", "s1"), (5, "w w w", "s1"), (400, None, "s0"), (401, "", "tiny"), (402, "w " * 30, "tiny"), (403, "w " * 9000, "s2")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, Taken string, first_slot int")
    firsts = {}
    for golden in (mixing.GOLDEN, 3):
        mix = mixing.Mix(docs, block=64, golden=golden)
        sizes = Counter()
        for _, t, s in rows:
            sizes[s] += len((t or "").split())
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = brute(order, [sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 64, golden)
        got = {s: {} for s in order}
        for r in mix.pieces.groupBy("_s", "rank", "slot").agg({"words": "sum"}).collect():
            got[order[r[0]]][r[1]] = (r[2], r[3])
        assert got == want
        taken = mix.taken()
        assert [c for c in taken.columns if c.lower() in ("taken", "first_slot")] == ["taken", "first_slot"]
        by = Counter()
        for r in taken.collect():
            by[r.source] += r.taken
            assert (r.first_slot is None) == (r.taken == 0) and r.taken <= 2 * r.size
        assert by == Counter({s: sum(n for _, n in v.values()) for s, v in want.items()})
        firsts[golden] = sorted((r.doc_id, r.first_slot or -1) for r in taken.collect())
    assert firsts[mixing.GOLDEN] != firsts[3]


def test_stretches_hold_the_shares(spark):
    """In any stretch of the schedule a source has its share of the slots, but for a few."""
    docs = spark.createDataFrame([(k, "w " * 200, f"s{k % 4}") for k in range(400)], "doc_id long, text string, source string")
    mix = mixing.Mix(docs, block=50)
    slots = {r.slot: r._s for r in mix.schedule.collect()}
    goal = [r.target for r in mix.sources.orderBy("_s").collect()]
    for a, b in ((0, 400), (137, 611), (900, 1500), (0, len(slots))):
        for s, t in enumerate(goal):
            share = t / sum(goal) * (min(b, len(slots)) - a)
            assert abs(sum(slots[i] == s for i in range(a, min(b, len(slots)))) - share) < 4
