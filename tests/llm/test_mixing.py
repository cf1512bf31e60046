"""Mixing: targets by plain resharing, permutations, bounds and reruns."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from longitrack.llm import mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > 3 * sizes[s]]
        if not over:
            return {**got, **{s: float(v) for s, v in capped.items()}}
        capped |= {s: 3 * sizes[s] for s in over}


def rows(seed):
    rnd = random.Random(seed)
    out = []
    for i in range(300):
        s = rnd.choice(["a", "a", "a", "b", "c", "Z", "é", None, "tiny", ""])
        n = rnd.choice([0, 1, 5, 40, 700]) if s != "tiny" else 1
        out.append((i, s, None if i == 17 else " ".join(["w"] * n) + rnd.choice(["", "\n", " \t"])))
    return out + [(5, "a", "x y z")] * 4 + [(None, "b", "x y"), (None, None, "x")]


def test_targets_and_bounds(spark):
    for seed in range(2):
        data = rows(seed)
        docs = spark.createDataFrame([(i, s, t, 1, 2) for i, s, t in data], "doc_id long, source string, text string, size int, block int")
        got = mixing.mix(docs).collect()
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes = defaultdict(int)
        for _, s, t in data:
            sizes[s] += size(t)
        want = plain_targets(sizes)
        assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, _, t in data)
        assert all(0 <= r.taken <= 3 * r["size"] for r in got)
        by = {round(want[s], 6): s for s in want}
        for key in {(r.source_size, round(r.target, 6)) for r in got}:
            assert any(abs(want[s] - key[1]) < 1e-5 and sizes[s] == key[0] for s in want), (key, by)
        per_source = defaultdict(int)
        for r in got:
            per_source[(r.source_size, r.target)] += r.taken
        for (n, target), taken in per_source.items():
            alike = sum(sizes[s] == n and abs(want[s] - target) < 1e-5 for s in want)
            assert abs(taken - alike * target) <= alike * (mixing.BLOCK + 1)
        assert Counter(mixing.mix(docs.repartition(7)).collect()) == Counter(got)


def test_permutations_and_slots(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long"), 12).alias("y")).collect()
        assert sorted(r.y for r in got) == list(range(n))
    goals = spark.createDataFrame([("a", 0, 10_000, 25_000.0), ("b", 1, 100, 30.0), ("c", 2, 0, 0.0)], "source string, no int, source_size long, target double")
    slots = mixing.slots(goals, block=100, shard_slots=50).collect()
    times = Counter(r.block for r in slots if r.no == 0)
    assert set(times) == set(range(100)) and set(times.values()) == {2, 3} and sum(r.words for r in slots if r.no == 0) == 25_000
    assert [(r.block, r.words) for r in slots if r.no == 1] == [(0, 30)]
    assert Counter(r.shard for r in slots) == {0: 50, 1: 50, 2: 50, 3: 50, 4: 50, 5: 1}


def test_draws_are_multinomial_and_totals_the_targets(spark):
    goals = spark.createDataFrame([(f"s{i}", i, 100 * n, 100.0 * n) for i, n in enumerate((20_000, 15_000, 5_000, 1, 0))], "source string, no int, source_size long, target double")
    due = {r.no: r.n for r in mixing.allotted(goals, 100).collect()}
    assert due == {0: 20_000, 1: 15_000, 2: 5_000, 3: 1}
    counts = defaultdict(int, {(r.shard, r.no): r["count"] for r in mixing.drawn(mixing.allotted(goals, 100), 100).collect()})
    total = sum(due.values())
    for no, n in due.items():
        p = n / total
        each = [counts[k, no] for k in range(400)]
        mean = sum(each) / 400
        assert abs(mean - 100 * p) < 5 * (100 * p * (1 - p) / 400) ** 0.5 + 1e-9
        if no < 3:
            assert 0.7 < sum((x - mean) ** 2 for x in each) / 399 / (100 * p * (1 - p)) < 1.4
    assert all(sum(counts[k, no] for no in due) == 100 for k in range(400))
    got = mixing.slots(goals, 100, 100).collect()
    # every slot of every source once, each block once, and shards as full as they were drawn
    assert Counter((r.no, r.slot) for r in got) == {(no, j): 1 for no, n in due.items() for j in range(n)}
    assert Counter((r.no, r.block) for r in got) == {(no, j): 1 for no, n in due.items() for j in range(n)}
    assert Counter(r.shard for r in got) == {k: 100 for k in range(400)} | {400: 1}
    moved = sum(max(0, counts[k, no] - n) for (k, no), n in Counter((r.shard, r.no) for r in got).items())
    assert moved <= 2 * total**0.5


def plain_mix(spark, data, goals, block, seed):
    """taken by (id, source, size, copy) in plain Python, from the slots and the order of documents alone."""
    texts = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in data]
    ids = spark.createDataFrame([(i,) for i in {i for i, _, _ in texts}], "i long").select("i", F.xxhash64(F.lit(seed), "i").alias("h")).collect()
    h = {r.i: r.h for r in ids}
    groups = max(1, int(len(texts) ** 0.5))
    out = Counter()
    slots = mixing.slots(spark.createDataFrame(goals, "source string, no int, source_size long, target double"), block, seed=seed).collect()
    for g in goals:
        mine = sorted((x for x in texts if x[1] == g.source), key=lambda x: (h[x[0]] % groups, h[x[0]], x[0] is not None, x[0] or 0, x[2]))
        stream = [k for k, x in enumerate(mine) for _ in range(x[2])]
        got = Counter()
        for r in slots:
            if r.no == g.no:
                got.update(stream[r.block * block : r.block * block + min(block, r.words)])
        out.update((mine[k][0], g.source_size, mine[k][2], got[k]) for k in range(len(mine)))
    return out


def test_taken_equals_plain_python(spark):
    data = rows(3)
    docs = spark.createDataFrame([(i, s, t) for i, s, t in data], "doc_id long, source string, text string")
    goals = mixing.targets(mixing.counted(docs, "doc_id", "source", "text")).collect()
    want = plain_mix(spark, data, goals, 64, 7)
    got = Counter((r.doc_id, r.source_size, r["size"], r.taken) for r in mixing.mix(docs, block=64, seed=7).collect())
    assert got == want
    held = Counter()
    for r in mixing.shards(docs, block=64, seed=7, shard_slots=16).collect():
        assert 0 <= r.start < r.end
        held[r.doc_id] += r.end - r.start
    assert held == Counter({i: n for i in {w[0] for w in want} if (n := sum(k[3] * c for k, c in want.items() if k[0] == i))})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(docs).count() == 0
    docs = spark.createDataFrame([(1, "a", None), (2, None, "  ")], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
