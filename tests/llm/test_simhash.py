"""SimHash against brute force over all pairs."""

import random

import xxhash

from longitrack.llm import simhash
from longitrack.llm.components import connected_components


def plain(text):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    ws = [w for w in t.split(" ") if w]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [(i, plain(t)) for i, t in rows]
    comp = {i: i for i, _ in fps}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, f in fps:
        for j, g in fps:
            if (f ^ g).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (f, root(i)) for i, f in fps}


def corpus():
    rnd = random.Random(5)
    vocab = ["w%d" % i for i in range(300)] + ["Äpfel", "ſ", "ÉA"]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 30, 200, 800]))]
        for _ in range(rnd.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(w).title() if g % 2 else "\n".join(w)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \t\n", "one", "One", "x y z", "long " * 30000])]
    return rows


def result(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    return {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs, **kw).collect()}


def test_fingerprints_and_components(spark):
    rows = corpus()
    assert result(spark, rows) == brute(rows)


def test_crowded_segments_give_the_same_components(spark):
    rows = corpus()
    assert result(spark, rows, pairs_up_to=1) == brute(rows)


def test_planted_fingerprints_at_each_distance(spark):
    rnd = random.Random(9)
    fps = []
    for _ in range(40):
        x = rnd.getrandbits(64)
        fps.append(x)
        for d in range(1, 7):
            y = x
            for b in rnd.sample(range(64), d):
                y ^= 1 << b
            fps.append(y)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for limit in (1, 1000):
        got = connected_components(simhash.links(df, limit))
        parts = {r.node % (1 << 64): r.component for r in got.collect()}
        for f in fps:
            for g in fps:
                if f < g and (f ^ g).bit_count() <= 4:
                    assert parts[f] == parts[g]


def test_empty_repeated_and_null_ids(spark):
    assert result(spark, []) == {}
    docs = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(7, 7), (7, 7), (None, 7), (None, None)]
    assert sorted(r.doc_id or 0 for r in simhash.one_of_each(docs).collect()) == [0, 7]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(500, 500), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 160)}, 500: 500}
