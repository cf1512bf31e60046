"""HyperMinHash near-duplicates against all pairs in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from longitrack.llm import hyperminhash as hmh

NAMES = ["id", "same", "n", "class", "registers", "members", "key", "component", "comp", "size"]


def shingles(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))} if ws else set()


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, len(sets[i]), least.get(find(i)), k == least.get(find(i))) for i, (k, _) in enumerate(rows))


def found(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in NAMES))
    return Counter(tuple(r) for r in hmh.near_duplicates(docs, **kw).collect())


def family(rnd, vocab, size, edits, length):
    base = rnd.choices(vocab, k=length)
    for _ in range(size):
        w = list(base)
        for _ in range(edits()):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        yield " ".join(w)


VOCABULARY = [f"w{i}" for i in range(4000)] + ["Äpfel", "ſ", "ÉA"]


@pytest.mark.parametrize("block", [1024, 5])
def test_families_against_all_pairs(spark, block):
    rnd = random.Random(3)
    texts = []
    for length in (4, 6, 9, 15, 40, 120, 400):
        for size in (1, 2, 6, 25):
            # from exact copies to pairs around the threshold and below
            texts += family(rnd, VOCABULARY, size, lambda: rnd.choice([0, 1, 1, 2, max(2, length // 20)]), length)  # noqa: B023
    rows = list(enumerate(t.title() if i % 3 == 0 else t for i, t in enumerate(texts)))
    assert found(spark, rows, block=block) == brute(rows)


def test_a_large_family_near_the_threshold(spark):
    rnd = random.Random(4)
    rows = list(enumerate(family(rnd, VOCABULARY, 150, lambda: rnd.choice([2, 3, 4]), 100)))
    for block in (1024, 16):
        assert found(spark, rows, block=block) == brute(rows)


def test_a_shared_passage_links_nothing(spark):
    rnd = random.Random(5)
    passage = rnd.choices(VOCABULARY, k=100)
    rows = [(i, " ".join(rnd.choices(VOCABULARY, k=60) + passage)) for i in range(80)]
    got = found(spark, rows, block=16)
    assert got == brute(rows) and all(kept for _, _, _, kept in got)


def test_odd_rows(spark):
    long = "long " * 5 + " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "ONE"), (6, "a b c"), (7, "a b c"), (7, "a b c"), (7, "other words in here now"), (None, "a b c"), (None, "only without id"), (8, long), (9, long + " end"), (10, "É é"), (11, "é é"), (None, None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == Counter()


def test_estimates_of_planted_similarities():
    rng = np.random.default_rng(6)
    for n in (50, 1000, 40_000):
        for shared in (0.0, 0.5, 0.8, 0.95):
            got = []
            for _ in range(60):
                k = round(n * 2 * shared / (1 + shared))
                pool = rng.integers(0, 1 << 64, 2 * n - k, dtype=np.uint64)
                x, y = (np.unique(p) for p in (pool[:n], pool[n - k :]))
                est, some = hmh.estimate(hmh.registers(x)[None], hmh.registers(y)[None], np.array([n]), np.array([n]))
                got.append(est[0])
            assert abs(np.mean(got) - shared) < 0.04


def test_registers_of_known_hashes():
    top = np.uint64(1) << np.uint64(56)  # the highest bit after the bucket's seven
    assert hmh.registers(np.array([0], np.uint64))[0] == 54 << 10
    r = hmh.registers(np.array([top], np.uint64))
    assert r[0] == 1 << 10 and (r[1:] == 0).all()
    assert hmh.registers(np.array([top + (top >> np.uint64(1))], np.uint64))[0] == (1 << 10) + 512
    assert hmh.registers(np.array([(np.uint64(5) << np.uint64(57)) + (top >> np.uint64(3))], np.uint64))[5] == 4 << 10


def test_chance_matches_are_taken_off():
    """With one mantissa bit's worth of range registers of different sets often match; the table knows how often."""
    rng = np.random.default_rng(8)
    sizes, table = hmh._chance_table()
    n = 1 << 14
    same = np.mean([(hmh.registers(np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))) == hmh.registers(np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)))).sum() for _ in range(400)])
    assert abs(same - table[14]) < 4 * np.sqrt(table[14] / 400) + 0.01
