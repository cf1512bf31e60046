"""Hard negatives against all pairs in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from longitrack.llm import negatives


def brute(rows, step=5, positives=5, few=3):
    """rows: (vec_id, vector, label) that take part, no two alike."""
    used = sorted({(i, tuple(math.floor(x * 256) for x in v), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for a, va, la in used:
        if a % step:
            continue
        score = lambda v: sum(x * y for x, y in zip(va, v, strict=True))  # noqa: B023, E731
        there = [(-score(v), i, lab) for i, v, lab in used if i != a and len(v) == len(va)]
        for s, p, _ in sorted(x for x in there if x[2] == la)[:positives]:
            s = -s
            found = sorted(x[:2] for x in there if x[2] != la and 50 * s <= -100 * x[0] <= 95 * s)[:few]
            out += [(a, p, k + 1, n, s, -m) for k, (m, n) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, step=5, kind="double", **kw):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").select("*", *(F.lit(1).alias(c) for c in ("id", "v", "norm", "key", "windows", "slot", "score")))
    return sorted(tuple(r) for r in negatives.hard_negatives(negatives.usable(df), F.col("id") % step == 0, **kw).collect())


def vectors(seed, n, dim=8, labels=4, scale=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(3)]
    return [(i, [scale * rnd.choice([0.3, 1, 2]) * (c + rnd.gauss(0, 0.5)) for c in rnd.choice(centres)], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("components", [1 << 17, 200])
def test_against_all_pairs(spark, components):
    rows = vectors(1, 300)
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows, components=components) == want


def test_ties_and_one_frequent_vector(spark):
    rnd = random.Random(2)
    common = [0.5, 0.5, 0.0, 0.25]
    rows = [(i, common if rnd.random() < 0.4 else [rnd.choice([0.0, 0.5, 1.0]) for _ in range(4)], rnd.randrange(3)) for i in range(240)]
    assert mined(spark, rows, components=300) == brute(rows)


def test_large_components_stay_exact(spark):
    for scale, n in ((1e5, 60), (1e14, 40)):
        rows = vectors(3, n, dim=4, labels=2, scale=scale)
        assert mined(spark, rows) == [r for r in brute(rows) if max(abs(r[4]), abs(r[5])) < 1 << 63]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(4, 60, labels=2)
    odd = [(100, None, 1), (105, [1.0, nan], 1), (110, [1.0, inf] * 4, 0), (115, [None] * 8, 1), (120, [0.1] * 8, None), (None, [1.0] * 8, 1), (125, [], 1), (126, [], 0), (130, [0.5, 0.5], 1), (131, [0.5, 0.25], 1), (132, [0.5, 0.125], 0), (135, [0.0] * 8, 1)]
    assert mined(spark, rows + odd + rows[:10], components=300) == brute(rows + odd)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(5, [1.0], 1)]) == []
    # negative scores alone: no window holds anything
    assert mined(spark, [(5, [1.0], 1), (6, [-1.0], 1), (7, [-0.6], 0)]) == []


def test_floats_and_few_labels(spark):
    import numpy as np

    rows = [(i, [float(np.float32(x)) for x in v], 1 if i % 9 else 0) for i, v, _ in vectors(5, 150)]
    assert mined(spark, rows, kind="float") == brute(rows)


def test_an_id_with_two_vectors_is_an_anchor_with_each(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [0.75, 0.0], 0), (9, [0.0, 0.75], 0)]
    assert mined(spark, rows) == brute(rows)
