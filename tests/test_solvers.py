"""Solvers and report operators against brute force."""

import itertools
import random

import numpy as np
import pytest

from longitrack.operators import reports, solvers


def cover_cost(order, pairs):
    """The least cost of covering detections by paths, by trying every set of links."""
    best = 10.0 * len(order)
    for n in range(len(pairs) + 1):
        for some in itertools.combinations(pairs, n):
            if len({(p[0], p[2]) for p in some}) == n == len({(p[1], p[3]) for p in some}):
                best = min(best, 10.0 * (len(order) - n) + sum(c + (t - s - 1) for s, t, _, _, c in some))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_path_cover_is_optimal(spark, seed):
    r = random.Random(seed)
    found = [(s, x) for s in range(3) for x in range(2)]
    pairs = [(s, t, x, y, round(r.uniform(0, 8), 3)) for s, t in ((0, 1), (1, 2), (0, 2)) for x in range(2) for y in range(2)]
    d = spark.createDataFrame([("m", *f) for f in found], "subject string, session_index int, roi long")
    p = spark.createDataFrame([("m", *q) for q in pairs] + [("m", 0, 1, 0, 9, 0.1), ("m", 0, 1, 0, 0, 1e6)], "subject string, session_a int, session_b int, roi_a long, roi_b long, cost double")
    got = sorted((x.track_id, x.session_index, x.roi) for x in solvers.path_cover(d, p).collect())
    assert sorted((s, x) for _, s, x in got) == found
    cost = {(s, x, t, y): c for s, t, x, y, c in pairs}
    total = 0.0
    for _, g in itertools.groupby(got, key=lambda x: x[0]):
        g = list(g)
        total += 10.0 + sum(cost[a[1], a[2], b[1], b[2]] + b[1] - a[1] - 1 for a, b in itertools.pairwise(g))
    assert total == pytest.approx(cover_cost(found, [q for q in pairs if q[4] <= 6.0]))


def test_path_cover_without_pairs(spark):
    d = spark.createDataFrame([("m", 0, 1), ("m", 1, 1), ("m", 1, 1)], "subject string, session_index int, roi long")
    p = spark.createDataFrame([], "subject string, session_a int, session_b int, roi_a long, roi_b long, cost double")
    assert sorted((x.track_id, x.session_index) for x in solvers.path_cover(d, p).collect()) == [(0, 0), (1, 1)]
    assert solvers.path_cover(d.limit(0), p).count() == 0
    other = spark.createDataFrame([("n", 0, 1, 1, 1, 0.5)], p.schema)
    assert solvers.path_cover(d, other).count() == 2


@pytest.mark.parametrize("seed", range(4))
def test_k_best(seed):
    cost = np.random.default_rng(seed).uniform(0, 5, (3, 3))
    cost[0, 1] = np.inf
    every = []
    for row in itertools.product(range(-1, 3), repeat=3):
        used = [c for c in row if c >= 0]
        if len(set(used)) == len(used):
            every.append((sum(2.0 if c < 0 else cost[i, c] for i, c in enumerate(row)), row))
    every = sorted(e for e in every if np.isfinite(e[0]))
    got = solvers.k_best(cost, 2.0, 12)
    assert [g[1] for g in got] == [e[1] for e in every[:12]]
    assert np.allclose([g[0] for g in got], [e[0] for e in every[:12]])


def test_k_best_assignments(spark):
    cells = spark.createDataFrame([(0, 1, 1, 1.0), (0, 1, 2, 2.0), (0, 2, 1, 3.0), (0, 2, 2, 9.0)], "e int, roi_a long, roi_b long, cost double")
    got = [(x.hypothesis, x.total, x.roi_a, x.roi_b) for x in solvers.k_best_assignments(cells, ["e"], 2, 4.0).orderBy("hypothesis", "roi_a").collect()]
    assert got == [(0, 5.0, 1, 1), (0, 5.0, 2, None), (1, 5.0, 1, 2), (1, 5.0, 2, 1)] or got == [(0, 5.0, 1, 2), (0, 5.0, 2, 1), (1, 5.0, 1, 1), (1, 5.0, 2, None)]


def test_relink(spark):
    t = spark.createDataFrame([("m", 1, 0, 1, False), ("m", 1, 1, 1, True), ("m", 1, 2, 1, None), ("m", 2, 0, 2, False), ("m", 2, 1, 2, True), ("m", 3, 0, 3, True)], "subject string, track_id long, session_index int, roi long, flagged boolean")
    rows = [(0, 1, 1, 1, 3.0), (0, 1, 1, 5, 1.0), (0, 1, 1, 2, 0.1), (1, 2, 1, 1, 1.0), (1, 2, 5, 1, 1.5), (0, 1, 2, 2, 1.0), (0, 1, 2, 6, 0.9)]
    p = spark.createDataFrame([("m", *r) for r in rows], "subject string, session_a int, session_b int, roi_a long, roi_b long, cost double")
    got = {(x.track_id, x.session_index): (x.roi, x.relinked) for x in solvers.relink(t, p).collect()}
    assert solvers.relink(t.limit(0), p).count() == 0
    # 5 saves 1.5 for the first track, whose cheapest ROI 2 is taken; 6 saves too little for the second.
    assert got == {(1, 0): (1, False), (1, 1): (5, True), (1, 2): (1, False), (2, 0): (2, False), (2, 1): (2, False), (3, 0): (3, False)}


@pytest.mark.parametrize("seed", range(3))
def test_disjoint_paths(spark, seed):
    r = random.Random(seed)
    paths = [(i, round(r.uniform(-1, 5), 3), [str(r.randrange(8)) for _ in range(3)]) for i in range(9)]
    good = [p for p in paths if p[1] > 0]
    best = max(sum(p[1] for p in some) for n in range(len(good) + 1) for some in itertools.combinations(good, n) if all(not set(a[2]) & set(b[2]) for a, b in itertools.combinations(some, 2)))
    df = spark.createDataFrame([("m", *p) for p in paths], "subject string, path_id long, score double, observations array<string>")
    got = [x.path_id for x in solvers.disjoint_paths(df).collect()]
    assert sum(paths[i][1] for i in got) == pytest.approx(best)
    assert all(not set(paths[a][2]) & set(paths[b][2]) for a, b in itertools.combinations(got, 2))


@pytest.mark.parametrize("most", [1, 2, 3])
def test_planned_splits(spark, most):
    r = random.Random(most)
    risks = {t: [r.randrange(0, 20) / 8 for _ in range(9)] for t in range(12)}
    df = spark.createDataFrame([(t, i, i + 1, v) for t, vs in risks.items() for i, v in enumerate(vs)], "track_id int, session_a int, session_b int, risk double")
    got: dict = {}
    for x in reports.planned_splits(df, most).collect():
        got.setdefault(x.track_id, []).append(x.session_b)
    for t, vs in risks.items():
        plans = [()] + [c for n in range(1, most + 1) for c in itertools.combinations(range(1, 10), n) if all(b - a >= 2 for a, b in itertools.pairwise((0, *c, 10))) and all(vs[b - 1] >= 1.5 for b in c)]
        gain = lambda c, vs=vs: sum(vs[b - 1] - 0.25 for b in c)
        assert tuple(sorted(got.get(t, []))) in plans
        assert gain(got.get(t, [])) == max(map(gain, plans))


def test_running_sums(spark):
    r = random.Random(5)
    rows = sorted(((float(s), r.randrange(9)) for s in r.sample(range(10000), 500)), reverse=True)
    got = {x.s: x.cum_n for x in reports.running(spark.createDataFrame(rows, "s double, n long"), "s", ["n"], 16).collect()}
    assert [got[s] for s, _ in rows] == list(itertools.accumulate(n for _, n in rows))


def test_fixed_precision_of_nothing(spark):
    p, k = spark.createDataFrame([("1,2", 0.5)], "identity string, score double"), spark.createDataFrame([("3,4",)], "identity string")
    assert [tuple(x) for x in reports.at_fixed_precision(p, k, (0.9,)).collect()] == [(0.9, 0, 0, 1.0, 0.0, None)]
    assert [tuple(x) for x in reports.at_fixed_precision(p.limit(0), k.limit(0), (0.9,)).collect()] == [(0.9, 0, 0, 1.0, 1.0, None)]


def test_sign_p_value(spark):
    df = spark.createDataFrame([(0, 4), (3, 4), (4, 4), (0, 0), (60, 100)], "k int, n int")
    from pyspark.sql import functions as F

    got = [x.p for x in df.select(reports.sign_p_value(F.col("k"), F.col("n")).alias("p")).collect()]
    assert got[3] is None and got[:3] == pytest.approx([1.0, 5 / 16, 1 / 16]) and got[4] == pytest.approx(0.028443966820490395)


def test_scan_tracks_over_a_gap(spark):
    seeds = spark.createDataFrame([("m", 1, 0, 1), ("m", 2, 0, 2)], "subject string, track_id long, session_index int, roi long")
    # Greedily track 1 would take ROI 5, which track 2 needs more; track 2 is missing in session 1 and comes back.
    rows = [(0, 1, 1, 5, 0.9), (0, 1, 1, 6, 0.8), (0, 1, 2, 5, 0.6), (1, 2, 5, 8, 1.0), (1, 2, 6, 7, 0.9), (0, 1, 1, 9, 0.1)]
    pairs = spark.createDataFrame([("m", *r) for r in rows], "subject string, session_a int, session_b int, roi_a long, roi_b long, score double")
    got = solvers.scan_tracks(seeds, pairs).collect()
    assert {(r.track_id, r.session_index, r.roi) for r in got} == {(1, 0, 1), (1, 1, 6), (1, 2, 7), (2, 0, 2), (2, 1, 5), (2, 2, 8)}
    assert got[0].total == pytest.approx(-0.8 - 0.6 - 1.0 - 0.9)
    skip = spark.createDataFrame([("m", 0, 2, 2, 8, 2.0), ("m", 0, 1, 1, 5, 0.5)], pairs.schema)
    got = solvers.scan_tracks(seeds, skip, max_gap=2).collect()
    assert {(r.track_id, r.session_index, r.roi) for r in got} == {(1, 0, 1), (1, 1, 5), (2, 0, 2), (2, 2, 8)}
    assert got[0].total == pytest.approx(-0.5 + 2.0 + 2.0 + 1.0 - 2.0)
    assert solvers.scan_tracks(seeds, pairs.limit(0)).count() == 2 and solvers.scan_tracks(seeds.limit(0), pairs).count() == 0


def test_chosen_edits(spark):
    edits = spark.createDataFrame([("m", 1, 1.0, ["a", "b"]), ("m", 2, 0.8, ["a"]), ("m", 3, 0.8, ["b"]), ("m", 4, 0.2, ["c"])], "subject string, path_id long, score double, observations array<string>")
    assert sorted(r.path_id for r in solvers.chosen_edits(edits, 0.3).collect()) == [2, 3]
    assert [r.path_id for r in solvers.chosen_edits(edits, 0.7).collect()] == [1]
