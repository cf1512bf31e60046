"""Local evidence, priors and paths on small cases with results worked out by hand or by plain Python."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from longitrack.functions import INADMISSIBLE
from longitrack.operators import evidence, paths, priors


def test_shift_finds_the_smallest_best_offset(spark):
    a = spark.createDataFrame([(0, 1, x, y, 1.0) for x in (2, 3) for y in (2, 3)], "g int, roi_a int, x int, y int, w double")
    b = spark.createDataFrame([(0, 7, x, y, 1.0) for x in (3, 4) for y in (2, 3)], "g int, roi_b int, x int, y int, w double")
    r = evidence.shifted_overlaps(a, b, "roi_a", "roi_b", ["g"], 1, (8, 8)).first()
    assert (r.shifted_iou, r.shift_dy, r.shift_dx) == (1.0, 0, -1)
    assert r.shifted_cosine == pytest.approx(1.0)
    assert evidence.shift_offsets(1)[:3] == [(0, 0), (-1, 0), (0, -1)]


def test_shift_loses_pixels_outside(spark):
    a = spark.createDataFrame([(0, 1, 0, 0, 1.0)], "g int, roi_a int, x int, y int, w double")
    b = spark.createDataFrame([(0, 7, 1, 0, 1.0), (0, 7, 0, 0, 1.0)], "g int, roi_b int, x int, y int, w double")
    r = evidence.shifted_overlaps(a, b, "roi_a", "roi_b", ["g"], 1, (4, 4)).first()
    assert (r.shifted_iou, r.shift_dy, r.shift_dx) == (1.0, 0, -1)  # the pixel that left counts in no area
    assert r.shifted_cosine == pytest.approx(1 / math.sqrt(2))  # but in the norm


def test_outline_cost(spark):
    a = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "roi_a int, x int, y int")
    b = spark.createDataFrame([(7, 3, 1)], "roi_b int, x int, y int")
    pairs = spark.createDataFrame([(1, 7), (1, 8)], "roi_a int, roi_b int")
    got = {r.roi_b: r.outline_cost for r in evidence.outline_cost(a, b, pairs, "roi_a", "roi_b", 2.0, (5, 6)).collect()}
    s = math.sqrt(2) - 1
    assert got[7] == pytest.approx(0.5 * ((3 + s + 2 + s) / 2 + 2 + s) / 2)
    assert got[8] == pytest.approx(11 / 2)


def test_lone_and_missing_points(spark):
    pts = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 3.0, 4.0), (1, 3, 0.0, 0.0)], "g int, roi int, x double, y double")
    d = {r.roi: tuple(r)[2:] for r in evidence.density(pts, ["g"], 5.0).collect()}
    assert d == {1: (1, 1.0, 5.0, 5.0), 2: (1, 1.0, 5.0, 5.0), 3: (0, 0.0, 0.0, 0.0)}
    s = {r.roi: r.signature for r in evidence.signatures(pts, ["g"], 2, normalized=False).collect()}
    assert s == {1: [5.0, 5.0], 2: [5.0, 5.0], 3: [0.0, 0.0]}
    cost = spark.range(1).select(evidence.constellation_cost(F.array(F.lit(1.0), F.lit(4.0)), F.array(F.lit(2.0), F.lit(1.0)), 2.0)).first()[0]
    assert cost == 1.0


def test_flat_patches_are_invalid(spark):
    img = spark.createDataFrame([(0, x, y, float(x)) for x in range(5) for y in range(5)], "g int, x long, y long, v double")
    flat = img.withColumn("v", F.lit(1.0))
    pt = spark.createDataFrame([(0, 1, 2.5, 2.0)], "g int, roi int, x double, y double")
    pairs = spark.createDataFrame([(0, 1, 1)], "g int, roi_a int, roi_b int")
    r = evidence.patch_correlations(img, pt, img, pt, pairs, ["g"], 1).first()
    assert r.patch_valid and r.patch_correlation == pytest.approx(1.0)
    r = evidence.patch_correlations(img, pt, flat, pt, pairs, ["g"], 1).first()
    assert (r.patch_valid, r.patch_correlation) == (False, 0.0)


def test_feature_distance_without_shared_features(spark):
    row = "g int, roi int, name string, value double"
    a = spark.createDataFrame([(0, 1, "p", 1.0), (0, 2, "q", float("nan"))], row)
    b = spark.createDataFrame([(0, 5, "p", 3.0)], row)
    pairs = spark.createDataFrame([(0, 1, 5), (0, 2, 5)], "g int, roi_a int, roi_b int")
    got = {r.roi_a: r.feature_distance for r in evidence.feature_distance(a, b, pairs, ["g"]).collect()}
    assert got == {1: 2.0, 2: 1.0}  # deviation 1 of two values; nothing shared


def test_priors_leave_inadmissible_pairs(spark):
    df = spark.createDataFrame([(1.0,), (INADMISSIBLE,), (None,), (float("nan"),)], "cost double")
    got = [r[0] for r in df.select(priors.edge_prior(F.col("cost"), gap=F.lit(3), bias=0.5, gap_weight=0.25, terms=[(2.0, F.lit(None))])).collect()]
    assert got == [2.0, INADMISSIBLE, INADMISSIBLE, INADMISSIBLE]


def test_intercept_and_offset(spark):
    one = spark.range(1)
    none = F.lit(None).cast("double")
    got = one.select(priors.intercept(F.lit(3), F.lit(2.0), none, F.lit(float("nan")), F.lit(0.5), none)).first()[0]
    assert got == pytest.approx(-0.3 - 0.2 - 0.25 - 0.5)
    assert one.select(priors.intercept(F.lit(1), F.lit(1e9), none, none, none, none)).first()[0] == -5.0
    assert one.select(priors.context_offset(F.lit(2), F.lit(2.0), F.lit(0.75), F.lit(0.5))).first()[0] == pytest.approx(0.75)


def test_reliability_penalties(spark):
    r = spark.range(1).select(priors.edge_reliability(gated=F.lit(False), rank=F.lit(2.0), activity=[F.lit(None), F.lit(0.0)], rmse=F.lit(1.0), valid=F.lit(0.5))).first()[0]
    assert r == pytest.approx(math.exp(-(0.75 + 0.25 + 0.25 + 1.0)))


def test_margin_shortfall_of_ties_and_lone_cells(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 3, 5.0)], "roi_a int, roi_b int, cost double").withColumn("e", F.lit(0))
    got = {(r.roi_a, r.roi_b): r.cost for r in priors.margin_shortfall(df, ["e"], 1.0, 0.5).collect()}
    assert got == {(1, 1): 1.5, (1, 2): 1.5, (2, 3): 5.0}


def test_confident_anchors_are_topped_up(spark):
    df = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.1), (0, 2, 1, 0.5), (0, 2, 2, 0.45)], "e int, roi_a int, roi_b int, posterior double")
    got = {(r.roi_a, r.roi_b): r.confident for r in priors.confident_anchors(df, ["e"], 0.8, 0.2, 2).collect()}
    assert got == {(1, 1): True, (2, 1): False}


def test_gap_tracks_against_all_paths(spark):
    links = [(0, 1, 1, 1), (0, 2, 1, 5), (1, 2, 1, 9), (2, 3, 5, 6), (3, 4, 6, 7), (0, 1, 2, 3), (0, 1, 2, 2), (1, 3, 8, 6)]
    df = spark.createDataFrame([("s", *x) for x in links + links[:1]], "subject string, session_a int, session_b int, roi_a int, roi_b int")

    def best(s, r):
        ways = [(1 + len(t), (t[-1][0] if t else b), s - b, -y, [(b, y), *t]) for a, b, x, y in links if (a, x) == (s, r) for t in [best(b, y)]]
        return max(ways)[4] if ways else []

    got = {(r.track_id, r.session_index, r.roi) for r in paths.gap_tracks(df, 2).collect()}
    want = {(r, *n) for r in {x for a, _, x, _ in links if a == 0} for n in [(0, r), *best(0, r)]}
    assert got == want


def test_hypotheses_against_enumeration(spark):
    edges = [(s, s + 1, x, y, 1.0 + ((3 * x + 5 * y + s) % 7) / 8) for s in range(2) for x in range(3) for y in range(3) if (x + y + s) % 4]
    df = spark.createDataFrame(edges, "session_a int, session_b int, roi_a int, roi_b int, cost double")
    seeds = spark.createDataFrame([(0,), (1,), (2,)], "roi int")
    out = [((r,), 0.0) for r in range(3)]
    for s in range(2):
        nxt = []
        for row, c in out:
            ways = sorted((k, y) for a, _, x, y, k in edges if a == s and x == row[-1])[:2]
            nxt += [((*row, y), c + k) for k, y in ways] or [((*row, -1), c)]
        out = sorted(nxt, key=lambda h: (h[1], h[0]))[:5]
    got = [(tuple(r.row), r.cost) for r in paths.hypotheses(df, seeds, 3, 2, 5).orderBy("cost", "row").collect()]
    assert got == out


def test_geometry_issue_and_threshold(spark):
    xs = [0.0, 1.0, 2.0, 40.0, 4.0, 5.0, 6.0, 7.0]
    df = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate(xs)], "track_id int, session_index int, x double, y double")
    assert [r.session_index for r in paths.geometry_issues(df).collect()] == [3]
    two = spark.createDataFrame([("a", v) for v in (0.0, 0.1, 0.9, 1.0)] + [("b", 2.0)] * 3, "k string, v double")
    got = {r.k: r.threshold for r in paths.otsu(two, ["k"], "v").collect()}
    assert got == {"a": 25.5 / 256, "b": math.nextafter(2.0, 0.0)}  # the centre of the bin that holds 0.1
    hills = [0.2 + 0.01 * (i % 5) for i in range(40)] + [0.8 + 0.01 * (i % 5) for i in range(40)] + [0.5]
    many = spark.createDataFrame([("c", v) for v in hills] + [("d", 0.0), ("d", 0.5), ("e", 0.0)], "k string, v double")
    got = {r.k: r.threshold for r in paths.valley(many, ["k"], "v").collect()}
    assert 0.24 < got["c"] < 0.8 and 0.0 < got["d"] < 0.5 and got["e"] == 0.0


def test_empty_tables(spark):
    links = spark.createDataFrame([], "subject string, session_a int, session_b int, roi_a int, roi_b int")
    assert paths.gap_tracks(links, 2).count() == 0
    pts = spark.createDataFrame([], "g int, roi int, x double, y double")
    assert evidence.density(pts, ["g"], 1.0).count() == 0 == evidence.signatures(pts, ["g"], 2).count()
    assert list(itertools.chain(paths.fitted(spark.createDataFrame([], "track_id int, session_index int, x double, y double")).collect())) == []


def test_blocks_of_small_images_are_like_joins(spark, monkeypatch):
    """Both ways of comparing give the same, over several blocks and with pixels outside the image."""
    import random

    from longitrack.operators import dense

    r = random.Random(1)
    cells = {(g, i, r.randrange(-1, 6), r.randrange(-1, 5)) for g in (1, 2) for i in range(12) for _ in range(6)}
    rows = [(g, 100 * g + i, x, y, float(r.randrange(1, 4))) for g, i, x, y in sorted(cells)]
    a = spark.createDataFrame(rows, "g int, roi_a long, x long, y long, w double")
    b = spark.createDataFrame([(g, i + 50, x, y, 2 * w) for g, i, x, y, w in rows], "g int, roi_b long, x long, y long, w double")
    names = ["g", "roi_a", "roi_b", "shifted_iou", "shift_dy", "shift_dx", "shifted_cosine"]
    of = lambda: sorted((*x[:6], round(x[6], 9)) for x in evidence.shifted_overlaps(a, b, "roi_a", "roi_b", ["g"], 1, (4, 5)).select(names).collect())
    monkeypatch.setattr(dense, "BLOCK", 5)
    blocks = of()
    monkeypatch.setattr(dense, "PIXELS", 3)
    met = a.join(b.withColumnRenamed("w", "w_b"), ["g", "x", "y"]).groupBy("g", "roi_a", "roi_b")
    want = met.agg(F.count(F.lit(1)).alias("inter"), F.sum(F.least("w", "w_b")).alias("min_sum"), F.sum(F.col("w") * F.col("w_b")).alias("dot"))
    got = dense.touching(a, b, ["g"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert blocks == of() and blocks
    assert "FlatMapCoGroups" in str(bundled(spark)._jdf.queryExecution().analyzed())


def bundled(spark):
    from longitrack.operators import bundles

    return bundles._touching(spark.createDataFrame([("s", 0, 1, 0, 0, 1.0)], "subject string, session_index int, roi long, x int, y int, w double"), 1, True)
