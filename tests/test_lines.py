"""Blocks of supports against all pairs made one by one, with blocks small enough that a session has several."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from longitrack.operators import bundles, dense, evidence, lines, pairs, ranking
from longitrack.plans import joint, policy, subjects


@pytest.fixture(scope="module")
def pixels(spark):
    r = random.Random(3)
    rows = {(str(g), s, roi, r.randrange(4), r.randrange(4)) for g in range(2) for s in range(4) for roi in range(12) for _ in range(6)}
    return spark.createDataFrame([(*x, 1.0) for x in sorted(rows)], "subject string, session_index int, roi long, x long, y long, w double").cache()


def test_lines_decide_as_all_pairs_do(spark, pixels, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 5)
    edge = ["subject", "session_a", "session_b"]
    everything = [r.asDict() for r in policy.gated_overlaps(pixels, 2, 1.0).collect()]
    some = {(*(r[c] for c in edge), r.roi_a, r.roi_b): r.iou for r in policy.gated_lines(pixels, 2, 1.0).collect()}
    assert len(some) < len(everything)
    for mine, other, k, sign in (("roi_a", "roi_b", 1, 1), ("roi_b", "roi_a", 1, 1), ("roi_a", "roi_b", 2, -1)):
        each = {}
        for r in everything:
            each.setdefault((*(r[c] for c in edge), r[mine]), []).append(r)
        for cells in each.values():
            for r in sorted(cells, key=lambda r: (-r["iou"], sign * r[other]))[:k]:
                assert some[(*(r[c] for c in edge), r["roi_a"], r["roi_b"])] == r["iou"]


def test_no_row_is_made_for_every_pair(spark, pixels, monkeypatch):
    """Local links and the cheapest pairs come without the join of all centres or pixels, which grew with the square."""
    monkeypatch.setattr(lines, "BLOCK", 5)
    bundle = bundles.bundle(pixels, max_gap=2, max_distance=0.8).collect()
    packed = lines.packed(pixels)
    near = {(r.subject, r.session_a, r.session_b, r.roi_a, r.roi_b) for r in lines.cheapest(packed, 2, 0.8, 2).collect()}
    assert len(near) < len(bundle)
    each = {}
    for r in bundle:
        for side in ("roi_a", "roi_b"):
            each.setdefault((r.subject, r.session_a, r.session_b, side, r[side]), []).append(r)
    for (*_, side, _), cells in each.items():
        other = "roi_b" if side == "roi_a" else "roi_a"
        for r in sorted(cells, key=lambda r: (-max(r.iou, 1e-6), r[other]))[:2]:
            assert (r.subject, r.session_a, r.session_b, r.roi_a, r.roi_b) in near
    wanted = spark.createDataFrame([(r.subject, r.session_a, r.session_b, r.roi_a, r.roi_b) for r in bundle], "subject string, session_a int, session_b int, roi_a long, roi_b long")
    told = {tuple(r[c] for c in wanted.columns): (r.inter / (r.area_a + r.area_b - r.inter), r.distance) for r in lines.of_pairs(packed, wanted).collect()}
    assert told == {tuple(r[c] for c in wanted.columns): (r.iou, r.distance) for r in bundle}


def test_first_cells_of_rows():
    c = np.array([[2.0, 1.0, 1.0], [np.inf, np.inf, 3.0]])
    assert [list(map(int, v)) for v in lines.first(c, 2)] == [[0, 1, 0], [1, 2, 2]]
    assert [list(map(int, v)) for v in lines.first(c, 1, greatest=True)] == [[0, 1], [2, 2]]
    assert [list(map(int, v)) for v in lines.up_to(c, 1)] == [[0, 0, 1], [1, 2, 2]]


def test_cheapest_costs_are_the_same_without_the_others(spark, pixels, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 5)
    made = []
    whole = bundles.bundle
    monkeypatch.setattr(bundles, "bundle", lambda *a, **k: made.append(a) or whole(*a, **k))
    got = subjects.registered_costs(pixels, 2, transform="none", reach=0.8, top_k=2)
    assert made[0][5] is not None  # only wanted pairs are made
    everything = subjects.registered_costs(pixels, 2, transform="none", reach=0.8, top_k=None)
    want = pairs.candidates(pairs.ranks(everything, subjects.EDGE, "roi_a", "roi_b"), 2).select(*everything.columns)
    show = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*want.columns).collect())
    assert show(got) == show(want)


def test_outlines_in_blocks(spark, pixels, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 5)
    side = lambda s, r: pixels.where(f"session_index = {s}").select("subject", F.concat_ws(":", "subject", "roi").alias(r), "x", "y", "w")
    a, b = side(0, "roi_a"), side(1, "roi_b")
    wanted = a.select("subject", "roi_a").distinct().join(b.select("subject", "roi_b").distinct(), "subject").select("roi_a", "roi_b")
    want = {(r.roi_a, r.roi_b): r.outline_cost for r in evidence.outline_cost(a, b, wanted, "roi_a", "roi_b", 2.0, (4, 4)).collect()}
    got = {(r.roi_a, r.roi_b): r.outline_cost for r in dense.outline_costs(a, b, "roi_a", "roi_b", ["subject"], 2.0, (4, 4)).collect()}
    assert got == pytest.approx(want) and len(got) == len(want) > 100


def test_rankers_need_no_row_for_every_pair(spark, pixels, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 5)
    names, better = ["distance", "iou", "area_cost", "weighted_dice"], {"weighted_dice": -1.0}
    heavy = pixels.withColumn("w", 1.0 + F.col("roi") % 3)
    everything = bundles.bundle(heavy, max_gap=1, max_distance=0.8).withColumn("label", (F.col("roi_a") == F.col("roi_b")).cast("int"))
    packed = lines.packed(heavy, weights=True)
    some = ranking.deciding_pairs(packed, names, better, reach=0.8, most=2)
    assert some.count() < everything.count()
    show = lambda df: sorted(str([[round(x, 9) for x in v] if isinstance(v, list) else v for v in r]) for r in df.collect())
    x = ranking.signed(names, better)
    assert show(ranking.rivals(some, x, most=2)) == show(ranking.rivals(everything, x, most=2))
    models = ranking.fit(some, names, "subject", better, most=2)
    rows = {}
    for r in ranking.scored(everything, models, names, "subject", better).collect():
        rows.setdefault((r.subject, r.session_a, r.roi_a), []).append(r)
    got = {(r.subject, r.session_a, r.roi_a): r for r in ranking.scored_lines(packed, models, names, better, reach=0.8).collect()}
    assert got.keys() == rows.keys()
    for k, cells in rows.items():
        g = got[k]
        assert g["first"] == min(cells, key=lambda r: (round(r.cost, 9), r.roi_b)).label and g.n == len(cells)
        for y, total in ((1, g.sum_yes), (0, g.sum_no)):
            assert total == pytest.approx(sum(r.match_probability for r in cells if r.label == y))


def test_whole_weights_are_compared_by_levels():
    a, b = (np.array([np.array([1, 2, 3]), np.array([2])], object) for _ in "ab")
    v = np.array([np.array([1.0, 2.0, 5.0]), np.array([3.0])], object)
    w = np.array([np.array([2.0, 2.0, 4.0]), np.array([1.0])], object)
    assert lines._least_sums(a, b, v, w).tolist() == [[7.0, 1.0], [2.0, 1.0]]
    assert lines._least_sums(a, b, v / 2, w / 2).tolist() == [[3.5, 0.5], [1.0, 0.5]]


def test_anchors_of_overlap_without_a_row_for_every_pair(spark, pixels, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 5)
    everything = bundles.bundle(pixels, max_gap=1, max_distance=0.8).withColumn("cost", bundles.cost("registered_iou")).select(*lines.EDGE, "roi_a", "roi_b", "cost")
    show = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*lines.EDGE, "roi_a", "roi_b", "anchor", "cost").collect())
    for quantile, least in ((0.25, 3), (0.0, 2)):
        assert show(joint.relieved_overlaps(pixels, 1, 0.8, quantile, least)) == show(joint.relieved(everything, lines.EDGE, quantile, least))
    counted = {tuple(r) for r in joint.overlap_anchors(lines.packed(pixels), 1, 0.8)[1].collect()}
    assert counted == {tuple(r) for r in everything.groupBy(*lines.EDGE).count().collect()}
