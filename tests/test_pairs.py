"""Pairs, assignment, evaluation, registration and sources on literal tables."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from longitrack.functions import c_log
from longitrack.operators import assignment, evaluation, learning, pairs, registration
from longitrack.sources import tables


def masks(spark, shift=0):
    rows = [(i, x + shift, y, 1.0) for i, (x0, y0) in enumerate(((0, 0), (3, 1))) for x in range(x0, x0 + 2) for y in range(y0, y0 + 2)]
    return spark.createDataFrame(rows, "roi long, x int, y int, w double")


def test_overlap_of_equal_and_shifted_masks(spark):
    a, b = masks(spark).withColumnRenamed("roi", "roi_a"), masks(spark).withColumnRenamed("roi", "roi_b")
    same = pairs.overlaps(a, b, "roi_a", "roi_b", ["x", "y"]).collect()
    assert {(r.roi_a, r.roi_b) for r in same} == {(0, 0), (1, 1)} and all(abs(r.iou - 1) + abs(r.cosine - 1) + abs(r.dice - 1) < 1e-9 for r in same)
    moved = pairs.overlaps(a, masks(spark, 1).withColumnRenamed("roi", "roi_b"), "roi_a", "roi_b", ["x", "y"]).collect()
    assert abs({(r.roi_a, r.roi_b): r.iou for r in moved}[0, 0] - 2 / 6) < 1e-12
    m = pairs.moments(masks(spark), "roi", 0.0).orderBy("roi").first()
    assert (m.area, m.cx, m.cy, m.cxx, m.cxy) == (4, 0.5, 0.5, 0.25, 0.0)


def test_edge_ranking(spark):
    cells = [(10, 20, 0, 0.0), (10, 21, 1, 2.0), (10, 22, 0, 1.0), (11, 20, 0, 5.0), (11, 21, 0, 4.0), (11, 22, 1, 3.0)]
    df = spark.createDataFrame(cells, "a long, b long, label int, cost double")
    got = {(r.a, r.b): r for r in evaluation.edge_ranks(df, [], "a", "b", "cost").collect()}
    x, y = got[10, 21], got[11, 22]
    assert (x.row_rank, x.column_rank, x.row_margin) == (3, 1, -2.0)
    assert (y.row_rank, y.column_rank, y.row_margin, y.column_margin) == (1, 2, 1.0, -2.0)
    iou = spark.createDataFrame([(0, 0, 1, 0.8), (0, 1, 0, 0.6), (0, 2, 0, 0.1)], "a long, b long, label int, iou double")
    r = evaluation.edge_ranks(iou, [], "a", "b", "iou", similarity=True).first()
    assert r.row_rank == 1 and abs(r.row_margin - 0.2) < 1e-12


def test_calibration(spark):
    df = spark.createDataFrame([(0.2, 0), (0.8, 1)], "p double, y int")
    r = evaluation.calibration(df, "p", "y").first()
    assert abs(r.ece - 0.2) < 1e-12 and abs(r.mce - 0.2) < 1e-12
    even = spark.createDataFrame([(0.5, 0), (0.5, 1)], "p double, y int")
    assert evaluation.calibration(even, "p", "y", 2).first().ece == 0
    assert evaluation.reliability_bins(spark.createDataFrame([(1.0, 1)], "p double, y int"), "p", "y").first().bin == 9


def test_comparison_skips_what_is_not_finite(spark):
    df = spark.createDataFrame([("m", "a", 0.5, 1, 1, 0), ("m", "b", 1.0, 2, 0, 0), ("n", "a", float("nan"), 0, 0, 0), ("n", "b", 0.25, 0, 0, 0)], "approach string, subject string, f double, tp long, fp long, fn long")
    got = {r.approach: r for r in evaluation.comparison(df, "approach", ["f"], {"pair": ("tp", "fp", "fn")}).collect()}
    assert got["m"].f_macro == 0.75 and abs(got["m"].pair_micro_f1 - 6 / 7) < 1e-12
    assert got["n"].f_macro == 0.25 and got["n"].f_sd == 0.0 and got["n"].pair_micro_f1 == 0.0


def test_triplet_support(spark):
    c = {(0, 1): [[0.1, 3], [3, 0.1]], (1, 2): [[0.1, 3], [3, 0.1]], (0, 2): [[0.2, 0.25], [0.3, 0.2]]}
    rows = [(a, b, i, j, float(v)) for (a, b), m in c.items() for i, r in enumerate(m) for j, v in enumerate(r)]
    df = spark.createDataFrame(rows, "session_a int, session_b int, roi_a long, roi_b long, cost double")
    got = {(r.roi_a, r.roi_b): r.penalty for r in pairs.triplet_support(df, 2, 0.5, 2.0).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 2.0, (1, 0): 2.0, (1, 1): 0.0}


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (6, 6)):
        for _ in range(20):
            c = rng.random((n, m)).round(2)
            r, k = assignment.minimum_assignment(c)
            small, large = min(n, m), max(n, m)
            t = c if n <= m else c.T
            assert len(set(r)) == len(set(k)) == small
            assert abs(c[r, k].sum() - min(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))) < 1e-9


def test_assignment_leaves_gated_cells(spark):
    df = spark.createDataFrame([("e", 1, 5, 1.0), ("e", 1, 6, 0.5), ("e", 2, 6, 0.6), ("e", 3, 7, 9.0)], "edge string, roi_a long, roi_b long, cost double")
    assert {(r.roi_a, r.roi_b) for r in assignment.assign(df, ["edge"]).collect()} == {(1, 5), (2, 6)}


def test_registration(spark):
    rng = np.random.default_rng(2)
    image = rng.random((24, 30))
    moved = registration.shifted(image, 3, -4)
    assert registration.integer_shift(image, moved)[:2] == (-3, 4)
    assert np.allclose(registration.warp_affine(image, np.array([[1, 0, 0], [0, 1, 0]], float)), image)
    df = spark.createDataFrame([("s", i, 24, 30, [float(v) for v in im.ravel()]) for i, im in enumerate((image, moved))], "subject string, session_index int, height int, width int, pixels array<double>")
    r = registration.estimate_shifts(df).first()
    assert (r.session_a, r.session_b, r.dy, r.dx) == (0, 1, -3, 4)
    px = spark.createDataFrame([("s", 1, 9, 5, 5, 1.0), ("s", 1, 9, 29, 0, 1.0)], "subject string, session_index int, roi long, x int, y int, w double")
    assert [(p.x, p.y) for p in registration.shift_pixels(px, registration.estimate_shifts(df), 24, 30).collect()] == [(9, 2)]


def test_affine_fit_and_radius_join(spark):
    pts = [(float(x), float(y), 1 + 2.0 * x - y, 3 + 0.5 * y) for x in range(3) for y in range(3)]
    r = pairs.affine_fit(spark.createDataFrame(pts, "x double, y double, tx double, ty double"), []).first()
    assert np.allclose([r.tx_0, r.tx_x, r.tx_y, r.ty_0, r.ty_x, r.ty_y], [1, 2, -1, 3, 0, 0.5])
    a = spark.createDataFrame([(i, float(i % 7), float(i // 7)) for i in range(49)], "roi long, x double, y double")
    got = {(r.roi_a, r.roi_b) for r in pairs.within_radius(a, a, 1.5, []).collect()}
    assert got == {(i, j) for i in range(49) for j in range(49) if (i % 7 - j % 7) ** 2 + (i // 7 - j // 7) ** 2 <= 2.25}


def test_priors(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 1, 1e6)], "a long, b long, cost double")
    v = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 1, 5)], "a long, b long, votes long")
    got = {(r.a, r.b): r.cost for r in pairs.with_votes(df, v, ["a", "b"], 0.2, 0.5, 2).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 3.0, (1, 1): 1e6}
    got = {(r.a, r.b): r.cost for r in pairs.with_teacher(df, v.where("a = 0 AND b = 1"), ["a", "b"], 1.0, 0.5, 2.0).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 1.5, (1, 1): 1e6}
    p = pairs.posteriors(df, [], "a").collect()
    assert abs(sum(r.posterior for r in p) - 1) < 1e-12 and len(p) == 2


def test_match_model_separates(spark):
    rows = [("s%d" % (i % 3), i, j, 0.1 if i == j else 1.0 + 0.01 * j) for i in range(12) for j in range(12)]
    df = spark.createDataFrame(rows, "subject string, roi_a long, roi_b long, cost double").withColumn("label", (F.col("roi_a") == F.col("roi_b")).cast("int"))
    hard = learning.hard_negatives(df, ["subject"], "roi_a", "roi_b", "cost", top_k=3)
    n = {r.label: r["count"] for r in hard.groupBy("label").count().collect()}
    assert n[1] == 12 and n[0] <= 48
    out = learning.leave_one_out(df.withColumn("d", F.col("cost")), "subject", ["d"]).collect()
    assert len(out) == len(rows) and all((r.match_probability > 0.5) == (r.label == 1) for r in out)


def test_sources(spark, tmp_path):
    (tmp_path / "long.csv").write_text("﻿track_id,session,roi\na,s1,1\na,s2,\na,s2,5\nb,s1,-1\n", encoding="utf-8")
    (tmp_path / "wide.csv").write_text("track_id,s1,s2\na,1,5\nb,,7\n")
    want = {("a", 0, 1), ("a", 1, 5)}
    assert {tuple(r) for r in tables.read_tracks_csv(spark, f"{tmp_path}/long.csv").select("track_id", "session_index", "roi").collect()} == want
    assert {tuple(r) for r in tables.read_tracks_csv(spark, f"{tmp_path}/wide.csv").select("track_id", "session_index", "roi").collect()} == want | {("b", 1, 7)}
    dates = tables.session_dates(spark.createDataFrame([("/d/2024-02-01_b",), ("/d/2024-01-05",), ("/d/other",)], "path string")).collect()
    assert [r.session for r in dates] == ["2024-01-05", "2024-02-01_b", "other"]
    np.save(tmp_path / "rois.npy", np.eye(4).reshape(1, 4, 4))
    got = tables.read_masks(spark, f"{tmp_path}/*.npy").collect()
    assert sorted((r.x, r.y) for r in got) == [(i, i) for i in range(4)]
    assert tables.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_c_log_ties_as_sql_does(spark):
    """Two documents whose costs SQL finds equal: Spark's own logarithm put the later one first."""
    x = [0.10810810810810811, 14 / 27, 1.0]
    df = spark.createDataFrame([(v,) for v in [*x, None, 0.0]], "v double")
    assert [r[0] for r in df.select(c_log("v")).collect()] == [*map(math.log, x), None, None]
    both = spark.createDataFrame([(0.10810810810810811, 0.3779644730092272), (0.10810810810810811, 0.37796447300922725)], "iou double, cosine double")
    cost = pairs.total_cost(None, 1.0, F.col("iou"), F.col("cosine"), F.abs(c_log(F.lit(14 / 27))), log=c_log)
    assert both.select(cost).distinct().count() == 1
