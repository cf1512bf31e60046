"""Pairs made in tiles: the same as SQL gives, over several blocks, and without a shuffle of pairs."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.operators import bundles, evidence, tiles


def _points(spark, n=40):
    # 8 places only, so that distances tie
    return spark.range(n).select((F.col("id") % 2).cast("int").alias("g"), F.col("id").alias("roi"), (F.col("id") * 7 % 8 * 1.0).alias("x"), (F.col("id") % 3 * 1.0).alias("y"))


def _sides(points):
    return points.withColumnRenamed("roi", "roi_a"), points.withColumnRenamed("roi", "roi_b")


def _pairs(points):
    a, b = (p.withColumnsRenamed({"x": f"x_{s}", "y": f"y_{s}"}) for p, s in zip(_sides(points), "ab", strict=True))
    return a.join(b, "g").withColumn("d", F.sqrt(F.pow(F.col("x_a") - F.col("x_b"), 2) + F.pow(F.col("y_a") - F.col("y_b"), 2)))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 6)
    monkeypatch.setattr(tiles, "CELLS", 30)
    monkeypatch.setattr(tiles, "BINS", 4)
    monkeypatch.setattr(bundles, "TILE", 3)


@pytest.mark.parametrize("dense", [False, True])
def test_places_over_blocks(spark, small, dense):
    p = _points(spark)
    got = {(r.roi_a, r.roi_b): tuple(r)[4:] for r in tiles.ranked(*_sides(p), ["g"], dense).collect()}
    place = lambda line, other: (F.dense_rank() if dense else F.row_number()).over(Window.partitionBy("g", line).orderBy("d", *([] if dense else [other]))) - 1
    n = lambda line: F.count(F.lit(1)).over(Window.partitionBy("g", line))
    want = _pairs(p).select("roi_a", "roi_b", place("roi_a", "roi_b"), place("roi_b", "roi_a"), n("roi_a"), n("roi_b")).collect()
    assert got == {(r[0], r[1]): tuple(r)[2:] for r in want}


def test_neighbours_and_median_over_blocks(spark, small):
    p = _points(spark, 41)
    d = _pairs(p).where("roi_a <> roi_b")
    want = {r[0]: tuple(r)[1:] for r in d.groupBy("roi_a").agg(F.count_if(F.col("d") <= 2.0), F.min("d"), F.percentile("d", F.lit(0.5)), F.slice(F.array_sort(F.collect_list("d")), 1, 3)).collect()}
    assert {r.roi: tuple(r)[2:] for r in tiles.neighbours(p, ["g"], 2.0, 3).collect()} == want
    middle = {r.g: r[1] for r in d.groupBy("g").agg(F.percentile("d", F.lit(0.5))).collect()}
    assert {r.g: r.median for r in tiles.median_distance(p, ["g"]).collect()} == pytest.approx(middle)
    lone = p.where("roi = 0")
    assert tiles.neighbours(lone, ["g"], 2.0, 3).count() == 0 == tiles.median_distance(lone, ["g"]).count()
    assert [tuple(r) for r in evidence.signatures(lone, ["g"], 2).collect()] == [(0, 0, [0.0, 0.0])]


def _recordings(spark):
    cells = [("s", t, r, (r * 5 + k * (r + t)) % 9, (r + k) % 4, 1.0 + (r + k) % 3) for t in (0, 1) for r in range(8) for k in range(5)]
    px = spark.createDataFrame(cells, "subject string, session_index int, roi long, x long, y long, w double")
    return px.groupBy("subject", "session_index", "roi", "x", "y").agg(F.sum("w").alias("w"))


def test_local_evidence_without_shuffling_pairs(spark, small, monkeypatch):
    px = _recordings(spark)
    rois = px.groupBy("subject", "session_index", "roi").agg((F.sum("w") / 100).alias("cell_probability"), F.avg("w").alias("f"))
    images = px.groupBy("subject", "session_index", "x", "y").agg(F.sum("w").alias("v"))
    new = bundles.local_bundle(px, images, rois, ["f"], 1, 4.0, (4, 9), 2, 1)
    shown = ["roi_a", "roi_b", *(F.round(c, 9).alias(c) for c in ("outline_cost", "constellation_cost", "centroid_rank_cost", "patch_correlation", "feature_distance", "soft_iou", "cosine")), "patch_valid"]
    got = sorted(map(tuple, new.select(*shown).collect()))
    old = bundles.local_evidence(bundles.bundle(px, rois, ["f"], 1, 4.0), px, images, (4, 9), 2, 1)
    assert got and got == sorted(map(tuple, old.select(*shown).collect()))
    # nothing is exchanged once pairs are made
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapCoGroupsInPandas")] and "Aggregate" not in plan[: plan.index("FlatMapCoGroupsInPandas")]
    met = bundles._touching(px, 1, False).collect()
    parts = {(r.roi_a, r.roi_b): (r.inter, r.min_sum, r.dot) for r in met}
    areas = {(r.session_index, r.roi): (r.area, r.mass, r.norm) for r in bundles.planes(px).collect()}
    for r in bundles.bundle(px, max_distance=4.0).collect():
        inter, least, dot = parts.get((r.roi_a, r.roi_b), (0, 0.0, 0.0))
        a, b = areas[0, r.roi_a], areas[1, r.roi_b]
        assert (r.iou, r.soft_iou, r.cosine) == pytest.approx((inter / (a[0] + b[0] - inter), least / (a[1] + b[1] - least), dot / (a[2] * b[2])))


def test_outlines_lie_anywhere(spark):
    from longitrack.operators import dense, lines

    px = spark.createDataFrame([(0, -3, -2), (0, 1, 0), (1, 70, 2)], "roi int, x int, y int").selectExpr("'s' AS subject", "0 AS session_index", "roi", "x", "y", "1.0D AS w")
    c = lines.packed(px).orderBy("roi").toPandas()["cells"].to_numpy()
    s = math.sqrt(2) - 1
    assert dense.outlines(c, c).round(9).tolist() == [[0.0, round(0.5 * ((73 + 4 * s + 69 + 2 * s) / 2 + 69 + 2 * s), 9)], [round(0.5 * ((73 + 4 * s + 69 + 2 * s) / 2 + 69 + 2 * s), 9), 0.0]]


JOINED = ["pair_context_distance", "pair_feature_components", "pair_feature_distance", "prior_context_costs", "prior_supported_costs", "prior_other_terms"]


@pytest.mark.parametrize("name", ["pair_rank_cost", "prior_dynamic_costs", "pair_patch_correlations", *JOINED])
def test_pairs_are_not_shuffled(spark, name):
    from longitrack.plans import bundling, catalog  # noqa: F401

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(i for i, line in enumerate(plan) if ("Join" in line and "_s#" in line if name in JOINED else "FlatMapCoGroupsInPandas" in line))
    above = [line.strip(" +-:!").split(" ")[0] for line in plan[:made]]
    assert set(above) <= {"Project", "Filter"}, above


def test_likely_pairs_over_blocks(spark, small):
    from longitrack.operators import pairs, priors

    p = _points(spark)
    factor = F.lit(1.0) / (1 + (F.col("roi_a") + F.col("roi_b")) % 3)
    every = _pairs(p).select("g", "roi_a", "roi_b", F.col("d").alias("cost"))
    want = priors.posterior_candidates(pairs.posteriors(every, ["g"], "roi_a", 2.0, factor), ["g"], 0.07, 2, 1)
    got = tiles.likely(*_sides(p), ["g"], 2.0, lambda a, b: 1.0 / (1 + (a["roi_a"].to_numpy()[:, None] + b["roi_b"].to_numpy()[None, :]) % 3), 0.07, 2, 1)
    shown = ["roi_a", "roi_b", F.round("cost", 9), F.round("posterior", 9)]
    rows = sorted(map(tuple, got.select(*shown).collect()))
    assert rows == sorted(map(tuple, want.select(*shown).collect())) and len(rows) < every.count()


def test_reliabilities_of_arrays(spark):
    import numpy as np

    from longitrack.operators import priors

    v = np.array([0.0, 0.3, 1.0])
    row = spark.createDataFrame([(x,) for x in v.tolist()], "v double")
    want = [r[0] for r in row.select(priors.edge_reliability(rank=F.col("v"), activity=[F.col("v")], empty=F.col("v") > 0.5, rmse=F.col("v"), valid=F.col("v"))).collect()]
    assert priors.edge_reliabilities(rank=v, activity=v, empty=v > 0.5, rmse=v, valid=v).tolist() == pytest.approx(want)
