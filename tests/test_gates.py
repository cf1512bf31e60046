"""Gates of track repair, one failed check at a time."""

import pytest
from pyspark.sql import functions as F

from longitrack.operators import cleanup

GOOD = {"edge_source": "policy", "remove_reason": "split_edge", "would_split_component": 1, "is_terminal_edge": 1, "is_last_session_edge": 1, "complete_component_size": 5, "growth_anchor_count": 0, "growth_residual": 3.0, "growth_residual_mahalanobis": 25.0, "registered_iou": 0.5, "shifted_iou": 0.7, "row_rank": 1, "column_rank": 1, "cell_probability_a": 0.6, "cell_probability_b": 0.9, "local_neighbor_distortion": 0.01}
SHAPE = "case int, " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'int' if isinstance(v, int) else 'double'}" for k, v in GOOD.items())
CASES = [
    ({}, "accepted"),
    ({"edge_source": "suffix"}, "coherence_suffix_edge"),
    ({"remove_reason": None}, "not_splittable"),
    ({"complete_component_size": 4}, "not_complete_component"),
    ({"growth_residual": float("nan")}, "growth_residual_below_gate"),
    ({"growth_residual_mahalanobis": float("inf")}, "growth_residual_mahalanobis_below_gate"),
    ({"registered_iou": 0.61}, "registered_iou_above_gate"),
    ({"shifted_iou": 0.59}, "shifted_iou_below_gate"),
    ({"row_rank": 0}, "row_rank_above_gate"),
    ({"cell_probability_b": None}, "cell_probability_missing"),
    ({"cell_probability_a": 0.66}, "min_cell_probability_above_gate"),
    ({"local_neighbor_distortion": None}, "local_neighbor_distortion_above_gate"),
    ({"is_terminal_edge": None, "row_rank": 3}, "not_terminal_edge"),
]


def test_growth_veto_reasons(spark):
    rows = [(i, *(GOOD | change).values()) for i, (change, _) in enumerate(CASES)]
    got = spark.createDataFrame(rows, SHAPE).select("case", cleanup.growth_veto_reason(5).alias("r")).orderBy("case").collect()
    assert [r.r for r in got] == [want for _, want in CASES]


@pytest.mark.parametrize(("i", "value", "want"), [(0, 0.8, True), (0, 0.79, False), (2, 6.1, False), (4, None, False), (5, float("nan"), False), (6, 1, False)])
def test_suffix_gate(spark, i, value, want):
    x = [0.9, 0.9, 1.0, 0.5, 0.6, 0.9, 2]
    x[i] = value
    assert spark.range(1).select(cleanup.suffix_gate(*(F.lit(v) for v in x))).first()[0] is want


def test_one_edit_a_subject_and_vetoes(spark):
    df = spark.createDataFrame([("s", 1, 5), ("s", 2, 9), ("t", 3, 1), ("t", 4, 1)], "subject string, id int, gain int")
    got = cleanup.first_per_subject(df, [F.desc("gain"), F.col("id")])
    assert sorted(r.id for r in got.collect()) == [2, 3]
    mine = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.1), (0, 3, 0.9)], "a int, b int, iou double")
    theirs = spark.createDataFrame([(0, 1), (0, 1)], "a int, b int")
    assert [r.b for r in cleanup.teacher_vetoes(mine, theirs, ["a", "b"], F.col("iou") < 0.5).collect()] == [2]


def test_residual_score_takes_what_is_not_finite_as_missing(spark):
    from pyspark.sql import functions as F

    from longitrack.operators import audits

    nan, inf = float("nan"), float("inf")
    rows = [(0, 20.0, 3.0, 0.5, 0.4, 0.1, 2.0, 1.0, 1, 0, 1), (1, nan, inf, nan, -inf, nan, nan, inf, 1, 0, 1), (2, *[None] * 10)]
    df = spark.createDataFrame(rows, "i int, m double, r double, a double, b double, d double, rr double, cr double, t int, l int, c int")
    got = {r.i: r.score for r in df.select("i", audits.residual_score(*(F.col(c) for c in ("m", "r", "a", "b", "d", "rr", "cr", "t", "l", "c"))).alias("score")).collect()}
    assert abs(got[0] - (2.0 + 1.0 + 0.5 * 0.4 + 0.25 * 0.5 + 0.2 + 0.15 - 0.1 - 0.1)) < 1e-9
    assert abs(got[1] - (0.35 - 1.6)) < 1e-9 and abs(got[2] + 1.6) < 1e-9


def test_features_that_only_one_side_has(spark):
    from longitrack.operators import bundles

    side = lambda rows: spark.createDataFrame(rows, "g long, roi long, name string, value double")
    out = bundles.feature_components(side([(1, 1, "x", 2.0)]), side([(1, 5, "x", 3.0), (1, 5, "y", 1.0)]), spark.createDataFrame([(1, 1, 5)], "g long, roi_a long, roi_b long"), ["g"])
    row = out.collect()[0]
    assert row.abs_y_diff == 0.0 and row.missing_stat_indicator == 1.0 and row.abs_x_diff > 0
