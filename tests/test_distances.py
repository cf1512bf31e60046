"""Distances in blocks: what is kept of each line, against all pairs."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers all queries)
from longitrack.operators import distances, pairs
from longitrack.plans import auditing, catalog, local

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i % 3, i, [float(i * 7 % 5), float(i * 3 % 4)]) for i in range(40)]
    rows += [(0, 90, [float("nan"), 0.0]), (1, 91, [1.0, None]), (None, 92, [0.0, 0.0]), (2, 93, None)]
    return spark.createDataFrame(rows, "session int, roi long, vector array<float>")


def cells(points):
    ok = [(r.session, r.roi, r.vector) for r in points.collect() if r.session is not None and r.vector and all(x is not None and x == x for x in r.vector)]
    return {(a[0], b[0], a[1], b[1]): math.dist(a[2], b[2]) for a, b in itertools.product(ok, ok) if b[0] == a[0] + 1}


def test_lines_across_blocks(points, monkeypatch):
    monkeypatch.setattr(distances, "BLOCK", 4)
    every = cells(points)
    found = distances.nearest(points, 1, 2, total=lambda c: (c <= 2).sum(1))
    got = {(r.session_a, r.session_b, r.roi_a, r.roi_b, r.side): (r.cost, r.total) for r in found.collect()}
    for (sa, sb, a, b), cost in every.items():
        for side, mine in (("row", [c for k, c in every.items() if (k[0], k[2]) == (sa, a)]), ("column", [c for k, c in every.items() if (k[1], k[3]) == (sb, b)])):
            if cost <= sorted(mine)[1]:
                assert got.pop((sa, sb, a, b, side)) == (cost, sum(c <= 2 for c in mine))
    assert not got


def test_ranks_limits_and_weights_across_blocks(points, monkeypatch):
    monkeypatch.setattr(distances, "BLOCK", 4)
    spark = points.sparkSession
    every = spark.createDataFrame([(*k, c) for k, c in cells(points).items()], "session_a int, session_b int, roi_a long, roi_b long, cost double")
    names = ["session_a", "session_b", "roi_a", "roi_b", "cost", "row_rank", "column_rank", "row_margin", "column_margin", "mutual_top1"]
    whole = pairs.ranks(every, ["session_a", "session_b"], "roi_a", "roi_b")
    assert sorted(distances.ranked(points, 3).select(names).collect()) == sorted(pairs.candidates(whole, 3).select(names).collect())
    limits = {r.session_a: r.limit for r in distances.lower_quantile(points, 0.25).collect()}
    for s, limit in limits.items():
        costs = sorted(c for k, c in cells(points).items() if k[0] == s)
        assert limit == costs[(len(costs) - 1) // 4]
    log = {(r.session_a, r.roi_a): r.total for r in distances.nearest(points, 1, 1, ("row",), temperature=0.001).collect()}
    for (s, a), total in log.items():
        line = [-c / 0.001 for k, c in cells(points).items() if k[0] == s and k[2] == a]
        assert abs(total - max(line) - math.log(sum(math.exp(x - max(line)) for x in line))) < 1e-9


@pytest.mark.parametrize("name", ["state_ranks", "state_posteriors", "state_triplet_support", "state_anchors", "state_segmentation_events", "prior_margin_shortfall", "prior_confident_anchors", "policy_candidate_edges", "learn_examples"])
def test_queries_make_no_table_of_all_pairs(spark, name, monkeypatch):
    def refuse(*_):
        raise AssertionError("all pairs as rows")

    for plans in (catalog, local, auditing):
        monkeypatch.setattr(plans, "_states", refuse, raising=False)
    assert catalog.QUERIES[name](spark, D).select(F.count(F.lit(1))).first()[0] > 0


def test_pairs_of_centres_are_dealt_out(spark):
    """However few the nations and rows, their pairs are made by all tasks, none of which has most."""
    n = [r["count"] for r in local._both_centres(spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(n) == 4 and max(n) < 0.5 * sum(n)


def test_near_candidates_make_no_table_of_all_pairs(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("all pairs as rows")

    monkeypatch.setattr(local, "_both_centres", refuse)
    assert local.pair_near_candidates(spark, D).count() >= 0
