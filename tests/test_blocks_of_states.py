"""Summaries of all cells made in blocks, against the same from rows of all cells; many cells tie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from longitrack.operators import cleanup, evaluation, learning
from longitrack.operators import distances as D

LINE = ["session_a", "session_b", "roi_a", "roi_b"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    rows = [(s, 100 * s + i, [float(v) for v in rng.integers(0, 4, 3)]) for s, n in enumerate((30, 1, 24, 33)) for i in range(n)]
    return spark.createDataFrame(rows, "session int, roi long, vector array<float>").cache()


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 8)


def by_seven():
    """A function of its own, as workers don't have this module."""
    return lambda a, b: np.fmod(a, 7) == np.fmod(b, 7)


def cells(points):
    return D.all_cells(points, 1).withColumn("label", (F.col("roi_a") % 7 == F.col("roi_b") % 7).cast("int"))


def shown(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_ranking_summary(points):
    want = evaluation.ranking_summary(evaluation.edge_ranks(cells(points), D.EDGE, "roi_a", "roi_b", "cost"), D.EDGE)
    got = D.ranking_summary(points, by_seven(), evaluation.HITS)
    assert shown(got.select(*want.columns)) == shown(want)


def test_link_margins(points):
    values = {"n": lambda c, row, column: len(c), "rows": lambda c, row, column: np.nansum(row - c), "columns": lambda c, row, column: np.nansum(column - c), "alone": lambda c, row, column: np.isnan(row).sum()}
    got = {r.session_a: r for r in D.link_margins(points, values).collect()}
    x = cleanup.link_diagnostics(cells(points).withColumn("s", -F.col("cost")), D.EDGE, "roi_a", "roi_b", "s", 0.0)
    want = {r.session_a: r for r in x.groupBy("session_a").agg(F.count("s").alias("n"), F.sum("row_competition_margin").alias("rows"), F.sum("column_competition_margin").alias("columns")).collect()}
    assert set(got) == set(want) == {0, 1, 2}
    assert all(got[s].n == want[s].n for s in want)
    assert got[2].rows == pytest.approx(want[2].rows) and got[2].columns == pytest.approx(want[2].columns)
    # a row whose only cell has no competitor
    assert got[0].alone == 30 and got[1].alone == 0


def test_hard_examples(points):
    want = learning.hard_negatives(cells(points), D.EDGE, "roi_a", "roi_b", "cost", 2, 1.5)
    got = D.hard_examples(points, by_seven(), 2, 1.5)
    assert shown(got.select(*LINE, "cost", "label")) == shown(want.select(*LINE, "cost", "label"))
