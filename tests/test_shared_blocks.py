"""Grown supports compared in blocks against a join over pixels, with pixels at and beyond the border."""

import random

from pyspark.sql import functions as F

from longitrack.operators import dense, evidence
from longitrack.operators.pairs import overlaps


def test_dilated_iou_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 3)
    rnd = random.Random(4)
    side = lambda base, roi: spark.createDataFrame(sorted({(i % 2, base + i, rnd.randrange(-1, 9), rnd.randrange(-1, 6), 1) for i in range(14) for _ in range(4)}), f"g int, {roi} long, x long, y long, w long")
    a, b, shape = side(0, "ra"), side(100, "rb"), (5, 8)
    want = overlaps(evidence.dilated(a, "ra", ["g"], 1, shape), evidence.dilated(b, "rb", ["g"], 1, shape), "ra", "rb", ["g", "x", "y"])
    show = lambda df: sorted((r.ra, r.rb, round(r.iou, 12)) for r in df.collect())
    got = evidence.dilated_iou(a, b, "ra", "rb", ["g"], 1, shape)
    assert show(got) == show(want.select("ra", "rb", "iou")) != []
    # no row is made for a pixel that a pair shares
    assert "Join" not in got.select(F.col("iou"))._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]
