"""Candidate pairs: overlap of sparse weighted supports, costs, gates, ranks, priors.

A pair table has the keys of its two sides; a cell that is not there is inadmissible. Overlaps come from
an equi-join on pixels, so only pairs that share one are ever made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.functions import EPSILON, INADMISSIBLE, admissible, clip, logit, overlap_cost, ratio, sigmoid

#: Fixed weights of the default cost: distance, overlap, cosine, area, features, cell probability.
WEIGHTS = {"centroid": 1.0, "iou": 6.0, "cosine": 2.0, "area": 0.5, "feature": 0.25, "cell_probability": 0.0}


def support(pixels: DataFrame, roi: str, w: str = "w") -> DataFrame:
    """Per ROI: number of pixels, sum and norm of weights over finite positive ones."""
    ok = pixels.where(F.col(w).isNotNull() & ~F.isnan(F.col(w).cast("double")) & (F.col(w) > 0))
    return ok.groupBy(roi).agg(F.count(F.lit(1)).alias("area"), F.sum(F.col(w) * 1.0).alias("mass"), F.sqrt(F.sum(F.col(w) * F.col(w) * 1.0)).alias("norm"))


def moments(pixels: DataFrame, roi: str, regularization: float = EPSILON) -> DataFrame:
    """Per ROI: area, weighted centroid and population covariance (plus regularization on the diagonal) of (x, y)."""
    x, y = F.col("x"), F.col("y")
    m = pixels.groupBy(roi).agg(F.count(F.lit(1)).alias("area"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), (F.var_pop(x) + regularization).alias("cxx"), (F.var_pop(y) + regularization).alias("cyy"), F.covar_pop(x, y).alias("cxy"))
    return m


def overlaps(a: DataFrame, b: DataFrame, roi_a: str, roi_b: str, pixel: list[str], log: Callable[[Column], Column] = F.log) -> DataFrame:
    """(roi_a, roi_b, ...): IoU, soft IoU, cosine, Dice, containments and area ratio of pairs that share a pixel.

    a and b: (roi, *pixel, w), w positive, one row a pixel.
    """
    left, right = a.withColumnRenamed("w", "w_a"), b.withColumnRenamed("w", "w_b")
    both = left.join(right, pixel).groupBy(roi_a, roi_b).agg(F.count(F.lit(1)).alias("inter"), F.sum(F.least("w_a", "w_b") * 1.0).alias("min_sum"), F.sum(F.col("w_a") * F.col("w_b") * 1.0).alias("dot"))
    sa = support(a, roi_a).withColumnsRenamed({"area": "area_a", "mass": "mass_a", "norm": "norm_a"})
    sb = support(b, roi_b).withColumnsRenamed({"area": "area_b", "mass": "mass_b", "norm": "norm_b"})
    c = both.join(sa, roi_a).join(sb, roi_b)
    i, na, nb = F.col("inter"), F.col("area_a"), F.col("area_b")
    return c.select(
        roi_a, roi_b, i, na, nb,
        ratio(i * 1.0, na + nb - i, 0.0).alias("iou"),
        ratio(F.col("min_sum"), F.col("mass_a") + F.col("mass_b") - F.col("min_sum"), 0.0).alias("soft_iou"),
        (F.col("dot") / F.greatest(F.col("norm_a") * F.col("norm_b"), F.lit(EPSILON))).alias("cosine"),
        ratio(2.0 * i, na + nb, 0.0).alias("dice"),
        ratio(2.0 * F.col("min_sum"), F.col("mass_a") + F.col("mass_b"), 0.0).alias("weighted_dice"),
        (i / F.least(na, nb)).alias("overlap_min"),
        (i / na).alias("containment_a"),
        (i / nb).alias("containment_b"),
        F.abs(i / na - i / nb).alias("containment_asymmetry"),
        F.abs(log(na / nb)).alias("area_cost"),
    )


def total_cost(distance: Column | None, scale: Column | float, iou: Column, cosine: Column, area_cost: Column, feature: Column | None = None, cell: Column | None = None, max_distance: float | None = None, weights: dict | None = None, log: Callable[[Column], Column] = F.log) -> Column:
    """The weighted cost of a pair; beyond max_distance, or not finite, it is inadmissible; never negative."""
    w = WEIGHTS | (weights or {})
    zero = F.lit(0.0)
    total = w["iou"] * overlap_cost(iou, log=log) + w["cosine"] * (1.0 - cosine) + w["area"] * area_cost
    if distance is not None:
        total = total + w["centroid"] * F.pow(distance / scale, 2)
    total = total + (w["feature"] * feature if feature is not None else zero) + (w["cell_probability"] * cell if cell is not None else zero)
    bad = total.isNull() | F.isnan(total)
    if distance is not None and max_distance is not None:
        bad = bad | (distance > max_distance)
    return F.when(bad, F.lit(INADMISSIBLE)).otherwise(F.greatest(total, zero))


def cell_probability_cost(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """-(ln a + ln b) / 2 of clipped probabilities; 0 if either is missing or negative."""
    cost = -0.5 * (F.log(clip(a, epsilon, 1.0)) + F.log(clip(b, epsilon, 1.0)))
    return F.when((a >= 0) & (b >= 0), cost).otherwise(F.lit(0.0))


def mahalanobis(dx: Column, dy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """sqrt(d' S^-1 d) of a two by two S in closed form."""
    det = sxx * syy - sxy * sxy
    return F.sqrt(F.greatest((syy * dx * dx - 2.0 * sxy * dx * dy + sxx * dy * dy) / det, F.lit(0.0)))


def ranks(pairs: DataFrame, edge: list[str], row: str, column: str, cost: str = "cost") -> DataFrame:
    """Row and column ranks among admissible cells (ties by key), the best other cost of each line, margins and ambiguity."""
    ok = pairs.where(admissible(F.col(cost)))
    out = ok
    for name, mine, other in (("row", row, column), ("column", column, row)):
        line = Window.partitionBy(*edge, mine)
        order = line.orderBy(cost, other)
        out = out.withColumn(f"{name}_rank", F.row_number().over(order))
        out = out.withColumn("_first", F.first(cost).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("_second", F.nth_value(cost, 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        best_other = F.when(F.col(f"{name}_rank") == 1, F.col("_second")).otherwise(F.col("_first"))
        out = out.withColumn(f"{name}_margin", best_other - F.col(cost)).withColumn(f"{name}_best", F.col("_first")).drop("_first", "_second")
    return out.withColumn("mutual_top1", (F.col("row_rank") == 1) & (F.col("column_rank") == 1)).withColumn("ambiguity", 1.0 / (1.0 + F.greatest(F.least("row_margin", "column_margin"), F.lit(0.0))))


def candidates(ranked: DataFrame, top_k: int, include_columns: bool = True, gate_margin: float | None = None, cost: str = "cost") -> DataFrame:
    """Cells in the top k of their row (or column), and within gate_margin of their row's or column's best."""
    keep = F.col("row_rank") <= top_k
    if include_columns:
        keep = keep | (F.col("column_rank") <= top_k)
    if gate_margin is not None:
        keep = keep & ((F.col(cost) <= F.col("row_best") + gate_margin) | (F.col(cost) <= F.col("column_best") + gate_margin))
    return ranked.where(keep)


def within_radius(a: DataFrame, b: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Pairs (roi_a, roi_b, distance) within a radius: points meet in grid cells of that width and their neighbours."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = a.withColumns({"gx": cell("x"), "gy": cell("y")}).select(*keys, F.col("roi").alias("roi_a"), F.col("x").alias("xa"), F.col("y").alias("ya"), "gx", "gy")
    right = b.withColumn("n", near).select(*keys, F.col("roi").alias("roi_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), (cell("x") + F.col("n.i")).alias("gx"), (cell("y") + F.col("n.j")).alias("gy"))
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    return left.join(right, [*keys, "gx", "gy"]).withColumn("distance", d).where(F.col("distance") <= radius).select(*keys, "roi_a", "roi_b", "distance")


def posteriors(pairs: DataFrame, edge: list[str], row: str, temperature: float = 1.0, reliability: Column | None = None) -> DataFrame:
    """Row softmax of -(cost - row minimum) / temperature, times reliability."""
    line = Window.partitionBy(*edge, row)
    e = F.exp(-(F.col("cost") - F.min("cost").over(line)) / temperature)
    return pairs.where(admissible(F.col("cost"))).withColumn("_e", e).withColumn("posterior", F.col("_e") / F.sum("_e").over(line) * (reliability if reliability is not None else F.lit(1.0))).drop("_e")


def with_votes(pairs: DataFrame, edge_votes: DataFrame, keys: list[str], relief: float, max_relief: float, min_votes: int) -> DataFrame:
    """Consensus: cost - min(max_relief, relief * votes), not below 0, where enough variants vote."""
    joined = pairs.join(edge_votes, keys, "left")
    return joined.withColumn("cost", voted(F.col("cost"), F.col("votes"), relief, max_relief, min_votes))


def voted(cost: Column, votes: Column, relief: float, max_relief: float, min_votes: int) -> Column:
    less = F.greatest(F.lit(0.0), cost - F.least(F.lit(max_relief), relief * votes))
    return F.when((votes >= min_votes) & admissible(cost), less).otherwise(cost)


def with_teacher(pairs: DataFrame, teacher: DataFrame, keys: list[str], penalty: float, relief: float, cap: float, floor: float = 0.0) -> DataFrame:
    """Teacher prior: others pay a penalty; a teacher's edge is capped, relieved, and floored."""
    marked = pairs.join(teacher.select(*keys).distinct().withColumn("_t", F.lit(True)), keys, "left")
    return marked.withColumn("cost", taught(F.col("cost"), F.col("_t"), penalty, relief, cap, floor)).drop("_t")


def taught(cost: Column, ours: Column, penalty: float, relief: float, cap: float, floor: float = 0.0) -> Column:
    return F.when(~admissible(cost), cost).when(ours, F.greatest(F.lit(floor), F.least(cost, F.lit(cap)) - relief)).otherwise(cost + penalty)


def triplet_support(pairs: DataFrame, top_k: int, cap: float, max_penalty: float) -> DataFrame:
    """Skip edges (gap 2): the least two-hop cost over the session between, and the penalty for lacking support.

    pairs: (session_a, session_b, roi_a, roi_b, cost). Only each row's top k first hops are followed.
    """
    by_row = Window.partitionBy("session_a", "session_b", "roi_a").orderBy("cost", "roi_b")
    hops = pairs.where("session_b = session_a + 1").where(admissible(F.col("cost"))).withColumn("k", F.row_number().over(by_row)).where(F.col("k") <= top_k)
    skip = pairs.where("session_b = session_a + 2").join(two_hops(hops), ["session_a", "session_b", "roi_a", "roi_b"], "left")
    return skip.withColumn("penalty", support_penalty(cap, max_penalty))


def support_penalty(cap: float, max_penalty: float) -> Column:
    return F.coalesce(clip(F.col("support") - cap, 0.0, max_penalty), F.lit(max_penalty))


def two_hops(hops: DataFrame) -> DataFrame:
    """(session_a, session_b, roi_a, roi_b, support) of the skip edges that two hops lead along: the least sum."""
    first = hops.select("session_a", F.col("session_b").alias("mid"), "roi_a", F.col("roi_b").alias("via"), F.col("cost").alias("c1"))
    second = hops.select(F.col("session_a").alias("mid"), "session_b", F.col("roi_a").alias("via"), "roi_b", F.col("cost").alias("c2"))
    return first.join(second, ["mid", "via"]).groupBy("session_a", "session_b", "roi_a", "roi_b").agg(F.min(F.col("c1") + F.col("c2")).alias("support"))


def anchors(ranked: DataFrame, edge: list[str], quantile: float, relief: float) -> DataFrame:
    """Mutual minima whose cost is at most a quantile of their edge's; their cost less a relief."""
    limit = ranked.groupBy(*edge).agg(F.percentile("cost", F.lit(quantile)).alias("limit"))
    return relieved(ranked.where("mutual_top1"), limit, edge, relief)


def relieved(mutual: DataFrame, limits: DataFrame, edge: list[str], relief: float) -> DataFrame:
    """The mutual minima up to their edge's limit; their cost less a relief."""
    found = mutual.join(limits, edge).where("cost <= limit")
    return found.withColumn("relieved", F.greatest(F.lit(0.0), F.col("cost") - relief))


def reliability(penalties: Column, low: float = 0.05, high: float = 1.0) -> Column:
    return clip(F.exp(-clip(penalties, 0.0, 100.0)), low, high)


def shifted_probability(p: Column, intercept: Column) -> Column:
    """A probability with an intercept added to its logit."""
    return sigmoid(logit(p) + intercept)


def segmentation_events(pairs: DataFrame, edge: list[str], row: str, column: str, similarity: str, threshold: float, min_children: int, max_children: int) -> DataFrame:
    """Splits (a row with several similar columns) and merges (a column with several similar rows), with their mean similarity."""
    high = pairs.where(F.col(similarity) >= threshold)
    out = None
    for kind, parent, child in (("split", row, column), ("merge", column, row)):
        n = Window.partitionBy(*edge, parent)
        best = high.withColumn("n_children", F.count(F.lit(1)).over(n)).withColumn("k", F.row_number().over(n.orderBy(F.desc(similarity), child))).where((F.col("n_children") >= min_children) & (F.col("k") <= max_children))
        events = best.groupBy(*edge, F.col(parent).alias("parent"), "n_children").agg(F.avg(similarity).alias("score")).withColumn("kind", F.lit(kind))
        out = events if out is None else out.unionByName(events)
    return out


def affine_fit(points: DataFrame, keys: list[str], regularization: float = 0.0) -> DataFrame:
    """Least squares x' = a + b x + c y and y' likewise from sums, by Cramer's rule; at least three pairs.

    points: (x, y, tx, ty). The sums are partial aggregates, so any number of points is one shuffle of sums.
    """
    s = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in ("x", "y", "tx", "ty")), F.covar_pop("x", "x").alias("sxx"), F.covar_pop("y", "y").alias("syy"), F.covar_pop("x", "y").alias("sxy"), *(F.covar_pop(p, t).alias(f"s{p}_{t}") for p in ("x", "y") for t in ("tx", "ty")))
    r = F.lit(regularization) / F.col("n")
    a, b, c = F.col("sxx") + r, F.col("syy") + r, F.col("sxy")
    det = a * b - c * c
    out = s.where((F.col("n") >= 3) & (det != 0))
    for t in ("tx", "ty"):
        out = out.withColumn(f"{t}_x", (F.col(f"sx_{t}") * b - F.col(f"sy_{t}") * c) / det).withColumn(f"{t}_y", (F.col(f"sy_{t}") * a - F.col(f"sx_{t}") * c) / det)
        out = out.withColumn(f"{t}_0", F.col(f"m_{t}") - F.col(f"{t}_x") * F.col("m_x") - F.col(f"{t}_y") * F.col("m_y"))
    return out.select(*keys, "n", *(f"{t}_{k}" for t in ("tx", "ty") for k in ("0", "x", "y")))
