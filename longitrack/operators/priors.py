"""Priors on the costs of candidate pairs, as expressions and windows on the pair table.

Every prior touches admissible pairs only; others keep the inadmissible cost. Weights default to zero where
the data model leaves a term off.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.functions import INADMISSIBLE, admissible, clip

#: Fixed values of the absence model: base cost and discounts.
ABSENCE = {"base": 1.0, "cell_probability": 0.50, "empty": 0.75, "density": 0.25, "no_trace": 0.10, "least": 0.0}
#: Fixed weights of the logit intercept of a session pair, and of its cost offset.
INTERCEPT = {"gap": -0.15, "density": -0.10, "low_probability": -0.50, "rmse": -0.05, "invalid": -1.00, "trace": 0.10, "limit": 5.0}
OFFSET = {"gap": 0.15, "rmse": 0.05, "invalid": 1.00, "low_probability": 0.50}
#: Fixed weights of what makes an edge unreliable.
UNRELIABLE = {"gated": 8.0, "logdet": 0.10, "rank": 0.75, "no_activity": 0.25, "empty": 8.0, "rmse": 0.25, "invalid": 2.0, "least": 1e-6}


def _finite(x: Column, otherwise: float) -> Column:
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(otherwise)).otherwise(x)


def adjusted(cost: Column, term: Column) -> Column:
    """cost + term where the cost is admissible and the sum finite, else inadmissible."""
    total = cost + term
    return F.when(admissible(cost) & total.isNotNull() & ~F.isnan(total) & (F.abs(total) != float("inf")), total).otherwise(F.lit(INADMISSIBLE))


def absence_costs(rois: DataFrame, session: list[str], weights: dict | None = None) -> DataFrame:
    """rois (cell_probability, empty, density, has_trace) with absence_cost: what it costs not to be seen.

    Density counts relative to the session's 90th percentile; missing probabilities give no discount.
    """
    w = ABSENCE | (weights or {})
    p, d = F.col("cell_probability").cast("double"), F.col("density").cast("double")
    scale = F.percentile(F.when(~F.isnan(d), d), F.lit(0.9)).over(Window.partitionBy(*session))
    scale = F.when(scale > 1e-12, scale).otherwise(1.0)
    cost = F.lit(w["base"])
    cost = cost - F.when(p.isNotNull() & ~F.isnan(p), w["cell_probability"] * (1.0 - clip(p, 0.0, 1.0))).otherwise(0.0)
    cost = cost - F.when(F.col("empty"), w["empty"]).otherwise(0.0)
    cost = cost - w["density"] * clip(F.when(F.isnan(d), 0.0).otherwise(F.coalesce(d, F.lit(0.0))) / F.col("_scale"), 0.0, 1.0)
    cost = cost - F.when(F.col("has_trace"), 0.0).otherwise(w["no_trace"])
    return rois.withColumn("_scale", scale).withColumn("absence_cost", F.greatest(cost, F.lit(w["least"]))).drop("_scale")


def absence_summary(rois: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: ROIs, and mean, median, least and largest absence_cost."""
    c = "absence_cost"
    return rois.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias(f"mean_{c}"), F.median(c).alias(f"median_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))


def gap_penalty(session_gap: Column, absence_a: Column, absence_b: Column) -> Column:
    """(gap - 1) times the mean absence cost of both ends."""
    return (session_gap - 1) * 0.5 * (absence_a + absence_b)


def _best_margin(cost: str, edge: list[str], line: str) -> Column:
    """How far the best cell of a line lies below the next cost; 0 if tied, null for others and for single cells."""
    by = Window.partitionBy(*edge, line)
    whole = by.orderBy(cost).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, second = F.nth_value(cost, 1).over(whole), F.nth_value(cost, 2).over(whole)
    return F.when(F.col(cost) - first <= 1e-12, second - first)


def best_margins(least: DataFrame, edge: list[str]) -> DataFrame:
    """(edge, roi_a, roi_b, margin, n) of the best cells, ties included, of lines given by their two least costs and ties (distances.nearest).

    n is the total of the row on its first cell, else 0.
    """
    line = F.when(F.col("side") == "column", F.col("roi_b")).otherwise(F.col("roi_a"))
    by = Window.partitionBy("side", *edge, line).orderBy("cost", "roi_a", "roi_b")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, second = F.nth_value("cost", 1).over(whole), F.nth_value("cost", 2).over(whole)
    n = F.when((F.col("side") == "row") & (F.row_number().over(by) == 1), F.col("total")).otherwise(0.0)
    found = least.withColumns({"margin": F.when(F.col("cost") - first <= 1e-12, second - first), "n": n, "_best": F.col("cost") - first <= 1e-12})
    return found.where("_best").select(*edge, "roi_a", "roi_b", "margin", "n")


def margin_shortfall(pairs: DataFrame, edge: list[str], weight: float, target: float, cap: float | None = None) -> DataFrame:
    """Admissible pairs that are best in row or column pay for a margin below the target."""
    ok = pairs.where(admissible(F.col("cost"))).withColumns({"_r": _best_margin("cost", edge, "roi_a"), "_c": _best_margin("cost", edge, "roi_b")})
    term = F.coalesce(weight * F.greatest(target - F.least("_r", "_c"), F.lit(0.0)), F.lit(0.0))
    term = F.least(term, F.lit(cap)) if cap is not None else term
    return ok.withColumn("cost", adjusted(F.col("cost"), term)).drop("_r", "_c")


def edge_prior(cost: Column, *, gap: Column | None = None, bias: float = 0.0, gap_weight: float = 0.0, terms: list[tuple[float, Column]] | None = None) -> Column:
    """cost + bias + gap_weight (gap - 1) + weighted terms (probability, area, missing activity, empty side, learned gap cost, quality)."""
    total = F.lit(bias)
    if gap is not None and gap_weight:
        total = total + gap_weight * (gap - 1)
    for weight, term in terms or []:
        total = total + weight * F.coalesce(term.cast("double"), F.lit(0.0))
    return adjusted(cost, total)


def affine_residual(x: Column, y: Column, tx: Column, ty: Column, affine: dict[str, Column], scale: float = 1.0) -> Column:
    """Distance between a point moved by an affine fit (tx_0, tx_x, tx_y, ty_0, ...) and its partner, over a scale."""
    u = affine["tx_0"] + affine["tx_x"] * x + affine["tx_y"] * y - tx
    v = affine["ty_0"] + affine["ty_x"] * x + affine["ty_y"] * y - ty
    return F.sqrt(u * u + v * v) / scale


def radial_residual(x: Column, y: Column, tx: Column, ty: Column, cx: Column, cy: Column, scale: float = 1.0) -> Column:
    """|difference of the two distances from a centre| over a scale."""
    far = lambda a, b: F.sqrt(F.pow(a - cx, 2) + F.pow(b - cy, 2))
    return F.abs(far(x, y) - far(tx, ty)) / scale


def intercept(gap: Column, density: Column, probability: Column, rmse: Column, valid: Column, trace: Column, bias: Column | float = 0.0, weights: dict | None = None) -> Column:
    """The bounded logit intercept of a session pair from what is seen of it; missing values are neutral."""
    w = INTERCEPT | (weights or {})
    zero = F.lit(0.0)
    total = (
        w["gap"] * F.greatest(_finite(gap, 1.0) - 1.0, zero)
        + w["density"] * F.greatest(_finite(density, 0.0), zero)
        + w["low_probability"] * (1.0 - clip(_finite(probability, 0.5), 0.0, 1.0))
        + w["rmse"] * F.greatest(_finite(rmse, 0.0), zero)
        + w["invalid"] * (1.0 - clip(_finite(valid, 1.0), 0.0, 1.0))
        + w["trace"] * clip(_finite(trace, 0.0), 0.0, 1.0)
        + bias
    )
    return clip(total, -w["limit"], w["limit"])


def context_offset(gap: Column, rmse: Column, valid: Column, probability: Column, weights: dict | None = None) -> Column:
    """A session pair's cost offset, never negative."""
    w = OFFSET | (weights or {})
    total = w["gap"] * (gap - 1) + w["rmse"] * rmse + w["invalid"] * (1.0 - valid) + w["low_probability"] * (1.0 - probability)
    return F.greatest(total, F.lit(0.0))


def shared_reliability(qualities: DataFrame, edge: list[str]) -> DataFrame:
    """Per session pair over its planes (valid_fraction, rmse): mean valid / (1 + mean rmse) in [0, 1]; 0 without values."""
    ok = lambda c: F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)))
    value = clip(F.coalesce(ok("valid_fraction"), F.lit(0.0)) / (1.0 + F.coalesce(ok("rmse"), F.lit(0.0))), 0.0, 1.0)
    return qualities.groupBy(*edge).agg(value.alias("reliability"))


def plane_metadata(planes: DataFrame, edge: list[str]) -> DataFrame:
    """Per session pair: planes, median shifts, their median absolute deviations, median peak and fit error."""
    median = lambda c: F.percentile(c, F.lit(0.5))
    m = planes.groupBy(*edge).agg(F.count(F.lit(1)).alias("plane_count"), *(median(c).alias(f"median_{c}") for c in ("shift_y", "shift_x", "peak_correlation", "fit_rmse")))
    off = planes.join(m.select(*edge, "median_shift_y", "median_shift_x"), edge)
    mads = off.groupBy(*edge).agg(*(median(F.abs(F.col(c) - F.col(f"median_{c}"))).alias(f"{c}_mad") for c in ("shift_y", "shift_x")))
    return m.join(mads, edge)


def plane_penalty(shift_weight: float, quality_weight: float, min_planes: int = 2) -> Column:
    """The penalty of a row of plane_metadata: disagreeing shifts, fit error, low peaks; 0 for too few planes."""
    shift = F.coalesce("shift_y_mad", F.lit(0.0)) + F.coalesce("shift_x_mad", F.lit(0.0))
    worse = F.greatest(F.coalesce("median_fit_rmse", F.lit(0.0)), F.lit(0.0)) + F.greatest(1.0 - F.coalesce("median_peak_correlation", F.lit(1.0)), F.lit(0.0))
    return F.when(F.col("plane_count") < min_planes, 0.0).otherwise(shift_weight * shift + quality_weight * worse)


def event_relief(score: Column, overlap: Column, dice: Column, area_cost: Column, min_overlap: float, min_dice: float, max_area_cost: float) -> Column:
    """-score / 4 for pairs that a split or merge explains, else 0."""
    plausible = ((overlap >= min_overlap) | (dice >= min_dice)) & (area_cost <= max_area_cost)
    return F.when(plausible, -0.25 * clip(score, 0.0, 1.0)).otherwise(0.0)


def edge_reliability(*, gated: Column | None = None, rank: Column | None = None, activity: list[Column] | None = None, empty: Column | None = None, rmse: Column | None = None, valid: Column | None = None, weights: dict | None = None) -> Column:
    """exp of minus the summed penalties, at least `least`; the first activity flag that is there counts."""
    w = UNRELIABLE | (weights or {})
    total = F.lit(0.0)
    if gated is not None:
        total = total + F.when(gated, w["gated"]).otherwise(0.0)
    if rank is not None:
        total = total + w["rank"] * clip(rank, 0.0, 1.0)
    if activity:
        total = total + w["no_activity"] * (1.0 - clip(F.coalesce(*activity), 0.0, 1.0))
    if empty is not None:
        total = total + F.when(empty, w["empty"]).otherwise(0.0)
    if rmse is not None:
        total = total + F.coalesce(w["rmse"] * F.greatest(rmse, F.lit(0.0)), F.lit(0.0))
    if valid is not None:
        total = total + F.coalesce(w["invalid"] * (1.0 - clip(valid, 0.0, 1.0)), F.lit(0.0))
    return clip(F.exp(-clip(total, 0.0, 100.0)), w["least"], 1.0)


def edge_reliabilities(*, rank: np.ndarray, activity: np.ndarray, empty: np.ndarray, rmse: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """edge_reliability() of arrays without missing values, for pairs that are made in tiles."""
    w = UNRELIABLE
    total = 0.0 + w["rank"] * np.clip(rank, 0.0, 1.0)
    total = total + w["no_activity"] * (1.0 - np.clip(activity, 0.0, 1.0))
    total = total + np.where(empty, w["empty"], 0.0)
    total = total + w["rmse"] * np.maximum(rmse, 0.0)
    total = total + w["invalid"] * (1.0 - np.clip(valid, 0.0, 1.0))
    return np.clip(np.exp(-np.clip(total, 0.0, 100.0)), w["least"], 1.0)


def uncertain_cost(cost: Column, reliability: Column, weight: float = 1.0) -> Column:
    return adjusted(cost, -weight * F.log(reliability))


def posterior_candidates(pairs: DataFrame, edge: list[str], min_probability: float, row_top_k: int | None = None, column_top_k: int | None = None) -> DataFrame:
    """Pairs likely enough, or among the k likeliest of their row or of their column."""
    keep, out = F.col("posterior") >= min_probability, pairs
    for name, mine, other, k in (("_i", "roi_a", "roi_b", row_top_k), ("_j", "roi_b", "roi_a", column_top_k)):
        if k is not None:
            out = out.withColumn(name, F.row_number().over(Window.partitionBy(*edge, mine).orderBy(F.desc("posterior"), other)))
            keep = keep | (F.col(name) <= k)
    return out.where(keep).drop("_i", "_j")


def confident_anchors(pairs: DataFrame, edge: list[str], min_probability: float, min_margin: float, min_anchors: int) -> DataFrame:
    """The best pair of each row if it is likely and clear of the next; short session pairs are topped up by the likeliest others.

    A row's only pair is clear of 0.
    """
    line = Window.partitionBy(*edge, "roi_a").orderBy(F.desc("posterior"), "roi_b")
    first = pairs.withColumns({"_k": F.row_number().over(line), "_next": F.coalesce(F.lead("posterior").over(line), F.lit(0.0))})
    clear = (F.col("_k") == 1) & (F.col("posterior") >= min_probability) & (F.col("posterior") - F.col("_next") >= min_margin)
    order = Window.partitionBy(*edge).orderBy(F.desc("_clear"), F.desc("posterior"), "roi_a", "roi_b")
    out = first.withColumn("_clear", clear).withColumn("_place", F.row_number().over(order))
    return out.where(F.col("_clear") | (F.col("_place") <= min_anchors)).withColumn("confident", F.col("_clear")).drop("_k", "_next", "_clear", "_place")
