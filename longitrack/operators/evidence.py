"""Local evidence for candidate pairs: overlap under shifts and dilation, outline distance, image patches,
neighbour constellations, shapes, density and traces.

Shifts and dilations multiply pixels by a fixed number of offsets and meet in an equi-join, so only pairs
that touch are made. Neighbour features compare the points of one session, which `keys` must name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.functions import EPSILON
from longitrack.operators import dense, tiles
from longitrack.operators.pairs import overlaps
from longitrack.session import written


def shift_offsets(radius: int) -> list[tuple[int, int]]:
    """All (dy, dx) of at most radius along either axis, shortest first, then by dy and dx."""
    span = range(-radius, radius + 1)
    return sorted(((dy, dx) for dy in span for dx in span), key=lambda o: (o[0] ** 2 + o[1] ** 2, *o))


def _offsets(offsets: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(offsets))))


def moved(pixels: DataFrame, offsets: list[tuple[int, int]], shape: tuple[int, int] | None = None) -> DataFrame:
    """Every pixel at every offset, with rank, dy and dx; those that leave an image of `shape` (height, width) are lost."""
    out = pixels.withColumn("_o", _offsets(offsets)).withColumns({"y": F.col("y") + F.col("_o.dy"), "x": F.col("x") + F.col("_o.dx"), "rank": F.col("_o.rank"), "dy": F.col("_o.dy"), "dx": F.col("_o.dx")}).drop("_o")
    return out if shape is None else out.where(F.col("y").between(0, shape[0] - 1) & F.col("x").between(0, shape[1] - 1))


def shifted_overlaps(a: DataFrame, b: DataFrame, roi_a: str, roi_b: str, keys: list[str], radius: int, shape: tuple[int, int]) -> DataFrame:
    """(*keys, roi_a, roi_b, shifted_iou, shift_dy, shift_dx, shifted_cosine) of pairs that touch at some offset of b.

    The best IoU is of the smallest offset that reaches it. The cosine is the best at any offset and keeps
    b's own norm. a and b: (*keys, roi, x, y, w), w positive. Small images are compared in blocks, where nearly all pairs touch.
    """
    dy, dx = (F.array(*(F.lit(o[i]) for o in shift_offsets(radius)))[F.col("rank")] for i in (0, 1))
    if dense.small(shape):
        out = dense.shifted_overlaps(a, b, roi_a, roi_b, keys, shift_offsets(radius), shape)
        return out.select(*keys, roi_a, roi_b, "shifted_iou", dy.alias("shift_dy"), dx.alias("shift_dx"), "shifted_cosine")
    square = F.sum(F.col("w") * F.col("w") * 1.0)
    left = a.withColumnRenamed("w", "w_a")
    right = moved(b, shift_offsets(radius), shape).withColumnRenamed("w", "w_b").drop("dy", "dx")
    area_a = a.groupBy(*keys, roi_a).agg(F.count(F.lit(1)).alias("area_a"), F.sqrt(square).alias("norm_a"))
    area_b = right.groupBy(*keys, roi_b, "rank").agg(F.count(F.lit(1)).alias("area_b"))
    norm_b = b.groupBy(*keys, roi_b).agg(F.sqrt(square).alias("norm_b"))
    met = left.join(right, [*keys, "x", "y"]).groupBy(*keys, roi_a, roi_b, "rank").agg(F.count(F.lit(1)).alias("inter"), F.sum(F.col("w_a") * F.col("w_b") * 1.0).alias("dot"))
    c = met.join(area_a, [*keys, roi_a]).join(area_b, [*keys, roi_b, "rank"]).join(norm_b, [*keys, roi_b])
    iou = F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter"))
    cosine = F.col("dot") / F.greatest(F.col("norm_a") * F.col("norm_b"), F.lit(EPSILON))
    best = F.max(F.struct(iou.alias("iou"), (-F.col("rank")).alias("first")))
    out = c.groupBy(*keys, roi_a, roi_b).agg(best.alias("best"), F.max(cosine).alias("shifted_cosine"))
    out = out.withColumn("rank", -F.col("best.first"))
    return out.select(*keys, roi_a, roi_b, F.col("best.iou").alias("shifted_iou"), dy.alias("shift_dy"), dx.alias("shift_dx"), "shifted_cosine")


def shift_penalty(dy: Column, dx: Column, scale: float = 1.0) -> Column:
    return F.sqrt(dy * dy + dx * dx) / scale


def dilated(pixels: DataFrame, roi: str, keys: list[str], radius: int, shape: tuple[int, int]) -> DataFrame:
    """Supports grown by a disk, of weight 1."""
    disk = [o for o in shift_offsets(radius) if o[0] ** 2 + o[1] ** 2 <= radius * radius]
    return moved(pixels.select(*keys, roi, "x", "y"), disk, shape).select(*keys, roi, "x", "y").distinct().withColumn("w", F.lit(1.0))


def dilated_iou(a: DataFrame, b: DataFrame, roi_a: str, roi_b: str, keys: list[str], radius: int, shape: tuple[int, int]) -> DataFrame:
    """(roi_a, roi_b, iou) of grown supports that touch; ids are unique over keys."""
    grown = dilated(a, roi_a, keys, radius, shape), dilated(b, roi_b, keys, radius, shape)
    if dense.small(shape):
        return dense.shared(*grown, roi_a, roi_b, keys, shape).select(roi_a, roi_b, "iou")
    return overlaps(*grown, roi_a, roi_b, [*keys, "x", "y"]).select(roi_a, roi_b, "iou")


def outline_cost(a: DataFrame, b: DataFrame, pairs: DataFrame, roi_a: str, roi_b: str, scale: float, shape: tuple[int, int]) -> DataFrame:
    """Symmetric chamfer distance of each candidate pair: the mean way of a's pixels to b's and back, over twice the scale.

    Steps cost 1, diagonal ones sqrt 2; an empty side is height plus width away. The way to a support is worked out
    once for each of the image's pixels that any partner has, then looked up by all pairs; a support is an array,
    which no image makes long.
    """

    def one_way(own, roi, other, far):
        pack = other.groupBy(far).agg(F.collect_list(F.struct("x", "y")).alias("_q"))
        cells = pairs.select(roi_a, roi_b).join(own.select(roi, F.col("x").alias("_x"), F.col("y").alias("_y")), roi)
        way = lambda q: F.greatest(F.abs(F.col("_x") - q["x"]), F.abs(F.col("_y") - q["y"])) + (2**0.5 - 1) * F.least(F.abs(F.col("_x") - q["x"]), F.abs(F.col("_y") - q["y"]))
        field = cells.select(far, "_x", "_y").distinct().join(pack, far).select(far, "_x", "_y", F.array_min(F.transform("_q", way)).alias("_d"))
        return cells.join(field, [far, "_x", "_y"]).groupBy(roi_a, roi_b).agg(F.avg("_d").alias(f"_{roi}"))

    both = pairs.join(one_way(a, roi_a, b, roi_b), [roi_a, roi_b], "left").join(one_way(b, roi_b, a, roi_a), [roi_a, roi_b], "left")
    cost = F.coalesce(0.5 * (F.col(f"_{roi_a}") + F.col(f"_{roi_b}")), F.lit(float(sum(shape)))) / scale
    return both.withColumn("outline_cost", cost).drop(f"_{roi_a}", f"_{roi_b}")


def shapes(pixels: DataFrame, roi: str, shape: tuple[int, int], bins: int = 6) -> DataFrame:
    """Per ROI: area, compactness, eccentricity, orientation, share of border pixels, weighted radial profile.

    Orientation is that of the major axis in (-pi/2, pi/2]. One shuffle by ROI serves all.
    """
    by = Window.partitionBy(roi)
    x, y, w = F.col("x"), F.col("y"), F.col("w") * 1.0
    p = pixels.where((F.col("w") > 0) & ~F.isnan(w)).withColumn("_m", F.sum(w).over(by))
    p = p.withColumns({"_cx": F.sum(w * x).over(by) / F.col("_m"), "_cy": F.sum(w * y).over(by) / F.col("_m")})
    dx, dy = x - F.col("_cx"), y - F.col("_cy")
    p = p.withColumn("_d", F.sqrt(dx * dx + dy * dy)).withColumn("_far", F.max("_d").over(by))
    ring = F.when(F.col("_far") > 0, F.least(F.floor(F.col("_d") / F.col("_far") * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    edge = (y == 0) | (y == shape[0] - 1) | (x == 0) | (x == shape[1] - 1)
    mass = F.sum(w)
    g = p.withColumn("_ring", ring).groupBy(roi).agg(
        F.count(F.lit(1)).alias("area"),
        ((F.max(x) - F.min(x) + 1) * (F.max(y) - F.min(y) + 1)).alias("_box"),
        F.avg(edge.cast("double")).alias("border_share"),
        (F.sum(w * dx * dx) / mass).alias("_xx"), (F.sum(w * dy * dy) / mass).alias("_yy"), (F.sum(w * dx * dy) / mass).alias("_xy"),
        F.array(*(F.sum(F.when(F.col("_ring") == i, w).otherwise(0.0)) / mass for i in range(bins))).alias("radial_profile"),
    )
    half, spread = (F.col("_xx") + F.col("_yy")) / 2, F.sqrt(F.pow((F.col("_xx") - F.col("_yy")) / 2, 2) + F.col("_xy") * F.col("_xy"))
    minor, major = F.greatest(half - spread, F.lit(0.0)), F.greatest(half + spread, F.lit(1e-12))
    return g.select(
        roi, "area",
        (F.col("area") / F.col("_box")).alias("compactness"),
        F.sqrt(F.greatest(1.0 - minor / major, F.lit(0.0))).alias("eccentricity"),
        (0.5 * F.atan2(2.0 * F.col("_xy"), F.col("_xx") - F.col("_yy"))).alias("orientation"),
        "border_share", "radial_profile",
    )


def density(points: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Per point: neighbours within the radius, their share of the session, nearest and median distance; alone: zeros."""
    return _with_density(points, tiles.neighbours(points, keys, radius, 1), keys)


def _with_density(points: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    n = F.greatest(F.count(F.lit(1)).over(Window.partitionBy(*keys)) - 1, F.lit(1))
    out = points.withColumn("_n", n).join(near, [*keys, "roi"], "left").na.fill(0, ["density"]).na.fill(0.0, ["nearest", "median_distance"])
    return out.select(*keys, "roi", "density", (F.col("density") / F.col("_n")).alias("crowding"), "nearest", "median_distance")


def signatures(points: DataFrame, keys: list[str], k: int, normalized: bool = True) -> DataFrame:
    """Per point: its k least distances to others in order, over the session's median; short ones repeat their last, lone ones are 0."""
    return _with_signature(points, tiles.neighbours(points, keys, 0.0, k), keys, k, normalized)


def _with_signature(points: DataFrame, near: DataFrame, keys: list[str], k: int, normalized: bool) -> DataFrame:
    last = F.coalesce(F.element_at("least", -1), F.lit(0.0))
    full = F.slice(F.concat(F.col("least"), F.array_repeat(last, k)), 1, k)
    if normalized:
        near = near.join(tiles.median_distance(points, keys), keys)
        divisor = F.when(F.col("median") > 1e-12, F.col("median")).otherwise(1.0)
        full = F.transform(full, lambda v: v / divisor)
    out = points.select(*keys, "roi").join(near.select(*keys, "roi", full.alias("signature")), [*keys, "roi"], "left")
    return out.select(*keys, "roi", F.coalesce("signature", F.array_repeat(F.lit(0.0), k)).alias("signature"))


def surroundings(points: DataFrame, keys: list[str], radius: float, k: int) -> DataFrame:
    """What density() and signatures() give, from one comparison of the points."""
    near = written(tiles.neighbours(points, keys, radius, k), "neighbours")
    return _with_density(points, near, keys).join(_with_signature(points, near, keys, k, True), [*keys, "roi"])


def constellation_cost(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Mean absolute difference of two signatures over the scale."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d) / F.size(a) / scale


def patches(image: DataFrame, points: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(*keys, roi, dy, dx, v) of the image in a square around each point, rounded half to even; missing and NaN pixels have no row."""
    around = moved(points.withColumns({"x": F.bround("x").cast("long"), "y": F.bround("y").cast("long")}), shift_offsets(radius)).drop("rank")
    return around.join(image.where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double"))), [*keys, "x", "y"]).select(*keys, "roi", "dy", "dx", F.col("v").cast("double").alias("v"))


def patch_moments(image: DataFrame, points: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Per point: pixels, mean and population deviation of its patch; 0 where the patch is outside."""
    m = patches(image, points, keys, radius).groupBy(*keys, "roi").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return points.select(*keys, "roi").join(m, [*keys, "roi"], "left").na.fill(0, ["n"]).na.fill(0.0, ["mean", "std"])


def unit_patches(image: DataFrame, points: DataFrame, keys: list[str], radius: int, epsilon: float = EPSILON) -> DataFrame:
    """(*keys, roi, patch) of points whose patch has two pixels or more and contrast: centred, of norm 1, missing pixels 0, by rows of offsets."""
    by = Window.partitionBy(*keys, "roi")
    c = patches(image, points, keys, radius).withColumns({"_n": F.count(F.lit(1)).over(by), "_c": F.col("v") - F.avg("v").over(by)})
    c = c.withColumn("_norm", F.sqrt(F.sum(F.col("_c") * F.col("_c")).over(by))).where((F.col("_n") >= 2) & (F.col("_norm") > epsilon))
    side = 2 * radius + 1
    place = ((F.col("dy") + radius) * side + F.col("dx") + radius).cast("int")
    cells = c.groupBy(*keys, "roi").agg(F.map_from_entries(F.collect_list(F.struct(place, F.col("_c") / F.col("_norm")))).alias("_m"))
    return cells.select(*keys, "roi", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.coalesce(F.element_at("_m", k), F.lit(0.0))).alias("patch"))


def patch_correlations(image_a: DataFrame, points_a: DataFrame, image_b: DataFrame, points_b: DataFrame, pairs: DataFrame, keys: list[str], radius: int, epsilon: float = EPSILON) -> DataFrame:
    """pairs (*keys, roi_a, roi_b) with patch_correlation and patch_valid.

    Patches are centred and scaled to norm 1; missing pixels count as the patch's mean. A patch of fewer than
    two pixels, or without contrast, makes its pairs invalid, of correlation 0.
    """

    def unit(image, points, roi):
        by = Window.partitionBy(*keys, "roi")
        c = patches(image, points, keys, radius).withColumns({"_n": F.count(F.lit(1)).over(by), "_c": F.col("v") - F.avg("v").over(by)})
        c = c.withColumn("_norm", F.sqrt(F.sum(F.col("_c") * F.col("_c")).over(by))).where((F.col("_n") >= 2) & (F.col("_norm") > epsilon))
        cells = F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "dy", "dx"), F.col("_c") / F.col("_norm"))))
        return c.groupBy(*keys, F.col("roi").alias(roi)).agg(cells.alias(f"_{roi}"))

    both = pairs.join(unit(image_a, points_a, "roi_a"), [*keys, "roi_a"], "left").join(unit(image_b, points_b, "roi_b"), [*keys, "roi_b"], "left")
    a, b = F.col("_roi_a"), F.col("_roi_b")
    products = F.transform(F.map_entries(a), lambda e: e["value"] * F.coalesce(F.element_at(b, e["key"]), F.lit(0.0)))
    valid = a.isNotNull() & b.isNotNull()
    dot = F.when(valid, F.aggregate(products, F.lit(0.0), lambda s, p: s + p)).otherwise(0.0)
    return both.withColumns({"patch_correlation": dot, "patch_valid": valid}).drop("_roi_a", "_roi_b")


def place_cost() -> Column:
    """The centroid_rank_cost of pairs with their places, as tiles.ranked() gives them."""
    share = lambda line: F.col(f"{line}_place") / F.greatest(F.col(f"{line}_n") - 1, F.lit(1))
    return 0.5 * (share("row") + share("column"))


def rank_cost(pairs: DataFrame, edge: list[str], distance: str) -> DataFrame:
    """Half the sum of a pair's ranks by distance in its row and column, each between 0 and 1; ties by id."""
    out = pairs
    for name, mine, other in (("_i", "roi_a", "roi_b"), ("_j", "roi_b", "roi_a")):
        line = Window.partitionBy(*edge, mine)
        share = (F.row_number().over(line.orderBy(distance, other)) - 1) / F.greatest(F.count(F.lit(1)).over(line) - 1, F.lit(1))
        out = out.withColumn(name, share)
    return out.withColumn("centroid_rank_cost", 0.5 * (F.col("_i") + F.col("_j"))).drop("_i", "_j")


def _there(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def feature_scales(values: DataFrame, edge: list[str], names: list[str], epsilon: float = EPSILON) -> DataFrame:
    """(edge, _s_* of each name) of both sides' values (edge, name, value).

    A scale is the quartile range / 1.349 if there are four values or more and it is large enough, else their deviation, else 1.
    """
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    s = values.where(_there(F.col("value"))).groupBy(*edge, "name").agg(F.count(F.lit(1)).alias("_n"), q.alias("_q"), F.stddev_pop("value").alias("_sd"))
    spread = (F.col("_q")[1] - F.col("_q")[0]) / 1.349
    scale = F.when((F.col("_n") >= 4) & (spread >= epsilon), spread).when(F.col("_sd") >= epsilon, F.col("_sd")).otherwise(1.0)
    return s.withColumn("_scale", scale).groupBy(*edge).agg(*(F.max(F.when(F.col("name") == n, F.col("_scale"))).alias(f"_s_{n}") for n in names))


def feature_gap(names: list[str]) -> Column:
    """The mean over shared features of |_f_*_a - _f_*_b| / _s_*; 1 where none is shared."""
    total, n = F.lit(0.0), F.lit(0)
    for f in names:
        a, b = F.col(f"_f_{f}_a"), F.col(f"_f_{f}_b")
        shared = _there(a) & _there(b)
        total = total + F.when(shared, F.abs(a - b) / F.col(f"_s_{f}")).otherwise(0.0)
        n = n + shared.cast("int")
    return F.when(n > 0, total / n).otherwise(1.0)


def feature_distance(a: DataFrame, b: DataFrame, pairs: DataFrame, edge: list[str], epsilon: float = EPSILON) -> DataFrame:
    """pairs with the mean over shared features of |difference| / scale; 1 where none is shared.

    a and b: (*edge, roi, name, value). A scale is the quartile range / 1.349 of both sides' values if there are
    four or more and it is large enough, else their deviation, else 1. Values that are null or NaN are missing.
    """
    ok = lambda df: df.where(_there(F.col("value")))
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    s = ok(a).unionByName(ok(b)).groupBy(*edge, "name").agg(F.count(F.lit(1)).alias("_n"), q.alias("_q"), F.stddev_pop("value").alias("_sd"))
    spread = (F.col("_q")[1] - F.col("_q")[0]) / 1.349
    s = s.select(*edge, "name", F.when((F.col("_n") >= 4) & (spread >= epsilon), spread).when(F.col("_sd") >= epsilon, F.col("_sd")).otherwise(1.0).alias("_scale"))
    left = pairs.select(*edge, "roi_a", "roi_b").join(ok(a).select(*edge, F.col("roi").alias("roi_a"), "name", F.col("value").alias("_va")), [*edge, "roi_a"])
    both = left.join(ok(b).select(*edge, F.col("roi").alias("roi_b"), "name", F.col("value").alias("_vb")), [*edge, "roi_b", "name"]).join(s, [*edge, "name"])
    mean = both.groupBy(*edge, "roi_a", "roi_b").agg(F.avg(F.abs(F.col("_va") - F.col("_vb")) / F.col("_scale")).alias("feature_distance"))
    return pairs.join(mean, [*edge, "roi_a", "roi_b"], "left").na.fill(1.0, ["feature_distance"])


def trace_statistics(traces: DataFrame, keys: list[str], threshold: float = 0.0, epsilon: float = EPSILON) -> DataFrame:
    """Per trace (rows of `v`): frames, mean, deviation, skewness (0 without spread) and the share of frames above a threshold."""
    g = traces.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.skewness("v").alias("_s"), F.avg((F.col("v") > threshold).cast("double")).alias("event_rate"))
    return g.withColumn("skew", F.when(F.col("std") > epsilon, F.col("_s")).otherwise(0.0)).drop("_s")


def scaled_difference(a: Column, b: Column, scale: Column) -> Column:
    """|a - b| / scale, 0 where either is missing."""
    return F.coalesce(F.abs(a - b) / F.when(scale > EPSILON, scale).otherwise(1.0), F.lit(0.0))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda p, q: p & q, conditions, F.lit(True))


def near_candidates(pairs: DataFrame, edge: list[str], max_distance: float | None = None, row_top_k: int | None = None, column_top_k: int | None = None) -> DataFrame:
    """Pairs (…, distance) within a distance and among the k nearest of their row and of their column; ties by id."""
    out, checks = pairs, []
    if max_distance is not None:
        checks.append(F.col("distance") <= max_distance)
    for name, mine, other, k in (("_i", "roi_a", "roi_b", row_top_k), ("_j", "roi_b", "roi_a", column_top_k)):
        if k is not None:
            out = out.withColumn(name, F.row_number().over(Window.partitionBy(*edge, mine).orderBy("distance", other)))
            checks.append(F.col(name) <= k)
    return out.where(all_of(checks)).drop("_i", "_j")
