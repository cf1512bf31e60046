"""Queries of the reports and their SQL, added to the catalog: users are tracks, days sessions, hours ROIs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.operators import descriptors, pairs, reports, tracks
from longitrack.plans.catalog import _LEDGER, _RESULTS, _TRACKS, _results, _round, _table, _tracks, query
from longitrack.plans.local import _PX, _SHAPE, _centres, _image

_IDS = "array_to_string(list(roi ORDER BY session_index), ',') AS identity"
_AUDIT = (
    _TRACKS
    + """, u AS (SELECT session_a, session_b, roi_a, roi_b, bool_or(k = 1) AS in_gt, bool_or(k = 2) AS in_teacher, bool_or(k = 3) AS in_prediction FROM (
  SELECT 1 AS k, session_a, session_b, roi_a, roi_b FROM rl UNION ALL SELECT 2, session_a, session_b, roi_a, roi_b FROM tl UNION ALL SELECT 3, session_a, session_b, roi_a, roi_b FROM pl) GROUP BY ALL)
"""
)


def _audit(spark, d):
    return tracks.audit(*(tracks.links(_tracks(spark, d, k)) for k in ("reference", "teacher", "predicted")))


def _ledger(spark, d):
    return tracks.ledger(tracks.links(_tracks(spark, d, "predicted")), tracks.links(_tracks(spark, d, "reference")), tracks.LINK)


@query(
    _TRACKS
    + f""", c AS (SELECT track_id % 7 AS score, {_IDS} FROM p WHERE session_index < 2 GROUP BY track_id HAVING count(*) = 2), k AS (SELECT DISTINCT identity FROM (SELECT {_IDS} FROM r WHERE session_index < 2 GROUP BY track_id HAVING count(*) = 2)),
o AS (SELECT threshold, count(*) AS predictions, count(DISTINCT k.identity) AS tp FROM (SELECT DISTINCT score AS threshold FROM c) JOIN c ON score >= threshold LEFT JOIN k USING (identity) GROUP BY 1),
tg AS (SELECT CAST(unnest([0.05, 0.2, 0.9]) AS DOUBLE) AS target), b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY tp DESC, predictions, threshold DESC) AS i FROM tg JOIN o ON tp / predictions >= target AND tp > 0)
SELECT tg.target, coalesce(tp, 0) AS tp, coalesce(predictions, 0) AS predictions, round(coalesce(tp / predictions, 1), 6) AS precision, round(coalesce(tp, 0) / (SELECT count(*) FROM k), 6) AS recall, CAST(threshold AS DOUBLE) AS threshold FROM tg LEFT JOIN b ON b.target = tg.target AND i = 1"""
)
def report_fixed_precision(spark, d):
    made = tracks.complete(_tracks(spark, d, "predicted"), 2).withColumn("score", (F.col("track_id") % 7).cast("double"))
    return _round(reports.at_fixed_precision(made, tracks.complete(_tracks(spark, d, "reference"), 2), (0.05, 0.2, 0.9)), "precision", "recall")


_FEEDBACK = _LEDGER + """, f AS (SELECT * FROM (SELECT session_a, session_b, roi_a, roi_b, n_predicted, n_reference, unnest([0, 1, 2, 3]) AS place, unnest(['true_positive', 'false_positive', 'false_negative', 'duplicate_prediction']) AS status,
  CAST(unnest([tp, fp, fn, greatest(n_predicted - 1, 0)]) AS BIGINT) AS count, CAST(unnest([1, 2, 2, 3]) AS DOUBLE) AS weight FROM e) WHERE count > 0)
"""


@query(_FEEDBACK + "SELECT * FROM f")
def report_link_feedback(spark, d):
    return reports.feedback(_ledger(spark, d), tracks.LINK)


@query(_FEEDBACK + "SELECT session_a, session_b, roi_a, roi_b, CASE WHEN place IN (1, 3) THEN 0 ELSE 1 END AS label, weight * count AS weight FROM (SELECT *, row_number() OVER (PARTITION BY session_a, session_b, roi_a, roi_b ORDER BY weight * count DESC, place) AS i FROM f) WHERE i = 1")
def report_label_overrides(spark, d):
    return reports.label_overrides(reports.feedback(_ledger(spark, d), tracks.LINK), tracks.LINK)


@query(
    _AUDIT
    + """, w AS (SELECT *, CASE WHEN in_gt OR in_teacher THEN 1 ELSE 0 END AS label, CASE WHEN in_gt THEN 1 WHEN in_teacher THEN 0.25 ELSE 0.1 END * CASE WHEN in_gt <> in_teacher THEN 0.25 ELSE 1 END AS weight, CASE WHEN in_gt THEN 'manual' WHEN in_teacher THEN 'weak_teacher' ELSE 'prediction_only' END AS source FROM u)
SELECT session_a, session_b, roi_a, roi_b, label, round(CAST(weight AS DOUBLE), 6) AS weight, source, in_gt <> in_teacher AS disagrees FROM w"""
)
def report_weak_labels(spark, d):
    return _round(reports.weak_labels(_audit(spark, d)), "weight").select(*tracks.LINK, "label", "weight", "source", "disagrees")


@query(
    _AUDIT
    + """, m AS (SELECT *, CASE WHEN roi_a = 0 THEN roi_b - roi_a ELSE (roi_b - roi_a + roi_a - 12) / 2.0 END AS margin FROM u),
s AS (SELECT session_a, session_b, roi_a, roi_b, round(1 / (1 + greatest(CAST(margin AS DOUBLE), 0)) + (in_gt <> in_teacher)::INT + (in_gt <> in_prediction)::INT + 0.5::DOUBLE * (in_teacher <> in_prediction)::INT + (roi_a = roi_b)::INT + 1 / (1 + CAST(roi_a * roi_b AS DOUBLE)), 6) AS priority FROM m)
SELECT * FROM s ORDER BY priority DESC, session_a, session_b, roi_a, roi_b LIMIT 500"""
)
def report_label_candidates(spark, d):
    """The links most worth a label: a top-k report."""
    a, b = F.col("roi_a").cast("double"), F.col("roi_b").cast("double")
    score = reports.label_priority(b - a, F.when(a != 0, a - 12.0), a * b, F.col("in_gt"), F.col("in_teacher"), F.col("in_prediction"), a == b)
    ranked = _audit(spark, d).select(*tracks.LINK, F.round(score, 6).alias("priority"))
    return ranked.orderBy(F.desc("priority"), *tracks.LINK).limit(500)


_CEILING = "".join(
    f""", j{g} AS (SELECT *, sum(broken) OVER (PARTITION BY track_id ORDER BY session_index) AS piece FROM (SELECT *, CASE WHEN session_index - lag(session_index) OVER (PARTITION BY track_id ORDER BY session_index) > {g} THEN 1 ELSE 0 END AS broken FROM r)),
b{g} AS (SELECT j{g}.* FROM j{g} JOIN j{g} z ON z.track_id = j{g}.track_id AND z.session_index = 2 AND z.piece = j{g}.piece)"""
    for g in (1, 2)
)


def _ceiling_sql(g: int) -> str:
    link = lambda v: f"(SELECT count(*) FROM {v} x JOIN {v} y ON y.track_id = x.track_id AND y.session_index = x.session_index + 1)"
    whole = lambda v: f"(SELECT count(*) FROM (SELECT 1 FROM {v} WHERE session_index < 3 GROUP BY track_id HAVING count(*) = 3))"
    each = lambda kind, c: f"SELECT 2 AS seed_session, {g} AS max_gap, '{kind}' AS kind, {c(f'b{g}')} AS tp, 0::BIGINT AS fp, {c('r')} - {c(f'b{g}')} AS fn"
    return f"{each('link', link)} UNION ALL {each('complete', whole)}"


@query(_TRACKS + _CEILING + f", o AS ({_ceiling_sql(1)} UNION ALL {_ceiling_sql(2)}) SELECT *, round(CASE WHEN 2 * tp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fn) END, 6) AS f1 FROM o")
def report_ceilings(spark, d):
    return _round(reports.ceilings(_tracks(spark, d, "reference"), 3, [2], [1, 2]), "f1")


def _variant_sql(variant: str, gap: str, v: str) -> str:
    link = lambda v: f"(SELECT count(*) FROM {v} x JOIN {v} y ON y.track_id = x.track_id AND y.session_index = x.session_index + 1)"
    whole = lambda v: f"(SELECT count(*) FROM (SELECT 1 FROM {v} GROUP BY track_id HAVING count(*) = 30))"
    return " UNION ALL ".join(f"SELECT '{variant}' AS variant, 2 AS seed_session, {gap}::INT AS max_gap, '{kind}' AS kind, {c(v)} AS tp, 0::BIGINT AS fp, {c('r')} - {c(v)} AS fn" for kind, c in (("link", link), ("complete", whole)))


@query(
    _TRACKS
    + _CEILING
    + ", o AS ("
    + " UNION ALL ".join(_variant_sql(*x) for x in (("reference_rows", "NULL", "r"), ("consecutive_stitch", "1", "b1"), ("gap_limited", "1", "b1"), ("gap_limited", "2", "b2")))
    + ") SELECT *, round(CASE WHEN 2 * tp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fn) END, 6) AS f1 FROM o"
)
def report_oracle_variants(spark, d):
    """What perfect links recover of the users' last hours over thirty days, each an id of its own, by the way they are put together."""
    t = _tracks(spark, d, "reference").withColumn("roi", 100 * F.col("track_id") + F.col("roi"))
    return _round(reports.oracle_variants(t, 30, [2], [1, 2]), "f1")


@query(
    _RESULTS
    + """, l AS (SELECT approach, 'score' AS metric, score AS value FROM res UNION ALL SELECT approach, 'tp', tp FROM res)
SELECT approach, metric, count(*) AS n_rows, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS least, round(max(value), 6) AS greatest FROM l GROUP BY 1, 2"""
)
def report_stratified(spark, d):
    return _round(reports.stratified(_results(spark, d), ["approach"], ["score", "tp"]), "mean", "median", "least", "greatest")


@query(
    _RESULTS
    + """SELECT approach, count(score) AS n, count(*) FILTER (score IS NULL) AS n_missing, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(min(score), 6) AS least, round(max(score), 6) AS greatest, round(avg(tp), 6) AS mean_tp, row_number() OVER (ORDER BY avg(score) DESC NULLS LAST, avg(tp) DESC NULLS LAST, approach) AS place FROM res GROUP BY 1"""
)
def report_sweep(spark, d):
    return _round(reports.sweep(_results(spark, d), "approach", "score", ["tp"]), "mean", "sd", "least", "greatest", "mean_tp")


@query("SELECT event_id, event_type, user_id, hour(ts) AS cost, count(*) OVER (PARTITION BY event_type, user_id ORDER BY hour(ts) RANGE UNBOUNDED PRECEDING) AS pessimistic_rank FROM events")
def report_pessimistic_ranks(spark, d):
    return reports.pessimistic_ranks(_table(spark, d, "events").select("event_id", "event_type", "user_id", F.hour("ts").alias("cost")), ["event_type"], "user_id", "cost")


def _radial(spark, d):
    t = _table(spark, d, "events").groupBy(F.col("user_id").alias("track_id"), (F.dayofmonth("ts") - 1).alias("session_index")).agg(F.avg("value").alias("x"), F.avg(F.hour("ts")).alias("y"))
    later = t.where("session_index BETWEEN 1 AND 3")
    first = t.where("session_index = 0").drop("session_index").join(later.select("track_id", "session_index"), "track_id")
    return reports.radial_rows(first, later, ["session_index"])


_RADIAL = """
WITH t AS (SELECT user_id AS track_id, day(ts) - 1 AS session_index, avg(value) AS x, avg(hour(ts)) AS y FROM events GROUP BY 1, 2),
j AS (SELECT b.session_index, track_id, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, a.x - avg(a.x) OVER w AS rx, a.y - avg(a.y) OVER w AS ry FROM t a JOIN t b USING (track_id) WHERE a.session_index = 0 AND b.session_index BETWEEN 1 AND 3 WINDOW w AS (PARTITION BY b.session_index)),
q AS (SELECT *, sqrt(rx * rx + ry * ry) AS radius FROM j), m AS (SELECT *, (dx * rx + dy * ry) / radius AS radial, (rx * dy - ry * dx) / radius AS tangential, sqrt(dx * dx + dy * dy) AS norm FROM q WHERE radius > 1e-9)
"""


@query(_RADIAL + "SELECT session_index, track_id, round(radius, 5) AS radius, round(radial, 5) AS radial, round(tangential, 5) AS tangential, round(norm, 5) AS norm, round(CASE WHEN norm > 0 THEN radial / norm END, 5) AS alignment FROM m")
def geometry_radial_rows(spark, d):
    return _radial(spark, d).select("session_index", "track_id", *(F.round(c, 5).alias(c) for c in ("radius", "radial", "tangential", "norm", "alignment")))


@query(
    _RADIAL
    + """, s AS (SELECT session_index, count(*) AS n, count(*) FILTER (radial > 0) AS outward, count(*) FILTER (radial < 0) AS inward, avg(radial) AS mr, quantile_cont(radial, 0.5) AS md, avg(norm) AS mn, avg(CASE WHEN norm > 0 THEN radial / norm END) AS ma FROM m GROUP BY 1)
SELECT session_index, n, outward, inward, round(mr, 5) AS mean_radial, round(md, 5) AS median_radial, round(mn, 5) AS mean_norm, round(ma, 5) AS mean_alignment,
  round(CASE WHEN outward + inward > 0 THEN list_sum(list_transform(range(outward, outward + inward + 1), lambda i: exp(lgamma(outward + inward + 1) - lgamma(i + 1) - lgamma(outward + inward - i + 1) - (outward + inward) * ln(2)))) END, 5) AS p_value FROM s"""
)
def geometry_radial_growth(spark, d):
    s = reports.radial_summary(_radial(spark, d), ["session_index"])
    return s.withColumns({c: F.round(c, 5) for c in ("mean_radial", "median_radial", "mean_norm", "mean_alignment", "p_value")})


@query(
    _RADIAL
    + """, h AS (SELECT *, CASE WHEN y < avg(y) OVER w THEN 'north' ELSE 'south' END || '_' || CASE WHEN x < avg(x) OVER w THEN 'west' ELSE 'east' END AS quadrant FROM m WINDOW w AS (PARTITION BY session_index))
SELECT session_index, quadrant, count(norm) AS n, round(avg(norm), 5) AS mean, round(quantile_cont(norm, 0.5), 5) AS median, round(max(norm), 5) AS greatest FROM h GROUP BY 1, 2"""
)
def report_quadrants(spark, d):
    return reports.by_quadrant(_radial(spark, d), ["session_index"], "norm").withColumns({c: F.round(c, 5) for c in ("mean", "median", "greatest")})


@query(_TRACKS + "SELECT session_index, count(*) AS n_reference, count(x.roi) AS n_loaded, round(count(x.roi) / count(*), 6) AS coverage FROM (SELECT DISTINCT session_index, roi FROM r) y LEFT JOIN (SELECT DISTINCT session_index, roi FROM p) x USING (session_index, roi) GROUP BY 1")
def report_input_coverage(spark, d):
    return _round(reports.coverage(_tracks(spark, d, "reference"), _tracks(spark, d, "predicted"), ["session_index"]), "coverage")


@query(
    _TRACKS
    + """, v AS (SELECT DISTINCT session_index, roi FROM p), x AS (SELECT DISTINCT session_a, session_b, roi_a, roi_b FROM rl), y AS (SELECT x.*, a.roi IS NULL AS na, b.roi IS NULL AS nb FROM x LEFT JOIN v a ON a.session_index = session_a AND a.roi = roi_a LEFT JOIN v b ON b.session_index = session_b AND b.roi = roi_b)
SELECT session_a, session_b, roi_a, roi_b, CASE WHEN na AND nb THEN 'both_missing' WHEN na THEN 'source_missing' ELSE 'target_missing' END AS reason FROM y WHERE na OR nb"""
)
def report_missing_edges(spark, d):
    return reports.missing_edges(tracks.links(_tracks(spark, d, "reference")), _tracks(spark, d, "predicted"))


@query(
    _TRACKS
    + """, l AS (SELECT DISTINCT a.session_index AS session_a, b.session_index AS session_b, a.roi AS roi_a, b.roi AS roi_b FROM p a JOIN p b ON a.track_id = b.track_id AND b.session_index BETWEEN a.session_index + 1 AND a.session_index + 2),
w AS (SELECT s.session_a, s.session_b, s.roi_a, s.roi_b, count(DISTINCT y.session_a) FILTER (y.roi_b = s.roi_b) AS support, count(*) FILTER (y.roi_b <> s.roi_b) AS conflicts FROM l s JOIN l x ON x.session_a = s.session_a AND x.roi_a = s.roi_a AND x.session_b < s.session_b JOIN l y ON y.session_a = x.session_b AND y.roi_a = x.roi_b AND y.session_b = s.session_b WHERE s.session_b = s.session_a + 2 GROUP BY ALL)
SELECT * FROM l WHERE session_b = session_a + 1 UNION ALL SELECT session_a, session_b, roi_a, roi_b FROM w WHERE support >= 1 AND conflicts = 0"""
)
def track_supported_skips(spark, d):
    return reports.supported_skips(tracks.edge_index(_tracks(spark, d, "predicted"), 2))


@query("SELECT 0 AS session_a, 1 AS session_b, a.vec_id AS roi_a, b.vec_id AS roi_b FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1")
def track_label_pairs(spark, d):
    """Even vectors are the first session's ROIs and odd ones the second's."""
    labels = _table(spark, d, "embeddings").select((F.col("vec_id") % 2).alias("session_index"), F.col("vec_id").alias("roi"), "label")
    return reports.label_pairs(labels, 0, 1)


@query(
    _TRACKS
    + """, l AS (SELECT track_id, lead(session_index) OVER w AS sb, (roi * 7 + lead(roi) OVER w * 3) % 20 / 8.0 AS risk, row_number() OVER w AS i, count(*) OVER (PARTITION BY track_id) AS n FROM p WINDOW w AS (PARTITION BY track_id ORDER BY session_index)),
c AS (SELECT track_id, sb, risk - 0.25 AS g, i FROM l WHERE sb IS NOT NULL AND i >= 2 AND n - i >= 2 AND risk >= 1.5),
z AS (SELECT track_id, g, 1 AS m, i AS k, [sb] AS path FROM c UNION ALL SELECT a.track_id, a.g + b.g, 2, a.i, [a.sb, b.sb] FROM c a JOIN c b ON b.track_id = a.track_id AND b.i - a.i >= 2),
y AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY g DESC, m, k, path DESC) AS place FROM z)
SELECT track_id, unnest(path) AS session_b, CAST(g AS DOUBLE) AS plan_gain FROM y WHERE place = 1"""
)
def track_planned_splits(spark, d):
    by = Window.partitionBy("track_id").orderBy("session_index")
    ahead = _tracks(spark, d, "predicted").withColumns({"session_b": F.lead("session_index").over(by), "next": F.lead("roi").over(by)}).where("session_b IS NOT NULL")
    return reports.planned_splits(ahead.select("track_id", F.col("session_index").alias("session_a"), "session_b", ((F.col("roi") * 7 + F.col("next") * 3) % 20 / 8.0).alias("risk")))


# Descriptors: suppliers are ROIs over lines' quantity and discount, nations sessions.

_COVARIANCES = """
WITH m AS (SELECT s_nationkey AS g, l_suppkey AS roi, var_pop(l_quantity) + 1e-6 AS xx, var_pop(l_discount * 100) + 1e-6 AS yy, covar_pop(l_quantity, l_discount * 100) AS xy, count(*) AS area FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
"""


def _covariances(spark, d):
    p = _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("roi"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return pairs.moments(p, "roi").join(_table(spark, d, "supplier").select(F.col("s_suppkey").alias("roi"), F.col("s_nationkey").alias("g")), "roi")


@query(
    _COVARIANCES
    + """, n AS (SELECT *, xx / greatest(xx + yy, 1e-6) AS p, yy / greatest(xx + yy, 1e-6) AS q, xy / greatest(xx + yy, 1e-6) AS r, greatest(xx * yy - xy * xy, 1e-6) AS det FROM m),
c AS (SELECT a.roi AS roi_a, b.roi AS roi_b, sqrt((pow(a.p - b.p, 2) + pow(a.q - b.q, 2) + 2 * pow(a.r - b.r, 2)) / 2) AS cost, abs(ln(a.det / b.det)) AS logdet FROM n a JOIN n b ON a.g = b.g AND a.roi < b.roi)
SELECT roi_a, roi_b, round(cost, 6) AS shape_cost, round(logdet, 6) AS logdet_cost, round(exp(-cost), 6) AS shape_similarity FROM c"""
)
def pair_covariance_costs(spark, d):
    m = _covariances(spark, d)
    side = lambda s: m.select("g", F.col("roi").alias(f"roi_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("cxx", "cyy", "cxy")))
    both = side("a").join(side("b"), "g").where("roi_a < roi_b")
    costs = descriptors.covariance_costs(*(tuple(F.col(f"{c}_{s}") for c in ("cxx", "cyy", "cxy")) for s in ("a", "b")))
    return _round(both.select("roi_a", "roi_b", *(v.alias(k) for k, v in costs.items())), *costs)


@query(_COVARIANCES + "SELECT g, round(greatest(1, 2 * sqrt(quantile_cont(area, 0.5) / pi())), 6) AS centroid_scale FROM m GROUP BY 1")
def pair_centroid_scale(spark, d):
    return _round(descriptors.centroid_scale(_covariances(spark, d), ["g"]), "centroid_scale")


@query("SELECT user_id, count(value) AS n, round(avg(hour(ts)) / greatest(abs(avg(value)), 1e-6), 5) AS ratio FROM events GROUP BY 1")
def activity_background_ratio(spark, d):
    out = descriptors.background_ratio(_table(spark, d, "events").select("user_id", "value", F.hour("ts").alias("hour")), ["user_id"], "value", "hour")
    return out.withColumn("ratio", F.round("ratio", 5))


_BINS = ", ".join(f"round(coalesce(avg(CASE WHEN bin = {i} THEN 1.0 WHEN bin IS NOT NULL THEN 0.0 END), 0), 6) AS h{i}" for i in range(4))


@query(
    _PX
    + f""", i AS (SELECT g, x, y, avg(price) AS v FROM li WHERE f = 'A' GROUP BY 1, 2, 3), sp AS (SELECT g, min(v) AS lo, max(v) AS hi, avg(v) AS mean FROM i GROUP BY 1),
fu AS (SELECT sp.g, x, y, coalesce(v, mean) AS u, v, CASE WHEN v IS NULL THEN NULL WHEN hi > lo THEN least(floor((v - lo) / ((hi + 1e-12 - lo) / 4)), 3) ELSE 0 END AS bin FROM sp CROSS JOIN range(51) AS p(x) CROSS JOIN range(11) AS q(y) LEFT JOIN i USING (g, x, y)),
gr AS (SELECT *, lag(u) OVER wx AS xa, lead(u) OVER wx AS xb, lag(u) OVER wy AS ya, lead(u) OVER wy AS yb FROM fu WINDOW wx AS (PARTITION BY g, y ORDER BY x), wy AS (PARTITION BY g, x ORDER BY y)),
gg AS (SELECT g, x, y, v, bin, sqrt(pow(CASE WHEN xa IS NULL THEN xb - u WHEN xb IS NULL THEN u - xa ELSE (xb - xa) / 2 END, 2) + pow(CASE WHEN ya IS NULL THEN yb - u WHEN yb IS NULL THEN u - ya ELSE (yb - ya) / 2 END, 2)) AS gradient FROM gr)
SELECT c.g, c.roi, round(avg(v), 3) AS mean, round(quantile_cont(v, 0.1), 3) AS p10, round(quantile_cont(v, 0.9), 3) AS p90, round(avg(gradient), 3) AS gradient, count(v) AS size, {_BINS}
FROM ca c JOIN gg ON gg.g = c.g AND abs(gg.x - CAST(round_even(c.x, 0) AS BIGINT)) <= 2 AND abs(gg.y - CAST(round_even(c.y, 0) AS BIGINT)) <= 2 GROUP BY 1, 2"""
)
def roi_patch_descriptors(spark, d):
    out = descriptors.patch_descriptors(_image(spark, d, "A"), _centres(spark, d, "A"), ["g"], 2, 4, _SHAPE)
    return out.select("g", "roi", *(F.round(c, 3).alias(c) for c in ("mean", "p10", "p90", "gradient")), "size", *(F.round(F.col("histogram")[i], 6).alias(f"h{i}") for i in range(4)))
