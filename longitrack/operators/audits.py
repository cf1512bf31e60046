"""Audits: components of tracks and their weakest bridges, causes of wrong links, triage, registration reports, choices among settings.

Labels are read only where a column says so (pairwise_tp, pairwise_fp); decisions to split use none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.operators import cleanup
from longitrack.operators.tracks import LINK

#: Bonuses of the conflict-augmented splits and the least risk they ask for; what the triage asks of a run.
CONFLICT_BONUS, DUPLICATE_BONUS, LEAST_BASE_RISK = 0.50, 0.50, 0.25
TRIAGE = {"oracle": 0.98, "top1": 0.70, "pairwise": 0.70, "gap": 0.15, "missing": 0.05}
#: Scores that are better the higher they are, besides those whose names say so.
SIMILARITIES = ("iou", "registered_iou", "mask_iou", "mask_cosine_similarity", "covariance_shape_similarity", "activity_correlation", "activity_similarity", "match_probability", "p_match", "p_same")


def successive(tracks: DataFrame) -> DataFrame:
    """(track_id, session_a, session_b, roi_a, roi_b, before) of successive observations, whatever the gap; before: how many lie up to session_a."""
    by = Window.partitionBy("track_id").orderBy("session_index")
    ahead = tracks.withColumns({"session_b": F.lead("session_index").over(by), "roi_b": F.lead("roi").over(by), "before": F.row_number().over(by)})
    return ahead.where("session_b IS NOT NULL").select("track_id", F.col("session_index").alias("session_a"), "session_b", F.col("roi").alias("roi_a"), "roi_b", "before")


def components(tracks: DataFrame, links: DataFrame, n_sessions: int, require_complete: bool = False) -> DataFrame:
    """One row a track: margins, counts of marginal, boundary, repeated and conflicting links, its weakest bridge and what a split there gains.

    links: successive() with threshold_margin, row_margin, column_margin, area_ratio, centroid_distance. The weakest bridge is the riskiest
    link, the first of equals. A track without links has risk 0 and no bridge (-1).
    """
    c = F.col
    risk = cleanup.risk(c("threshold_margin"), c("row_margin"), c("column_margin"), c("area_ratio"), c("centroid_distance"))
    marginal = (c("threshold_margin") <= cleanup.MARGIN_LOW) & ((c("row_margin") <= cleanup.MARGIN_HIGH) | (c("column_margin") <= cleanup.MARGIN_HIGH))
    boundary = (c("centroid_distance") >= cleanup.DISTANCE) | (c("area_ratio") < cleanup.AREA_FLOOR)
    seen = tracks.groupBy("session_index", "roi").agg(F.count(F.lit(1)).alias("_seen"))
    at = lambda s: seen.select(c("session_index").alias(f"session_{s}"), c("roi").alias(f"roi_{s}"), c("_seen").alias(f"_seen_{s}"))
    repeats = links.groupBy(*LINK).agg(F.count(F.lit(1)).alias("_times"))
    own = links.withColumn("risk", risk).join(repeats, LINK).join(at("a"), ["session_a", "roi_a"]).join(at("b"), ["session_b", "roi_b"])
    worst = F.max(F.struct("risk", (-c("session_a")).alias("first"), "session_a", "session_b", "roi_a", "roi_b", "before")).alias("_w")
    per = own.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.min("threshold_margin").alias("min_edge_margin"), F.median("threshold_margin").alias("median_edge_margin"), F.count_if(marginal).alias("n_marginal_edges"),
        F.max("centroid_distance").alias("max_centroid_distance"), F.min("area_ratio").alias("min_area_ratio"), F.count_if(boundary).alias("n_boundary_edges"), F.count_if(c("_times") > 1).alias("n_same_predicted_edges"),
        F.count_if((c("_seen_a") > 1) | (c("_seen_b") > 1)).alias("n_conflicting_edges"), F.sum("risk").alias("component_risk_sum"), worst,
    )
    n = tracks.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_observations"))
    out = n.join(per, "track_id", "left").na.fill(0, ["n_edges", "n_marginal_edges", "n_boundary_edges", "n_same_predicted_edges", "n_conflicting_edges"]).na.fill(0.0, ["component_risk_sum"])
    w = lambda name, none: F.coalesce(c("_w")[name], F.lit(none))
    left, right = c("left_observations"), c("n_observations") - c("left_observations")
    short = F.when(left < cleanup.MIN_SIDE, cleanup.SPLIT_PENALTY).otherwise(0.0) + F.when(right < cleanup.MIN_SIDE, cleanup.SPLIT_PENALTY).otherwise(0.0)
    out = out.withColumns({"is_complete_track": c("n_observations") == n_sessions, "component_score": w("risk", 0.0), "weakest_bridge_session_a": w("session_a", -1), "weakest_bridge_session_b": w("session_b", -1), "weakest_bridge_source_roi": w("roi_a", -1), "weakest_bridge_target_roi": w("roi_b", -1), "left_observations": w("before", 0)})
    out = out.withColumn("split_gain", F.when(c("n_edges") > 0, c("component_score") - cleanup.SPLIT_PENALTY - short).otherwise(-cleanup.SPLIT_PENALTY))
    ok = (c("n_edges") > 0) & (c("component_score") >= cleanup.RISK) & (left >= cleanup.MIN_SIDE) & (right >= cleanup.MIN_SIDE) & (c("split_gain") > 0)
    return out.withColumn("would_split", ok & c("is_complete_track") if require_complete else ok).drop("_w")


def conflict_augmented(rows: DataFrame, threshold: float = cleanup.RISK, conflict: float = CONFLICT_BONUS, duplicate: float = DUPLICATE_BONUS, least_base: float = LEAST_BASE_RISK) -> DataFrame:
    """components() with a bonus for conflicting and repeated links, the score with it, and which tracks split for it beyond those that would."""
    c = F.col
    bonus = F.when(c("n_conflicting_edges") > 0, conflict).otherwise(0.0) + F.when(c("n_same_predicted_edges") > 0, duplicate).otherwise(0.0)
    out = rows.withColumn("conflict_bonus", bonus).withColumn("augmented_score", c("component_score") + c("conflict_bonus"))
    right = c("n_observations") - c("left_observations")
    extra = ~c("would_split") & (c("conflict_bonus") > 0) & (c("component_score") >= least_base) & (c("left_observations") >= cleanup.MIN_SIDE) & (right >= cleanup.MIN_SIDE) & (c("augmented_score") >= threshold)
    return out.withColumn("extra_split", extra).withColumn("applied_split", c("would_split") | c("extra_split"))


def split_components(tracks: DataFrame, rows: DataFrame, flag: str = "would_split") -> DataFrame:
    """(track_id, piece, session_index, roi): the flagged tracks cut before the far end of their weakest bridge."""
    at = rows.where(F.col(flag)).select("track_id", F.col("weakest_bridge_session_b").alias("_cut"))
    piece = F.when(F.col("_cut").isNotNull() & (F.col("session_index") >= F.col("_cut")), 1).otherwise(0)
    return tracks.join(at, "track_id", "left").select("track_id", piece.alias("piece"), "session_index", "roi")


def wrong_links(predicted: DataFrame, reference: DataFrame, predicted_links: DataFrame, reference_links: DataFrame, costs: DataFrame | None = None, threshold: float | None = None, ambiguity: float = 0.15) -> DataFrame:
    """(LINK, kind, n, category) of links that one side has more often than the other, each with its first fitting cause.

    costs: (LINK, cost, row_rank_cost, column_rank_cost), ranks between 0 and 1; links without them have no cause from costs.
    """
    count = lambda df, name: df.groupBy(*LINK).agg(F.count(F.lit(1)).alias(name))
    both = count(predicted_links, "_p").join(count(reference_links, "_r"), LINK, "full").na.fill(0, ["_p", "_r"]).where("_p <> _r")
    both = both.select(*LINK, F.when(F.col("_p") > F.col("_r"), "false_positive").otherwise("false_negative").alias("kind"), F.abs(F.col("_p") - F.col("_r")).alias("n"))
    for name, df in (("p", predicted), ("r", reference)):
        seen = df.groupBy("session_index", "roi").agg(F.count(F.lit(1)).alias("_n"))
        for s in ("a", "b"):
            both = both.join(seen.select(F.col("session_index").alias(f"session_{s}"), F.col("roi").alias(f"roi_{s}"), F.col("_n").alias(f"_{name}{s}")), [f"session_{s}", f"roi_{s}"], "left")
    both = both.na.fill(0, ["_pa", "_pb", "_ra", "_rb"])
    for s in ("a", "b"):
        key = ["session_a", "session_b", f"roi_{s}"]
        both = both.join(reference_links.select(*key).distinct().withColumn(f"_end_{s}", F.lit(True)), key, "left")
    if costs is None:
        both = both.withColumns({x: F.lit(None).cast("double") for x in ("cost", "row_rank_cost", "column_rank_cost")})
    else:
        both = both.join(costs.select(*LINK, "cost", "row_rank_cost", "column_rank_cost"), LINK, "left")
    c = F.col
    over = F.coalesce(c("cost") > threshold, F.lit(False)) if threshold is not None else F.lit(False)
    unclear = F.coalesce(F.when(c("row_rank_cost").isNotNull() & c("column_rank_cost").isNotNull(), F.least("row_rank_cost", "column_rank_cost") <= ambiguity), F.lit(False))
    positive = F.when((c("_pa") > 1) | (c("_pb") > 1), "duplicate_observation").when(F.coalesce("_end_a", "_end_b", F.lit(False)), "split_merge_or_neighbor_swap").when(over, "threshold_too_loose").when(unclear, "ambiguous_candidate").otherwise("false_continuation")
    negative = F.when((c("_pa") == 0) | (c("_pb") == 0), "roi_missing_from_prediction").when((c("_ra") > 1) | (c("_rb") > 1), "reference_split_merge").when(over, "threshold_too_strict").when(unclear, "ambiguous_candidate").otherwise("missed_link")
    return both.select(*LINK, "kind", "n", F.when(c("kind") == "false_positive", positive).otherwise(negative).alias("category"))


def failure_mode(oracle: Column, pairwise: Column, complete: Column, top1: Column, missing: Column, asks: dict | None = None) -> Column:
    """Which part of a run to mend next, from its scores; numbers that are missing count as the worst."""
    t = TRIAGE | (asks or {})
    value = lambda x, none: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), none).otherwise(x)
    o, p, c, m, e = (value(x.cast("double"), none) for x, none in ((oracle, 0.0), (pairwise, 0.0), (complete, 0.0), (top1, 0.0), (missing, 1.0)))
    ranking = (e > t["missing"]) | (m < t["top1"])
    stitching = (p >= t["pairwise"]) & (p - c >= t["gap"])
    return F.when(o < t["oracle"], "row-assembly-or-scoring").when(ranking, "registration-or-cost-ranking").when(stitching, "solver-priors-or-track-stitching").when(p < t["pairwise"], "association-ranking").otherwise("no-dominant-failure")


def score_direction(name: Column) -> Column:
    """`similarity` or `cost`, by a score's name."""
    n = F.lower(F.trim(name))
    return F.when(n.isin(*SIMILARITIES) | n.endswith("_similarity") | n.endswith("_correlation") | n.startswith("p_") | n.endswith("_probability"), "similarity").otherwise("cost")


def score_rows(cells: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, score_name, score, direction): a tensor's planes as rows."""
    long = cells.select(*keys, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(keys, names, "score_name", "score")
    return long.withColumn("direction", score_direction(F.col("score_name")))


#: What a feature is chosen by: means over summary rows.
RATES = ("row_hit_at_1_present", "column_hit_at_1_present", "mutual_top1_rate_present", "row_positive_margin_rate", "column_positive_margin_rate")


def selected_features(rows: DataFrame, least: dict[str, float] | None = None, most: int | None = None) -> DataFrame:
    """(score_name, selection_score, mean_* of RATES, summary_rows, gt_edges), best first; least: bounds by rate; most: how many."""
    fine = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))
    g = rows.where(F.coalesce(F.col("score_name"), F.lit("")) != "").groupBy("score_name").agg(*(F.avg(fine(n)).alias(f"mean_{n}") for n in RATES), F.count(F.lit(1)).alias("summary_rows"), F.coalesce(F.sum("gt_edges"), F.lit(0)).alias("gt_edges"))
    means = F.array(*(F.col(f"mean_{n}") for n in RATES))
    known = F.filter(means, lambda x: x.isNotNull())
    score = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.0)
    g = g.withColumn("selection_score", score).na.fill(0.0, [f"mean_{n}" for n in RATES])
    for name, bound in (least or {}).items():
        g = g.where(F.col(f"mean_{name}") >= bound)
    g = g.orderBy(F.desc("selection_score"), "score_name")
    return g if most is None else g.limit(most)


def pareto_ranks(rows: DataFrame, approach: str, baseline: str, objective: str, floors: dict[str, float], ties: list[str]) -> DataFrame:
    """rows with `feasible` (no metric below the baseline's less its floor's slack; the baseline itself always is) and their rank."""
    base = rows.where(F.col(approach) == baseline).agg(*(F.max(m).alias(f"_{m}") for m in floors))  # one row
    near = reduce(lambda a, b: a & b, (F.coalesce(F.col(m) >= F.col(f"_{m}") - slack, F.lit(True)) for m, slack in floors.items()), F.lit(True))
    out = rows.crossJoin(F.broadcast(base)).withColumn("feasible", near | (F.col(approach) == baseline)).drop(*(f"_{m}" for m in floors))
    order = Window.partitionBy().orderBy(F.desc("feasible"), *(F.desc_nulls_last(m) for m in (objective, *ties)), approach)  # a row a setting
    return out.withColumn("rank", F.row_number().over(order))


def summarised(rows: DataFrame, keys: list[str], medians: tuple[str, ...] = (), p10: tuple[str, ...] = (), p90: tuple[str, ...] = (), rates: tuple[str, ...] = (), modes: tuple[str, ...] = (), most: tuple[str, ...] = (), count: str = "n_gt_links") -> DataFrame:
    """Per group: rows, medians, tenths, shares of true flags, commonest values (the least of equals) and largest values; what is not a number is left out."""
    fine = lambda n: F.when(~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n).cast("double")) != float("inf")), F.col(n).cast("double"))
    at = lambda n, q, name: F.percentile(fine(n), F.lit(q)).alias(f"{name}_{n}")
    cells = [F.count(F.lit(1)).alias(count), *(at(n, 0.5, "median") for n in medians), *(at(n, 0.1, "p10") for n in p10), *(at(n, 0.9, "p90") for n in p90)]
    cells += [F.avg(F.col(n).cast("double")).alias(f"{n}_rate") for n in rates] + [F.mode(n, deterministic=True).alias(n) for n in modes] + [F.max(n).alias(n) for n in most]
    return rows.groupBy(*keys).agg(*cells)


#: Fixed reports: what each says of its rows.
REGISTRATION_QA = {"medians": ("registered_iou", "registered_centroid_distance", "gt_rank", "cost_margin"), "p10": ("registered_iou",), "p90": ("registered_iou", "registered_centroid_distance", "gt_rank"), "rates": ("gt_is_top1", "gt_is_top5", "gt_candidate_admissible", "target_gated"), "modes": ("registration_backend", "transform_type"), "most": ("empty_registered_rois",)}
GROWTH_QA = {"medians": ("raw_iou", "registered_iou", "raw_residual_norm", "registered_residual_norm", "gt_rank"), "p90": ("registered_residual_norm",), "rates": ("registered_iou_positive", "gt_candidate_admissible"), "modes": ("transform_type",)}
ORACLE_QA = {"medians": ("baseline_iou", "oracle_iou", "iou_gain", "baseline_centroid_distance", "oracle_centroid_distance", "residual_norm_gain"), "p90": ("oracle_centroid_distance",), "rates": ("baseline_iou_positive", "oracle_iou_positive"), "modes": ("baseline_transform_type",)}
RESIDUAL_QA = {"medians": ("raw_iou", "baseline_iou", "oracle_iou", "baseline_iou_row_rank", "oracle_iou_row_rank", "baseline_residual_norm", "oracle_residual_norm"), "rates": ("baseline_iou_row_rank_is_1", "oracle_iou_row_rank_is_1"), "modes": ("baseline_transform_type",)}


def with_gains(rows: DataFrame) -> DataFrame:
    """Oracle rows with iou_gain, residual_norm_gain and flags of positive overlaps."""
    c = F.col
    return rows.withColumns({"iou_gain": c("oracle_iou") - c("baseline_iou"), "residual_norm_gain": c("baseline_centroid_distance") - c("oracle_centroid_distance"), "baseline_iou_positive": c("baseline_iou") > 0, "oracle_iou_positive": c("oracle_iou") > 0})


def backend_usage(rows: DataFrame, edge: list[str], by: list[str], shifts: list[str]) -> DataFrame:
    """Per backend (by): edges, link rows, subjects in order and median shifts; an edge counts once, with its least values."""
    each = rows.groupBy(*edge).agg(F.count(F.lit(1)).alias("_rows"), *(F.min(c).alias(c) for c in by if c not in edge), *(F.min(c).alias(c) for c in shifts))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("edge_count"), F.sum("_rows").alias("gt_link_rows"), F.count_distinct("subject").alias("subject_count"), F.array_join(F.sort_array(F.collect_set(F.col("subject").cast("string"))), ",").alias("subjects"), *(F.median(c).alias(f"median_{c}") for c in shifts))


def best_threshold(table: DataFrame) -> DataFrame:
    """The row of a threshold table with the best F1, then precision, then the lowest threshold."""
    best = F.max(F.struct("f1", "precision", (-F.col("threshold")).alias("_t"), "tp", "fp", "fn", "recall")).alias("b")
    return table.agg(best).select((-F.col("b._t")).alias("threshold"), *(f"b.{c}" for c in ("tp", "fp", "fn", "precision", "recall", "f1")))


def session_labels(tracks: DataFrame, sizes: DataFrame, fill: int = -1) -> DataFrame:
    """(session_index, roi, label) for every ROI 0..n_rois-1 of a session: its track, the first of several, or fill."""
    every = sizes.select("session_index", F.explode(F.when(F.col("n_rois") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_rois").cast("long") - 1))).alias("roi"))
    label = tracks.groupBy("session_index", F.col("roi").cast("long").alias("roi")).agg(F.min("track_id").alias("label"))
    return every.join(label, ["session_index", "roi"], "left").withColumn("label", F.coalesce("label", F.lit(fill)))


def agreed_links(edge_votes: DataFrame, n_variants: int, min_votes: int = 1, min_share: float = 0.0) -> DataFrame:
    """Links with enough votes: min_votes, and ceil(min_share * n_variants)."""
    least = max(min_votes, -int(-(min_share * n_variants) // 1))
    return edge_votes.where(F.col("votes") >= least)


def one_to_one(links: DataFrame) -> DataFrame:
    """Links that share neither end with another of their sessions."""
    a, b = (Window.partitionBy("session_a", "session_b", f"roi_{s}") for s in ("a", "b"))
    return links.withColumns({"_a": F.count(F.lit(1)).over(a), "_b": F.count(F.lit(1)).over(b)}).where("_a = 1 AND _b = 1").drop("_a", "_b")


def gap_priority(area_ratio: Column, probability: Column, iou: Column, row_margin: Column, column_margin: Column, threshold_margin: Column) -> Column:
    """How surely a gap candidate passes the strict gate: its least slack, then those of margin, area and competition; greater is surer."""
    slack = (area_ratio - cleanup.GAP_AREA, probability - cleanup.GAP_PROBABILITY, cleanup.GAP_IOU - iou, row_margin, column_margin, threshold_margin - cleanup.GAP_MARGIN)
    return F.struct(F.least(*slack).alias("bottleneck"), slack[5].alias("threshold"), slack[0].alias("area"), F.least(slack[3], slack[4]).alias("competition"))


def residual_score(mahalanobis: Column, residual: Column, iou: Column, shifted_iou: Column, distortion: Column, row_rank: Column, column_rank: Column, terminal: Column, last: Column, complete: Column, bonus: Column | None = None) -> Column:
    """The score of an edit without labels: growth and overlaps speak for it, lower ranks and distortion against it.

    Values that are missing, NaN or infinite count as 0, ranks as 9. The weights are fixed values.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    zero = lambda x: F.when(finite(x), x.cast("double")).otherwise(0.0)
    rank = lambda x: F.greatest(F.when(finite(x), x).otherwise(F.lit(9)), F.lit(1)) - 1
    yes = lambda x: F.when(F.coalesce(x, F.lit(0)) > 0, 1.0).otherwise(0.0)
    total = F.least(F.lit(3.0), zero(mahalanobis) / 10.0) + F.least(F.lit(1.5), zero(residual) / 3.0) + 0.50 * zero(shifted_iou) + 0.25 * zero(iou)
    total = total + 0.20 * yes(complete) + 0.15 * yes(terminal) + 0.15 * yes(last) - 0.10 * rank(row_rank) - 0.10 * rank(column_rank) - F.greatest(zero(distortion), F.lit(0.0))
    return total if bonus is None else total + bonus


def policy_candidates(cells: DataFrame, accepted: DataFrame, thresholds: DataFrame, edge: list[str], top_k: int = 2, least_iou: float = 0.10, margin: float = 0.15, bonus: float = 0.25, penalty: float = 0.25, gap_penalty: float = 1.0, margin_weight: float = 0.5, epsilon: float = 1e-3) -> DataFrame:
    """Accepted links and, of each row, the top k others near enough to the threshold, with a score from the logit of their overlap.

    cells: (edge, roi_a, roi_b, iou); accepted: (edge, roi_a, roi_b); thresholds: (edge, threshold). Ties go to the greater column.
    """
    key = [*edge, "roi_a", "roi_b"]
    own = cells.join(thresholds.select(*edge, "threshold"), edge).join(accepted.select(*key).distinct().withColumn("_yes", F.lit(True)), key, "left").withColumn("accepted", F.coalesce("_yes", F.lit(False))).drop("_yes")
    floor = F.greatest(F.lit(least_iou), F.greatest(F.lit(0.0), F.col("threshold") - margin))
    near = F.col("iou") >= floor
    order = Window.partitionBy(*edge, "roi_a", near).orderBy(F.desc("iou"), F.desc("roi_b"))
    kept = own.withColumn("_k", F.row_number().over(order)).where(F.col("accepted") | (near & (F.col("_k") <= top_k))).drop("_k")
    return kept.withColumn("score", policy_score(bonus, penalty, gap_penalty, margin_weight, epsilon))


def policy_score(bonus: float = 0.25, penalty: float = 0.25, gap_penalty: float = 1.0, margin_weight: float = 0.5, epsilon: float = 1e-3) -> Column:
    """The score of a candidate (session_a, session_b, iou, threshold, accepted)."""
    p = F.least(F.greatest("iou", F.lit(epsilon)), F.lit(1.0 - epsilon))
    return F.log(p / (1.0 - p)) + margin_weight * (F.col("iou") - F.col("threshold")) + F.when(F.col("accepted"), bonus).otherwise(-penalty) - gap_penalty * (F.col("session_b") - F.col("session_a") - 1)
