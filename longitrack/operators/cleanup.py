"""Track repair: pruning and splitting of weak links, and edits that depend on each other's order.

Diagnostics and gates are column expressions. Edits that occupy slots (gap insertion, teacher rescue)
depend on order, so those of one subject are applied in one group, sorted by explicit keys.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.session import ship

#: Fixed values of the component cleanup and of the strict gap gate.
MARGIN_LOW, MARGIN_HIGH, AREA_FLOOR, DISTANCE, RISK, SPLIT_PENALTY, MIN_SIDE = 0.10, 0.20, 0.45, 4.0, 1.50, 0.25, 2
GAP, GAP_AREA, GAP_PROBABILITY, GAP_IOU, GAP_MARGIN = 2, 0.90, 0.80, 0.55, 0.20
#: Fixed values of the growth veto and of the suffix gate.
GROWTH_VETO = {"mahalanobis": 20.0, "residual": 2.5, "iou": (0.45, 0.60), "shifted_iou": (0.60, 0.80), "probability": (0.50, 0.65), "distortion": 0.05, "anchors": 0, "rank": 1}
SUFFIX = {"length": 2, "probability": 0.80, "area": 0.80, "distance": 6.0, "shifted_iou": 0.30, "motion": 0.50, "shape": 0.82}


def link_diagnostics(links: DataFrame, edge: list[str], row: str, column: str, similarity: str, threshold: float) -> DataFrame:
    """Per link: margin over the threshold, and over the best competitor in its row and in its column."""
    out = links.withColumn("threshold_margin", F.col(similarity) - threshold)
    for name, mine in (("row", row), ("column", column)):
        order = Window.partitionBy(*edge, mine).orderBy(F.desc(similarity))
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, second = F.nth_value(similarity, 1).over(whole), F.nth_value(similarity, 2).over(whole)
        k = F.row_number().over(order)
        out = out.withColumn(f"{name}_competition_margin", F.col(similarity) - F.coalesce(F.when(k == 1, second).otherwise(first), F.lit(0.0)))
    return out


def should_prune(threshold_margin: Column, row_margin: Column, column_margin: Column, area_ratio: Column, distance: Column) -> Column:
    """Weak over the threshold and over both competitors, and of poor area or distance."""
    weak = (threshold_margin < MARGIN_LOW) & (row_margin < MARGIN_HIGH) & (column_margin < MARGIN_HIGH)
    return weak & ((area_ratio < AREA_FLOOR) | (distance > DISTANCE))


def risk(threshold_margin: Column, row_margin: Column, column_margin: Column, area_ratio: Column, distance: Column) -> Column:
    """A sum of five risks between 0 and 1: low margins, low area ratio, high distance."""
    low = lambda x, at: F.least(F.greatest((at - x) / at, F.lit(0.0)), F.lit(1.0))
    return low(threshold_margin, MARGIN_LOW) + low(row_margin, MARGIN_HIGH) + low(column_margin, MARGIN_HIGH) + low(area_ratio, AREA_FLOOR) + F.least(F.greatest((distance - DISTANCE) / DISTANCE, F.lit(0.0)), F.lit(1.0))


def weakest_bridges(links: DataFrame, risk_column: str, min_side: int = MIN_SIDE, at_least: float = RISK) -> DataFrame:
    """The riskiest link of each track that leaves min_side observations on both sides, if risky enough."""
    by = Window.partitionBy("track_id")
    placed = links.withColumn("before", F.row_number().over(by.orderBy("session_a"))).withColumn("n", F.count(F.lit(1)).over(by) + 1)
    ok = placed.where((F.col("before") >= min_side) & (F.col("n") - F.col("before") >= min_side) & (F.col(risk_column) >= at_least))
    return ok.withColumn("k", F.row_number().over(by.orderBy(F.desc(risk_column), "session_a"))).where("k = 1").drop("k", "before", "n")


def gate_reason(checks: list[tuple[str, Column]]) -> Column:
    """The names of failed checks joined by `;`, empty where all hold; a check on missing values fails."""
    return F.concat_ws(";", *(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))


def strict_gap_gate(gap: Column, area_ratio: Column, cell_probability: Column, iou: Column, threshold_margin: Column) -> Column:
    return gate_reason([("gap", gap == GAP), ("area", area_ratio >= GAP_AREA), ("cell_probability", cell_probability >= GAP_PROBABILITY), ("iou", iou <= GAP_IOU), ("threshold_margin", threshold_margin >= GAP_MARGIN)])


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The first failed check's name, else `accepted`."""
    out = F.lit("accepted")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def _within(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x is a number and between the bounds that are given."""
    ok = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    if low is not None:
        ok = ok & (x >= low)
    return ok if high is None else ok & (x <= high)


def growth_veto_reason(n_sessions: int, gate: dict | None = None) -> Column:
    """`accepted`, or the first reason why an edge is no growth veto; missing values fail.

    Read from the columns edge_source, remove_reason, would_split_component, is_terminal_edge, is_last_session_edge,
    complete_component_size, growth_anchor_count, growth_residual, growth_residual_mahalanobis, registered_iou,
    shifted_iou, row_rank, column_rank, cell_probability_a, cell_probability_b and local_neighbor_distortion.
    """
    g = GROWTH_VETO | (gate or {})
    c, number = F.col, lambda name: F.coalesce(F.col(name), F.lit(0))
    pa, pb = c("cell_probability_a"), c("cell_probability_b")
    checks = [
        ("coherence_suffix_edge", F.coalesce(c("edge_source"), F.lit("")) != "suffix"),
        ("not_splittable", c("remove_reason") == "split_edge"),
        ("does_not_split_component", number("would_split_component") > 0),
        ("not_terminal_edge", number("is_terminal_edge") > 0),
        ("not_last_session_edge", number("is_last_session_edge") > 0),
        ("not_complete_component", number("complete_component_size") >= n_sessions),
        ("growth_anchor_count_below_gate", number("growth_anchor_count") >= g["anchors"]),
        ("growth_residual_below_gate", _within(c("growth_residual"), g["residual"])),
        ("growth_residual_mahalanobis_below_gate", _within(c("growth_residual_mahalanobis"), g["mahalanobis"])),
        ("registered_iou_below_gate", _within(c("registered_iou"), g["iou"][0])),
        ("shifted_iou_below_gate", _within(c("shifted_iou"), g["shifted_iou"][0])),
        ("registered_iou_above_gate", _within(c("registered_iou"), high=g["iou"][1])),
        ("shifted_iou_above_gate", _within(c("shifted_iou"), high=g["shifted_iou"][1])),
        ("row_rank_above_gate", _within(c("row_rank"), 1, g["rank"])),
        ("column_rank_above_gate", _within(c("column_rank"), 1, g["rank"])),
        ("cell_probability_missing", _within(pa) & _within(pb)),
        ("cell_probability_below_gate", F.least(pa, pb) >= g["probability"][0]),
        ("min_cell_probability_above_gate", F.least(pa, pb) <= g["probability"][1]),
        ("local_neighbor_distortion_above_gate", _within(c("local_neighbor_distortion"), high=g["distortion"])),
    ]
    return first_failure(checks)


def suffix_gate(cell_probability: Column, area_ratio: Column, distance: Column, shifted_iou: Column, motion: Column, shape: Column, path_length: Column, gate: dict | None = None) -> Column:
    """Whether a suffix may be stitched on: every bound of SUFFIX holds; missing values fail."""
    g = SUFFIX | (gate or {})
    lows = (("probability", cell_probability), ("area", area_ratio), ("shifted_iou", shifted_iou), ("motion", motion), ("shape", shape))
    ok = _within(distance, high=g["distance"]) & (path_length == g["length"])
    for name, x in lows:
        ok = ok & _within(x, g[name])
    return F.coalesce(ok, F.lit(False))


def first_per_subject(rows: DataFrame, order: list[Column], limit: int = 1) -> DataFrame:
    """The first rows of each subject in an explicit order: at most `limit` edits are made to one."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("subject").orderBy(*order))).where(F.col("_k") <= limit).drop("_k")


def teacher_vetoes(predicted_links: DataFrame, teacher_links: DataFrame, keys: list[str], weak: Column) -> DataFrame:
    """Links that no teacher's link supports and that are weak: where tracks are to be split."""
    return predicted_links.join(teacher_links.select(*keys).distinct(), keys, "left_anti").where(weak)


def insert_edges(tracks: DataFrame, candidates: DataFrame, max_rounds: int = 1) -> DataFrame:
    """Extend tracks by candidate edges in order, per subject; again up to max_rounds or until nothing changes.

    tracks: (subject, track_id, session_index, roi). candidates: (subject, session_a, session_b, roi_a, roi_b,
    priority), applied by descending priority and then key, where a track has roi_a in session_a, its slot
    in session_b is empty, and no track of the subject has roi_b there. A group holds one subject's tracks.
    """
    ship(tracks.sparkSession)
    schema = "subject string, track_id long, session_index int, roi long, inserted boolean"

    def edit(t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        owner = {(s, r): k for k, s, r in zip(t["track_id"], t["session_index"], t["roi"], strict=True)}
        taken = {(k, s) for k, s in zip(t["track_id"], t["session_index"], strict=True)}
        order = c.sort_values(["priority", "session_a", "session_b", "roi_a", "roi_b"], ascending=[False, True, True, True, True], kind="stable")
        new = []
        for _ in range(max_rounds):
            before = len(new)
            for a, b, x, y in zip(order["session_a"], order["session_b"], order["roi_a"], order["roi_b"], strict=True):
                k = owner.get((a, x))
                if k is not None and (k, b) not in taken and (b, y) not in owner:
                    owner[b, y] = k
                    taken.add((k, b))
                    new.append((k, b, y))
            if len(new) == before:
                break
        subject = t["subject"].iloc[0] if len(t) else None
        old = t.assign(inserted=False)[["subject", "track_id", "session_index", "roi", "inserted"]]
        more = pd.DataFrame(new, columns=["track_id", "session_index", "roi"]).assign(subject=subject, inserted=True)
        return pd.concat([old, more[old.columns]]) if len(more) else old

    left = tracks.select(F.col("subject").cast("string").alias("subject"), F.col("track_id").cast("long").alias("track_id"), F.col("session_index").cast("int").alias("session_index"), F.col("roi").cast("long").alias("roi"))
    right = candidates.withColumn("subject", F.col("subject").cast("string"))
    return left.groupBy("subject").cogroup(right.groupBy("subject")).applyInPandas(edit, schema)
