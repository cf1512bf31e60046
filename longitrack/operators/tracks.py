"""Tracks in long form (track_id, session_index, roi; a missing observation has no row), links and scores.

Multisets of links and of complete tracks are scored by counting each identity on both sides and
summing the smaller count, so duplicates are matched once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.functions import f1, ratio

LINK = ["session_a", "session_b", "roi_a", "roi_b"]


def _by_session():
    return Window.partitionBy("track_id").orderBy("session_index")


def observed(tracks: DataFrame) -> DataFrame:
    """Rows with an observation: missing markers and negative ids are dropped, ids are whole numbers."""
    roi = F.expr("try_cast(roi AS BIGINT)")
    return tracks.withColumn("roi", roi).where("roi >= 0")


def from_wide(wide: DataFrame, track_id: str, sessions: list[str]) -> DataFrame:
    """A table with a column for each session, to long form; session_index follows the given order."""
    order = F.create_map(*(x for i, s in enumerate(sessions) for x in (F.lit(s), F.lit(i))))
    long = wide.select(F.col(track_id).alias("track_id"), *(F.col(s).cast("string").alias(s) for s in sessions)).unpivot(["track_id"], sessions, "session", "roi")
    return observed(long.select("track_id", order[F.col("session")].alias("session_index"), "roi"))


def to_wide(tracks: DataFrame, n_sessions: int, fill: int | None = None) -> DataFrame:
    """One row for each track and one column s0, s1, ... for each session."""
    wide = tracks.groupBy("track_id").pivot("session_index", list(range(n_sessions))).agg(F.first("roi"))
    return wide.select("track_id", *((F.coalesce(str(i), F.lit(fill)) if fill is not None else F.col(str(i))).alias(f"s{i}") for i in range(n_sessions)))


def conflicts(tracks: DataFrame) -> DataFrame:
    """(track_id, session_index) with two different ids; a valid table has none, equal repeats are allowed."""
    return observed(tracks).groupBy("track_id", "session_index").agg(F.count_distinct("roi").alias("n_rois")).where("n_rois > 1")


def links(tracks: DataFrame) -> DataFrame:
    """Links between consecutive sessions, one row for each track that has both ends."""
    after = tracks.withColumn("session_b", F.lead("session_index").over(_by_session())).withColumn("roi_b", F.lead("roi").over(_by_session()))
    return after.where("session_b = session_index + 1").select("track_id", F.col("session_index").alias("session_a"), "session_b", F.col("roi").alias("roi_a"), "roi_b")


def links_for(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links for given forward session pairs (session_a, session_b)."""
    a = tracks.select("track_id", F.col("session_index").alias("session_a"), F.col("roi").alias("roi_a"))
    b = tracks.select("track_id", F.col("session_index").alias("session_b"), F.col("roi").alias("roi_b"))
    return a.join(pairs.where("session_a < session_b"), "session_a").join(b, ["track_id", "session_b"]).select("track_id", *LINK)


def edge_index(tracks: DataFrame, max_gap: int) -> DataFrame:
    """All links of each track up to a gap, by so many leads over its sessions."""
    ahead = tracks.select("track_id", F.col("session_index").alias("session_a"), F.col("roi").alias("roi_a"), *(F.lead(F.struct(F.col("session_index").alias("session_b"), F.col("roi").alias("roi_b")), k).over(_by_session()).alias(f"_{k}") for k in range(1, max_gap + 1)))
    each = ahead.select("track_id", "session_a", "roi_a", F.explode(F.array(*(f"_{k}" for k in range(1, max_gap + 1)))).alias("x"))
    return each.select("track_id", "session_a", "x.session_b", "roi_a", "x.roi_b").where(f"session_b - session_a <= {max_gap}")


def complete(tracks: DataFrame, n_sessions: int) -> DataFrame:
    """(track_id, identity) of tracks observed in all of the first n sessions."""
    rows = tracks.where(F.col("session_index") < n_sessions).groupBy("track_id").agg(F.count_distinct("session_index").alias("n"), F.sort_array(F.collect_list(F.struct("session_index", "roi"))).alias("r"))
    return rows.where(F.col("n") == n_sessions).select("track_id", F.array_join(F.transform("r", lambda x: x["roi"].cast("string")), ",").alias("identity"))


def ledger(predicted: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Per identity: its counts on both sides and TP, FP, FN as multisets."""
    side = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = side(predicted, "n_predicted").join(side(reference, "n_reference"), keys, "full").na.fill(0, ["n_predicted", "n_reference"])
    p, r = F.col("n_predicted"), F.col("n_reference")
    return both.select(*keys, p, r, F.least(p, r).alias("tp"), F.greatest(p - r, F.lit(0)).alias("fp"), F.greatest(r - p, F.lit(0)).alias("fn"))


def scored(identities: DataFrame, by: list[str] | None = None, empty: float | None = 1.0) -> DataFrame:
    """TP, FP, FN summed, with precision, recall and F1; empty denominators give `empty`."""
    s = identities.groupBy(*(by or [])).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.withColumns({"precision": ratio(tp * 1.0, tp + fp, empty), "recall": ratio(tp * 1.0, tp + fn, empty), "f1": f1(tp, fp, fn, empty)})


def seeded(tracks: DataFrame, reference: DataFrame, seed_session: int = 0) -> DataFrame:
    """Tracks whose id in the seed session is one of the reference's there."""
    at = lambda df: df.where(F.col("session_index") == seed_session)
    kept = at(tracks).join(at(reference).select("roi").distinct(), "roi", "left_semi").select("track_id").distinct()
    return tracks.join(kept, "track_id", "left_semi")


def summary(tracks: DataFrame, n_sessions: int) -> DataFrame:
    """Tracks, complete tracks, mean length and fragments (breaks inside tracks)."""
    jump = F.col("session_index") - F.lag("session_index").over(_by_session())
    per = tracks.withColumn("jump", jump).groupBy("track_id").agg(F.count(F.lit(1)).alias("length"), F.count_if(F.col("jump") > 1).alias("breaks"))
    return per.agg(F.count(F.lit(1)).alias("n_tracks"), F.count_if(F.col("length") == n_sessions).alias("complete_tracks"), F.avg("length").alias("mean_length"), F.coalesce(F.sum("breaks"), F.lit(0)).alias("fragmentation"))


def by_horizon(predicted: DataFrame, reference: DataFrame, horizons: list[int]) -> DataFrame:
    """For each horizon: the share of the reference's complete prefixes that the prediction has, as multisets."""
    out = None
    for h in horizons:
        score = scored(ledger(complete(predicted, h), complete(reference, h), ["identity"]), empty=0.0).select(F.lit(h).alias("horizon"), "tp", "fn", F.col("recall").alias("proportion"))
        out = score if out is None else out.unionByName(score)
    return out


def votes(variants: DataFrame) -> DataFrame:
    """In how many variants (column variant) each link occurs; a variant votes once."""
    by = Window.partitionBy("variant", "track_id").orderBy("session_index")
    found = variants.withColumn("session_b", F.lead("session_index").over(by)).withColumn("roi_b", F.lead("roi").over(by)).where("session_b = session_index + 1")
    return found.select("variant", F.col("session_index").alias("session_a"), "session_b", F.col("roi").alias("roi_a"), "roi_b").distinct().groupBy(*LINK).agg(F.count(F.lit(1)).alias("votes"))


def split_at(tracks: DataFrame, bridges: DataFrame, min_side: int = 1) -> DataFrame:
    """Split tracks before the far end of each bridge (track_id, session_b), if both sides keep min_side observations.

    The pieces of a track are numbered by a running count of its splits.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("track_id"))
    before = F.row_number().over(_by_session()) - 1
    cuts = bridges.select("track_id", F.col("session_b").alias("session_index"), F.lit(1).alias("cut")).distinct()
    marked = tracks.join(cuts, ["track_id", "session_index"], "left").withColumns({"n": n, "before": before})
    ok = F.col("cut").isNotNull() & (F.col("before") >= min_side) & (F.col("n") - F.col("before") >= min_side)
    return marked.withColumn("piece", F.sum(F.when(ok, 1).otherwise(0)).over(_by_session())).select("track_id", "piece", "session_index", "roi")


def gap_costs(reference: DataFrame, max_gap: int, smoothing: float = 1.0) -> DataFrame:
    """-ln of the smoothed share of observations that are seen again after exactly `gap` sessions."""
    ahead = reference.withColumn("last", F.max("session_index").over(Window.partitionBy("track_id")))
    gaps = F.explode(F.sequence(F.lit(1), F.lit(max_gap))).alias("gap")
    chances = ahead.select("track_id", "session_index", "last", gaps).where("session_index + gap <= last")
    later = ahead.select("track_id", (F.col("session_index")).alias("later"))
    seen = chances.withColumn("later", F.col("session_index") + F.col("gap")).join(later.withColumn("hit", F.lit(1)), ["track_id", "later"], "left")
    out = seen.groupBy("gap").agg(F.count("hit").alias("positives"), F.count(F.lit(1)).alias("opportunities"))
    return out.withColumn("cost", -F.log((F.col("positives") + smoothing) / F.greatest(F.col("opportunities") + 2 * smoothing, F.lit(1.0))))


def audit(reference: DataFrame, teacher: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every link of three sets with its membership and a category."""
    mark = lambda df, name: df.select(*LINK).distinct().withColumn(name, F.lit(True))
    both = mark(reference, "in_gt").join(mark(teacher, "in_teacher"), LINK, "full").join(mark(predicted, "in_prediction"), LINK, "full").na.fill(False)
    g, t, p = F.col("in_gt"), F.col("in_teacher"), F.col("in_prediction")
    name = F.when(g & t & p, "all_agree").when(g & t, "prediction_missed_teacher_found").when(g & p, "prediction_found_teacher_missed").when(g, "both_missed").when(t & p, "shared_false_positive").when(p, "prediction_false_positive").otherwise("teacher_false_positive")
    return both.withColumn("category", name)


def stitched(matches: DataFrame, seeds: DataFrame, n_sessions: int, start: int = 0) -> DataFrame:
    """Tracks that follow matches (session_a, roi_a, roi_b between consecutive sessions) from seeds (track_id, roi).

    Forwards from the start session, then backwards, until the first miss; one join a session.
    """
    now = seeds.select("track_id", F.lit(start).alias("session_index"), "roi")
    out = now
    for step in (1, -1):
        front = now
        for s in range(start, n_sessions - 1) if step == 1 else range(start, 0, -1):
            a, b = ("roi_a", "roi_b") if step == 1 else ("roi_b", "roi_a")
            edge = matches.where(F.col("session_a") == (s if step == 1 else s - 1)).select(F.col(a).alias("roi"), F.col(b).alias("next"))
            front = front.join(edge, "roi").select("track_id", F.lit(s + step).alias("session_index"), F.col("next").alias("roi"))
            out = out.unionByName(front)
    return out
