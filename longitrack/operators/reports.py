"""Reports on scored tracks and links: operating points, sweeps, feedback, ceilings, growth and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.functions import ratio
from longitrack.operators import tracks

#: Precisions to report at, feedback weights, and weights of weak labels.
PRECISIONS = (0.90, 0.95, 0.99)
FEEDBACK = {"true_positive": 1.0, "false_positive": 2.0, "false_negative": 2.0, "duplicate_prediction": 3.0}
WEAK = {"manual_positive": 1.0, "manual_negative": 1.0, "teacher_positive": 0.25, "teacher_negative": 0.10, "disagreement": 0.25}


def running(rows: DataFrame, order: str, columns: list[str], buckets: int = 256) -> DataFrame:
    """Running sums `cum_<column>` over descending `order`, whose values must be distinct.

    Rows are dealt into ranges at approximate quantiles; each range is summed in its own task and shifted by the
    totals of the ranges above it, of which there are at most `buckets`. The quantiles only balance the tasks.
    """
    cuts = rows.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)]).alias("_cuts"))
    dealt = rows.join(F.broadcast(cuts)).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    above = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_r").agg(*(F.sum(c).alias(f"_t{c}") for c in columns))
    starts = totals.select("_r", *(F.coalesce(F.sum(f"_t{c}").over(above), F.lit(0)).alias(f"_s{c}") for c in columns))
    here = Window.partitionBy("_r").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(starts), "_r").withColumns({f"cum_{c}": F.sum(c).over(here) + F.col(f"_s{c}") for c in columns})
    return out.drop("_r", *(f"_s{c}" for c in columns))


def at_fixed_precision(predicted: DataFrame, reference: DataFrame, targets: tuple[float, ...] = PRECISIONS) -> DataFrame:
    """Per target: the score threshold that keeps most true tracks at that precision or better.

    predicted: (identity, score), reference: (identity). A reference track counts once, however often it is
    predicted; each prediction counts. Ties go to the higher precision, then to more predictions, then to the higher
    threshold. Where no threshold does, nothing is kept: precision 1 and no threshold.
    """
    known = reference.select("identity").distinct()
    n = known.agg(F.count(F.lit(1)).alias("n_reference"))
    made = predicted.where("score IS NOT NULL").groupBy("score").agg(F.count(F.lit(1)).alias("predictions"))
    hits = predicted.join(known, "identity", "left_semi").groupBy("identity").agg(F.max("score").alias("score")).groupBy("score").agg(F.count(F.lit(1)).alias("tp"))
    swept = running(made.join(hits, "score", "left").na.fill(0, ["tp"]), "score", ["tp", "predictions"])
    tp, p = F.col("cum_tp"), F.col("cum_predictions")
    best = F.max_by(F.struct(tp.alias("tp"), p.alias("predictions"), (tp / p).alias("precision"), F.col("score").alias("threshold")), F.struct(tp, tp / p, p, "score"))
    each = swept.withColumn("target", F.explode(F.array(*(F.lit(t) for t in targets)))).where((tp / p >= F.col("target")) & (tp > 0)).groupBy("target").agg(best.alias("b"))
    wanted = predicted.sparkSession.createDataFrame([(t,) for t in targets], "target double")
    out = wanted.join(F.broadcast(each), "target", "left").join(F.broadcast(n))
    tp = F.coalesce("b.tp", F.lit(0))
    return out.select("target", tp.alias("tp"), F.coalesce("b.predictions", F.lit(0)).alias("predictions"), F.coalesce("b.precision", F.lit(1.0)).alias("precision"), ratio(tp * 1.0, F.col("n_reference"), 1.0).alias("recall"), F.col("b.threshold").alias("threshold"))


def feedback(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each status that a link's counts give: true and false positives, false negatives, repeats."""
    counts = {"true_positive": F.col("tp"), "false_positive": F.col("fp"), "false_negative": F.col("fn"), "duplicate_prediction": F.greatest(F.col("n_predicted") - 1, F.lit(0))}
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(k).alias("status"), v.cast("long").alias("count"), F.lit(FEEDBACK[k]).alias("weight")) for i, (k, v) in enumerate(counts.items())))
    return ledger.select(*keys, "n_predicted", "n_reference", F.explode(rows).alias("_f")).select(*keys, "n_predicted", "n_reference", "_f.*").where("count > 0")


def label_overrides(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per link the label and weight of its heaviest status (weight times count; the first of equals)."""
    heavy = F.col("weight") * F.col("count")
    label = F.when(F.col("status").isin("false_positive", "duplicate_prediction"), 0).otherwise(1)
    best = F.max_by(F.struct(label.alias("label"), heavy.alias("weight")), F.struct(heavy, -F.col("place")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.label", "b.weight")


def weak_labels(audit: DataFrame, weights: dict | None = None) -> DataFrame:
    """Label, weight and source of audited links: a manual link counts fully, a teacher's or a prediction's little."""
    w = WEAK | (weights or {})
    g, t, p = F.col("in_gt"), F.col("in_teacher"), F.col("in_prediction")
    case = lambda a, b, c, e: F.when(g, a).when(t, b).when(p, c).otherwise(e)
    weight = case(w["manual_positive"], w["teacher_positive"], w["teacher_negative"], w["manual_negative"])
    return audit.withColumns(
        {
            "label": case(1, 1, 0, 0),
            "weight": weight * F.when(g != t, w["disagreement"]).otherwise(1.0),
            "source": case(F.lit("manual"), F.lit("weak_teacher"), F.lit("prediction_only"), F.lit("unmatched")),
            "disagrees": g != t,
        }
    )


def label_priority(row_margin: Column, column_margin: Column, score: Column, gt: Column, teacher: Column, prediction: Column, missing: Column) -> Column:
    """How much a manual label of a link would tell: low margins, disagreement, a missing end, a score near 0."""
    known = F.filter(F.array(row_margin, column_margin), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
    low = F.when(F.size(known) > 0, 1.0 / (1.0 + F.greatest(mean, F.lit(0.0)))).otherwise(1.0)
    differ = lambda a, b: (F.coalesce(a, F.lit(False)) != F.coalesce(b, F.lit(False))).cast("double")
    unsure = F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 1.0).otherwise(1.0 / (1.0 + F.abs(score)))
    return low + differ(gt, teacher) + differ(gt, prediction) + 0.5 * differ(teacher, prediction) + F.coalesce(missing, F.lit(False)).cast("double") + unsure


def within_gap(reference: DataFrame, seed_session: int, max_gap: int) -> DataFrame:
    """What perfect links up to a gap recover: the observations tied to the one in the seed session.

    A running count of longer gaps numbers a track's pieces; the piece with the seed is kept, and tracks without
    a seed go.
    """
    by = Window.partitionBy("track_id").orderBy("session_index")
    jump = F.col("session_index") - F.lag("session_index").over(by)
    pieces = reference.withColumn("_j", F.when(jump > max_gap, 1).otherwise(0)).withColumn("_p", F.sum("_j").over(by))
    seeded = F.max(F.when(F.col("session_index") == seed_session, F.col("_p"))).over(Window.partitionBy("track_id"))
    return pieces.withColumn("_s", seeded).where("_p = _s").drop("_j", "_p", "_s")


def ceilings(reference: DataFrame, n_sessions: int, seed_sessions: list[int], max_gaps: list[int]) -> DataFrame:
    """Link and complete-track scores of within_gap for each seed session and gap: the best that such links allow."""
    out = None
    for seed in seed_sessions:
        for gap in max_gaps:
            best = within_gap(reference, seed, gap)
            scores = {"link": (tracks.links(best), tracks.links(reference), tracks.LINK), "complete": (tracks.complete(best, n_sessions), tracks.complete(reference, n_sessions), ["identity"])}
            for kind, (a, b, keys) in scores.items():
                row = tracks.scored(tracks.ledger(a, b, keys)).select(F.lit(seed).alias("seed_session"), F.lit(gap).alias("max_gap"), F.lit(kind).alias("kind"), "tp", "fp", "fn", "f1")
                out = row if out is None else out.unionByName(row)
    return out


def _followed(reference: DataFrame, n_sessions: int, start: int) -> DataFrame:
    """(track_id, session_index, roi): for each roi of the start session the links between consecutive sessions that lead on from it, both ways.

    Of several links from a roi that to the least is followed. A seed's row grows by one join a session; there is one row a seed throughout.
    """
    links = tracks.links(reference)
    now = reference.where(F.col("session_index") == start).select("roi").distinct().withColumns({"track_id": F.col("roi").cast("string"), "row": F.array(F.struct(F.lit(start).alias("session_index"), "roi"))})
    for step, mine, other, sessions in ((1, "roi_a", "roi_b", range(start, n_sessions - 1)), (-1, "roi_b", "roi_a", range(start - 1, -1, -1))):
        led = links.groupBy("session_a", mine).agg(F.min(other).alias("next"))
        now = now.withColumn("at", F.element_at(F.filter("row", lambda x: x["session_index"] == start), 1)["roi"])
        for s in sessions:
            edge = led.where(F.col("session_a") == s).select(F.col(mine).alias("at"), "next")
            cell = F.array(F.struct(F.lit(s + 1 if step == 1 else s).alias("session_index"), F.col("next").alias("roi")))
            now = now.join(edge, "at", "left").select("track_id", F.when(F.col("next").isNull(), F.col("row")).otherwise(F.concat("row", cell)).alias("row"), F.col("next").alias("at"))
    return now.select("track_id", F.explode("row").alias("x")).select("track_id", "x.session_index", "x.roi")


def oracle_variants(reference: DataFrame, n_sessions: int, seed_sessions: list[int], max_gaps: list[int]) -> DataFrame:
    """(variant, seed_session, max_gap, kind, tp, fp, fn, f1): what perfect links of several kinds recover of a reference, all in one plan.

    Variants are the reference itself (`reference_rows`), what stitching consecutive links from the seeds gives (`consecutive_stitch`, of several links from a roi the one to the least
    roi), and within_gap for each gap (`gap_limited`). reference: (track_id, session_index, roi). Scores compare multisets with the whole reference.
    """
    ref = reference.select(F.col("track_id").cast("string").alias("track_id"), F.col("session_index").cast("int").alias("session_index"), F.col("roi").cast("long").alias("roi"))
    out = None

    def add(found: DataFrame, variant: str, seed: int, gap: int | None) -> None:
        nonlocal out
        row = found.select(F.concat_ws("|", F.lit(variant), F.lit(seed), F.lit("" if gap is None else gap)).alias("v"), F.concat_ws("|", F.lit(variant), F.lit(seed), F.lit("" if gap is None else gap), "track_id").alias("track_id"), "session_index", "roi")
        out = row if out is None else out.unionByName(row)

    settings = []
    for seed in seed_sessions:
        for variant, gap, found in (("reference_rows", None, ref), ("consecutive_stitch", 1, _followed(ref, n_sessions, seed)), *(("gap_limited", g, within_gap(ref, seed, g)) for g in max_gaps)):
            add(found, variant, seed, gap)
            settings.append((f"{variant}|{seed}|{'' if gap is None else gap}", variant, seed, gap))
    table = F.broadcast(reference.sparkSession.createDataFrame(settings, "v string, variant string, seed_session int, max_gap int"))  # the settings themselves
    scores = None
    for kind, keys, rows in (("link", tracks.LINK, tracks.links), ("complete", ["identity"], lambda df: tracks.complete(df, n_sessions))):
        found = rows(out).join(out.select("track_id", "v").distinct(), "track_id")
        truth = rows(ref).select(*keys).join(table.select("v"), F.lit(True))
        one = tracks.scored(tracks.ledger(found, truth, ["v", *keys]), ["v"]).withColumn("kind", F.lit(kind))
        scores = one if scores is None else scores.unionByName(one)
    whole = table.join(F.broadcast(reference.sparkSession.createDataFrame([("link",), ("complete",)], "kind string")), F.lit(True))
    done = whole.join(scores, ["v", "kind"], "left").na.fill(0, ["tp", "fp", "fn"]).na.fill(1.0, ["f1"])
    return done.select("variant", "seed_session", "max_gap", "kind", "tp", "fp", "fn", "f1")


def stratified(rows: DataFrame, fields: list[str], metrics: list[str]) -> DataFrame:
    """Mean, median, least and greatest of each metric by any fields; missing and NaN values are left out."""
    long = rows.select(*fields, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(fields, metrics, "metric", "value").withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    v = F.col("value")
    return long.groupBy(*fields, "metric").agg(F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def sweep(rows: DataFrame, setting: str, metric: str, ties: list[str]) -> DataFrame:
    """Settings of a sweep by the mean of a metric: its population deviation, extremes and missing values, ranked."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    v = finite(metric)
    out = rows.groupBy(setting).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("greatest"), *(F.avg(finite(t)).alias(f"mean_{t}") for t in ties))
    order = [F.desc_nulls_last("mean"), *(F.desc_nulls_last(f"mean_{t}") for t in ties), setting]
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def pessimistic_ranks(cells: DataFrame, edge: list[str], row: str, cost: str) -> DataFrame:
    """Each cell's rank in its row with ties counted against it: how many of the row cost no more."""
    w = Window.partitionBy(*edge, row).orderBy(cost).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("pessimistic_rank", F.count(F.lit(1)).over(w))


def radial_rows(source: DataFrame, target: DataFrame, keys: list[str], min_radius: float = 1e-9) -> DataFrame:
    """Displacement of tracked points outwards from and around the mean of their source points.

    source, target: keys, track_id, x, y. Points no further than min_radius from the centre are left out.
    """
    both = source.join(target.withColumnsRenamed({"x": "tx", "y": "ty"}), [*keys, "track_id"])
    by = Window.partitionBy(*keys)
    rx, ry = F.col("x") - F.avg("x").over(by), F.col("y") - F.avg("y").over(by)
    out = both.withColumns({"rx": rx, "ry": ry}).withColumn("radius", F.sqrt(F.col("rx") ** 2 + F.col("ry") ** 2)).where(F.col("radius") > min_radius)
    ux, uy, dx, dy = F.col("rx") / F.col("radius"), F.col("ry") / F.col("radius"), F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    norm = F.sqrt(dx * dx + dy * dy)
    moved = out.withColumns({"radial": dx * ux + dy * uy, "tangential": ux * dy - uy * dx, "norm": norm})
    return moved.withColumn("alignment", ratio(F.col("radial"), F.col("norm"), None)).drop("rx", "ry")


def sign_p_value(k: Column, n: Column) -> Column:
    """The chance of k or more heads in n fair throws, null without throws; its terms are added up as logarithms."""
    start = F.struct(F.lit(0.0).alias("log"), F.when(k <= 0, F.exp(-n * F.log(F.lit(2.0)))).otherwise(0.0).alias("sum"))

    def step(s, i):
        log = s["log"] + F.log(n - i + 1.0) - F.log(i)
        return F.struct(log.alias("log"), (s["sum"] + F.when(i >= k, F.exp(log - n * F.log(F.lit(2.0)))).otherwise(0.0)).alias("sum"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, step)["sum"])


def radial_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many points moved outwards and inwards, how far, and how likely so many outwards are by chance."""
    r = F.col("radial")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(r > 0).alias("outward"), F.count_if(r < 0).alias("inward"),
        F.avg(r).alias("mean_radial"), F.median(r).alias("median_radial"), F.avg("norm").alias("mean_norm"), F.avg("alignment").alias("mean_alignment"),
    )
    return out.withColumn("p_value", sign_p_value(F.col("outward"), F.col("outward") + F.col("inward")))


def by_quadrant(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A measure by edge and quadrant around the mean point: north is low y, west low x."""
    by = Window.partitionBy(*keys)
    name = F.concat(F.when(F.col("y") < F.avg("y").over(by), "north").otherwise("south"), F.lit("_"), F.when(F.col("x") < F.avg("x").over(by), "west").otherwise("east"))
    v = F.col(value)
    return rows.withColumn("quadrant", name).groupBy(*keys, "quadrant").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.max(v).alias("greatest"))


def coverage(reference: DataFrame, loaded: DataFrame, by: list[str]) -> DataFrame:
    """By session: how many of the reference's ROIs were loaded, and the share of it."""
    mark = loaded.select(*by, "roi").distinct().withColumn("_hit", F.lit(1))
    out = reference.select(*by, "roi").distinct().join(mark, [*by, "roi"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n_reference"), F.count("_hit").alias("n_loaded"))
    return out.withColumn("coverage", F.col("n_loaded") / F.col("n_reference"))


def missing_edges(reference_links: DataFrame, loaded: DataFrame) -> DataFrame:
    """Reference links with an end that was not loaded, once each, and which end it is."""
    rois = loaded.select("session_index", "roi").distinct()
    end = lambda s: rois.select(F.col("session_index").alias(f"session_{s}"), F.col("roi").alias(f"roi_{s}"), F.lit(1).alias(f"_{s}"))
    x = reference_links.select(*tracks.LINK).distinct().join(end("a"), ["session_a", "roi_a"], "left").join(end("b"), ["session_b", "roi_b"], "left")
    a, b = F.col("_a").isNull(), F.col("_b").isNull()
    return x.where(a | b).select(*tracks.LINK, F.when(a & b, "both_missing").when(a, "source_missing").otherwise("target_missing").alias("reason"))


def supported_skips(links: DataFrame, min_support: int = 1, reject_conflicts: bool = True) -> DataFrame:
    """Links without skips, and those skips that paths of two links over a session between support.

    A skip is in conflict if its source links to a session between, from where a link goes to another ROI of the
    target's session than the skip's.
    """
    plain = links.select(*tracks.LINK).distinct()
    skips = plain.where("session_b - session_a > 1")
    first = plain.select("session_a", "roi_a", F.col("session_b").alias("_s"), F.col("roi_b").alias("_r"))
    then = plain.select(F.col("session_a").alias("_s"), F.col("roi_a").alias("_r"), "session_b", F.col("roi_b").alias("_to"))
    ways = skips.join(first, ["session_a", "roi_a"]).where("_s < session_b").join(then, ["_s", "_r", "session_b"])
    counted = ways.groupBy(*tracks.LINK).agg(F.count_distinct(F.when(F.col("_to") == F.col("roi_b"), F.col("_s"))).alias("support"), F.count_if(F.col("_to") != F.col("roi_b")).alias("conflicts"))
    ok = (F.col("support") >= min_support) & ((F.col("conflicts") == 0) if reject_conflicts else F.lit(True))
    return plain.where("session_b - session_a = 1").unionByName(counted.where(ok).select(*tracks.LINK))


def label_pairs(labels: DataFrame, session_a: int, session_b: int) -> DataFrame:
    """Pairs of ROIs of two sessions that carry the same label (session_index, roi, label)."""
    side = lambda i, s: labels.where((F.col("session_index") == i) & F.col("label").isNotNull()).select("label", F.col("roi").alias(f"roi_{s}"))
    return side(session_a, "a").join(side(session_b, "b"), "label").select(F.lit(session_a).alias("session_a"), F.lit(session_b).alias("session_b"), "roi_a", "roi_b")


def planned_splits(links: DataFrame, max_splits: int = 2, min_side: int = 2, at_least: float = 1.5, penalty: float = 0.25, n_sessions: int | None = None) -> DataFrame:
    """The splits of each track that take away most risk while every piece keeps min_side observations.

    links: (track_id, session_a, session_b, risk), the links between successive observations. A split gains its
    risk less the penalty. The best plan that ends at a link extends the best one that ends far enough before it: one
    window for each further split. Of equal plans that with fewer splits counts, then the earlier one. With
    n_sessions, only tracks observed in all of them are split. Returns track_id, session_b of each split, plan_gain.
    """
    track = Window.partitionBy("track_id")
    placed = links.withColumns({"_i": F.row_number().over(track.orderBy("session_a")), "_n": F.count(F.lit(1)).over(track) + 1})
    ok = (F.col("_i") >= min_side) & (F.col("_n") - F.col("_i") >= min_side) & (F.col("risk") >= at_least) & (F.col("risk") > penalty)
    if n_sessions is not None:
        ok = ok & (F.col("_n") == n_sessions)
    gain = F.col("risk") - penalty
    now = placed.where(ok).withColumn("_p1", F.struct(gain.alias("gain"), (-F.col("_i")).alias("k"), F.array("session_b").alias("path")))
    before = track.orderBy("_i").rangeBetween(Window.unboundedPreceding, -min_side)
    for j in range(2, max_splits + 1):
        best = F.max(f"_p{j - 1}").over(before)
        now = now.withColumn("_b", best).withColumn(f"_p{j}", F.when(F.col("_b").isNotNull(), F.struct((F.col("_b.gain") + gain).alias("gain"), F.col("_b.k").alias("k"), F.concat("_b.path", F.array("session_b")).alias("path")))).drop("_b")
    plans = F.array(*(F.when(F.col(f"_p{j}").isNotNull(), F.struct(F.col(f"_p{j}.gain").alias("gain"), F.lit(-j).alias("n"), F.col(f"_p{j}.k").alias("k"), F.col(f"_p{j}.path").alias("path"))) for j in range(1, max_splits + 1)))
    best = now.groupBy("track_id").agg(F.max(F.array_max(plans)).alias("b"))
    return best.select("track_id", F.explode("b.path").alias("session_b"), F.col("b.gain").alias("plan_gain"))
