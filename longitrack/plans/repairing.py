"""Queries of edits applied to tracks, and their SQL, added to the catalog.

The tracks are the tracklets and the paths that plans/tracking.py finds from the overlaps of suppliers' years, so edits act on what the engine itself makes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from longitrack.operators import dynamic, edits, lines
from longitrack.plans.catalog import query
from longitrack.plans.tracking import _CANDIDATES, _HELD, _N, _PIXELS, _REACH, _SCORED, _candidates, _chosen_sql, _named, _packed, _paths_sql, _pieces, _score, _scored
from longitrack.session import written

#: Tracks of tracklets in SQL, and the teacher's links: those of the chosen paths.
_BOTH = (
    _SCORED
    + _CANDIDATES.removeprefix(_PIXELS)
    + _paths_sql(_N, 8, 4).replace("paths AS (SELECT *, len", f"paths AS (SELECT *, {_HELD} AS held, len")
    + _chosen_sql(False)
    + """, te AS (SELECT subject, k - 1 AS a, row[k] AS x, row[k + 1] AS y FROM sel, range(1, 7) AS r(k) WHERE row[k] >= 0 AND row[k + 1] >= 0),
ob AS (SELECT subject, fs::VARCHAR || ':' || fr::VARCHAR AS t, s, roi AS r FROM tr)
"""
)


def _teacher(spark, d):
    paths = dynamic.policy_tracks(_candidates(spark, d), _N)
    return written(dynamic.observations(paths), "teacher")


def _of_links(spark, d, links):
    """Links with the score that _pairs gives them; those beyond its reach are left out."""
    told = _scored(lines.of_pairs(_packed(spark, d), links).where(F.col("distance") <= _REACH))
    return written(told.select(*links.columns, "score"), "scored-links")


def _suffix_steps(packed, kept, most):
    """Of _pairs the steps over the last two years that a suffix may be made of: from ends of tracks, over suppliers no track holds, to such.

    Of several steps into the year before the last, or out of it, only the best `most` of each supplier are given, with those they may tie with:
    where fewer than `most` suffixes are taken before, one of the better ones is free.
    """
    at = lambda s: packed.where(F.col("session_index") == s)
    ends = kept.where(F.col("session_a") == _N - 3).select(F.col("session_a").alias("session_index"), "subject", F.col("roi_a").alias("roi")).distinct()
    held = kept.select("subject", "session_index", "roi").distinct()
    key = ["subject", "session_index", "roi"]
    first, free = at(_N - 3).join(ends, key, "left_semi"), packed.where(F.col("session_index") >= _N - 2).join(held, key, "left_anti")

    def step(a, b, into):
        def reduce(p, _):
            _, si, ratio, score = _score(p)
            c = np.where((p.distance <= _REACH) & (ratio >= 0.6) & (si >= 0.2), -score, np.inf)
            i, j = lines.up_to(c, most) if not into else lines.up_to(np.ascontiguousarray(c.T), most)[::-1]
            return p.rows(i, j).assign(area_ratio=ratio[i, j])

        return lines.in_blocks(lines.sides(a, 1)[0], lines.sides(b, 1)[1], reduce, f"{lines.PAIR}, area_ratio double")

    middle = free.where(F.col("session_index") == _N - 2)
    return _scored(step(first, middle, True).unionByName(step(middle, free.where(F.col("session_index") == _N - 1), False)))


def _forest(spark, d, packed=None):
    """Tracklets as tracks, and their names."""
    pieces = _pieces(spark, d, packed).withColumnRenamed("tracklet", "track_id")
    return pieces, _named(pieces.withColumnRenamed("track_id", "tracklet")).withColumnRenamed("tracklet", "track_id")


@query(
    _BOTH
    + """, eg AS (SELECT subject, a, x, y, row_number() OVER (PARTITION BY subject ORDER BY a, x, y) AS k, count(*) OVER (PARTITION BY subject) AS n FROM te),
st AS (
  SELECT subject, 0::BIGINT AS k, list({'t': t, 's': s, 'r': r}) AS o FROM ob GROUP BY subject
  UNION ALL
  SELECT subject, k, CASE
    WHEN len(src) = 1 AND len(tgt) = 0 AND list_contains(ss, 0) AND NOT list_contains(ss, a + 1) AND len(ss) + 1 < 7 THEN list_append(o, {'t': src[1], 's': a + 1, 'r': y})
    WHEN len(src) = 0 AND len(tgt) = 1 AND list_contains(ts, 0) AND NOT list_contains(ts, a) AND len(ts) + 1 < 7 THEN list_append(o, {'t': tgt[1], 's': a, 'r': x})
    WHEN len(src) = 1 AND len(tgt) = 1 AND src[1] <> tgt[1] AND NOT list_has_any(ss, ts) AND (list_contains(ss, 0) OR list_contains(ts, 0)) AND len(ss) + len(ts) < 7
      THEN list_transform(o, lambda z: {'t': CASE WHEN z.t = tgt[1] THEN src[1] ELSE z.t END, 's': z.s, 'r': z.r})
    ELSE o END
  FROM (SELECT *, list_transform(list_filter(o, lambda z: z.t = src[1]), lambda z: z.s) AS ss, list_transform(list_filter(o, lambda z: z.t = tgt[1]), lambda z: z.s) AS ts
    FROM (SELECT st.subject, eg.k, o, a, x, y, list_distinct(list_transform(list_filter(o, lambda z: z.s = a AND z.r = x), lambda z: z.t)) AS src, list_distinct(list_transform(list_filter(o, lambda z: z.s = a + 1 AND z.r = y), lambda z: z.t)) AS tgt
      FROM st JOIN eg ON eg.subject = st.subject AND eg.k = st.k + 1))
)
SELECT subject, z.t AS track, z.s::INT AS session_index, z.r AS roi FROM (SELECT subject, unnest(o) AS z FROM st QUALIFY row_number() OVER (PARTITION BY subject ORDER BY k DESC) = 1)"""
)
def cleanup_applied_rescue(spark, d):
    """Tracklets that take up the links of the chosen paths, one after another, where nothing speaks against them."""
    tracks, names = _forest(spark, d)
    out, _ = edits.rescue(tracks, _teacher(spark, d), _N, order="lexicographic")
    return out.join(names, ["subject", "track_id"]).select("subject", F.col("name").alias("track"), "session_index", "roi")


@query(
    _BOTH
    + """, lk AS (SELECT te.subject, a, x, y, score, distance, row_number() OVER (PARTITION BY te.subject ORDER BY score, a, x) AS k FROM te JOIN ps ON ps.subject = te.subject AND ps.sa = a AND ps.sb = a + 1 AND ps.ra = x AND ps.rb = y),
tg AS (SELECT lk.*, sel.seed, row_number() OVER (PARTITION BY lk.subject, sel.seed ORDER BY lk.k) AS i FROM lk JOIN sel ON sel.subject = lk.subject AND sel.row[a + 1] = x AND sel.row[a + 2] = y WHERE lk.k <= 4 AND len(list_filter(sel.row, lambda v: v >= 0)) = 7)
SELECT sel.subject, sel.seed, (CASE WHEN tg.a IS NOT NULL AND r.k - 1 > tg.a THEN 1 ELSE 0 END)::BIGINT AS piece, (r.k - 1)::INT AS session_index, row[r.k] AS roi FROM sel JOIN range(1, 8) AS r(k) ON row[r.k] >= 0 LEFT JOIN tg ON tg.i = 1 AND tg.subject = sel.subject AND tg.seed = sel.seed"""
)
def cleanup_applied_vetoes(spark, d):
    """Chosen paths over all years split at their links of the least overlap, of the four worst of a nation; a path that was split is whole no more."""
    tracks = _teacher(spark, d)
    links = edits.teacher_edges(tracks).select("subject", F.col("session_index").alias("session_a"), (F.col("session_index") + 1).alias("session_b"), F.col("roi").alias("roi_a"), "roi_b", F.lit(0).alias("occurrence"))
    scored = _of_links(spark, d, links)
    pieces, _ = edits.vetoed(tracks, scored, [F.col("score"), F.col("session_a"), F.col("roi_a")], _N, max_vetoes=4, complete=True)
    return pieces.select("subject", F.col("track_id").alias("seed"), "piece", "session_index", "roi")


@query(
    _SCORED
    + """, sf AS (SELECT en.subject, en.id AS track, [p.sb, q.sb] AS ss, [p.rb, q.rb] AS rs, least(p.ar, q.ar) AS ar, greatest(p.distance, q.distance) AS distance, least(p.si, q.si) AS si, p.score + q.score AS score
  FROM en JOIN ps p ON p.subject = en.subject AND p.sa = en.ls AND p.ra = en.lr AND p.sb = p.sa + 1 JOIN ps q ON q.subject = p.subject AND q.sa = p.sb AND q.ra = p.rb AND q.sb = q.sa + 1 AND q.sb = 6),
ab AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(score, 9) DESC, track, rs) AS k FROM sf WHERE ar >= 0.6 AND distance <= 2.0 AND si >= 0.2
  AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.subject = sf.subject AND tr.s >= 5 AND ((tr.s = 5 AND tr.roi = rs[1]) OR (tr.s = 6 AND tr.roi = rs[2])) AND tr.fs < 5)),
z AS (SELECT subject, 0::BIGINT AS k, []::VARCHAR[] AS used, []::BIGINT[] AS got, 0 AS n FROM (SELECT DISTINCT subject FROM ab)
  UNION ALL SELECT z.subject, ab.k, CASE WHEN ok THEN list_concat(used, [track, '5:' || rs[1], '6:' || rs[2]]) ELSE used END, CASE WHEN ok THEN list_append(got, ab.k) ELSE got END, CASE WHEN ok THEN n + 1 ELSE n END
  FROM (SELECT z.*, z.n < 2 AND NOT list_has_any(used, [track, '5:' || rs[1], '6:' || rs[2]]) AS ok FROM z JOIN ab ON ab.subject = z.subject AND ab.k = z.k + 1) z JOIN ab ON ab.subject = z.subject AND ab.k = z.k + 1),
fin AS (SELECT subject, unnest(got) AS k FROM z QUALIFY row_number() OVER (PARTITION BY subject ORDER BY z.k DESC) = 1)
SELECT subject, track, score, session_index, roi FROM (SELECT ab.subject, track, round(score, 6) AS score, unnest(ss)::INT AS session_index, unnest(rs) AS roi FROM ab JOIN fin ON fin.subject = ab.subject AND fin.k = ab.k)"""
)
def cleanup_applied_suffixes(spark, d):
    """Tracklets that end two years before the last with the suffixes added that lead there, two of a nation at most."""
    packed = _packed(spark, d)
    tracks, names = _forest(spark, d, packed)
    # what later tracklets hold is free to be taken: only tracks that reach further back keep their years
    kept = tracks.join(dynamic.ends(tracks.withColumnRenamed("track_id", "tracklet")).where("first_session < 5").select("subject", F.col("tracklet").alias("track_id"), F.col("last_session").alias("session_a"), F.col("last_roi").alias("roi_a")), ["subject", "track_id"])
    kept = written(kept, "kept")
    pairs = written(_suffix_steps(packed, kept, 2), "suffix-steps").select("subject", "session_a", "session_b", "roi_a", "roi_b", "score", "shifted_iou", "area_ratio", "distance")
    step = lambda i: pairs.select("subject", *(F.col(c).alias(f"{c}{i}") for c in pairs.columns[1:]))
    ends = kept.select("subject", "track_id", F.col("session_a").alias("session_a1"), F.col("roi_a").alias("roi_a1")).distinct()
    two = ends.join(step(1), ["subject", "session_a1", "roi_a1"]).join(step(2).withColumnsRenamed({"session_a2": "session_b1", "roi_a2": "roi_b1"}), ["subject", "session_b1", "roi_b1"]).join(names, ["subject", "track_id"])
    passes = (F.least("area_ratio1", "area_ratio2") >= 0.6) & (F.greatest("distance1", "distance2") <= 2.0) & (F.least("shifted_iou1", "shifted_iou2") >= 0.2)
    paths = two.select("subject", F.xxhash64("track_id", "roi_b1", "roi_b2").alias("path_id"), "track_id", F.array("session_b1", "session_b2").alias("sessions"), F.array("roi_b1", "roi_b2").alias("rois"), passes.alias("passes"), (F.col("score1") + F.col("score2")).alias("score"), "name")
    out, flags = edits.stitched(kept.select("subject", "track_id", "session_index", "roi"), paths, [F.desc(F.round("score", 9)), F.col("name"), F.col("rois")], _N, 2)
    added = out.where("added").join(flags.where("selected").select("subject", "track_id", "name", F.round("score", 6).alias("score")), ["subject", "track_id"])
    return added.select("subject", F.col("name").alias("track"), "score", "session_index", "roi")


@query(
    _BOTH
    + """, lk AS (SELECT te.subject, sel.seed, a, 4 - ps.score AS benefit, row_number() OVER (PARTITION BY te.subject ORDER BY 4 - ps.score DESC, a, x) AS k FROM te JOIN ps ON ps.subject = te.subject AND ps.sa = a AND ps.sb = a + 1 AND ps.ra = x AND ps.rb = y JOIN sel ON sel.subject = te.subject AND sel.row[a + 1] = x AND sel.row[a + 2] = y QUALIFY k <= 4),
hs AS (SELECT subject, [k] AS ks FROM lk UNION ALL SELECT p.subject, [p.k, q.k] FROM lk p JOIN lk q ON p.subject = q.subject AND p.k < q.k),
he AS (SELECT hs.subject, ks, lk.seed, a, benefit FROM hs JOIN lk ON lk.subject = hs.subject AND list_contains(ks, lk.k)),
ht AS (SELECT DISTINCT subject, seed FROM lk),
hx AS (SELECT hs.subject, ks, sel.seed, r.s, (SELECT count(*) FROM he WHERE he.subject = hs.subject AND he.ks = hs.ks AND he.seed = sel.seed AND he.a < r.s) AS piece FROM hs JOIN ht ON ht.subject = hs.subject JOIN sel ON sel.subject = ht.subject AND sel.seed = ht.seed JOIN range(0, 7) AS r(s) ON sel.row[r.s + 1] >= 0),
ha AS (SELECT subject, ks, count(*) FILTER (n < 2) AS short FROM (SELECT subject, ks, seed, piece, count(*) AS n FROM hx GROUP BY ALL) GROUP BY ALL),
ho AS (SELECT he.subject, ks, sum(benefit) - 0.25 * count(*) - 0.5 * any_value(short) AS objective FROM he JOIN ha USING (subject, ks) GROUP BY ALL),
hc AS (SELECT * FROM ho WHERE round(objective, 9) >= 1 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY round(objective, 9) DESC, len(ks), ks) = 1)
SELECT ho.subject, array_to_string(list_transform(ho.ks, lambda v: v::VARCHAR), ',') AS edits, round(ho.objective, 5) AS objective, hc.ks IS NOT NULL AS chosen FROM ho LEFT JOIN hc ON hc.subject = ho.subject AND hc.ks = ho.ks"""
)
def cleanup_best_configuration(spark, d):
    """Sets of up to two splits of a nation's chosen paths at their weakest links, by the pieces that they leave."""
    tracks = _teacher(spark, d)
    links = edits.teacher_edges(tracks).select("subject", F.col("session_index").alias("session_a"), (F.col("session_index") + 1).alias("session_b"), F.col("roi").alias("roi_a"), "roi_b", F.lit(0).alias("occurrence"))
    weak = _of_links(spark, d, links).withColumn("score", 4 - F.col("score"))
    _, sets = edits.best_configuration(tracks, weak, [F.col("session_a"), F.col("roi_a")], _N)
    return sets.select("subject", F.array_join(F.transform("edits", lambda x: x.cast("string")), ",").alias("edits"), F.round("objective", 5).alias("objective"), "chosen")
