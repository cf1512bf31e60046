"""Tracks, scores and repair on literal tables."""

import pytest

from longitrack.operators import cleanup, tracks


def table(spark, rows, **kw):
    """Rows of ids by session, None for missing, as a long track table."""
    long = [(i, s, v) for i, r in enumerate(rows) for s, v in enumerate(r) if v is not None]
    return spark.createDataFrame(long, "track_id long, session_index int, roi long")


def link_scores(spark, predicted, reference):
    p, r = table(spark, predicted), table(spark, reference)
    return tracks.scored(tracks.ledger(tracks.links(p), tracks.links(r), tracks.LINK)).first()


def complete_scores(spark, predicted, reference, n):
    p, r = table(spark, predicted), table(spark, reference)
    return tracks.scored(tracks.ledger(tracks.complete(p, n), tracks.complete(r, n), ["identity"])).first()


def counts(row):
    return row.tp, row.fp, row.fn


def test_three_sessions(spark):
    reference, predicted = [[0, 10, 20], [1, 11, 21], [2, None, 22]], [[0, 10, 20], [1, None, 21], [3, 13, 23]]
    c, x = complete_scores(spark, predicted, reference, 3), link_scores(spark, predicted, reference)
    assert counts(c) == (1, 1, 1) and c.f1 == 0.5
    assert counts(x) == (2, 2, 2) and x.f1 == 0.5
    s = tracks.summary(table(spark, predicted), 3).first()
    assert s.complete_tracks == 2 and abs(s.mean_length - 8 / 3) < 1e-12


def test_duplicates_match_once(spark):
    reference, predicted = [[0, 10, 20]], [[0, 10, 20]] * 2
    c, x = complete_scores(spark, predicted, reference, 3), link_scores(spark, predicted, reference)
    assert counts(c) == (1, 1, 0) and (c.precision, c.recall) == (0.5, 1.0) and abs(c.f1 - 2 / 3) < 1e-12
    assert counts(x) == (2, 2, 0) and abs(x.f1 - 2 / 3) < 1e-12


def test_session_subsets_and_no_match(spark):
    pairs = spark.createDataFrame([(0, 1)], "session_a int, session_b int")
    p, r = table(spark, [[0, 10, 20], [0, 10, 99]]), table(spark, [[0, 10, 20]])
    x = tracks.scored(tracks.ledger(tracks.links_for(p, pairs), tracks.links_for(r, pairs), tracks.LINK)).first()
    assert counts(x) == (1, 1, 0) and abs(x.f1 - 2 / 3) < 1e-12
    x = link_scores(spark, [[1, 11]], [[0, 10]])
    assert (x.precision, x.recall, x.f1) == (0.0, 0.0, 0.0)
    assert link_scores(spark, [], []).f1 == 1.0


def test_horizons(spark):
    got = tracks.by_horizon(table(spark, [[10, 20, 30]]), table(spark, [[10, 20, 30], [40, None, 60]]), [2, 3]).collect()
    assert {r.horizon: r.proportion for r in got} == {2: 1.0, 3: 1.0}


def test_published_counts(spark):
    rows = [(581, 18, 24), (586, 28, 19), (55, 4, 5), (56, 4, 4)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, tp long, fp long, fn long")
    got = [round(r.f1, 6) for r in tracks.scored(df, ["k"]).orderBy("k").collect()]
    assert got == [0.965116, 0.961444, 0.924370, 0.933333]


def test_wide_and_long(spark):
    wide = spark.createDataFrame([("a", "1", None), ("b", "nan", "7"), ("c", "-1", "3.0")], "track string, s1 string, s2 string")
    long = tracks.from_wide(wide, "track", ["s1", "s2"])
    assert {(r.track_id, r.session_index, r.roi) for r in long.collect()} >= {("a", 0, 1), ("b", 1, 7)}
    back = tracks.to_wide(table(spark, [[1, None], [2, 3]]), 2, fill=-1).orderBy("track_id").collect()
    assert [(r.s0, r.s1) for r in back] == [(1, -1), (2, 3)]
    bad = spark.createDataFrame([("a", 0, "1"), ("a", 0, "2"), ("b", 0, "4"), ("b", 0, "4"), ("b", 0, None)], "track_id string, session_index int, roi string")
    assert [r.track_id for r in tracks.conflicts(bad).collect()] == ["a"]


def test_stitching_stops_at_the_first_miss_both_ways(spark):
    matches = spark.createDataFrame([(0, 1, 11), (1, 11, 21), (2, 99, 31), (1, 12, 22), (0, 2, 12)], "session_a int, roi_a long, roi_b long")
    seeds = spark.createDataFrame([(7, 11), (8, 12)], "track_id long, roi long")
    got = {(r.track_id, r.session_index, r.roi) for r in tracks.stitched(matches, seeds, 4, start=1).collect()}
    assert got == {(7, 0, 1), (7, 1, 11), (7, 2, 21), (8, 0, 2), (8, 1, 12), (8, 2, 22)}


def test_splits_keep_long_sides(spark):
    t = table(spark, [[1, 2, 3, 4], [5, 6]])
    bridges = spark.createDataFrame([(0, 2), (0, 1), (1, 1)], "track_id long, session_b int")
    got = {(r.track_id, r.piece, r.session_index) for r in tracks.split_at(t, bridges, 2).collect()}
    assert got == {(0, 0, 0), (0, 0, 1), (0, 1, 2), (0, 1, 3), (1, 0, 0), (1, 0, 1)}


def test_gap_costs_and_votes(spark):
    t = table(spark, [[1, 2, None, 4]])
    got = {r.gap: (r.positives, r.opportunities) for r in tracks.gap_costs(t, 3).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 1)}
    both = table(spark, [[1, 2], [1, 2]]).selectExpr("'x' AS variant", "*").unionByName(table(spark, [[1, 2], [1, 3]]).selectExpr("'y' AS variant", "*"))
    assert {(r.roi_a, r.roi_b): r.votes for r in tracks.votes(both).collect()} == {(1, 2): 2, (1, 3): 1}


def test_insertion_respects_slots_and_order(spark):
    t = spark.createDataFrame([("s", 0, 0, 1), ("s", 1, 0, 2), ("s", 1, 1, 5)], "subject string, track_id long, session_index int, roi long")
    c = spark.createDataFrame([("s", 0, 1, 1, 5, 9.0), ("s", 0, 1, 1, 6, 1.0), ("s", 0, 1, 2, 7, 5.0), ("s", 1, 2, 6, 8, 7.0)], "subject string, session_a int, session_b int, roi_a long, roi_b long, priority double")
    new = lambda n: {(r.track_id, r.session_index, r.roi) for r in cleanup.insert_edges(t, c, n).where("inserted").collect()}
    assert new(1) == {(0, 1, 6)} and new(5) == {(0, 1, 6), (0, 2, 8)}


@pytest.mark.parametrize(("row", "reason"), [((2, 0.95, 0.9, 0.5, 0.3), ""), ((1, 0.95, 0.9, 0.6, 0.3), "gap;iou"), ((2, None, 0.1, 0.5, 0.1), "area;cell_probability;threshold_margin")])
def test_gate_reasons(spark, row, reason):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([row], "g int, a double, p double, i double, m double")
    assert df.select(cleanup.strict_gap_gate(*map(F.col, "gapim")).alias("r")).first().r == reason


def test_micro_f1_of_published_counts(spark):
    """Counts of links and complete tracks and the F1 that is published for them."""
    rows = [("link", 581, 18, 24, 0.965116), ("complete", 55, 4, 5, 0.924370), ("link", 586, 28, 19, 0.961444), ("complete", 56, 4, 4, 0.933333)]
    for kind, tp, fp, fn, f1 in rows:
        df = spark.createDataFrame([(tp - 3, fp, 1), (3, 0, fn - 1)], "tp long, fp long, fn long")
        assert round(tracks.scored(df).first().f1, 6) == f1, kind


def test_oracle_variants_against_plain_python(spark):
    import random
    from collections import Counter

    from longitrack.operators import reports

    rnd, n = random.Random(3), 5
    rows = {k: {t: 10 * k + t for t in range(n) if rnd.random() < 0.75} for k in range(14)}
    df = spark.createDataFrame([(f"t{k}", t, x) for k, v in rows.items() for t, x in v.items()], "track_id string, session_index int, roi long")

    def limited(v, seed, gap):
        if seed not in v:
            return {}
        kept, last = {seed}, seed
        for t in sorted(x for x in v if x > seed):
            if t - last > gap:
                break
            kept.add(t)
            last = t
        last = seed
        for t in sorted((x for x in v if x < seed), reverse=True):
            if last - t > gap:
                break
            kept.add(t)
            last = t
        return {t: v[t] for t in kept}

    def bags(table):
        return Counter((t, v[t], v[t + 1]) for v in table for t in v if t + 1 in v), Counter(tuple(v[t] for t in range(n)) for v in table if len(v) == n)

    truth, want = bags(rows.values()), {}
    for seed in (0, 2):
        for name, gap, found in (("reference_rows", None, list(rows.values())), ("consecutive_stitch", 1, [limited(v, seed, 1) for v in rows.values()]), *(("gap_limited", g, [limited(v, seed, g) for v in rows.values()]) for g in (1, 2))):
            for kind, a, b in zip(("link", "complete"), bags(found), truth, strict=True):
                want[name, seed, gap, kind] = tuple(sum(x.values()) for x in (a & b, a - b, b - a))
    got = {(r.variant, r.seed_session, r.max_gap, r.kind): (r.tp, r.fp, r.fn) for r in reports.oracle_variants(df, n, [0, 2], [1, 2]).collect()}
    assert got == want
    assert {r.f1 for r in reports.oracle_variants(df.limit(0), n, [0], [1]).collect()} == {1.0}
