"""Edits on changing tracks against plain Python on whole matrices."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from longitrack.operators import edits as E

TRACK = "subject string, track_id long, session_index int, roi long"
N = 5


def table(spark, matrices):
    """{subject: rows} to long form; a row's place is its id, -1 is missing."""
    return spark.createDataFrame([(s, k, i, x) for s, rows in matrices.items() for k, r in enumerate(rows) for i, x in enumerate(r) if x >= 0], TRACK)


def matrix(df, n=N):
    out = {}
    for r in df.collect():
        out.setdefault((r.subject, r.track_id), [-1] * n)[r.session_index] = r.roi
    return Counter((s, tuple(r)) for (s, _), r in out.items())


def rescued(rows, teacher, order, completes=(), backfill=True, seed_backfill=False, merges=True, teacher_completes=False, support=1, limit=None, n=N):
    """One subject's rows by trying the teacher's links on the whole matrix, with the links that were applied in turn."""
    rows = [list(r) for r in rows]
    links = sorted((a, r[a], r[a + 1]) for r in teacher for a in range(n - 1) if r[a] >= 0 and r[a + 1] >= 0)
    todo = [(*e, k) for e, c in sorted(Counter(links).items()) for k in range(c)]
    whole = {tuple(r) for r in teacher if min(r) >= 0}

    def look(a, x, y):
        s = [i for i, r in enumerate(rows) if r[a] == x]
        t = [i for i, r in enumerate(rows) if r[a + 1] == y]
        if len(s) > 1 or len(t) > 1 or not (s or t) or s == t:
            return None
        if (s and rows[s[0]][a + 1] >= 0) or (t and rows[t[0]][a] >= 0):
            return None
        if s and t:
            p, q = rows[s[0]], rows[t[0]]
            if not merges or any(u >= 0 and v >= 0 and u != v for u, v in zip(p, q, strict=True)):
                return None
            made, action, held = [max(u, v) for u, v in zip(p, q, strict=True)], "merge", None
            held = made
        elif s:
            made = list(rows[s[0]])
            made[a + 1], action, held = y, "extend", rows[s[0]]
        else:
            made = list(rows[t[0]])
            made[a], action, held = x, "seed" if a == 0 and seed_backfill else "backfill", rows[t[0]]
            if action == "seed":
                held = made
            elif not backfill:
                return None
        known = teacher_completes and min(made) >= 0 and tuple(made) in whole
        if held[0] < 0 and not (action == "backfill" and known):
            return None
        if max(sum(v >= 0 for v in rows[k[0]]) for k in (s, t) if k) < support:
            return None
        if min(made) >= 0 and action not in completes and not known:
            return None
        return action, made, s, t

    def worth(e):
        got = look(*e[:3])
        return (E.ACTIONS.index(got[0]), -sum(v >= 0 for v in got[1]), e) if got else (4, 0, e)

    if order == "structural":
        todo.sort(key=worth)
    done = []
    while todo:
        if order == "dynamic":
            todo.sort(key=worth)
        e = todo.pop(0)
        if sum(r[e[0]] == e[1] and r[e[0] + 1] == e[2] for r in rows) > e[3] or (limit is not None and len(done) >= limit):
            continue
        got = look(*e[:3])
        if got:
            action, made, s, t = got
            rows[(s or t)[0]] = made
            if s and t:
                del rows[t[0]]
            done.append((*e, action))
    return Counter(tuple(r) for r in rows), Counter(done)


def fragments(seed, subjects=4, people=7, n=N):
    """True tracks, broken up with losses and swaps as a prediction, and with some swaps as a teacher."""
    rnd = random.Random(seed)
    predicted, teacher = {}, {}
    for k in range(subjects):
        rows, lines = [], []
        for p in range(people):
            true = [10 * p + s for s in range(n)]
            cut = rnd.randrange(1, n)
            rows += [[x if i < cut and rnd.random() < 0.85 else -1 for i, x in enumerate(true)], [x if i >= cut and rnd.random() < 0.85 else -1 for i, x in enumerate(true)]]
            lines.append([x if rnd.random() < 0.9 else 10 * rnd.randrange(people) + i if rnd.random() < 0.5 else -1 for i, x in enumerate(true)])
        predicted[f"s{k}"] = [r for r in rows if max(r) >= 0] + ([rows[0]] if k == 0 and max(rows[0]) >= 0 else [])
        teacher[f"s{k}"] = lines
    return predicted, teacher


SETTINGS = [{}, {"completes": E.ACTIONS}, {"seed_backfill": True, "completes": ("seed",)}, {"teacher_completes": True}, {"merges": False, "completes": E.ACTIONS}, {"backfill": False}, {"min_support": 2, "completes": E.ACTIONS, "seed_backfill": True}]


@pytest.mark.parametrize("order", E.ORDERS)
def test_rescue_against_whole_matrices(spark, order):
    predicted, teacher = fragments(1)
    tracks, lines = table(spark, predicted).cache(), table(spark, teacher).cache()
    for options in SETTINGS if order == "structural" else SETTINGS[1:4]:
        got, ledger = E.rescue(tracks, lines, N, order=order, **options)
        plain = {("support" if k == "min_support" else k): v for k, v in options.items()}
        want, done = Counter(), Counter()
        for s in predicted:
            rows, applied = rescued(predicted[s], teacher[s], order, **plain)
            want.update({(s, r): c for r, c in rows.items()})
            done.update({(s, *e): c for e, c in applied.items()})
        assert matrix(got) == want, options
        assert Counter((r.subject, r.session_a, r.roi_a, r.roi_b, r.occurrence, r.action) for r in ledger.where("applied").collect()) == done


@pytest.mark.parametrize("order", E.ORDERS)
def test_edit_limits_follow_the_order_across_components(spark, order):
    predicted, teacher = fragments(2)
    for limit in (0, 3) if order == "lexicographic" else (3, 5):
        got, ledger = E.rescue(table(spark, predicted), table(spark, teacher), N, order=order, completes=E.ACTIONS, max_edits=limit)
        want, done = Counter(), Counter()
        for s in predicted:
            rows, applied = rescued(predicted[s], teacher[s], order, completes=E.ACTIONS, limit=limit)
            want.update({(s, r): c for r, c in rows.items()})
            done.update({(s, *e): c for e, c in applied.items()})
        assert matrix(got) == want, limit
        rows = ledger.collect()
        assert Counter((r.subject, r.session_a, r.roi_a, r.roi_b, r.occurrence, r.action) for r in rows if r.applied) == done
        assert limit > 3 or any(r.reason == "edit_limit" for r in rows)


def test_confidence_gates_and_odd_rows(spark):
    tracks = table(spark, {"a": [[1, 2, -1, -1, -1], [7, -1, -1, -1, -1]]})
    teacher = table(spark, {"a": [[-1, 2, 5, -1, -1], [-1, 2, 6, -1, -1]]})
    sure = spark.createDataFrame([("a", 1, 2, 6, 0.9), ("a", 1, 2, 5, float("nan")), ("a", 1, 2, 6, 0.2)], "subject string, session_index int, roi long, roi_b long, confidence double")
    assert matrix(E.rescue(tracks, teacher, N)[0])["a", (1, 2, 5, -1, -1)] == 1
    assert matrix(E.rescue(tracks, teacher, N, confidence=sure)[0])["a", (1, 2, 6, -1, -1)] == 1
    assert matrix(E.rescue(tracks, teacher, N, gate=sure.where("roi_b = 6"))[0])["a", (1, 2, 6, -1, -1)] == 1
    assert matrix(E.rescue(tracks, teacher, N, gate=sure.limit(0))[0]) == matrix(tracks)
    # ids beyond what a float holds stay apart
    far = tracks.withColumn("track_id", F.col("track_id") + F.lit(1 << 60))
    assert {r.track_id for r in E.rescue(far, teacher, N)[0].collect()} == {1 << 60, (1 << 60) + 1}
    odd = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 0, 1), ("a", None, 1, 3), (None, 1, 1, 3), ("a", 2, 1, None), ("a", 3, -1, 3)], TRACK)
    assert matrix(E.rescue(odd, teacher, N)[0]) == {("a", (1, -1, -1, -1, -1)): 1}
    assert E.rescue(tracks.limit(0), teacher, N)[0].count() == 0
    assert matrix(E.rescue(tracks, teacher.limit(0), N)[0]) == matrix(tracks)
    with pytest.raises(ValueError):
        E.rescue(tracks, teacher, N, order="best")


VETO = "subject string, session_a int, session_b int, roi_a long, roi_b long, occurrence int, score double"


def test_vetoes_split_one_after_another(spark):
    tracks = table(spark, {"a": [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10], [1, 2, -1, -1, -1]], "b": [[1, 2, 3, -1, -1]]})
    rows = [("a", 3, 4, 4, 5, 0, 9.0), ("a", 2, 3, 3, 4, 0, 8.0), ("a", 0, 1, 1, 2, 1, 7.0), ("a", 0, 1, 6, 99, 0, 6.0), ("a", 3, 4, 9, 10, None, 5.0), ("b", 0, 1, 1, 2, 0, 1.0)]
    vetoes = spark.createDataFrame(rows, VETO)

    def run(**kw):
        pieces, flags = E.vetoed(tracks, vetoes, [F.desc("score")], N, **kw)
        out = {}
        for r in pieces.collect():
            out.setdefault((r.subject, r.track_id, r.piece), [-1] * N)[r.session_index] = r.roi
        return {k: tuple(v) for k, v in out.items()}, {(r.subject, r.score) for r in flags.where("applied").collect()}

    pieces, applied = run()
    assert applied == {("a", 9.0), ("a", 8.0), ("a", 7.0), ("a", 5.0), ("b", 1.0)}
    assert pieces["a", 0, 0] == (1, 2, 3, -1, -1) and pieces["a", 0, 1] == (-1, -1, -1, 4, -1) and pieces["a", 0, 2] == (-1, -1, -1, -1, 5) and pieces["a", 2, 1] == (-1, 2, -1, -1, -1)
    assert run(complete=True)[1] == {("a", 9.0), ("a", 5.0)}  # what is left of the first is not complete
    assert run(last_session=True)[1] == {("a", 9.0), ("a", 5.0)}
    assert run(terminal=True, min_size=4)[1] == {("a", 9.0), ("a", 8.0), ("a", 5.0)}
    assert run(max_vetoes=1)[1] == {("a", 9.0), ("b", 1.0)}
    assert E.vetoed(tracks, vetoes.limit(0), [F.desc("score")], N)[0].count() == tracks.count()
    assert E.vetoed(tracks.limit(0), vetoes, [F.desc("score")], N)[0].count() == 0


PATH = "subject string, path_id long, track_id long, sessions array<int>, rois array<long>, passes boolean, score double"


def test_suffixes_share_nothing_and_keep_their_order(spark):
    tracks = table(spark, {"a": [[1, 2, 3, -1, -1], [4, 5, 6, -1, -1], [7, 8, -1, -1, -1], [-1, -1, -1, 30, 31]], "b": [[1, 2, 3, -1, -1]]})
    rows = [
        ("a", 1, 0, [3, 4], [10, 11], True, 9.0), ("a", 2, 0, [3, 4], [12, 13], True, 8.0), ("a", 3, 1, [3, 4], [14, 11], True, 7.0), ("a", 4, 1, [3, 4], [16, 17], True, 6.0),
        ("a", 5, 2, [3, 4], [30, 40], True, 9.5), ("a", 6, 2, [2, 3], [41, 42], True, 9.5), ("a", 7, 2, [1, 4], [43, 44], True, 9.5), ("a", 8, 2, [3, 4], [45, 46], False, 9.5), ("a", 9, 9, [3, 4], [47, 48], True, 9.5),
        ("a", 10, 2, [], [], True, 9.9), ("a", 11, 2, [3, 4], [50, 51], None, 9.9), ("b", 1, 0, [3, 4], [10, 11], True, 1.0),
    ]
    paths = spark.createDataFrame(rows, PATH)
    for limit, want in ((1, {("a", 1), ("b", 1)}), (2, {("a", 1), ("a", 4), ("b", 1)}), (9, {("a", 1), ("a", 4), ("b", 1)})):
        out, flags = E.stitched(tracks, paths, [F.desc("score"), F.col("path_id")], N, limit)
        assert {(r.subject, r.path_id) for r in flags.where("selected").collect()} == want
        assert matrix(out)["a", (1, 2, 3, 10, 11)] == 1 and matrix(out)["a", (4, 5, 6, 16, 17)] == (limit > 1)
        assert out.where("added").count() == 2 * len(want)
    assert E.stitched(tracks, paths.limit(0), [F.desc("score")], N)[0].count() == tracks.count()


def test_greedy_choice_of_suffixes_against_plain_python(spark):
    rnd = random.Random(5)
    tracks = table(spark, {"a": [[10 * k + i if i < 3 else -1 for i in range(N)] for k in range(6)]})
    rows = [("a", k, rnd.randrange(6), [3, 4], [rnd.randrange(100, 106), rnd.randrange(200, 206)], True, round(rnd.random(), 6)) for k in range(30)]
    taken, want = set(), set()
    for _, k, t, _, (x, y), _, _ in sorted(rows, key=lambda r: -r[6]):
        cells = {("t", t), (3, x), (4, y)}
        if not cells & taken and len(want) < 4:
            taken |= cells
            want.add(k)
    _, flags = E.stitched(tracks, spark.createDataFrame(rows, PATH), [F.desc("score")], N, 4)
    assert {r.path_id for r in flags.where("selected").collect()} == want
    assert len(list(itertools.combinations(want, 2))) > 0


def configurations(rows, candidates, options, n=N):
    """One subject's sets of edits with their objectives, by splitting whole rows. candidates: (a, b, x, y, score) in order."""
    ranked = sorted(enumerate(candidates), key=lambda t: (-t[1][4], t[0]))[: options["top_k"]]
    sets = []
    for size in range(1, options["max_edits"] + 1):
        for pick in itertools.combinations(range(len(ranked)), size):
            sets.append((round(sum(ranked[i][1][4] for i in pick) - options["edit_penalty"] * size, 9), size, pick))
    sets = sorted(sets, key=lambda t: (-t[0], t[1], t[2]))[: options["most"]]
    out = []
    for _, size, pick in sets:
        now, gain, applied = [list(r) for r in rows], 0.0, 0
        for i in pick:
            a, b, x, y, score = ranked[i][1]
            hit = next((k for k, r in enumerate(now) if r[a] == x and r[b] == y), None)
            if hit is None or (options["complete"] and min(now[hit]) < 0):
                continue
            r = now.pop(hit)
            now += [r[:b] + [-1] * (n - b), [-1] * b + r[b:]]
            gain, applied = gain + score, applied + 1
        short = lambda rs: sum(sum(v >= 0 for v in r) < options["meaningful"] for r in rs)
        whole = lambda rs: sum(min(r) >= 0 for r in rs)
        value = gain - options["edit_penalty"] * applied - options["fragment_penalty"] * max(0, short(now) - short(rows)) - options["completion_penalty"] * max(0, whole(rows) - whole(now))
        out.append((tuple(i + 1 for i in pick), applied, round(value, 9), Counter(tuple(r) for r in now)))
    return out


@pytest.mark.parametrize("complete", [False, True])
def test_best_configuration_against_all_sets(spark, complete):
    rnd = random.Random(8)
    matrices, rows, plain = {}, [], {}
    for k in range(6):
        s = f"s|{k}"
        matrices[s] = [[10 * t + i if rnd.random() < 0.9 else -1 for i in range(N)] for t in range(4)]
        links = [(a, a + 1, r[a], r[a + 1]) for r in matrices[s] for a in range(N - 1) if r[a] >= 0 and r[a + 1] >= 0]
        plain[s] = [(*e, round(rnd.uniform(0.2, 1.6), 3)) for e in rnd.sample(links, 6)] + [(0, 1, 777, 778, 1.55)]
        rows += [(s, *e[:4], 0, e[4], i) for i, e in enumerate(plain[s])]
    options = {"top_k": 5, "max_edits": 3, "most": 12, "edit_penalty": 0.25, "fragment_penalty": 0.5, "completion_penalty": 0.3, "meaningful": 3, "complete": complete}
    candidates = spark.createDataFrame(rows, "subject string, session_a int, session_b int, roi_a long, roi_b long, occurrence int, score double, i int")
    done, sets = E.best_configuration(table(spark, matrices), candidates, [F.col("i")], N, threshold=1.0, **options)
    got = {}
    for r in sets.collect():
        got.setdefault(r.subject, {})[tuple(r.edits)] = r
    want = Counter()
    for s, lines in matrices.items():
        found = configurations(lines, plain[s], options)
        assert {e: (a, v) for e, a, v, _ in found} == {e: (r.n_applied, round(r.objective, 9)) for e, r in got[s].items()}
        best = min(((-v, len(e), e) for e, a, v, _ in found if a and v >= 1.0), default=None)
        assert [e for e, r in got[s].items() if r.chosen] == ([best[2]] if best else [])
        left = next(rows_ for e, _, _, rows_ in found if e == best[2]) if best else Counter(tuple(r) for r in lines if max(r) >= 0)
        want.update({(s, r): c for r, c in left.items() if max(r) >= 0})
    pieces = done.withColumn("track_id", F.xxhash64("subject", "track_id", "piece")).drop("piece")
    assert matrix(pieces) == want


def test_configurations_of_nothing_and_conflicts(spark):
    tracks = table(spark, {"a": [[1, 2, 3, 4, 5]]})
    schema = "subject string, session_a int, session_b int, roi_a long, roi_b long, occurrence int, score double, conflict array<string>"
    rows = [("a", 1, 2, 2, 3, 0, 2.0, ["p"]), ("a", 3, 4, 4, 5, 0, 1.9, ["p"]), ("a", 0, 1, 1, 2, 0, 1.8, None)]
    sets = {tuple(r.edits) for r in E.hypotheses(spark.createDataFrame(rows, schema), [F.col("session_a")]).collect()}
    assert sets == {(1,), (2,), (3,), (1, 3), (2, 3)}
    done, found = E.best_configuration(tracks, spark.createDataFrame([], schema), [F.col("session_a")], N)
    assert done.count() == 5 and found.count() == 0
    assert E.best_configuration(tracks.limit(0), spark.createDataFrame(rows, schema), [F.col("session_a")], N)[1].where("chosen").count() == 0


def test_rescue_takes_many_components_at_once(spark, monkeypatch):
    monkeypatch.setattr(E, "GROUP", 50)
    row = "subject string, track_id long, session_index int, roi long"
    # 40 subjects of a seed and its follower, which a teacher joins, and a lone track
    own = [(f"s{i}", k, s, r) for i in range(40) for k, s, r in ((1, 0, 10 * i), (2, 1, 10 * i + 1), (3, 1, 10 * i + 2))]
    teacher = [(f"s{i}", 9, s, 10 * i + s) for i in range(40) for s in (0, 1)]
    out, ledger = E.rescue(spark.createDataFrame(own, row), spark.createDataFrame(teacher, row), 3, order="lexicographic")
    want = {(f"s{i}", k, s, r) for i in range(40) for k, s, r in ((1, 0, 10 * i), (1, 1, 10 * i + 1), (3, 1, 10 * i + 2))}
    assert {tuple(r) for r in out.collect()} == want
    assert ledger.where("applied").count() == 40
