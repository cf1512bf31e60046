"""Repairs applied to tracks that change under them: rescue by a teacher's links, vetoes that split, suffixes that are stitched on.

An edit depends on those made before it, but only on those that touch the same tracks. Rescues are therefore applied by component of
tracks and teacher's links, vetoes by track, and what limits the edits of a subject is worked out from the order in which components would have
taken their turns. Gates on features are columns that the caller's rows already carry or that cleanup makes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.operators.graph import components
from longitrack.session import ship, written

ORDERS = ("lexicographic", "structural", "dynamic")
#: What an edit does, in the order of its worth: a seed found for a track, two fragments merged, a source or a target added.
ACTIONS = ("seed", "merge", "backfill", "extend")

_TRACK = "subject string, track_id long, session_index int, roi long"
_LEDGER = "session_b int, roi_b long, occurrence int, applied boolean, action string, reason string, turn array<double>"
#: Rows that a task rescues at once, about: whole components.
GROUP = 20_000


class _Forest:
    """The tracks of one component as they change."""

    def __init__(self, rows, n_sessions: int, seed: int, whole: set, options: dict):
        self.rows: dict[int, dict[int, int]] = {}
        self.at: dict[tuple[int, int], set[int]] = {}
        for track, session, roi in rows:
            self.rows.setdefault(track, {})[session] = roi
            self.at.setdefault((session, roi), set()).add(track)
        self.n, self.seed, self.whole, self.options = n_sessions, seed, whole, options

    def count(self, a: int, x: int, y: int) -> int:
        return len(self.at.get((a, x), set()) & self.at.get((a + 1, y), set()))

    def _finishes(self, row: dict, action: str) -> bool:
        """Whether an edit would complete a track that it may not complete."""
        if len(row) < self.n or action in self.options["completes"]:
            return False
        return not (self.options["teacher_completes"] and tuple(row[s] for s in range(self.n)) in self.whole)

    def plan(self, a: int, x: int, y: int) -> tuple[str | None, str, dict | None, tuple]:
        """(action, reason, the row it makes, (track that takes it, track that goes)); no action if it is refused."""
        source, target = self.at.get((a, x), set()), self.at.get((a + 1, y), set())
        no = lambda why: (None, why, None, ())
        if len(source) > 1:
            return no("ambiguous_source")
        if len(target) > 1:
            return no("ambiguous_target")
        s, t = next(iter(source), None), next(iter(target), None)
        if s is None and t is None:
            return no("missing_source")
        if s == t:
            return no("already_same_component")
        if s is not None and a + 1 in self.rows[s]:
            return no("source_has_target")
        if t is not None and a in self.rows[t]:
            return no("target_has_source")
        supported = max(len(self.rows[k]) for k in (s, t) if k is not None) >= self.options["min_support"]
        if s is not None and t is not None:
            if not self.options["merges"]:
                return no("target_already_claimed")
            if any(self.rows[s][k] != v for k, v in self.rows[t].items() if k in self.rows[s]):
                return no("merge_conflict")
            made, action, takes = self.rows[s] | self.rows[t], "merge", (s, t)
        elif t is None:
            made, action, takes = self.rows[s] | {a + 1: y}, "extend", (s, None)
        else:
            made, takes = self.rows[t] | {a: x}, (t, None)
            action = "seed" if a == self.seed and self.options["seed_backfill"] else "backfill"
            if action == "backfill" and not self.options["backfill"]:
                return no("missing_source")
        confirmed = self.options["teacher_completes"] and len(made) == self.n and tuple(made[k] for k in range(self.n)) in self.whole
        anchored = self.seed in (made if action in ("merge", "seed") else self.rows[takes[0]])
        if not anchored and not (action == "backfill" and confirmed):
            return no("not_seed_anchored")
        if not supported:
            return no("insufficient_support")
        if self._finishes(made, action):
            return no("would_complete_track")
        return action, "accepted", made, takes

    def key(self, edge) -> tuple:
        """Lower keys come first: the action's worth, confidence, then what the row it makes holds."""
        a, x, y, occurrence, confidence = edge
        action, _, made, _ = self.plan(a, x, y)
        rank = ACTIONS.index(action) if action else len(ACTIONS)
        return (float(rank), -confidence if self.options["by_confidence"] else 0.0, -float(len(made) if made else 0), float(a), float(x), float(y), float(occurrence))

    def apply(self, made: dict, takes: tuple) -> None:
        keeps, goes = takes
        for track in (k for k in takes if k is not None):
            for cell in self.rows[track].items():
                self.at[cell].discard(track)
        if goes is not None:
            del self.rows[goes]
        self.rows[keeps] = made
        for cell in made.items():
            self.at.setdefault(cell, set()).add(keeps)


def _rescue_rows(g: pd.DataFrame, n_sessions: int, seed: int, order: str, options: dict) -> list[tuple]:
    """One component's rows (kinds track, edge, whole) to what its tracks hold and a ledger of the edges."""
    kind = g["kind"].to_numpy()
    tracks, edges, whole = (g[kind == k] for k in ("track", "edge", "whole"))
    forest = _Forest(zip(tracks["track_id"], tracks["session_index"], tracks["roi"], strict=True), n_sessions, seed, {tuple(map(int, i.split(","))) for i in whole["identity"]}, options)
    todo = [(int(a), int(x), int(y), k, float(c)) for a, x, y, n, c in zip(edges["session_index"], edges["roi"], edges["roi_b"], edges["n"], edges["confidence"], strict=True) for k in range(int(n))]
    last = g["last"].iloc[0]  # the turn of the subject's last edit, if they are limited
    first = (lambda e: tuple(map(float, e[:4]))) if order == "lexicographic" else forest.key
    turns = sorted((first(e), e) for e in todo)
    turn, log = (), []
    while turns:
        if order == "dynamic":
            turns = sorted((forest.key(e), e) for _, e in turns)
        key, edge = turns.pop(0)
        a, x, y, occurrence, _ = edge
        if forest.count(a, x, y) > occurrence:
            continue
        action, reason, made, takes = forest.plan(a, x, y)
        turn = max(turn, key)  # after all that stood before it in its component
        if action and last is not None and (*turn, a, x, y, occurrence) > tuple(last):
            action, reason = None, "edit_limit"
        if action:
            forest.apply(made, takes)
        log.append((a, x, a + 1, y, occurrence, action is not None, action, reason, list(turn)))
    subject = g["subject"].iloc[0]
    out = [("track", subject, k, s, r, *[None] * 7) for k, row in forest.rows.items() for s, r in row.items()]
    return out + [("edge", subject, None, *row) for row in log]


def _typed(tracks: DataFrame) -> DataFrame:
    c = F.col
    return tracks.select(c("subject").cast("string").alias("subject"), c("track_id").cast("long").alias("track_id"), c("session_index").cast("int").alias("session_index"), c("roi").cast("long").alias("roi")).where("subject IS NOT NULL AND track_id IS NOT NULL AND session_index >= 0 AND roi >= 0").distinct()


def teacher_edges(teacher: DataFrame) -> DataFrame:
    """(subject, session_index, roi, roi_b, n): the links between consecutive sessions of a teacher's tracks, and how many tracks have each."""
    by = Window.partitionBy("subject", "track_id").orderBy("session_index")
    t = _typed(teacher).withColumn("_next", F.lead("session_index").over(by)).withColumn("roi_b", F.lead("roi").over(by))
    return t.where("_next = session_index + 1").groupBy("subject", "session_index", "roi", "roi_b").agg(F.count(F.lit(1)).cast("int").alias("n"))


def rescue(tracks: DataFrame, teacher: DataFrame, n_sessions: int, seed_session: int = 0, order: str = "structural", confidence: DataFrame | None = None, gate: DataFrame | None = None, backfill: bool = True, seed_backfill: bool = False, merges: bool = True, completes: tuple[str, ...] = (), teacher_completes: bool = False, min_support: int = 1, max_edits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Tracks with a teacher's links added where nothing speaks against it, and a ledger of the links that were tried.

    tracks and teacher: (subject, track_id, session_index, roi), one roi a track and session. A link adds its target or its source to the track that has the
    other end, or merges two tracks that agree wherever both have a roi; a merged track keeps the source's id. It is refused where an end is in two tracks or the track has another roi there, where the track would
    not hold the seed session, has fewer than min_support observations, or would become complete, unless its action is in `completes` or
    the teacher has that complete track and teacher_completes is set. seed_backfill lets a link from the seed session give a track its seed.

    Links are tried by session and ids (`lexicographic`), by the worth of what they would do at first (`structural`), or by that as it is
    after each edit (`dynamic`). confidence: (subject, session_index, roi, roi_b, confidence), higher first among links of equal worth. gate: links
    (subject, session_index, roi, roi_b) that may be tried, all without. max_edits bounds the edits of a subject to the first of them in the order of
    their turns. Repeated rows count once, rows without ids take no part. A ledger's `turn` is the key by which components of a subject are interleaved.
    """
    ship(tracks.sparkSession)
    if order not in ORDERS or set(completes) - set(ACTIONS) or min_support < 1 or (max_edits is not None and max_edits < 0):
        raise ValueError(f"order is one of {ORDERS}, completes some of {ACTIONS}, min_support positive and max_edits not negative")
    link = ["subject", "session_index", "roi", "roi_b"]
    options = {"backfill": backfill, "seed_backfill": seed_backfill, "merges": merges, "completes": set(completes), "teacher_completes": teacher_completes, "min_support": min_support, "by_confidence": confidence is not None}
    own, edges = _typed(tracks), teacher_edges(teacher)
    if gate is not None:
        edges = edges.join(gate.withColumn("subject", F.col("subject").cast("string")).select(*link).distinct(), link, "left_semi")
    if confidence is None:
        edges = edges.withColumn("confidence", F.lit(0.0))
    else:
        sure = confidence.withColumn("subject", F.col("subject").cast("string")).groupBy(*link).agg(F.max(F.col("confidence").cast("double")).alias("confidence"))
        edges = edges.join(sure, link, "left").withColumn("confidence", F.when(F.col("confidence").isNull() | F.isnan("confidence"), float("-inf")).otherwise(F.col("confidence")))
    full = _typed(teacher).where(F.col("session_index") < n_sessions).groupBy("subject", "track_id").agg(F.sort_array(F.collect_list(F.struct("session_index", "roi"))).alias("r")).where(F.size("r") == n_sessions)
    full = full.select("subject", F.lit(0).alias("session_index"), F.get("r", 0)["roi"].alias("roi"), F.array_join(F.transform("r", lambda x: x["roi"].cast("string")), ",").alias("identity")).distinct()

    cell = lambda s, r: F.xxhash64(F.lit("cell"), "subject", s, r)
    # zeros, not nulls: pandas would take longs with nulls for floats
    missing = {"track_id": F.lit(0).cast("long"), "roi_b": F.lit(0).cast("long"), "n": F.lit(0), "confidence": F.lit(0.0), "identity": F.lit("")}
    shape = lambda df, kind, node: df.select(F.lit(kind).alias("kind"), "subject", "session_index", "roi", *(F.col(c) if c in df.columns else v.alias(c) for c, v in missing.items()), node.alias("node"))
    at = cell("session_index", "roi")
    rows = shape(own, "track", at).unionByName(shape(edges, "edge", at)).unionByName(shape(full, "whole", at))
    rows = written(rows, "forest")
    bonds = own.select(F.xxhash64(F.lit("track"), "subject", "track_id").alias("a"), at.alias("b")).unionByName(edges.select(at.alias("a"), cell(F.col("session_index") + 1, "roi_b").alias("b"))).unionByName(rows.select(F.col("node").alias("a"), F.col("node").alias("b")))
    part = components(bonds)
    placed = written(rows.join(part, "node"), "forest-parts")
    schema = f"kind string, {_TRACK}, {_LEDGER}"
    names = ["kind", "subject", "track_id", "session_index", "roi", "session_b", "roi_b", "occurrence", "applied", "action", "reason", "turn"]

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        out = [row for _, c in g.groupby("component") for row in _rescue_rows(c, n_sessions, seed_session, order, options)]
        return pd.DataFrame(out, columns=names, dtype=object)

    # most components are a track or two, so that a group takes many of them
    groups = max(int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed.count() // GROUP)
    bucket = F.pmod(F.xxhash64("component"), F.lit(groups))
    run = lambda df: written(df.withColumn("_bucket", bucket).repartition(groups, "_bucket").groupBy("_bucket").applyInPandas(solve, schema), "rescued")
    done = run(placed.withColumn("last", F.lit(None).cast("array<double>")))
    if max_edits is not None:
        # up to its last edit a limited run is the same as an unlimited one
        turn = F.concat("turn", F.array(*(F.col(c).cast("double") for c in ("session_index", "roi", "roi_b", "occurrence"))))
        applied = done.where("kind = 'edge' AND applied").select("subject", turn.alias("last"))
        ranked = applied.withColumn("k", F.row_number().over(Window.partitionBy("subject").orderBy("last")))
        limits = ranked.groupBy("subject").agg(F.max("k").alias("n"), F.max(F.when(F.col("k") <= max_edits, F.struct("k", "last")))["last"].alias("last")).where(F.col("n") > max_edits)
        done = run(placed.join(limits.select("subject", F.coalesce("last", F.array().cast("array<double>")).alias("last")), "subject", "left"))
    columns = ["subject", "track_id", "session_index", "roi"]
    ledger = done.where("kind = 'edge'").select("subject", F.col("session_index").alias("session_a"), "session_b", F.col("roi").alias("roi_a"), "roi_b", "occurrence", "applied", "action", "reason", "turn")
    return done.where("kind = 'track'").select(*columns), ledger


def vetoed(tracks: DataFrame, vetoes: DataFrame, order: list[Column], n_sessions: int, max_vetoes: int | None = None, terminal: bool = False, last_session: bool = False, complete: bool = False, min_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Tracks split at vetoed links as (subject, track_id, piece, session_index, roi), and the vetoes with `applied`.

    vetoes: (subject, session_a, session_b, roi_a, roi_b, occurrence, ...), in an explicit order; of a link in several tracks the
    occurrence-th track by id is meant, from 0. The first max_vetoes of a subject are tried. Each must hold for the track as earlier ones leave it: terminal: nothing in the session
    before or after the link; last_session: the link ends in the last session; complete: the piece has all sessions; min_size: it has so many. Pieces are numbered
    from the first session on.
    """
    ship(tracks.sparkSession)
    own = _typed(tracks)
    v = vetoes.withColumn("subject", F.col("subject").cast("string")).withColumn("_k", F.row_number().over(Window.partitionBy("subject").orderBy(*order)))
    tried = v if max_vetoes is None else v.where(F.col("_k") <= max_vetoes)
    a = own.select("subject", "track_id", F.col("session_index").alias("session_a"), F.col("roi").alias("roi_a"))
    b = own.select("subject", "track_id", F.col("session_index").alias("session_b"), F.col("roi").alias("roi_b"))
    edge = ["subject", "session_a", "session_b", "roi_a", "roi_b"]
    met = tried.select(*edge, "occurrence", "_k").join(a, ["subject", "session_a", "roi_a"]).join(b, ["subject", "track_id", "session_b", "roi_b"])
    nth = F.row_number().over(Window.partitionBy("_k", *edge).orderBy("track_id")) - 1
    aimed = written(met.withColumn("_nth", nth).where(F.col("_nth") == F.coalesce("occurrence", F.lit(0))).select("subject", "track_id", "session_a", "session_b", "_k"), "aimed")

    def cut(t: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        if t.empty:
            return pd.DataFrame({"subject": [], "track_id": [], "_k": [], "session_b": []})
        pieces, out = [sorted(t["session_index"])], []
        for x in w.sort_values("_k").itertuples(index=False):
            k = next((i for i, p in enumerate(pieces) if x.session_a in p and x.session_b in p), None)
            if k is None:
                continue
            p = pieces[k]
            ok = not last_session or x.session_b == n_sessions - 1
            ok = ok and (not complete or len(p) >= n_sessions) and (min_size is None or len(p) >= min_size)
            ok = ok and (not terminal or x.session_a - 1 not in p or x.session_b + 1 not in p)
            if ok:
                pieces[k : k + 1] = [[s for s in p if s < x.session_b], [s for s in p if s >= x.session_b]]
                out.append((t["subject"].iloc[0], t["track_id"].iloc[0], x[4], x.session_b))
        return pd.DataFrame(out, columns=["subject", "track_id", "_k", "session_b"])

    touched = own.join(aimed.select("subject", "track_id").distinct(), ["subject", "track_id"], "left_semi")
    hits = aimed.select(F.col("subject").alias("s"), F.col("track_id").alias("t"), "session_a", "session_b", "_k")
    cuts = written(touched.groupBy("subject", "track_id").cogroup(hits.groupBy("s", "t")).applyInPandas(cut, "subject string, track_id long, _k int, session_b int"), "cuts")
    marks = cuts.select("subject", "track_id", F.col("session_b").alias("session_index"), F.lit(1).alias("_cut")).distinct()
    running = Window.partitionBy("subject", "track_id").orderBy("session_index")
    pieces = own.join(marks, ["subject", "track_id", "session_index"], "left").withColumn("piece", F.sum(F.coalesce("_cut", F.lit(0))).over(running)).select("subject", "track_id", "piece", "session_index", "roi")
    flags = v.join(cuts.select("subject", "_k", F.lit(True).alias("applied")), ["subject", "_k"], "left").withColumn("applied", F.coalesce("applied", F.lit(False))).drop("_k")
    return pieces, flags


def stitched(tracks: DataFrame, paths: DataFrame, order: list[Column], n_sessions: int, max_stitches: int = 1) -> tuple[DataFrame, DataFrame]:
    """Tracks with suffixes added, and the suffixes with `selected`.

    paths: (subject, path_id, track_id, sessions array<int>, rois array<long>, passes boolean, ...): what a suffix adds to a track, in
    order. One may be selected if it passes, reaches the last session, starts after the track's own end and uses no roi that any track of the subject has. In an explicit order, those are
    taken that share neither track nor roi with one taken before, up to max_stitches of a subject.
    """
    own = _typed(tracks)
    key = ["subject", "path_id"]
    typed = written(paths.withColumn("subject", F.col("subject").cast("string")).withColumn("track_id", F.col("track_id").cast("long")), "suffix-paths")
    steps = typed.select(*key, "track_id", "rois", F.posexplode("sessions").alias("_i", "session_index")).select(*key, "track_id", F.col("session_index").cast("int").alias("session_index"), F.get("rois", F.col("_i")).cast("long").alias("roi"))
    used = steps.join(own.select("subject", "session_index", "roi").distinct(), ["subject", "session_index", "roi"], "left_semi").select(*key).distinct()
    last = own.groupBy("subject", "track_id").agg(F.max("session_index").alias("_last"))
    ok = F.coalesce("passes", F.lit(False)) & (F.size("sessions") > 0) & (F.element_at("sessions", -1) == n_sessions - 1) & (F.get("sessions", 0) > F.col("_last"))
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(*order))
    able = written(typed.join(last, ["subject", "track_id"]).where(F.size("sessions") > 0).where(ok).join(used, key, "left_anti").withColumn("_k", rank), "suffixes")
    # a turn takes what no earlier suffix of the subject conflicts with among those that are left; at most max_stitches turns
    held = steps.join(able.select(*key, "_k"), key)
    cells = held.select("subject", "_k", F.concat_ws(":", F.lit("cell"), "session_index", "roi").alias("cell"))
    cells = written(cells.unionByName(able.select("subject", "_k", F.concat_ws(":", F.lit("track"), "track_id").alias("cell"))).distinct(), "suffix-cells")
    taken = able.select("subject", "_k").limit(0)
    left = able.select("subject", "_k")
    for _ in range(max_stitches):
        first = left.groupBy("subject").agg(F.min("_k").alias("_k"))
        if first.isEmpty():
            break
        taken = written(taken.unionByName(first), "taken")
        blocked = cells.join(first, ["subject", "_k"], "left_semi").select("subject", "cell").distinct().join(cells, ["subject", "cell"]).select("subject", "_k").distinct()
        left = written(left.join(blocked, ["subject", "_k"], "left_anti"), "left")
    picked = able.join(taken, ["subject", "_k"], "left_semi").select(*key)
    new = steps.join(picked, key, "left_semi").select("subject", "track_id", "session_index", "roi")
    flags = typed.join(picked.withColumn("selected", F.lit(True)), key, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    return own.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True))), flags


#: Fixed values of the choice among hypotheses: candidates of a subject, edits of a hypothesis, hypotheses of a subject, and what edits and short pieces cost.
CANDIDATES, EDITS, HYPOTHESES = 4, 2, 16
EDIT_PENALTY, FRAGMENT_PENALTY, SCORE_THRESHOLD, MEANINGFUL = 0.25, 0.5, 1.0, 2


def hypotheses(candidates: DataFrame, order: list[Column], top_k: int = CANDIDATES, max_edits: int = EDITS, most: int = HYPOTHESES, penalty: float = EDIT_PENALTY) -> DataFrame:
    """(subject, edits array<int>, total): sets of a subject's top_k candidates, up to max_edits in each, the `most` of the greatest total score less penalties.

    candidates: (subject, score, ...), and `conflict` as an array of strings, if some can't be made together: those that share one. An edit is named by its place, from 1, by descending score
    and then the explicit order. Equal totals go to fewer edits, then to those that come first.
    """
    k = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("score"), *order))
    held = F.col("conflict") if "conflict" in candidates.columns else F.array().cast("array<string>")
    ranked = candidates.withColumn("subject", F.col("subject").cast("string")).withColumn("k", k).where(F.col("k") <= top_k).select("subject", "k", "score", F.coalesce(held, F.array().cast("array<string>")).alias("held"))
    now = ranked.select("subject", F.array("k").alias("edits"), F.col("score").cast("double").alias("total"), "held")
    out = now
    more = ranked.withColumnsRenamed({"held": "also", "score": "gain"})
    for _ in range(max_edits - 1):  # top_k ^ max_edits sets of a subject at most
        now = now.join(more, "subject").where((F.col("k") > F.element_at("edits", -1)) & ~F.arrays_overlap("held", "also"))
        now = now.select("subject", F.concat("edits", F.array("k")).alias("edits"), (F.col("total") + F.col("gain")).alias("total"), F.concat("held", "also").alias("held"))
        out = out.unionByName(now)
    value = F.round(F.col("total") - penalty * F.size("edits"), 9)
    first = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc(value), F.size("edits"), "edits"))
    return out.withColumn("_n", first).where(F.col("_n") <= most).select("subject", "edits", "total")


def best_configuration(tracks: DataFrame, candidates: DataFrame, order: list[Column], n_sessions: int, top_k: int = CANDIDATES, max_edits: int = EDITS, most: int = HYPOTHESES, edit_penalty: float = EDIT_PENALTY, fragment_penalty: float = FRAGMENT_PENALTY, completion_penalty: float = 0.0, meaningful: int = MEANINGFUL, threshold: float = SCORE_THRESHOLD, **gates) -> tuple[DataFrame, DataFrame]:
    """Tracks split by the set of edits that leaves each subject's tracks best, and every set with its objective and `chosen`.

    candidates: links to split at, (subject, session_a, session_b, roi_a, roi_b, occurrence, score), and `conflict` as for hypotheses. Each set is applied to the tracks by itself, under the gates of
    vetoed(). Its objective is the scores of what applied, less a penalty for each edit, for each piece of fewer than `meaningful` observations more than before, and for
    each complete track lost. The greatest objective is chosen if it reaches the threshold; ties go to fewer edits. Sets of which nothing applies are never chosen.
    """
    own = written(_typed(tracks), "tracks")
    c = candidates.withColumn("subject", F.col("subject").cast("string"))
    names = ["session_a", "session_b", "roi_a", "roi_b", "occurrence"]
    placed = c.withColumn("k", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("score"), *order))).where(F.col("k") <= top_k)
    placed = written(placed.select("subject", "k", "score", *names), "candidates")
    sets = hypotheses(c, order, top_k, max_edits, most, edit_penalty).withColumn("key", F.concat_ws("|", F.array_join(F.transform("edits", lambda x: x.cast("string")), ","), "subject"))
    sets = written(sets, "hypotheses")
    # only tracks that hold a candidate's link change: others are the same under every set
    ends = own.select("subject", "track_id", F.col("session_index").alias("session_a"), F.col("roi").alias("roi_a"))
    hit = ends.join(placed.select("subject", "session_a", "roi_a").distinct(), ["subject", "session_a", "roi_a"], "left_semi").select("subject", "track_id").distinct()
    some = own.join(hit, ["subject", "track_id"], "left_semi")
    copies = some.join(sets.select("subject", "key"), "subject").select(F.col("key").alias("subject"), "track_id", "session_index", "roi")
    each = sets.select("key", "subject", F.explode("edits").alias("k")).join(placed, ["subject", "k"])
    pieces, flags = vetoed(copies, each.select(F.col("key").alias("subject"), "k", "score", *names), [F.col("k")], n_sessions, **gates)
    short = lambda n: F.count_if(F.col("n") < n)
    size = pieces.groupBy("subject", "track_id", "piece").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("subject").alias("key")).agg(short(meaningful).alias("short_after"), F.count_if(F.col("n") >= n_sessions).alias("complete_after"))
    base = some.groupBy("subject", "track_id").agg(F.count(F.lit(1)).alias("n")).groupBy("subject").agg(short(meaningful).alias("short_before"), F.count_if(F.col("n") >= n_sessions).alias("complete_before"))
    gain = flags.groupBy(F.col("subject").alias("key")).agg(F.count_if("applied").alias("n_applied"), F.coalesce(F.sum(F.when(F.col("applied"), F.col("score"))), F.lit(0.0)).alias("benefit"))
    scored = sets.join(gain, "key", "left").join(size, "key", "left").join(base, "subject", "left").na.fill(0)
    new, lost = F.greatest(F.col("short_after") - F.col("short_before"), F.lit(0)), F.greatest(F.col("complete_before") - F.col("complete_after"), F.lit(0))
    objective = F.col("benefit") - edit_penalty * F.col("n_applied") - fragment_penalty * new - completion_penalty * lost
    scored = scored.withColumns({"objective": objective, "new_short": new, "lost_complete": lost})
    able = (F.col("n_applied") > 0) & (F.round("objective", 9) >= threshold)
    first = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc(able), F.desc(F.round("objective", 9)), F.size("edits"), "edits"))
    scored = written(scored.withColumn("chosen", able & (first == 1)).select("subject", "edits", "total", "n_applied", "new_short", "lost_complete", "objective", "chosen"), "objectives")
    take = scored.where("chosen").select("subject", F.explode("edits").alias("k")).join(placed, ["subject", "k"])
    done, _ = vetoed(own, take.select("subject", "k", *names), [F.col("k")], n_sessions, **gates)
    return done, scored
