"""Distances between all points of two sessions, in blocks: a task holds two blocks of points and their distances,
and gives on only what is asked of each line (a row or a column of an edge): its least cells and a sum over it.

points: (session, roi, vector). A cell whose distance is not finite or not admissible is not there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.functions import INADMISSIBLE
from longitrack.session import ship, written

EDGE = ["session_a", "session_b"]
#: Points in a block, about; their distances are a few times 32 MB in a task.
BLOCK = 2048
#: Bins of a unit of distance in the search for a quantile.
BINS = 1024
_BLOCKS = [*EDGE, "_d", "_ba", "_bb"]


def _distances(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Summed one component after the other, as SQL does, so that equal pairs tie; inadmissible ones are infinite."""
    x, y = (np.stack(s["vector"].to_numpy()).astype(float) for s in (a, b))
    out, across, spare = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T), np.empty((32, len(y)))
    for i in range(0, len(x), 32):
        part, row = out[i : i + 32], x[i : i + 32]
        d = spare[: len(part)]
        for k in range(x.shape[1]):
            np.subtract(row[:, k, None], across[k], out=d)
            d *= d
            part += d
    np.sqrt(out, out=out)
    out[~(out < INADMISSIBLE)] = np.inf
    return out


def in_blocks(points: DataFrame, gap: int, reduce: Callable, schema: str, row_wants: DataFrame | None = None, column_wants: DataFrame | None = None, of_edge: DataFrame | None = None, block: int | None = 0) -> DataFrame:
    """(session_a, session_b, ...) of reduce(a, b, distances) for every two blocks of sessions up to `gap` apart; block None takes sessions whole.

    a and b are frames (roi, vector) in order of roi; row_wants (edge, roi_a, ...), column_wants (edge, roi_b, ...)
    and of_edge (edge, ...) add columns to a, to b and to a.
    """
    ship(points.sparkSession)
    p = points.where(F.col("session").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull())).withColumn("_d", F.size("vector"))
    n = p.groupBy("session", "_d").agg((F.lit(1) if block is None else F.ceil(F.count(F.lit(1)) / (block or BLOCK)).cast("int")).alias("_n"))
    p = p.join(n, ["session", "_d"]).withColumn("_at", F.pmod(F.xxhash64("roi"), F.col("_n")).cast("int")).drop("_n")

    def side(mine: str, other: str, step: int, wants: DataFrame | None) -> DataFrame:
        out = p.withColumnsRenamed({"session": f"session_{mine}", "_at": f"_b{mine}"})
        out = out.withColumn(f"session_{other}", F.explode(F.array(*((F.col(f"session_{mine}") + step * g).cast(points.schema["session"].dataType) for g in range(1, gap + 1)))))
        out = out.join(n.withColumnRenamed("session", f"session_{other}"), [f"session_{other}", "_d"])
        if wants is not None:
            out = out.join(wants.withColumnRenamed(f"roi_{mine}", "roi"), [*EDGE, "roi"], "left")
        if of_edge is not None and mine == "a":
            out = out.join(of_edge, EDGE)
        out = out.withColumn(f"_b{other}", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        return out.toDF(*out.columns)  # columns of its own: both sides come from the same points

    def solve(key, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[f.strip().split()[0] for f in f"session_a x,session_b x,{schema}".split(",")])
        a, b = a.sort_values("roi", ignore_index=True), b.sort_values("roi", ignore_index=True)
        out = reduce(a, b, _distances(a, b))
        out.insert(0, "session_a", key[0])
        out.insert(1, "session_b", key[1])
        return out

    kind = points.schema["session"].dataType.simpleString()
    a, b = side("a", "b", 1, row_wants), side("b", "a", -1, column_wants)
    return a.groupBy(*_BLOCKS).cogroup(b.groupBy(*_BLOCKS)).applyInPandas(solve, f"session_a {kind}, session_b {kind}, {schema}")


def _least(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells of each row up to its k-th least, ties included, without infinite ones."""
    limit = np.partition(c, k - 1, axis=1)[:, k - 1] if k < c.shape[1] else np.full(len(c), np.inf)
    return np.nonzero((c <= limit[:, None]) & (c < np.inf))


def nearest(points: DataFrame, gap: int, k: int, sides: tuple[str, ...] = ("row", "column"), total: Callable | None = None, also: Callable | None = None, temperature: float | None = None) -> DataFrame:
    """(edge, roi_a, roi_b, cost, side, total): of each line of each side the cells up to its k-th least, ties included.

    total(distances) gives a number for each row of a block, which are summed over a line; with a temperature, total is
    the logarithm of the line's sum of exp(-distance / temperature).
    also(a, b, distances) marks cells that are given on besides, once, on the side "more".
    """

    def log_sums(m):
        low = np.where(np.isfinite(m.min(1)), m.min(1), 0.0)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(-(m - low[:, None]) / temperature).sum(1)) - low / temperature

    of_rows = total if temperature is None else log_sums

    def reduce(a, b, c):
        parts = []
        ids = a["roi"].to_numpy(), b["roi"].to_numpy()
        for name in sides:
            m = c if name == "row" else np.ascontiguousarray(c.T)
            i, j = _least(m, k)
            sums = np.full(len(i), np.nan)
            if of_rows is not None and len(i):
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                sums[first] = of_rows(m)[i[first]]
            x, y = (i, j) if name == "row" else (j, i)
            parts.append(pd.DataFrame({"roi_a": ids[0][x], "roi_b": ids[1][y], "cost": m[i, j], "side": name, "total": sums}))
        if also is not None:
            x, y = np.nonzero(also(*ids, c) & (c < np.inf))
            parts.append(pd.DataFrame({"roi_a": ids[0][x], "roi_b": ids[1][y], "cost": c[x, y], "side": "more", "total": np.nan}))
        return pd.concat(parts, ignore_index=True)

    found = in_blocks(points, gap, reduce, "roi_a long, roi_b long, cost double, side string, total double")
    by = Window.partitionBy("side", *EDGE, _line())
    found = found.withColumn("total", F.nanvl("total", F.lit(None)))
    if temperature is not None:
        most = F.max("total").over(by)
        found = found.withColumn("_m", most).withColumn("total", F.exp(F.col("total") - F.col("_m")))
    whole = F.sum("total").over(by)
    found = found.withColumn("_k", F.rank().over(by.orderBy("cost"))).withColumn("total", whole if temperature is None else F.log(whole) + F.col("_m")).drop("_m")
    return found.where((F.col("_k") <= k) | (F.col("side") == "more")).drop("_k")


def _line() -> Column:
    return F.when(F.col("side") == "column", F.col("roi_b")).otherwise(F.col("roi_a"))


def ordered(found: DataFrame, k: int) -> DataFrame:
    """The first k cells of each line of nearest(), ties by id, with their place."""
    by = Window.partitionBy("side", *EDGE, _line()).orderBy("cost", F.when(F.col("side") == "column", F.col("roi_a")).otherwise(F.col("roi_b")))
    return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def ranked(points: DataFrame, k: int) -> DataFrame:
    """What pairs.ranks() says of the cells of consecutive sessions that are among the first k of their row or column; k at least 2."""
    top = written(ordered(nearest(points, 1, k), k), "nearest")
    cells = top.select(*EDGE, "roi_a", "roi_b", "cost").distinct()

    def wants(mine, other):
        return cells.groupBy(*EDGE, mine).agg(F.collect_list(F.struct(F.col("cost"), F.col(other).alias("other"))).alias("wants"))

    def before(frame, others, c, name):
        """How many cells of its line in this block come before each wanted one."""
        lists = [(i, w) for i, ws in enumerate(frame["wants"]) if ws is not None for w in ws]
        at = np.array([i for i, _ in lists], int)
        cost, other = np.array([w["cost"] for _, w in lists], float), np.array([w["other"] for _, w in lists], np.int64)
        n = np.zeros(len(lists), np.int64)
        for s in range(0, len(lists), 1024):
            part = c[at[s : s + 1024]]
            v = cost[s : s + 1024, None]
            n[s : s + 1024] = ((part < v) | ((part == v) & (others[None, :] < other[s : s + 1024, None]))).sum(1)
        own = frame["roi"].to_numpy()[at]
        x, y = (own, other) if name == "row" else (other, own)
        return pd.DataFrame({"roi_a": x, "roi_b": y, "row": n if name == "row" else 0, "column": 0 if name == "row" else n})

    def count(a, b, c):
        return pd.concat([before(a, b["roi"].to_numpy(), c, "row"), before(b, a["roi"].to_numpy(), np.ascontiguousarray(c.T), "column")], ignore_index=True)

    places = in_blocks(points, 1, count, "roi_a long, roi_b long, row long, column long", wants("roi_a", "roi_b"), wants("roi_b", "roi_a"))
    places = places.groupBy(*EDGE, "roi_a", "roi_b").agg((F.sum("row") + 1).alias("row_rank"), (F.sum("column") + 1).alias("column_rank"))
    out = cells.join(places, [*EDGE, "roi_a", "roi_b"])
    for name, line in (("row", "roi_a"), ("column", "roi_b")):
        two = top.where(F.col("side") == name).groupBy(*EDGE, line).agg(F.min(F.when(F.col("place") == 1, F.col("cost"))).alias(f"{name}_best"), F.min(F.when(F.col("place") == 2, F.col("cost"))).alias("_second"))
        out = out.join(two, [*EDGE, line]).withColumn(f"{name}_margin", F.when(F.col(f"{name}_rank") == 1, F.col("_second")).otherwise(F.col(f"{name}_best")) - F.col("cost")).drop("_second")
    return out.withColumn("mutual_top1", (F.col("row_rank") == 1) & (F.col("column_rank") == 1))


def lower_quantile(points: DataFrame, q: float) -> DataFrame:
    """(edge, limit): the greatest distance of an edge that is not above its quantile, by counts in bins and the values of one bin."""
    bins = lambda c: np.floor(c * BINS).astype(np.int64)

    def histogram(a, b, c):  # noqa: ARG001
        at, n = np.unique(bins(c[c < np.inf]), return_counts=True)
        return pd.DataFrame({"bin": at, "n": n})

    by = Window.partitionBy(*EDGE)
    h = in_blocks(points, 1, histogram, "bin long, n long").groupBy(*EDGE, "bin").agg(F.sum("n").alias("n"))
    h = h.withColumns({"_to": F.sum("n").over(by.orderBy("bin")), "_lo": F.floor(q * (F.sum("n").over(by) - 1)).cast("long")})
    here = h.where((F.col("_lo") < F.col("_to")) & (F.col("_lo") >= F.col("_to") - F.col("n"))).select(*EDGE, F.col("bin").alias("_bin"), (F.col("_lo") - F.col("_to") + F.col("n")).alias("_left"))
    here = written(here, "bins")

    def values(a, b, c):  # noqa: ARG001
        part = c[c < np.inf]
        v, n = np.unique(part[bins(part) == a["_bin"].iloc[0]], return_counts=True)
        return pd.DataFrame({"cost": v, "n": n})

    v = in_blocks(points, 1, values, "cost double, n long", of_edge=here.select(*EDGE, "_bin")).groupBy(*EDGE, "cost").agg(F.sum("n").alias("n"))
    v = v.withColumn("_to", F.sum("n").over(by.orderBy("cost"))).join(here, EDGE)
    return v.where(F.col("_left") < F.col("_to")).groupBy(*EDGE).agg(F.min("cost").alias("limit"))


def sums(points: DataFrame, gap: int, values: dict[str, Callable], rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(edge, *values): sums of what values' functions (ids of a, ids of b, distances) give for a block, over the cells of known points.

    rows: (edge, roi_a, known) and columns: (edge, roi_b, known).
    """

    def reduce(a, b, c):
        i, j = (s["known"].notna().to_numpy() for s in (a, b))
        c = c[i][:, j]
        ids = a["roi"].to_numpy()[i], b["roi"].to_numpy()[j]
        return pd.DataFrame({n: [float(f(*ids, c))] for n, f in values.items()})

    found = in_blocks(points, gap, reduce, ", ".join(f"{n} double" for n in values), rows, columns)
    return found.groupBy(*EDGE).agg(*(F.sum(n).alias(n) for n in values))


def n_cells(points: DataFrame, gap: int) -> DataFrame:
    """(edge, n_pairs): how many pairs sessions `gap` apart have."""
    n = points.groupBy("session").agg(F.count(F.lit(1)).alias("_n"))
    a = n.select(F.col("session").alias("session_a"), (F.col("session") + gap).cast(points.schema["session"].dataType).alias("session_b"), "_n")
    return a.join(n.select(F.col("session").alias("session_b"), F.col("_n").alias("_m")), "session_b").select(*EDGE, (F.col("_n") * F.col("_m")).alias("n_pairs"))


def all_cells(points: DataFrame, gap: int, yes: Callable | None = None) -> DataFrame:
    """(edge, roi_a, roi_b, cost): every cell, or those that yes(ids of a, ids of b, distances) marks, made in small blocks, as they are given on and not shuffled."""

    def reduce(a, b, c):
        ids = a["roi"].to_numpy(), b["roi"].to_numpy()
        i, j = np.nonzero((c < np.inf) if yes is None else (c < np.inf) & yes(ids[0][:, None], ids[1][None, :], c))
        return pd.DataFrame({"roi_a": ids[0][i], "roi_b": ids[1][j], "cost": c[i, j]})

    return in_blocks(points, gap, reduce, "roi_a long, roi_b long, cost double", block=BLOCK // 4)


def hard_examples(points: DataFrame, yes: Callable, k: int, ratio: float) -> DataFrame:
    """What learning.hard_negatives() gives of the cells of consecutive sessions, of which yes(ids of a, ids of b) are positive: (edge, roi_a, roi_b, cost, label).

    A block gives on its positives and of each line the negatives that may be among the first k; no window sees a positive.
    """

    def reduce(a, b, c):
        ids = a["roi"].to_numpy(), b["roi"].to_numpy()
        true = yes(ids[0][:, None], ids[1][None, :])
        parts = []
        for name in ("row", "column", "more"):
            if name == "more":
                x, y = np.nonzero(true & (c < np.inf))
            else:
                m = np.where(true, np.inf, c)
                x, y = _least(m, k) if name == "row" else _least(np.ascontiguousarray(m.T), k)[::-1]
            parts.append(pd.DataFrame({"roi_a": ids[0][x], "roi_b": ids[1][y], "cost": c[x, y], "side": name}))
        return pd.concat(parts, ignore_index=True)

    found = written(in_blocks(points, 1, reduce, "roi_a long, roi_b long, cost double, side string"), "examples")
    true = found.where("side = 'more'").drop("side")
    false = ordered(found.where("side <> 'more'"), k).select(*EDGE, "roi_a", "roi_b", "cost").distinct()
    n = true.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("_p"))
    place = F.row_number().over(Window.partitionBy(*EDGE).orderBy("cost", "roi_a", "roi_b"))
    few = false.withColumn("_n", place).join(n, EDGE, "left").where(F.col("_n") <= ratio * F.greatest(F.coalesce("_p", F.lit(0)), F.lit(1))).drop("_n", "_p")
    return true.withColumn("label", F.lit(1)).unionByName(few.withColumn("label", F.lit(0)))


def link_margins(points: DataFrame, values: dict[str, Callable]) -> DataFrame:
    """(edge, *values): sums over all cells of consecutive sessions of what values' functions (cells, row's, column's best other cell) give for a block.

    Where a line has no other cell its best one is NaN.
    """
    top = written(ordered(nearest(points, 1, 2), 2), "best-two")

    def two(side, line):
        at = lambda n: F.max(F.when(F.col("place") == n, F.col("cost")))
        return top.where(F.col("side") == side).groupBy(*EDGE, line).agg(at(1).alias("first"), at(2).alias("second"))

    def reduce(a, b, c):
        others = []
        for frame, cost in ((a, c), (b, c.T)):
            first, second = (frame[x].to_numpy(float)[:, None] for x in ("first", "second"))
            others.append(np.where(cost == first, second, first))
        there = c < np.inf
        row, column = others[0][there], others[1].T[there]
        return pd.DataFrame({n: [float(f(c[there], row, column))] for n, f in values.items()})

    found = in_blocks(points, 1, reduce, ", ".join(f"{n} double" for n in values), two("row", "roi_a"), two("column", "roi_b"))
    return found.groupBy(*EDGE).agg(*(F.sum(n).alias(n) for n in values))


def ranking_summary(points: DataFrame, yes: Callable, hits: tuple[int, ...]) -> DataFrame:
    """(edge, edges, hit_at_k, mutual_top1_rate, mean_row_margin, median_row_margin): evaluation.ranking_summary() of the cells for which yes(ids of a, ids of b).

    A row's rank and margins follow from its first costs and its best false one. The median is found by counts in bins and the values of those in the middle.
    """
    most = max(hits)

    def lines(a, b, c):
        ids = a["roi"].to_numpy(), b["roi"].to_numpy()
        i, j = _least(c, most)
        false = np.where(yes(ids[0][:, None], ids[1][None, :]), np.inf, c).min(1)
        parts = [("row", ids[0][i], c[i, j]), ("false", ids[0], false), ("column", ids[1], c.min(0))]
        return pd.concat([pd.DataFrame({"side": n, "roi": r, "cost": v}) for n, r, v in parts], ignore_index=True)

    found = in_blocks(points, 1, lines, "side string, roi long, cost double").where("cost < double('infinity')")
    of_line = Window.partitionBy(*EDGE, "side", "roi").orderBy("cost")
    kept = written(found.withColumn("_k", F.row_number().over(of_line)).where((F.col("_k") == 1) | (F.col("side") == "row") & (F.col("_k") <= most)), "first-costs")
    at = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("_k") == k), F.col("cost")))
    rows = kept.where("side <> 'column'").groupBy(*EDGE, F.col("roi").alias("roi_a")).agg(*(at("row", k).alias(f"to_{k}") for k in sorted({1, *hits})), at("false", 1).alias("false"))
    columns = kept.where("side = 'column'").select(*EDGE, F.col("roi").alias("roi_b"), F.col("cost").alias("first"))

    def true(a, b, c):
        """Rows, columns and costs of true cells, and their margins, NaN without a false cell."""
        i, j = np.nonzero(yes(a["roi"].to_numpy()[:, None], b["roi"].to_numpy()[None, :]) & (c < np.inf))
        return i, j, c[i, j], a["false"].to_numpy(float)[i] - c[i, j]

    bins = lambda m: np.floor(m * BINS).astype(np.int64)

    def counted(a, b, c):
        i, j, v, margin = true(a, b, c)
        # a row of fewer cells has a place for each
        hit = {k: v <= np.nan_to_num(a[f"to_{k}"].to_numpy(float), nan=np.inf)[i] for k in {1, *hits}}
        both = hit[1] & (v == b["first"].to_numpy(float)[j])
        known = margin[~np.isnan(margin)]
        at, n = np.unique(bins(known), return_counts=True)
        head = pd.DataFrame({"bin": [None], "n": [len(v)], **{f"hit_{k}": [int(hit[k].sum())] for k in hits}, "mutual": [int(both.sum())], "total": [known.sum()]})
        return pd.concat([head, pd.DataFrame({"bin": at, "n": n, **{f"hit_{k}": 0 for k in hits}, "mutual": 0, "total": 0.0})], ignore_index=True).astype({"bin": "Int64"})

    schema = ", ".join(["bin long", "n long", *(f"hit_{k} long" for k in hits), "mutual long", "total double"])
    counts = written(in_blocks(points, 1, counted, schema, rows, columns).groupBy(*EDGE, "bin").agg(*(F.sum(c).alias(c) for c in ("n", *(f"hit_{k}" for k in hits), "mutual", "total"))), "margin-bins")
    by = Window.partitionBy(*EDGE)
    h = counts.where("bin IS NOT NULL").withColumns({"_to": F.sum("n").over(by.orderBy("bin")), "_n": F.sum("n").over(by)})
    low, high = F.floor((F.col("_n") - 1) / 2).cast("long"), F.ceil((F.col("_n") - 1) / 2).cast("long")
    middle = written(h.where((low < F.col("_to")) & (high >= F.col("_to") - F.col("n"))).groupBy(*EDGE).agg(F.array_agg("bin").alias("_bins"), F.min(F.col("_to") - F.col("n")).alias("_before"), F.max("_n").alias("_n")), "middle-bins")

    def values(a, b, c):
        *_, margin = true(a, b, c)
        margin = margin[~np.isnan(margin)]
        v, n = np.unique(margin[np.isin(bins(margin), a["_bins"].iloc[0])], return_counts=True)
        return pd.DataFrame({"margin": v, "n": n})

    v = in_blocks(points, 1, values, "margin double, n long", rows, None, middle.select(*EDGE, "_bins")).groupBy(*EDGE, "margin").agg(F.sum("n").alias("n"))
    v = v.withColumn("_to", F.sum("n").over(by.orderBy("margin"))).join(middle, EDGE).withColumn("_to", F.col("_to") + F.col("_before"))
    median = v.groupBy(*EDGE).agg(*(F.min(F.when(p < F.col("_to"), F.col("margin"))).alias(x) for p, x in ((low, "_l"), (high, "_h")))).select(*EDGE, ((F.col("_l") + F.col("_h")) / 2).alias("median_row_margin"))
    margins = h.groupBy(*EDGE).agg(F.sum("n").alias("_margins"))
    out = counts.where("bin IS NULL AND n > 0").join(margins, EDGE, "left").join(median, EDGE, "left")
    share = lambda c: F.col(c) / F.col("n")
    return out.select(*EDGE, F.col("n").alias("edges"), *(share(f"hit_{k}").alias(f"hit_at_{k}") for k in hits), share("mutual").alias("mutual_top1_rate"), (F.col("total") / F.col("_margins")).alias("mean_row_margin"), "median_row_margin")
