"""Pairs of two sides' points in tiles: a task holds a block of each side and makes their pairs as matrices, where they are
used, so that no shuffle sees a row for every pair. Where a pair's whole line is needed (a rank, a median, a sum), the task also
has the points of that line, a few numbers each.

A side is (*keys, roi_a or roi_b, ...), its ROIs unique over the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.session import ship, written

#: Points in a block, about, and cells of a matrix that a task works on at once.
TILE, CELLS = 1024, 1 << 21
#: The least number of bins in the search for a quantile.
BINS = 1024


def in_tiles(a: DataFrame, b: DataFrame, keys: list[str], reduce: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, size: int = 0, split: bool = True, whole: list[str] | None = None) -> DataFrame:
    """(*keys, ...) of reduce(p, q) for every two blocks of a and b of equal keys, p and q in order of roi; without split, b is one block.

    whole: columns that a task is told of all rows of its keys; `own` tells those of its blocks, and other columns of the rest are null.
    """
    spark = a.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = F.ceil(F.count(F.lit(1)) / (size or TILE)).cast("int")
    n = a.groupBy(*keys).agg(parts.alias("_na")).join(b.groupBy(*keys).agg((parts if split else F.lit(1)).alias("_nb")), keys)

    def side(df, roi, mine, other):
        every = lambda s: F.explode(F.sequence(F.lit(0), F.col(f"_n{s}") - 1))
        at = F.pmod(F.xxhash64(roi), F.col(f"_n{mine}")).cast("int")
        out = df.join(n, keys).withColumn("_at", at).withColumn(f"_b{mine}", F.col("_at") if whole is None else every(mine)).withColumn(f"_b{other}", every(other))
        out = out.withColumn("own", F.col("_at") == F.col(f"_b{mine}")).drop("_na", "_nb", "_at")
        if whole is not None:
            out = out.withColumns({c: F.when(F.col("own"), F.col(c)) for c in df.columns if c not in (*keys, roi, *whole)})
        # columns of its own, as both sides may come from one table; few rows make many pairs, so tasks aren't merged by size
        return out.toDF(*out.columns).repartition(tasks, *keys, "_ba", "_bb").groupBy(*keys, "_ba", "_bb")

    names = [f.split()[0] for f in schema.split(", ")]

    def solve(key, p, q):
        if not (p["own"].any() and q["own"].any()):
            return pd.DataFrame(columns=[*keys, *names])
        out = reduce(p.sort_values("roi_a", ignore_index=True), q.sort_values("roi_b", ignore_index=True))[names]
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    kinds = ", ".join(f"{k} {a.schema[k].dataType.simpleString()}" for k in keys)
    return side(a, "roi_a", "a", "b").cogroup(side(b, "roi_b", "b", "a")).applyInPandas(solve, f"{kinds}, {schema}")


def kind(df: DataFrame, column: str) -> str:
    return f"{column} {df.schema[column].dataType.simpleString()}"


def distances(p: pd.DataFrame, q: pd.DataFrame) -> np.ndarray:
    x, y = (p[c].to_numpy(float)[:, None] - q[c].to_numpy(float)[None, :] for c in ("x", "y"))
    x *= x
    y *= y
    x += y
    return np.sqrt(x, out=x)


def parts(p: pd.DataFrame, q: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """p some rows at a time, so many that their cells with q can be worked on at once."""
    step = max(1, CELLS // max(len(q), 1))
    for s in range(0, len(p), step):
        yield p.iloc[s : s + step]


def places(c: np.ndarray, dense: bool = False) -> np.ndarray:
    """Of each cell its place in its row by value, from 0: ties by column, or, dense, together."""
    order = np.argsort(c, axis=1, kind="stable")
    n = np.broadcast_to(np.arange(c.shape[1], dtype=np.int32), c.shape)
    if dense:
        s = np.take_along_axis(c, order, 1)
        n = np.zeros(c.shape, np.int32)
        np.cumsum(s[:, 1:] != s[:, :-1], axis=1, out=n[:, 1:])
    out = np.empty(c.shape, np.int32)
    np.put_along_axis(out, order, n, 1)
    return out


def line_places(p: pd.DataFrame, q: pd.DataFrame, dense: bool = False, reach: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of p, over all of q, the places by distance of q's own columns, and how many lie within reach."""
    own = q["own"].to_numpy(bool)
    out, n = [], []
    for part in parts(p, q):
        c = distances(part, q)
        out.append(places(c, dense)[:, own])
        n.append((c <= reach).sum(1))
    return np.concatenate(out), np.concatenate(n)


def ranked(a: DataFrame, b: DataFrame, keys: list[str], dense: bool = False) -> DataFrame:
    """(*keys, roi_a, roi_b, distance, row_place, column_place, row_n, column_n) of all pairs: places by distance in row and column from 0, and lengths of both.

    a and b: (*keys, roi_a or roi_b, x, y). Ties go by id, or share a dense place.
    """

    def reduce(p, q):
        mine, other = p[p["own"].to_numpy(bool)], q[q["own"].to_numpy(bool)]
        rows, columns = line_places(mine, q, dense)[0], line_places(other, p, dense)[0].T
        ids = mine["roi_a"].to_numpy(), other["roi_b"].to_numpy()
        told = {"distance": distances(mine, other).ravel(), "row_place": rows.ravel(), "column_place": columns.ravel()}
        return pd.DataFrame({"roi_a": np.repeat(ids[0], len(ids[1])), "roi_b": np.tile(ids[1], len(ids[0])), **told, "row_n": np.int32(len(q)), "column_n": np.int32(len(p))})

    schema = f"{kind(a, 'roi_a')}, {kind(b, 'roi_b')}, distance double, row_place int, column_place int, row_n int, column_n int"
    return in_tiles(a.select(*keys, "roi_a", "x", "y"), b.select(*keys, "roi_b", "x", "y"), keys, reduce, schema, whole=["x", "y"])


def _two(points: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points with both coordinates, as both sides."""
    ok = points.where(~F.isnan(F.col("x").cast("double")) & ~F.isnan(F.col("y").cast("double")))
    return tuple(ok.select(*keys, F.col("roi").alias(f"roi_{s}"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")) for s in "ab")


def neighbours(points: DataFrame, keys: list[str], radius: float, k: int) -> DataFrame:
    """(*keys, roi, density, nearest, median_distance, least): of each point, over the others of its keys, how many are within the radius, the least
    and the median distance, and the k least in order. Points that have no other, or lack a coordinate, have no row.
    """

    def reduce(p, q):
        ids, out = q["roi_b"].to_numpy(), []
        for part in parts(p, q):
            c = distances(part, q)
            own = part["roi_a"].to_numpy()[:, None] == ids[None, :]
            c[own] = -1.0
            n, first = own.sum(1), np.arange(len(part))
            near = (c <= radius).sum(1) - n
            c.sort(axis=1)
            m = c.shape[1] - n
            some = m > 0
            at = [np.minimum(n + f, c.shape[1] - 1) for f in (0, np.maximum(m - 1, 0) // 2, m // 2)]
            low, mid, high = (c[first, x] for x in at)
            least = [c[i, n[i] : n[i] + k].copy() for i in first]
            out.append(pd.DataFrame({"roi": part["roi_a"].to_numpy(), "density": near, "nearest": low, "median_distance": 0.5 * mid + 0.5 * high, "least": least})[some])
        return pd.concat(out, ignore_index=True)

    a, b = _two(points, keys)
    roi = points.schema["roi"].dataType.simpleString()
    return in_tiles(a, b, keys, reduce, f"roi {roi}, density long, nearest double, median_distance double, least array<double>", split=False)


def median_distance(points: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, median): of all distances between two points of the same keys, by counts in bins and the values of the bins that hold the middle."""
    a, b = _two(points, keys)
    reach = F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    n = F.count(F.lit(1))
    # as many bins as points: the values that share one are then about as many
    a = a.join(a.groupBy(*keys).agg((F.greatest(reach, F.lit(1e-300)) / F.greatest(n, F.lit(BINS))).alias("_w")), keys)

    def cells(p, q):
        for part in parts(p, q):
            c = distances(part, q)[part["roi_a"].to_numpy()[:, None] != q["roi_b"].to_numpy()[None, :]]
            yield c, np.floor(c / part["_w"].iloc[0]).astype(np.int64)

    def summed(counts, name):
        both = [np.concatenate(c) for c in zip(*counts, strict=True)]
        v, at = np.unique(both[0], return_inverse=True)
        return pd.DataFrame({name: v, "n": np.bincount(at, both[1], len(v)).astype(np.int64)})

    def histogram(p, q):
        return summed([np.unique(bins, return_counts=True) for _, bins in cells(p, q)], "bin")

    def values(p, q):
        low, high = p["_lo"].iloc[0], p["_hi"].iloc[0]
        return summed([np.unique(c[(bins >= low) & (bins <= high)], return_counts=True) for c, bins in cells(p, q)], "value")

    by = Window.partitionBy(*keys)
    h = in_tiles(a, b, keys, histogram, "bin long, n long", split=False).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    h = h.withColumns({"_to": F.sum("n").over(by.orderBy("bin")), "_all": F.sum("n").over(by)})
    # places of the two middle distances, from 0
    h = h.withColumns({"_i": F.floor((F.col("_all") - 1) / 2).cast("long"), "_j": F.floor(F.col("_all") / 2).cast("long")})
    here = h.where((F.col("_i") < F.col("_to")) & (F.col("_j") >= F.col("_to") - F.col("n")))
    here = written(here.groupBy(*keys).agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"), F.min(F.col("_to") - F.col("n")).alias("_before"), F.first("_i").alias("_i"), F.first("_j").alias("_j")), "middle")
    v = in_tiles(a.join(here.select(*keys, "_lo", "_hi"), keys), b, keys, values, "value double, n long", split=False).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    v = v.join(here, keys).withColumn("_to", F.col("_before") + F.sum("n").over(by.orderBy("value")))
    first = lambda c: F.min(F.when(F.col(c) < F.col("_to"), F.col("value")))
    return v.groupBy(*keys).agg((0.5 * first("_i") + 0.5 * first("_j")).alias("median"))


def products(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of vectors of both sides, 0 where one is missing, and where none is."""
    some = [np.array([v is not None for v in s], bool) for s in (a, b)]
    out, both = np.zeros((len(a), len(b))), some[0][:, None] & some[1][None, :]
    if both.any():
        x, y = (np.stack(s[k].to_numpy()).astype(float) for s, k in zip((a, b), some, strict=True))
        out[np.ix_(*some)] = x @ y.T
    return out, both


def patch_correlations(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, roi_a, roi_b, patch_correlation, patch_valid) of all pairs of sides with a `patch` of evidence.unit_patches(), null where invalid."""

    def reduce(p, q):
        ids = p["roi_a"].to_numpy(), q["roi_b"].to_numpy()
        out, both = products(p["patch"], q["patch"])
        return pd.DataFrame({"roi_a": np.repeat(ids[0], len(ids[1])), "roi_b": np.tile(ids[1], len(ids[0])), "patch_correlation": out.ravel(), "patch_valid": both.ravel()})

    return in_tiles(a, b, keys, reduce, f"{kind(a, 'roi_a')}, {kind(b, 'roi_b')}, patch_correlation double, patch_valid boolean")


def likely(a: DataFrame, b: DataFrame, keys: list[str], temperature: float, reliability: Callable, least: float, row_k: int, column_k: int) -> DataFrame:
    """(*keys, roi_a, roi_b, cost, posterior) of the pairs likely enough, or among the k likeliest of their row or column, ties by id.

    a and b: (*keys, roi_a or roi_b, x, y, and what reliability(p, q) reads, which gives the factors of all pairs). A posterior is exp(-distance /
    temperature) over its sum in the row, times the factor. Every row's sum is taken over its whole line at once, so that equal rows stay equal.
    """

    def totals(p, q):
        out = []
        for part in parts(p, q):
            c = distances(part, q)
            low = c.min(1)
            out.append(pd.DataFrame({"roi_a": part["roi_a"].to_numpy(), "_low": low, "_sum": np.exp(-(c - low[:, None]) / temperature).sum(1)}))
        return pd.concat(out, ignore_index=True)

    def reduce(p, q):
        c = distances(p, q)
        v = np.exp(-(c - p["_low"].to_numpy()[:, None]) / temperature) / p["_sum"].to_numpy()[:, None] * reliability(p, q)
        mark = v >= least
        for k, m, cells in ((row_k, -v, mark), (column_k, -v.T, mark.T)):
            first = np.argsort(m, axis=1, kind="stable")[:, :k]
            np.put_along_axis(cells, first, True, 1)
        i, j = np.nonzero(mark)
        return pd.DataFrame({"roi_a": p["roi_a"].to_numpy()[i], "roi_b": q["roi_b"].to_numpy()[j], "cost": c[i, j], "posterior": v[i, j]})

    sums = in_tiles(a.select(*keys, "roi_a", "x", "y"), b.select(*keys, "roi_b", "x", "y"), keys, totals, f"{kind(a, 'roi_a')}, _low double, _sum double", split=False)
    found = in_tiles(a.join(sums, [*keys, "roi_a"]), b, keys, reduce, f"{kind(a, 'roi_a')}, {kind(b, 'roi_b')}, cost double, posterior double")
    place = lambda mine, other: F.row_number().over(Window.partitionBy(*keys, mine).orderBy(F.desc("posterior"), other))
    found = found.withColumns({"_i": place("roi_a", "roi_b"), "_j": place("roi_b", "roi_a")})
    return found.where((F.col("posterior") >= least) | (F.col("_i") <= row_k) | (F.col("_j") <= column_k)).drop("_i", "_j")
