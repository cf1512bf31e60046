"""Overlaps and distances of all supports of two sessions, in blocks: a task holds two blocks of supports and what it
compares of them, and gives on only what is asked of each line (a row or a column of an edge), not all pairs.

A support is one row with its pixels as an array, so that pixels are shuffled with the blocks and never multiplied by pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longitrack.functions import EPSILON
from longitrack.session import ship

EDGE = ["subject", "session_a", "session_b"]
#: Supports in a block, about, and pixels that are compared at once.
BLOCK, PIXELS = 2048, 4096
#: Whole weights up to this are compared level by level.
LEVELS = 64
#: Scores that are nearer to each other than this may tie once they are rounded.
NEAR = 2e-9
_BLOCKS = [*EDGE, "_ba", "_bb"]
#: What is told of a pair.
PAIR = "roi_a long, roi_b long, inter long, area_a long, area_b long, distance double"


def packed(pixels: DataFrame, weights: bool = False) -> DataFrame:
    """(subject, session_index, roi, cx, cy, cells): of each support its centre and its pixels of positive weight, coded as longs; with weights, theirs as `values`."""
    ok = pixels.where(F.col("w").isNotNull() & ~F.isnan(F.col("w").cast("double")) & (F.col("w") > 0))
    cell = F.col("x").cast("long") * (1 << 32) + F.col("y").cast("long")
    key = (F.col("subject").cast("string").alias("subject"), F.col("session_index").cast("int").alias("session_index"), F.col("roi").cast("long").alias("roi"))
    if weights:
        both = F.collect_list(F.struct(cell.alias("c"), F.col("w").cast("double").alias("v")))
        out = ok.groupBy(*key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), both.alias("_p"))
        return out.withColumns({"cells": F.col("_p.c"), "values": F.col("_p.v")}).drop("_p")
    return ok.groupBy(*key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.collect_list(cell).alias("cells"))


def sides(supports: DataFrame, max_gap: int) -> tuple[DataFrame, DataFrame]:
    """Supports once for each edge that their session begins, and once for each that it ends."""
    s = F.col("session_index")
    a = supports.withColumn("session_b", F.explode(F.sequence(s + 1, s + max_gap))).withColumnRenamed("session_index", "session_a")
    b = supports.withColumn("session_a", F.explode(F.sequence(s - max_gap, s - 1))).withColumnRenamed("session_index", "session_b")
    return a, b


class Pairs:
    """All pairs of two blocks of supports: ROIs and areas of both sides, shared pixels and distances of centres."""

    def __init__(self, a: pd.DataFrame, b: pd.DataFrame):
        self.gap = 1
        self.sides = a, b
        self.roi_a, self.roi_b = a["roi"].to_numpy(), b["roi"].to_numpy()
        self.area_a, self.area_b = (np.array([len(c) for c in s["cells"]], float) for s in (a, b))
        self.inter = _shared(a["cells"].to_numpy(), b["cells"].to_numpy())
        x, y = (a[c].to_numpy()[:, None] - b[c].to_numpy()[None, :] for c in ("cx", "cy"))
        x *= x
        y *= y
        x += y
        self.distance = np.sqrt(x, out=x)

    def iou(self) -> np.ndarray:
        return self.inter / (self.area_a[:, None] + self.area_b[None, :] - self.inter)

    def masses(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([v.sum() for v in s["values"]], float) for s in self.sides)

    def min_sum(self) -> np.ndarray:
        """The sum of the lesser weights over shared pixels; both sides have `values`."""
        return _least_sums(*(s[c].to_numpy() for c in ("cells", "values") for s in self.sides))

    def overlap_fraction(self) -> np.ndarray:
        return self.inter / np.minimum(self.area_a[:, None], self.area_b[None, :])

    def area_ratio(self) -> np.ndarray:
        """The lesser area over the greater, as exp(-|ln|) comes out in the C library."""
        (ua, ia), (ub, ib) = (np.unique(s, return_inverse=True) for s in (self.area_a, self.area_b))
        table = np.array([[math.exp(-abs(math.log(x / y))) for y in ub] for x in ua])
        return table[ia[:, None], ib[None, :]]

    def rows(self, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"roi_a": self.roi_a[i], "roi_b": self.roi_b[j], "inter": self.inter[i, j].astype(np.int64), "area_a": self.area_a[i].astype(np.int64), "area_b": self.area_b[j].astype(np.int64), "distance": self.distance[i, j]})


def _tables(a: np.ndarray, b: np.ndarray, values: tuple | None = None, kind: type = np.float32):
    """Both sides' supports over the pixels that they share, some pixels at a time: 1 where a support has one, or its value."""
    flat = [np.concatenate(s) for s in (a, b)]
    of = [np.repeat(np.arange(len(s)), [len(c) for c in s]) for s in (a, b)]
    both = np.intersect1d(*flat)
    for s in range(0, len(both), PIXELS):
        part, tables = both[s : s + PIXELS], []
        for k, (f, o, n) in enumerate(zip(flat, of, (len(a), len(b)), strict=True)):
            at = np.minimum(np.searchsorted(part, f), len(part) - 1)
            here = part[at] == f
            t = np.zeros((n, len(part)), kind)
            t[o[here], at[here]] = 1.0 if values is None else values[k][here]
            tables.append(t)
        yield tables


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pixels each two supports share."""
    out = np.zeros((len(a), len(b)))
    for x, y in _tables(a, b):
        out += x @ y.T
    return out


def _least_sums(a: np.ndarray, b: np.ndarray, va: np.ndarray, vb: np.ndarray) -> np.ndarray:
    """The sum of the lesser value over the pixels that each two supports share; values are positive."""
    out = np.zeros((len(a), len(b)))
    for x, y in _tables(a, b, (np.concatenate(va), np.concatenate(vb)), float):
        top = min(x.max(), y.max())
        if top <= LEVELS and (x == np.floor(x)).all() and (y == np.floor(y)).all():
            # whole numbers: the lesser of two is how many levels both reach
            for level in range(1, int(top) + 1):
                out += (x >= level).astype(np.float32) @ (y >= level).astype(np.float32).T
            continue
        for k in range(x.shape[1]):
            i, j = np.flatnonzero(x[:, k]), np.flatnonzero(y[:, k])
            out[np.ix_(i, j)] += np.minimum(x[i, k][:, None], y[j, k][None, :])
    return out


def weighted(a: np.ndarray, b: np.ndarray, va: np.ndarray, vb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each two supports the pixels that they share, and over these the sums of the lesser value and of the products; values are positive."""
    dot = np.zeros((len(a), len(b)))
    for x, y in _tables(a, b, (np.concatenate(va), np.concatenate(vb)), float):
        dot += x @ y.T
    return _shared(a, b), _least_sums(a, b, va, vb), dot


def in_blocks(a: DataFrame, b: DataFrame, reduce: Callable[[Pairs, pd.DataFrame], pd.DataFrame], schema: str, block: int | None = 0) -> DataFrame:
    """(EDGE, ...) of reduce(pairs, frame of a) for every two blocks of supports of an edge, in order of roi; block None takes sessions whole.

    a and b: (EDGE, roi, cx, cy, cells), a with further columns, if reduce reads them.
    """
    spark = a.sparkSession
    ship(spark)
    count = lambda df, n: df.groupBy(*EDGE).agg((F.lit(1) if block is None else F.ceil(F.count(F.lit(1)) / (block or BLOCK)).cast("int")).alias(n))
    n = count(a, "_na").join(count(b, "_nb"), EDGE)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def side(df, mine, other):
        out = df.join(n, EDGE).withColumn(f"_b{mine}", F.pmod(F.xxhash64("roi"), F.col(f"_n{mine}")).cast("int"))
        out = out.withColumn(f"_b{other}", F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1))).drop("_na", "_nb")
        # columns of its own, as both sides may come from one table; few rows make many pairs, so tasks aren't merged by size
        return out.toDF(*out.columns).repartition(tasks, *_BLOCKS)

    names = [f.split()[0] for f in schema.split(", ")]

    def solve(key, p, q):
        if not len(p) or not len(q):
            return pd.DataFrame(columns=[*EDGE, *names])
        p, q = p.sort_values("roi", ignore_index=True), q.sort_values("roi", ignore_index=True)
        pairs = Pairs(p, q)
        pairs.gap = key[2] - key[1]
        out = reduce(pairs, p)[names]
        for i, k in enumerate(EDGE):
            out.insert(i, k, key[i])
        return out

    pairs = side(a, "a", "b").groupBy(*_BLOCKS).cogroup(side(b, "b", "a").groupBy(*_BLOCKS))
    return pairs.applyInPandas(solve, f"subject string, session_a int, session_b int, {schema}")


def first(c: np.ndarray, k: int, greatest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least cells of each row, ties to the least column or the greatest; infinite ones are not there."""
    c, n = c.copy(), np.arange(len(c))
    i, j = [], []
    for _ in range(min(k, c.shape[1])):
        at = c.shape[1] - 1 - c[:, ::-1].argmin(1) if greatest else c.argmin(1)
        ok = c[n, at] < np.inf
        i.append(n[ok])
        j.append(at[ok])
        c[n, at] = np.inf
    return np.concatenate(i), np.concatenate(j)


def of_lines(c: np.ndarray, k: int, rows: bool = True, columns: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The cells among the k least of their row or column, once each, ties to the lesser one."""
    mark = np.zeros(c.shape, bool)
    if rows:
        mark[first(c, k)] = True
    if columns:
        j, i = first(np.ascontiguousarray(c.T), k)
        mark[i, j] = True
    return np.nonzero(mark)


def up_to(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of each row up to its k-th least and those so near to it that rounding may tie them."""
    limit = np.partition(c, k - 1, axis=1)[:, k - 1] if k < c.shape[1] else np.full(len(c), np.inf)
    return np.nonzero((c <= limit[:, None] + NEAR) & (c < np.inf))


def cheapest(supports: DataFrame, max_gap: int, reach: float, k: int, epsilon: float = EPSILON) -> DataFrame:
    """(EDGE, roi_a, roi_b) of pairs within reach that are among the k of the greatest overlap of their row or column in a block: all that are so in an edge, and some more.

    supports: as packed() gives them. Overlaps below epsilon are equal; ties go to the lesser roi.
    """

    def reduce(p, _):
        i, j = of_lines(np.where(p.distance <= reach, -np.maximum(p.iou(), epsilon), np.inf), k)
        return pd.DataFrame({"roi_a": p.roi_a[i], "roi_b": p.roi_b[j]})

    return in_blocks(*sides(supports, max_gap), reduce, "roi_a long, roi_b long")


def of_pairs(supports: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (EDGE, roi_a, roi_b, ...) with inter, area_a, area_b and distance; pairs without a support are left out."""
    side = lambda s: supports.select("subject", F.col("session_index").alias(f"session_{s}"), F.col("roi").alias(f"roi_{s}"), *(F.col(c).alias(f"_{c}_{s}") for c in ("cx", "cy", "cells")))
    both = wanted.join(side("a"), ["subject", "session_a", "roi_a"]).join(side("b"), ["subject", "session_b", "roi_b"])
    c = F.col
    told = {
        "inter": F.size(F.array_intersect("_cells_a", "_cells_b")).cast("long"), "area_a": F.size("_cells_a").cast("long"), "area_b": F.size("_cells_b").cast("long"),
        "distance": F.sqrt(F.pow(c("_cx_a") - c("_cx_b"), 2) + F.pow(c("_cy_a") - c("_cy_b"), 2)),
    }
    return both.withColumns(told).drop(*(f"_{x}_{s}" for x in ("cx", "cy", "cells") for s in "ab"))
