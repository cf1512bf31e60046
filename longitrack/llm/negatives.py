"""Hard negatives by norm-bucketed search.

Rows are dealt into buckets by the norm of their vector, largest first, each a matrix of bounded size. An anchor
looks for the best scores within windows: its positives in one window without limits, then for each positive
the rows of other labels whose score is in the window that the positive's score sets. By Cauchy and Schwarz no row of
a bucket scores above the anchor's norm times the bucket's largest; a bucket is left out where that is below both
what a window accepts at least and the k-th score found so far. A first pass over the buckets of the
largest norms gives every window a k-th score to start from, which already keeps blocks of anchors from
meeting buckets at all; within the second pass the score runs on from bucket to bucket.

Scores are integer inner products, worked out as matrix products of 32- or 64-bit floats where all sums
are exact in those, else of Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.llm.common import remove, written
from longitrack.session import ship

#: Components of a bucket's or an anchor block's matrix at most (but for a single longer vector), and how many buckets one task takes.
COMPONENTS, CHUNK = 1 << 17, 4
#: Tasks that make stacks at most.
MOST_PARTS = 20_000
#: Components of the product of a slice of anchors with a bucket held at a time.
HELD = 1 << 20

_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_STACK = pa.schema([("dim", pa.int64()), ("chunk", pa.int64()), ("number", pa.int64()), ("low", pa.float64()), ("peak", pa.float64()), *((n, pa.binary()) for n in ("ids", "labels", "vectors", "windows"))])
_STACK_DDL = "dim long, chunk long, number long, low double, peak double, ids binary, labels binary, vectors binary, windows binary"


def usable(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v, norm): the distinct rows that take part, components scaled and floored to longs.

    Rows with a null id, label or vector or a component that is null, NaN or infinite take no part. Components beyond 64
    bits are held at the largest long. Rows that repeat all three count once. Other columns aren't read.
    """
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    fine = F.col(id_column).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & finite
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    out = rows.where(fine).select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v")).distinct()
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def _stack(components: int, chunk: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (dim, id, label, v, by, windows) to stacks: rows of one length of vectors as a matrix."""
        held, k, base = [], 0, TaskContext.get().partitionId() << 32

        def packed(chunk_of: int):
            ids, labels = (np.array([x[i] for x in held], np.int64) for i in (1, 2))
            v = np.concatenate([x[3] for x in held])
            peak = float(np.abs(v.astype(np.float64)).max(initial=0))
            v = v.astype(np.int16 if peak < 1 << 15 else np.int64)
            windows = np.concatenate([x[5] for x in held])
            row = (held[0][0], base + chunk_of, base + k, min(x[4] for x in held), peak, *(x.tobytes() for x in (ids, labels, v, windows)))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _STACK.types, strict=True)], schema=_STACK)

        for b in batches:
            lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (b.column(3), b.column(5))]
            plain = zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)
            for i, (dim, own, label, by) in enumerate(plain):
                if held and (dim != held[0][0] or (len(held) + 1) * max(dim, 16) > components):
                    yield packed(k // chunk)
                    held, k = [], k + 1
                v, windows = (flat[at[i] : at[i + 1]].copy() for flat, at in lists)
                held.append((dim, own, label, v, by, windows))
        if held:
            yield packed(k // chunk)

    return f


def stacked(rows: DataFrame, name: str, by: Column, windows: Column, components: int = COMPONENTS, chunk: int = CHUNK) -> DataFrame:
    """rows (id, label, v, norm) as a written table of stacks with neighbouring values of `by`; low is a stack's least."""
    keys = ["dim", "by", "id"]
    dealt = rows.select(F.size("v").cast("long").alias("dim"), "id", "label", "v", by.cast("double").alias("by"), windows.cast("array<long>").alias("windows"))
    # as many parts as chunks, however many the session has: a stack that isn't full costs as much as a full one
    size = rows.agg(F.sum(F.greatest(F.size("v"), F.lit(16)).cast("long"))).first()[0] or 0
    parts = min(MOST_PARTS, -(-size // (components * chunk)) or 1)
    ranges = dealt.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).coalesce(parts)
    return written(ranges.mapInArrow(_stack(components, chunk), _STACK_DDL), name)


def _unpacked(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(b.ids, np.int64)
    return ids, np.frombuffer(b.labels, np.int64), np.frombuffer(b.vectors, np.int16 if b.peak < 1 << 15 else np.int64).reshape(len(ids), int(b.dim))


def _products(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products; most bounds the sums of the absolute values of their terms. Those beyond 64 bits are held at the largest."""
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return (x.astype(kind) @ y.astype(kind).T).astype(np.int64)
    return np.clip(x.astype(object) @ y.astype(object).T, -_LAST, _LAST).astype(np.int64)


def _searched(k: int, slots: int, same: bool):
    def f(key, buckets, block):
        """A block of anchors against a chunk of buckets, largest norms first: the k best of each window by (-score, id)."""
        if buckets.empty or block.empty:
            return pd.DataFrame({c: np.array([], np.int64) for c in ("anchor", "slot", "id", "score")})
        a = block.iloc[0]
        ids, labels, vectors = _unpacked(a)
        asked = np.frombuffer(a.windows, np.int64).reshape(len(ids), 3 * slots + 1)
        keys = asked[:, -1]
        low, high, start = asked[:, :-1].reshape(len(ids), slots, 3).transpose(2, 0, 1)
        floor = np.maximum(low, start)
        norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))[:, None]
        score, who = np.full((len(ids), slots, k), _NONE), np.full((len(ids), slots, k), _LAST)
        for b in buckets.sort_values(["low", "number"]).itertuples():
            kth = np.maximum(floor, score[:, :, -1])
            live = (norm * -b.low * (1 + 1e-9) + 1 >= kth) & (low <= high)  # Cauchy and Schwarz, with room for rounding
            some = np.flatnonzero(live.any(axis=1))
            if not len(some):
                continue
            rids, rlabels, rows = _unpacked(b)
            order = np.argsort(rids, kind="stable")  # the first of equal scores then has the least id
            rids, rlabels, rows = rids[order], rlabels[order], rows[order]
            step = max(1, HELD // len(rids))
            for at in range(0, len(some), step):
                mine = some[at : at + step]
                scores = _products(vectors[mine], rows, a.peak * b.peak * max(1, int(b.dim)))
                alike = labels[mine, None] == rlabels
                scores[~(alike & (ids[mine, None] != rids) if same else ~alike)] = _NONE
                for slot in range(slots):
                    m = mine[live[mine, slot]]
                    x = scores[live[mine, slot]]
                    x = np.where((x >= kth[m, slot, None]) & (x <= high[m, slot, None]) & (x > _NONE), x, _NONE)
                    for _ in range(k):
                        best = x.argmax(axis=1)
                        got = x[np.arange(len(x)), best]
                        hit = got > _NONE
                        if not hit.any():
                            break
                        m, x, best, got = m[hit], x[hit], best[hit], got[hit]
                        s, w = np.column_stack((score[m, slot], got)), np.column_stack((who[m, slot], rids[best]))
                        order = np.lexsort((w, ~s))[:, :k]
                        score[m, slot], who[m, slot] = np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)
                        x[np.arange(len(x)), best] = _NONE
        r, slot, j = np.nonzero(score > _NONE)
        return pd.DataFrame({"anchor": keys[r], "slot": slot, "id": who[r, slot, j], "score": score[r, slot, j]})

    return f


def _pass(buckets: DataFrame, blocks: DataFrame, n_blocks: int, k: int, slots: int, same: bool, name: str) -> DataFrame:
    """(anchor, slot, id, score, rank), written: the k best of each window, from the pairs of block and bucket that the norms leave."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1)))).alias("salt")
    there = buckets.select("dim", "chunk", "number", F.col("low").alias("least"), spread)
    here = blocks.select("dim", F.col("number").alias("block"), F.col("low").alias("need"), F.pmod(F.xxhash64("number"), F.lit(max(1, n_blocks))).cast("int").alias("salt"))
    # a bucket's low is its largest norm below zero; a block's is the least norm that any of its windows asks for
    pairs = written(here.join(there, ["dim", "salt"]).where(F.col("need") <= -F.col("least") * (1 + 1e-9) + 1e-9).select("block", "chunk", "number"), "pairs")
    left = buckets.drop("chunk").join(pairs, "number").select("block", "chunk", "number", "dim", "low", "peak", "ids", "labels", "vectors")
    right = blocks.select(F.col("number").alias("block"), "dim", "peak", "ids", "labels", "vectors", "windows").join(pairs.select("block", F.col("chunk").alias("of")).distinct(), "block").withColumnRenamed("block", "own")
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("own", "of")).applyInPandas(_searched(k, slots, same), "anchor long, slot long, id long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    best = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)
    remove(pairs)
    return best


def search(anchors: DataFrame, buckets: DataFrame, k: int, slots: int, same: bool, components: int = COMPONENTS) -> DataFrame:
    """(anchor, slot, rank, id, score): for each window of each anchor the k best rows of the same or another label; anchor is its key.

    anchors: (key, id, label, v, norm, windows), windows being an array of `slots` pairs (low, high) of scores, both allowed; a slot
    that isn't used has low above high. buckets: rows made by stacked() by their norms, negative. Higher scores come
    first, ties by the lesser id; an anchor's own id is never found. Vectors are compared with those of their own length.
    """
    flat = lambda start: F.concat(F.flatten(F.transform("windows", lambda w, i: F.array(w["low"], w["high"], start(i)))), F.array("key"))

    def asked(start) -> Column:
        """The least norm any window asks for."""
        of = F.transform("windows", lambda w, i: F.when(w["low"] > w["high"], float("inf")).when(F.greatest(w["low"], start(i)) <= 0, float("-inf")).when(F.col("norm") == 0, float("inf")).otherwise((F.greatest(w["low"], start(i)) - 1) / F.col("norm")))
        return F.array_min(of)

    def blocks(rows: DataFrame, start) -> tuple[DataFrame, int]:
        made = stacked(rows, "blocks", asked(start), flat(start), components)
        return made, made.count()

    none = lambda i: F.lit(_NONE)
    heads = buckets.groupBy("dim").agg(F.min(F.struct("low", "number")).alias("h")).select("h.number")
    first, n = blocks(anchors, none)
    seeds = _pass(buckets.join(heads, "number", "left_semi"), first, n, k, slots, same, "seeds")
    kth = seeds.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), "score"))).alias("kth"))
    known = anchors.join(kth.withColumnRenamed("anchor", "key"), "key", "left")
    start = lambda i: F.coalesce(F.try_element_at("kth", i), F.lit(_NONE))
    second, n = blocks(known, start)
    found = _pass(buckets, second, n, k, slots, same, "found")
    for table in (first, seeds, second):
        remove(table)
    return found


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, components: int = COMPONENTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: as usable() gives them; anchors: which of them are anchors. An anchor's positives are its best other rows of its label; for each, the
    negatives are the best rows of other labels whose score is from low to high percent of the positive's. A positive of a negative
    score has no such row, one of score zero those of score zero. Rows are told apart by their ids: rows of one id are never
    each other's positives, and an id with several vectors or labels is an anchor with each of them. Only vectors of one
    length have a score. Without anchors or rows the result is empty.
    """
    ship(rows.sparkSession)
    rows = written(rows.withColumn("key", F.xxhash64("id", "label", "v")), "vectors")
    buckets = stacked(rows, "buckets", -F.col("norm"), F.array(), components)
    mine = rows.where(anchors)
    window = lambda lo, hi: F.struct(F.expr(f"CAST({lo} AS BIGINT)").alias("low"), F.expr(f"CAST({hi} AS BIGINT)").alias("high"))
    found = search(mine.withColumn("windows", F.array(window(-_LAST, _LAST))), buckets, positives, 1, True, components).select(F.col("anchor").alias("key"), (F.col("rank") - 1).cast("int").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    whole = F.col("positive_score").cast("decimal(20,0)")
    found = found.withColumn("w", F.struct(F.ceil(whole * low / 100).cast("long").alias("low"), F.floor(whole * high / 100).cast("long").alias("high")))
    of = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("ws"))  # at most `positives` entries
    unused = window(1, 0)
    asked = mine.join(of, "key").withColumn("windows", F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.try_element_at("ws", i), unused))).drop("ws")
    got = search(asked, buckets, negatives, positives, False, components).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    remove(buckets)
    named = found.drop("w").join(mine.select("key", F.col("id").alias("anchor_id")), "key").withColumnRenamed("key", "anchor")
    return got.join(named, ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
