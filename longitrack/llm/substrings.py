"""Removal of byte strings that occur more than once in a corpus, exactly, by run-length indexes.

A run-compressed index (see runindex) marks the long matches of the strings it holds. One index over a corpus
would be one task, so the corpus is split by what can match at all. Every window of `length` bytes has an
anchor: the k-gram of least hash in it (the first of equals). Equal windows have equal anchors at equal
places, so only windows whose anchors hold the same k-gram can be equal. Windows of one anchor are
consecutive and all cover it; their bytes are the anchor's context. Contexts that occur twice are repeated as a whole. Of
the others, those under the same k-grams are indexed together, and their matching statistics are streamed; where
these reach `length` a repeated window begins, and since all windows of a context cover its anchor, the first and the last
bound what is removed.

Numbers of rows follow the text: about two anchors in `length` bytes, and an index only for contexts that differ from
others of their k-gram. A k-gram with more than GROUP different contexts does not go to one task: its windows are
compared by a distributed count of their hashes, with the same result.

Strings of NOTICED bytes are looked for first. Longer ones that repeat lie within what those cover, so the
removal reads no other text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longitrack.llm import runindex
from longitrack.llm.common import remove, short_batches, small, written
from longitrack.llm.rolling import mix, sums, windows_hash
from longitrack.session import ship

LENGTH = 400
#: About 50 words: the length from which repeats are counted, though only those of LENGTH are removed.
NOTICED = 256
GRAM = 48
#: Different contexts of a k-gram that are indexed in one task: at most 8000 * 752 bytes.
GROUP = 8000
_PIECE = 1 << 20
_POS = np.uint64((1 << 24) - 1)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values."""
    n = len(v)
    full = -(-n // w) * w
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, context, p, lo, hi) of a text: an anchor's k-gram and context hashes, its place, its first and last window."""
    parts = []
    gram = min(gram, length)
    for at in range(0, len(raw) - length + 1, _PIECE):
        data = np.frombuffer(raw[at : at + _PIECE + length - 1], np.uint8)
        if len(data) < length:
            break
        hashes = sums(data)
        begin = np.arange(len(data) - gram + 1)
        grams = windows_hash(hashes, begin, begin + gram)
        p = (_least((grams & ~_POS) | begin.astype(np.uint64), length - gram + 1) & _POS).astype(np.int64)
        lo = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1))
        hi = np.concatenate((lo[1:], [len(p)])) - 1
        p = p[lo]
        context = mix(windows_hash(hashes, lo, hi + length) + (p - lo).astype(np.uint64))
        parts.append((grams[p], context, p + at, lo + at, hi + at))
    if not parts:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals joined where they touch or overlap."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate(([True], start[1:] > end[:-1]))
    return start[first], end[np.concatenate((first[1:], [True]))]


def _anchor_rows(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, context, p, lo, hi, n) without repeats within the text; n = 0 marks removed bytes [lo, hi) that are known already."""
    key, context, p, lo, hi = anchors(raw, length, gram)
    if not len(key):
        return key, context, p, lo, hi, p
    _, first, where, n = np.unique(key ^ mix(context), return_index=True, return_inverse=True, return_counts=True)
    rows = [key[first], context[first], p[first], lo[first], hi[first], n]
    if (n > 1).any():
        again = n[where] > 1
        a, b = _union(lo[again], hi[again] + length)
        none = np.zeros(len(a), np.int64)
        rows = [np.concatenate(x) for x in zip(rows, (none.astype(np.uint64), none.astype(np.uint64), none, a, b, none), strict=True)]
    return tuple(rows)


def shared_windows(group: np.ndarray, contexts: list[np.ndarray], offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, distance, first owner) of every window that two contexts of one group share at one distance from their anchors.

    Contexts are sequences of bytes or token hashes, offset the anchor's place in each.
    """
    sizes = np.array([len(c) for c in contexts])
    data = np.concatenate(contexts)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = (np.cumsum(sizes) - sizes)[owner] + inside
    distance = offset[owner] - inside
    h = windows_hash(sums(data), begin, begin + length)
    h = mix(h + mix(group[owner] + distance.astype(np.uint64)))
    _, first, where, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    found = n[where] > 1
    return owner[found], distance[found], owner[first[where[found]]]


def extremes(n: int, who: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest and least distance of each of n owners; -1 for those without."""
    top, low = np.full(n, -1, np.int64), np.full(n, 1 << 62, np.int64)
    np.maximum.at(top, who, distance)
    np.minimum.at(low, who, distance)
    low[top < 0] = -1
    return top, low


def whole_groups(batches, step: int = 2000):
    """Tables of whole groups, about `step` rows each, from batches that are sorted by `key`."""
    rest: list = []
    for b in batches:
        rest.append(b)
        now = pa.Table.from_batches(rest).combine_chunks()
        key = now.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
        at = 0
        while at < last:
            end = last if at + step >= last else int(np.searchsorted(key, key[at + step], side="right"))
            end = min(end, last)
            yield now.slice(at, end - at)
            at = end
        rest = now.slice(last).to_batches()
    if rest and sum(b.num_rows for b in rest):
        yield pa.Table.from_batches(rest).combine_chunks()


def _marked(contexts: list[np.ndarray], offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, largest, least distance back from the anchor) of the repeated windows of those contexts that have any."""
    reach = runindex.build(contexts).statistics() >= length
    sizes = np.array([len(x) for x in contexts])
    at = np.flatnonzero(reach)
    owner = np.repeat(np.arange(len(contexts)), sizes)[at]
    who, first = np.unique(owner, return_index=True)
    last = np.concatenate((first[1:], [len(at)])) - 1 if len(who) else first
    begins = (np.cumsum(sizes) - sizes)[who]
    return who, offset[who] - (at[first] - begins), offset[who] - (at[last] - begins)


def _on(left: tuple[str, str], right: tuple[str, str]):
    return F.col(left[0]).eqNullSafe(F.col(right[0])) & (F.col(left[1]) == F.col(right[1]))


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, within: DataFrame | None = None) -> DataFrame:
    """(doc, same, spans): the byte spans [start, end) covered by strings of `length` bytes that also start elsewhere, in this or another row.

    spans are sorted and apart, and only texts that have any are listed. same is a hash that tells apart texts under one id; rows that
    repeat both are occurrences of their own. within is such a table: only strings inside its spans are looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    ids = dict(docs.select(F.col(id_column).alias("doc")).dtypes)["doc"]
    texts = docs.select(F.col(id_column).alias("doc"), F.xxhash64(text).alias("same"), F.col(text).cast("binary").alias("t")).where(F.length("t") >= length)
    if within is None:
        pieces = texts.withColumn("spans", F.lit(None).cast("array<struct<start: bigint, end: bigint>>"))
    else:
        long = within.select(F.col("doc").alias("_doc"), F.col("same").alias("_same"), F.filter("spans", lambda x: x["end"] - x["start"] >= length).alias("spans")).where(F.size("spans") > 0)
        pieces = texts.join(small(long), _on(("doc", "same"), ("_doc", "_same"))).select("doc", "same", "t", "spans")

    def scan(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            counts = []
            for x, spans in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                raw, count = x.as_py(), 0
                for start, end in [(x["start"], x["end"]) for x in spans] if spans is not None else [(0, len(raw))]:
                    key, context, *places, n = _anchor_rows(raw[start:end], length, gram)
                    count += len(key)
                    for o, r in zip(out, (key, context, *(p + start for p in places), n), strict=True):
                        o.append(r)
                counts.append(count)
            whose = pa.array(np.repeat(np.arange(len(counts)), counts))
            arrays = [pa.array(np.concatenate(o).view(np.int64) if o else [], pa.int64()) for o in out]
            yield pa.RecordBatch.from_arrays([b.column(0).take(whose), b.column(1).take(whose), *arrays], names=["doc", "same", "key", "context", "p", "lo", "hi", "n"])

    shape = f"doc {ids}, same long, key long, context long, p long, lo long, hi long, n long"
    with short_batches(spark):
        every = written(pieces.mapInArrow(scan, shape), "anchors")
    known = written(every.where("n = 0").select("doc", "same", F.col("lo").alias("start"), F.col("hi").alias("end")), "known")
    marks = every.where("n > 0")
    # tables of their own, so that joins with them can split a k-gram that is in very many places
    keys = written(marks.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key"), "keys")
    # rows of one text repeated are one in `marks` for each row, so counts are of occurrences
    held = written(marks.join(keys, "key", "left_semi"), "repeated-grams")
    remove(every)
    remove(keys)
    contexts = held.groupBy("key", "context").agg(F.sum("n").alias("times"), F.min(F.struct("p", "same", "doc", "lo", "hi")).alias("rep"))
    contexts = written(contexts, "contexts")
    whole = held.join(contexts.where("times > 1").select("key", "context"), ["key", "context"], "left_semi").select("doc", "same", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))

    # k-grams with a context that is alone among several: these are indexed together
    open_keys = written(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("times").alias("least")).where("m > 1 AND least = 1").select("key", "m"), "open-keys")
    asked = contexts.join(open_keys, "key").select("key", "context", "m", F.col("rep.doc").alias("_doc"), F.col("rep.same").alias("_same"), (F.col("rep.p") - F.col("rep.lo")).alias("offset"), F.col("rep.lo").alias("lo"), (F.col("rep.hi") + length).alias("end"))
    per_text = written(asked.groupBy("_doc", "_same").agg(F.collect_list(F.struct("key", "context", "m", "offset", "lo", "end")).alias("asked")), "asked")
    joined = texts.join(small(per_text), _on(("doc", "same"), ("_doc", "_same")))
    cut = joined.select("t", F.explode("asked").alias("x")).select("x.key", "x.context", "x.m", "x.offset", F.expr("substring(t, cast(x.lo as int) + 1, cast(x.end - x.lo as int))").alias("bytes"))
    cut = written(cut.dropDuplicates(["key", "context"]), "cut")

    def compare(batches):
        for t in whole_groups(batches):
            raws = [np.frombuffer(x, np.uint8) for x in t.column("bytes").to_pylist()]
            who, top, low = _marked(raws, t.column("offset").to_numpy(), length)
            yield pa.RecordBatch.from_arrays([t.column(n).take(pa.array(who)).combine_chunks() for n in ("key", "context")] + [pa.array(top), pa.array(low)], names=["key", "context", "top", "low"])

    def windows(batches):
        for b in batches:
            for k, c, o, raw in zip(*(b.column(n).to_pylist() for n in ("key", "context", "offset", "bytes")), strict=True):
                begin = np.arange(len(raw) - length + 1)
                h = windows_hash(sums(np.frombuffer(raw, np.uint8)), begin, begin + length).view(np.int64)
                same = lambda v: pa.array(np.full(len(begin), v))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(k), same(c), pa.array(o - begin), pa.array(h)], names=["key", "context", "d", "h"])

    with short_batches(spark, 500):
        bounds = written(cut.where(F.col("m") <= group).repartition("key").sortWithinPartitions("key").mapInArrow(compare, "key long, context long, top long, low long"), "compared")
    tables = [known, held, contexts, open_keys, per_text, cut, bounds]
    if not open_keys.where(F.col("m") > group).isEmpty():
        single = cut.where(F.col("m") > group).mapInArrow(windows, "key long, context long, d long, h long")
        twice = single.groupBy("key", "d", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "d", "h")
        many = single.join(twice, ["key", "d", "h"], "left_semi").groupBy("key", "context").agg(F.max("d").alias("top"), F.min("d").alias("low"))
        many = written(many, "counted")
        bounds, tables = bounds.unionByName(many), [*tables, many]
    edges = held.join(bounds, ["key", "context"]).select("doc", "same", (F.col("p") - F.col("top")).alias("start"), (F.col("p") - F.col("low") + length).alias("end"))
    spans = known.unionByName(whole).unionByName(edges)
    found = spans.groupBy("doc", "same").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def united(batches):
        for b in batches:
            rows = []
            for xs in b.column(2).to_pylist():
                start, end = _union(np.array([x["start"] for x in xs]), np.array([x["end"] for x in xs]))
                rows.append([{"start": x, "end": y} for x, y in zip(start.tolist(), end.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, _SPANS)], names=["doc", "same", "spans"])

    found = found.mapInArrow(united, f"doc {ids}, same long, spans array<struct<start: bigint, end: bigint>>")
    found = written(found, "spans")
    for t in tables:
        remove(t)
    return found


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, bodies: bool = False, noticed: int = NOTICED) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated[, kept]) of every row, kept being the bytes that stay.

    Bytes are removed that a string of `length` bytes covers which also starts elsewhere; n_repeated counts those that
    one of `noticed` bytes covers, which is not above `length`. Texts are their UTF-8 bytes; null is empty. Texts shorter than these
    lengths stay whole. Repeated rows are each reported, and repeat each other; null ids are ids like others; other columns are not read.
    """
    noticed = min(noticed, length)
    marked = repeated_spans(docs, id_column, text, noticed, gram, group)
    gone = repeated_spans(docs, id_column, text, length, gram, group, within=marked) if noticed < length else marked
    both = marked.select(F.col("doc").alias("_doc"), F.col("same").alias("_same"), F.col("spans").alias("marked")).join(gone, _on(("_doc", "_same"), ("doc", "same")), "left").select("_doc", "_same", "spans", "marked")
    spans = small(written(both, "both-spans"))
    ids = dict(docs.select(F.col(id_column).alias("doc")).dtypes)["doc"]
    own = docs.select(F.col(id_column).alias("doc"), F.xxhash64(text).alias("same"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    joined = own.join(spans, _on(("doc", "same"), ("_doc", "_same")), "left").select("doc", "t", "spans", "marked")

    def apply(batches):
        for b in batches:
            out = []
            for raw, spans, marked in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                kept, at = [], 0
                for x in spans or ():
                    kept.append(raw[at : x["start"]])
                    at = x["end"]
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), len(spans or ()), hashlib.sha256(kept).hexdigest(), sum(x["end"] - x["start"] for x in marked or ()), kept if bodies else None))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept"])

    done = joined.mapInArrow(apply, f"doc {ids}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept binary").withColumnRenamed("doc", id_column)
    return done if bodies else done.drop("kept")
