"""Near-duplicates by HyperMinHash: which documents share at least 0.8 of their four-word shingles.

A document's shingle hashes are dealt into 128 buckets by their upper bits; of the least hash in a bucket a
16-bit register keeps the number of leading zeros and the 10 bits after the first one (Yu and Weber,
"HyperMinHash: MinHash in LogLog space", 2017). A register without a hash is zero.

Documents with equal shingle sets are one class, and only classes are compared. Four registers make one of
32 bands; classes that agree in a band that isn't empty are candidates. At the threshold a pair of large sets misses all
bands with a probability of (1 - 0.8^4)^32 = 5e-8; sets of few shingles have bands that no differing shingle
touches. Candidates go on if the Jaccard estimate from their registers, less the matches that hashes of
different shingles make by chance, isn't more than five standard errors below the threshold; then their
whole shingle sets decide.

Links are looked for in two steps, so that a group of many near copies never makes all its pairs. First every
class is compared with one leader: of the least classes of its bands, the one it shares most bands with. The
components of those links decide what is left to compare: classes that meet in a band, are close in size and are in
different components. They are compared within their band's groups, which are cut into pairs of blocks of bounded
size: by registers at first, then, where a class comes close to one of another component, by whole sets. A task gives one link for
each two components it joins, so what comes out grows with classes, not with pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longitrack.llm.common import remove, short_batches, spread_join, written
from longitrack.llm.components import connected_components
from longitrack.session import ship

SHINGLE = 4
SIMILARITY = 80  #: percent
BUCKET_BITS, MANTISSA_BITS = 7, 10
REGISTERS, BAND = 1 << BUCKET_BITS, 4
#: How far below the threshold, in standard errors, an estimate may be without ruling a pair out.
ERRORS = 5.0
#: Groups of a band are compared in blocks of about so many classes, or so many shingles where they are long.
BLOCK, SHINGLES = 1024, 1 << 20
#: Pairs of registers compared at a time.
PAIRS = 1 << 15

_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(raw: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; a text of fewer words has one, without words none."""
    ws = (raw or b"").lower().split()  # both on ASCII alone, as bytes do
    if not ws:
        return np.empty(0, np.uint64)
    hs = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))
    n = min(n, len(ws))
    out = np.full(len(ws) - n + 1, n, np.uint64)
    for k in range(n):
        out += hs[k : len(ws) - n + 1 + k] * _SEEDS[k]
    return np.unique(_mixed(out))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 128 registers of a sorted set: leading zeros plus one in the upper six bits, mantissa below."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: a bucket's first hash is its least
        rest = (hashes[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)  # 53 bits, exact as floats
        length = np.frexp(rest.astype(np.float64))[1].astype(np.uint64)
        mantissa = np.where(length > 0, (rest << (np.uint64(54) - np.maximum(length, np.uint64(1)))) & np.uint64((1 << 53) - 1), np.uint64(0)) >> np.uint64(53 - MANTISSA_BITS)
        out[bucket[first]] = ((np.uint64(54) - length) << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    return out


def _chance_table() -> tuple[np.ndarray, np.ndarray]:
    """Log sizes, and for two disjoint sets of that size how many registers are expected to match by chance."""
    sizes = np.exp2(np.arange(0, 41, dtype=np.float64))
    zeros = np.arange(54)[:, None]
    low = np.exp2(-zeros - 1.0) * (1 + np.arange(1 << MANTISSA_BITS) / (1 << MANTISSA_BITS))  # a bucket's share of hashes below each register value
    high = low + np.exp2(-zeros - 1.0 - MANTISSA_BITS)
    out = [REGISTERS * ((np.exp(n * np.log1p(-low / REGISTERS)) - np.exp(n * np.log1p(-high / REGISTERS))) ** 2).sum() for n in sizes]
    return np.log(sizes), np.array(out)


_chance: list[tuple[np.ndarray, np.ndarray]] = []


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers of sets of n and m members, and on how many registers each rests.

    Matches expected by chance are taken off; they depend on both sizes, which are close where it matters, so their
    geometric mean stands for them.
    """
    if not _chance:
        _chance.append(_chance_table())
    some = ((x | y) != 0).sum(axis=-1)
    same = ((x == y) & (x != 0)).sum(axis=-1)
    by_chance = np.interp((np.log(np.maximum(n, 1)) + np.log(np.maximum(m, 1))) / 2, *_chance[0])
    return (same - by_chance * (1 - same / np.maximum(some, 1))) / np.maximum(some, 1), some


def close(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may be at the threshold: sizes allow it and the estimate does not rule it out."""
    got, some = estimate(x, y, n, m)
    t = percent / 100
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (got >= t - ERRORS * np.sqrt(t * (1 - t) / np.maximum(some, 1)))


def _matrix(column: pa.Array, kind=np.uint16, width: int = REGISTERS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, same, text) to (id, same, n, class, registers)."""
    for b in batches:
        sets = [shingle_set(t.as_py()) for t in b.column(2).cast(pa.binary())]
        sig = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        regs = pa.array([registers(s).tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.int64()), regs], names=["id", "same", "n", "class", "registers"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, registers) to (key, band, class) for each band with a hash."""
    for b in batches:
        if b.num_rows:
            bands = _matrix(b.column(1), np.uint64, REGISTERS // BAND)
            row, band = np.nonzero(bands)
            keys = _mixed(bands[row, band] * _SEEDS[0] + _SEEDS[band + 16]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(band.astype(np.int8)), b.column(0).take(pa.array(row))], names=["key", "band", "class"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) to (class, members): the whole sets, for verification."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in b.column(1).cast(pa.binary())], pa.binary())], names=["class", "members"])


def _estimated(percent: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, n_a, n_b, r_a, r_b) to the (a, b) that may be at the threshold."""
        for b in batches:
            if b.num_rows:
                keep = close(_matrix(b.column(4)), _matrix(b.column(5)), b.column(2).to_numpy(), b.column(3).to_numpy(), percent)
                yield b.select(["a", "b"]).filter(pa.array(keep))

    return f


def _similar(percent: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, members of a, members of b) to the (a, b) at the threshold."""
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # two sorted runs: merged
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return f


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Batches sorted by their first columns, cut into tables of one group each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [c.to_numpy() for c in b.columns[:n_keys]]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if held and any(k[0] != held[0].column(i)[0].as_py() for i, k in enumerate(keys)):
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *cuts.tolist(), b.num_rows]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _shared(sets: list[np.ndarray]):
    """A function of one set to how many members it shares with each of these sets, by one index over all."""
    size = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]

    def f(own: np.ndarray) -> np.ndarray:
        lo, many = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        many -= lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        return np.bincount(owner[at], minlength=len(sets))

    return f


def _first_band(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first band in which rows of registers agree."""
    x, y = (np.ascontiguousarray(v).view(np.uint64) for v in (x, y))
    return ((x == y) & (x != 0)).argmax(axis=1)


def _possible(g: pa.Table, comp: np.ndarray, regs: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of a group that may be linked: of different components, in this pair of blocks, close by their registers.

    A pair that meets in several bands is one of the first alone, and of one class of sizes: two rows that are both of the
    class below have met there.
    """
    side, below, band = (g.column(c).to_numpy() for c in ("side", "below", "band"))
    asks, asked = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for at in range(0, len(asks), step := max(1, PAIRS // max(1, len(asked)))):
        x = asks[at : at + step, None]
        i, j = np.nonzero((comp[x] != comp[asked]) & ~(below[x] & below[asked]) & ((side[x] != 2) | (x < asked)))
        i, j = x[i, 0], asked[j]
        i, j = (v[_first_band(regs[i], regs[j]) == band[0]] for v in (i, j)) if len(i) else (i, j)
        keep = close(regs[i], regs[j], n[i], n[j], percent)
        yield i[keep], j[keep]


def _promising(percent: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (_DEALT, registers): the (key, size, class) with a possible partner in another component."""
        for g in _groups(batches, 4):
            found = np.zeros(len(g), bool)
            for i, j in _possible(g, g.column("comp").to_numpy(), _matrix(g.column("registers")), g.column("n").to_numpy(), percent):
                found[i] = found[j] = True
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(g.column(c).to_numpy()[found]) for c in ("key", "size", "class")], names=["key", "size", "class"])

    return f


def _verified(percent: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (_DEALT, members): links between components at the threshold, one for each two that a group joins."""
        for g in _groups(batches, 4):
            sets = [np.frombuffer(v, np.uint64) for v in g.column("members").to_pylist()]
            n, cls = g.column("n").to_numpy(), g.column("class").to_numpy()
            _, comp = np.unique(g.column("comp").to_numpy(), return_inverse=True)
            regs, shared, out = np.array([registers(s) for s in sets]), None, []
            for i, j in _possible(g, comp.copy(), regs, n, percent):
                for x in np.unique(i):
                    y = j[(i == x)]
                    y = y[comp[y] != comp[x]]  # not joined meanwhile
                    if len(y) > 8:
                        shared = shared or _shared(sets)
                        both = shared(sets[x])[y]
                    else:
                        both = np.array([len(np.intersect1d(sets[x], sets[k], assume_unique=True)) for k in y], np.int64)
                    for k in y[100 * both >= percent * (n[x] + n[y] - both)]:
                        if comp[k] != comp[x]:
                            out.append((cls[x], cls[k]))
                            comp[comp == comp[k]] = comp[x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return f


def _two(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with a table's columns for both, first all of a's, then all of b's, by column."""
    for side in "ab":
        pairs = pairs.join(table.select(F.col("class").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs.select("a", "b", *(f"{c}_{side}" for c in columns for side in "ab"))


_DEALT = ("key", "size", "i", "j", "side", "band", "below", "class", "comp", "n")


def _mixed_only(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of groups with more than one component."""
    mixed = rows.groupBy(*keys).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(*keys)
    return rows.join(mixed, keys)


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """rows (key, size, class, comp, n) for each pair (i, j) of blocks of their group that they are in; side is 0 in i, 1 in j, 2 if i = j.

    A block holds about `block` classes, or SHINGLES of their shingles if those are fewer classes.
    """
    load = rows.groupBy("key", "size").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    own = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("class", "key"), F.col("blocks"))).cast("int")
    each = rows.join(load, ["key", "size"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return each.select("key", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), *_DEALT[5:])


def links(classes: DataFrame, texts: DataFrame, percent: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) between classes that join all classes at the threshold.

    classes: (class, n, registers, id, same), texts: (id, same, text), the row of each class among them. Every link given
    is at the threshold; pairs whose ends other links join need not be among them.
    """
    keys = classes.select("class", "registers").mapInArrow(_bands, "key long, band byte, class long")
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("met"), F.min("class").alias("leader")).where("met > 1")
    held = written(keys.join(met.select("key", "leader"), "key"), "bands")
    estimated = lambda pairs: _two(pairs, classes, "n", "registers").mapInArrow(_estimated(percent), "a long, b long")

    stars = held.where("class <> leader").groupBy("class", "leader").agg(F.count(F.lit(1)).alias("bands"))
    chosen = stars.groupBy("class").agg(F.max_by("leader", F.struct("bands", "leader")).alias("b")).select(F.col("class").alias("a"), "b")
    wanted = classes.join(held.select("class").distinct(), "class", "left_semi").select("id", "same", "class")
    with short_batches(classes.sparkSession, 500):
        mine = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["same"] == wanted["same"]))
        sets = written(mine.select("class", "text").mapInArrow(_sets, "class long, members binary").dropDuplicates(["class"]), "sets")
        similar = lambda pairs: _two(pairs, sets, "members").mapInArrow(_similar(percent), "a long, b long")
        first = written(similar(estimated(chosen)), "first-links")

        parts = written(connected_components(first).select(F.col("node").alias("class"), F.col("component").alias("comp")), "first-components")
        placed = held.select("key", "band", "class").join(parts, "class", "left").select("key", "band", "class", F.coalesce("comp", "class").alias("comp"))
        rest = _mixed_only(placed, ["key"]).join(classes.select("class", "n"), "class")
        # sets at the threshold differ in size by 1 / 0.8 at most: they are in one class of sizes or in neighbouring ones
        step = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent)) - F.lit(1e-9)).cast("long")
        near = F.explode(F.array(F.struct(step.alias("size"), F.lit(False).alias("below")), F.struct((step + 1).alias("size"), F.lit(True).alias("below"))))
        rest = written(_mixed_only(rest.withColumn("s", near).select("key", "band", "class", "comp", "n", "s.*"), ["key", "size"]), "mixed-bands")
        in_blocks = lambda rows: rows.repartition("key", "size", "i", "j").sortWithinPartitions("key", "size", "i", "j")

        maybe = in_blocks(_dealt(rest, block).join(classes.select("class", "registers"), "class").select(*_DEALT, "registers"))
        maybe = written(maybe.mapInArrow(_promising(percent), "key long, size long, class long").distinct(), "promising")
        near_by = _dealt(rest.join(maybe, ["key", "size", "class"]), block)
        second = in_blocks(near_by.join(sets, "class").select(*_DEALT, "members")).mapInArrow(_verified(percent), "a long, b long")
        found = written(first.unionByName(second), "links")
    for table in (held, sets, first, parts, rest, maybe):
        remove(table)
    return found


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = SIMILARITY, **options) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; kept is true where the row's id is its component's.

    Null, empty and blank texts have no shingle and are linked with nothing: each row is its own component. A text with
    fewer than four words is one shingle. Repeated rows stay repeated, with one component. A row with a null id belongs
    to the component of its text, whose id is the least that isn't null; where all ids of it are null, so is
    component_id, and such rows are kept. Other columns aren't read. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))
    with short_batches(docs.sparkSession):
        rows = written(texts.mapInArrow(_sketches, "id long, same long, n long, class long, registers binary"), "sketches")
    named = rows.where("n > 0")
    classes = named.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same")).alias("k"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = written(classes.select("class", "n", "registers", "k.id", "k.same"), "classes")
    joined = links(classes, texts, percent, **options)
    remove(classes)
    parts = connected_components(joined)
    placed = spread_join(named.select("id", "n", "class"), parts.withColumnRenamed("node", "class"), "class", "left").select("id", "n", F.coalesce("component", "class").alias("component"))
    placed = written(placed, "components")
    remove(joined)
    ids = written(placed.groupBy("component").agg(F.min("id").alias("component_id")), "component-ids")
    found = spread_join(placed, ids, "component").select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
