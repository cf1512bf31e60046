"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint takes, in each bit, the majority of the hashes of a text's four-word shingles.
Two fingerprints within four bits agree up to one bit in at least one of three segments, so every
distinct fingerprint is stored under its three segments and looked up under each segment value in the
ball of radius one around its own. The ball is enumerated on one side only: of two values one bit
apart, exactly one has that bit set, and only that one asks for the other. Matches are verified on all
64 bits. Copies share a fingerprint and cost nothing beyond their own row.

Segment values that very many distinct fingerprints share (large groups of near copies) would match in
pairs; there, each fingerprint is linked to the centres of the radius-two balls it lies in. Two
fingerprints are within four bits exactly if they share such a centre, so linking all to the least
member of each centre joins the same components with rows in proportion to the group, not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longitrack.llm.common import short_batches, small, spread_join, unused, written
from longitrack.llm.components import connected_components
from longitrack.session import ship

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: (shift, bits) of the segments, from the low end: 22 + 21 + 21.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A segment value with more distinct fingerprints than this is linked by centres instead of pairs.
PAIRS_UP_TO = 1500

_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(raw: bytes | None, n: int = SHINGLE) -> int:
    """The fingerprint of a text (UTF-8); 0 without words. Only A to Z are lower-cased."""
    ws = (raw or b"").lower().split()  # both on ASCII alone, as bytes do
    if not ws:
        return 0
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(b" ".join(ws[i : i + n]), SEED) for i in range(max(1, len(ws) - n + 1))])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 16):  # bounded temporaries
        ones += bits[at : at + (1 << 16)].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def _of_texts(texts: pa.Array) -> pa.Array:
    values = np.array([fingerprint(x.as_py()) for x in texts.cast(pa.binary())], np.uint64)
    return pa.array(values.view(np.int64))


_fingerprints = F.arrow_udf(_of_texts, T.LongType())


def _of_batches(batches):
    """(id, same, text) batches to (id, same, fp): texts go to Python and nothing waits for them in the JVM."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _of_texts(b.column(2))], names=["id", "same", "fp"])


def with_fingerprints(docs: DataFrame, text: str = "text", column: str = "fp") -> DataFrame:
    """docs with its fingerprints as longs; null and empty texts have 0. Replaces a column of that name."""
    ship(docs.sparkSession)
    return docs.withColumn(column, _fingerprints(F.col(text)))


def _segment(fp, i: int):
    shift, bits = SEGMENTS[i]
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _distance(x, y):
    return F.bit_count(x.bitwiseXOR(y))


def links(fps: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column fp) within DISTANCE bits of each other.

    Pairs between all but those that meet only under crowded segment values, which are joined through
    the least member of each centre they share; every link given is itself within DISTANCE.
    """
    fp = F.col("fp")
    stored = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("seg"), _segment(fp, i).alias("value")) for i in range(len(SEGMENTS)))))
    index = fps.select("fp", stored.alias("s")).select("fp", "s.seg", "s.value")
    # rows of one segment value: how many there are decides the way they are linked
    load = index.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n"))
    crowded = load.where(F.col("n") > pairs_up_to).select("seg", "value")
    held = index.join(crowded, ["seg", "value"], "left_anti")

    tagged = lambda i: lambda v: F.struct(F.lit(i).cast("byte").alias("seg"), v.alias("value"))
    balls = []
    for i, (_, bits) in enumerate(SEGMENTS):
        own = _segment(fp, i)
        flips = F.transform(F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.call_function("shiftright", own, b).bitwiseAND(F.lit(1)) == 1), lambda b: own.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
        balls.append(F.transform(F.concat(F.array(own), flips), tagged(i)))
    asked = fps.select(F.col("fp").alias("q"), F.explode(F.concat(*balls)).alias("s")).select("q", "s.seg", "s.value")
    near = asked.join(held, ["seg", "value"]).where((F.col("q") != fp) & (_distance(F.col("q"), fp) <= DISTANCE))
    found = near.select(F.least("q", "fp").alias("a"), F.greatest("q", "fp").alias("b"))

    # who asks for a crowded value, or lies in one
    dense = asked.join(crowded, ["seg", "value"], "left_semi").select(F.col("q").alias("fp")).distinct()
    one = [1 << k for k in range(64)]
    near_by = [0, *one, *(x | y for i, x in enumerate(one) for y in one[:i])]
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in near_by))
    centres = dense.select("fp", F.explode(F.transform(masks, lambda m: fp.bitwiseXOR(m))).alias("centre"))
    least = centres.groupBy("centre").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("centre", "a")
    starred = centres.join(least, "centre").where("fp <> a").select("a", F.col("fp").alias("b"))
    return found.unionByName(starred).distinct()


def _components(docs: DataFrame, id_column: str, text: str, pairs_up_to: int) -> DataFrame:
    """(id, same, fp, component) of every row; same tells apart texts under one id, component is a fingerprint."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("same"), F.col(text).alias("t"))
    with short_batches(docs.sparkSession):
        rows = written(texts.mapInArrow(_of_batches, "id long, same long, fp long"), "fingerprints")
    fps = rows.select("fp").distinct()
    parts = connected_components(written(links(fps, pairs_up_to), "links"))
    placed = spread_join(rows, parts.withColumnRenamed("node", "fp"), "fp", "left")
    return written(placed.select("id", "same", "fp", F.coalesce("component", "fp").alias("component")), "components")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the least id within reach over links.

    Rows with equal fingerprints are linked, those without words too (their fingerprint is 0). Repeated
    rows stay repeated. A row with a null id keeps its fingerprint and its component, whose id is the
    least that is not null; a component of null ids alone has a null id. Other columns are not read.
    """
    rows = _components(docs, id_column, text, pairs_up_to)
    ids = written(rows.groupBy("component").agg(F.min("id").alias("component_id")), "component-ids")
    return spread_join(rows, ids, "component").select(F.col("id").alias(id_column), "fp", "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """One document of each component, that with the least id (null last), with its own columns.

    Of several texts under that id, and of rows that repeat both, one stays. What goes is looked up by id
    and text, so texts move only if very many documents go.
    """
    rows = _components(docs, id_column, text, pairs_up_to)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same")).alias("k")).select("component", F.col("k.id").alias("k_id"), F.col("k.same").alias("k_same"))
    keys = written(rows.groupBy("id", "same", "component").agg(F.count(F.lit(1)).alias("n")), "texts")
    keys = spread_join(keys, written(first, "first"), "component")
    k_id, k_same = unused(docs, "_id"), unused(docs, "_same")
    named = lambda df: df.select(F.col("id").alias(k_id), F.col("same").alias(k_same))
    is_first = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("same") == F.col("k_same"))
    gone = small(written(named(keys.where(~is_first)), "gone"))
    repeated = small(written(named(keys.where(is_first & (F.col("n") > 1))), "repeated"))
    alike = docs[id_column].cast("long").eqNullSafe(F.col(k_id)) & (F.xxhash64(docs[text]) == F.col(k_same))
    kept = docs.join(gone, alike, "left_anti")
    if repeated.isEmpty():
        return kept
    one = docs.join(repeated, alike, "left_semi").withColumn(k_same, F.xxhash64(docs[text])).dropDuplicates([id_column, k_same]).drop(k_same)
    return kept.join(repeated, alike, "left_anti").unionByName(one)


