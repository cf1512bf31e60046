"""Benchmark decontamination: which documents contain which test items.

Containment is the share of an item's distinct five-word shingles (lower-cased; an item of fewer words is
one shingle of its own width) that a document has. Candidates come from MinHash sketches partitioned by
item size: of an item with n shingles of which `need` must be found, only the n - need + 1 least hashes are
kept, since a document that lacks all of those cannot reach `need`. The sketch so grows with the item,
misses nothing, and is looked up among all hashes of a long document, whose own length does not
dilute it. Each size class knows its largest sketch hash and least `need`; a document offers only hashes up
to the largest bound of the classes it is long enough for. Candidates are then verified on the shingles
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longitrack.llm.common import small, unused, words, written

SHINGLE = 5
THRESHOLD = 0.8


def _shingles(ws: Column, width: int | Column) -> Column:
    """The shingles of a width, in order, words joined by spaces; none if there are too few words."""
    last = F.size(ws) - width + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(ws, i, width), " "))).otherwise(F.array().cast("array<string>"))


def _hashes(hs: Column, width: int) -> Column:
    """Hashes of the shingles of a width from the hashes of the words."""
    last = F.size(hs) - width + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(F.lit(width), *(F.get(hs, i + k) for k in range(width)))))


def _below(hashes: Column, top: Column) -> Column:
    return F.filter(hashes, lambda h: h <= top)


def _need(n: Column, threshold: float) -> Column:
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9))


def items_with_shingles(items: DataFrame, id_column: str, text: str, threshold: float, n: int) -> DataFrame:
    """(item, key, ws, width, shingles, n_item, need) of the distinct items that have a word."""
    own = items.select(F.col(id_column).alias("item"), words(F.lower(text)).alias("ws")).where(F.size("ws") > 0).distinct()
    own = own.withColumn("key", F.xxhash64("item", "ws")).withColumn("width", F.least(F.size("ws"), F.lit(n)))
    own = own.withColumn("shingles", F.array_distinct(_shingles(F.col("ws"), F.col("width"))))
    return own.withColumn("n_item", F.size("shingles").cast("long")).withColumn("need", _need(F.col("n_item"), threshold))


def sketches(items: DataFrame, n: int) -> DataFrame:
    """(key, width, size_class, need, h): the least hashes of each item."""
    hs = F.transform("ws", lambda w: F.xxhash64(w))
    hashed = F.coalesce(*(F.when(F.col("width") == k, _hashes(F.col("hs"), k)) for k in range(1, n + 1)))
    least = F.slice(F.array_sort(F.array_distinct(hashed)), 1, (F.col("n_item") - F.col("need") + 1).cast("int"))
    size_class = F.floor(F.log2("n_item")).cast("int")
    return items.withColumn("hs", hs).select("key", "width", size_class.alias("size_class"), "need", F.explode(least).alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item, n_item, n_shared, containment) for every pair at the threshold or above.

    One row for a pair: repeated rows and rows that share an id count once, with their best containment.
    Null, empty and blank texts contain nothing and items without words are in nothing. Null ids are ids like
    others. Other columns are not read. Either table may be empty.
    """
    own = written(items_with_shingles(items, item_id, item_text, threshold, n), "items")
    sketch = written(sketches(own, n), "sketch")
    # at most n widths of 63 classes: their bounds are known to the driver
    bounds = sketch.groupBy("width", "size_class").agg(F.max("h").alias("top"), F.min("need").alias("need")).collect()
    widths = sorted({b.width for b in bounds})
    texts = docs.select(F.col(id_column).alias("doc"), F.col(text).alias("t"), F.xxhash64(text).alias("same"))
    if not widths:
        widths, bounds = [n], []

    hs = texts.select("same", F.transform(words(F.lower("t")), lambda w: F.xxhash64(w)).alias("hs"))
    offers = []
    for w in widths:
        count = F.size("hs") - (w - 1)
        tops = [F.when(count >= b.need, F.lit(b.top)) for b in bounds if b.width == w]
        top = F.greatest(*tops, F.lit(None).cast("long")) if tops else F.lit(None).cast("long")
        offers.append(_below(_hashes(F.col("hs"), w), top))
    offered = hs.select("same", F.explode(F.concat(*(F.coalesce(o, F.array().cast("array<long>")) for o in offers))).alias("h"))
    candidates = written(offered.join(small(sketch.select("h").distinct()), "h", "left_semi").select("same").distinct(), "candidates")

    near = texts.join(small(candidates), "same", "left_semi").select("doc", "same", words(F.lower("t")).alias("ws"))
    found = near.select("doc", "same", F.explode(F.array_distinct(F.concat(*(_shingles(F.col("ws"), w) for w in widths)))).alias("shingle")).distinct()
    of_items = own.select("item", "key", "n_item", "need", F.explode("shingles").alias("shingle"))
    shared = found.join(small(of_items), "shingle").groupBy("doc", "same", "item", "key", "n_item", "need").agg(F.count(F.lit(1)).alias("n_shared"))
    best = shared.where("n_shared >= need").groupBy("doc", "item").agg(F.max_by(F.struct("n_item", "n_shared"), F.struct(F.col("n_shared") / F.col("n_item"), "n_item")).alias("b"))
    return best.select(F.col("doc").alias(id_column), F.col("item").alias(item_id), "b.n_item", "b.n_shared", (F.col("b.n_shared") / F.col("b.n_item")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no item, with their own columns; all rows of a contaminated id go."""
    name = unused(docs, "_bad")
    bad = contaminated(docs, items, id_column=id_column, **options).select(F.col(id_column).alias(name)).distinct()
    return docs.join(small(written(bad, "contaminated")), docs[id_column].eqNullSafe(F.col(name)), "left_anti")
