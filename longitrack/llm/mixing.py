"""Mixing sources to target weights, in blocks of tokens.

The documents of a source, in a fixed pseudorandom order, form one stream of tokens that is packed into
blocks of fixed length. A source's target says how many slots of the mix are its own; every output shard
draws its sources' counts from the multinomial distribution of these, and what a source draws over or under
its own slots in all is evened out. Slot j of a source takes the block to which a pseudorandom permutation
of the source's block indices, one for each pass, maps j, and blocks are joined to slots by index.
Only numbers move: no text is read after its tokens are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longitrack.llm.common import WORD, small, written

BLOCK = 128
SHARD_SLOTS = 8192
MAX_PASSES = 3
ROUNDS = 12
SEED = 42
#: Weights of the sources in order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Slots made in one task.
_TASK = 1 << 16


def counted(docs: DataFrame, id_column: str, source: str, text: str) -> DataFrame:
    """(doc, source, size) of every row; a null text has size 0."""
    return docs.select(F.col(id_column).alias("doc"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, no, source_size, target): sources by code point, null last, share the total by weight.

    No target is above max_passes times its source's size; what is over goes to the others by weight.
    That is a level: each source gets its weight times the level, or its bound. With sources sorted by
    bound over weight, the level is that of the first source whose bound it does not exceed. One row
    a source; sources are named collections, so their windows hold few rows.
    """
    everything = Window.partitionBy()
    ordered = everything.orderBy(F.col("source").asc_nulls_last())
    by_bound = everything.orderBy("ratio", "no")
    n = F.lit(len(weights))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("no"), n) + 1).cast("int"))
    base = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    base = base.withColumn("no", F.row_number().over(ordered) - 1).withColumn("w", w)
    base = base.withColumn("bound", F.col("source_size") * F.lit(float(max_passes))).withColumn("ratio", F.col("bound") / F.col("w"))
    before = F.coalesce(F.sum("bound").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    base = base.withColumn("level", (F.sum("source_size").over(everything) - before) / left)
    # capped sources come first; the first that is not has the level
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no", "level"))).over(everything)["level"]
    return base.withColumn("target", F.least(F.col("bound"), F.coalesce(level, F.lit(0.0)) * F.col("w"))).select("source", "no", "source_size", "target")


def _permuted(x: Column, n: Column, key: Column, rounds: int) -> Column:
    """x under a pseudorandom permutation of 0..n-1 (swap-or-not: Hoang, Morris and Rogaway, 2012)."""

    def step(now: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - now, n)
        swap = F.xxhash64(key, r + rounds, F.greatest(now, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(now)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def allotted(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """(no, blocks, cut, n): of each source with tokens, its blocks, the slots it is due, and how long the last is if cut.

    A source whose target is E passes and R tokens more has E slots for each of its blocks, then R // block whole slots
    and one that is cut. A block is thus taken at most E + 1 times.
    """
    want = F.round("target").cast("long")
    g = goals.where("source_size > 0").withColumn("passes", F.expr("CAST(round(target) AS BIGINT) DIV source_size")).withColumn("rest", want - F.col("passes") * F.col("source_size"))
    g = g.withColumn("blocks", F.expr(f"(source_size + {block - 1}) DIV {block}")).withColumn("cut", F.expr(f"rest % {block}"))
    g = g.withColumn("n", F.col("passes") * F.col("blocks") + F.expr(f"rest DIV {block}") + F.when(F.col("cut") > 0, 1).otherwise(0))
    return g.where("n > 0").select("no", "blocks", "cut", "n")


def _upto(value: str, *order: str) -> Column:
    """The sum of value over the rows before; one row a source."""
    return F.coalesce(F.sum(value).over(Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def drawn(due: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, no, count): the multinomial draw of each output shard, each source as likely as it is due slots.

    Every slot of a shard draws its source by a hash; the sources' stretches of [0, total) are looked up by buckets of about
    a quarter of a mean stretch, which makes at most five rows a source.
    """
    spark = due.sparkSession
    sources, total = due.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = max(1, total // (4 * max(1, sources)))
    stretches = due.withColumn("first", _upto("n", "no")).select("no", "n", "first", F.explode(F.expr(f"sequence(first DIV {width}, (first + n - 1) DIV {width})")).alias("bucket"))
    slots = spark.range(0, total, 1, min(10_000, max(1, -(-total // _TASK)))).select(F.expr(f"id DIV {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(1, total))).alias("x"))
    found = slots.withColumn("bucket", F.expr(f"x DIV {width}")).join(small(written(stretches, "stretches")), "bucket").where("x >= first AND x < first + n")
    return found.groupBy("shard", "no").agg(F.count(F.lit(1)).alias("count"))


def slots(goals: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """The mix: (shard, no, slot, block, words), `words` being how many tokens the slot takes from its block.

    Each shard draws its sources' counts. Over all shards a source draws nearly, not exactly, what it is due: slots over
    that, spread over the shards by a permutation of the source's slots, go to the sources that lack some. Numbers of blocks are below 2^62.
    """
    due = written(allotted(goals, block), "allotted")
    counts = written(drawn(due, shard_slots, seed), "draws")
    # a running sum over each source's shards in two steps, so that no task has all of them
    parts = counts.withColumn("part", F.expr("shard DIV 1024"))
    per_part = parts.groupBy("no", "part").agg(F.sum("count").alias("s"))
    earlier = Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select("no", "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("no", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("at", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(per_part, ["no", "part"]).select("shard", "no", "count", (F.col("start") + F.col("at")).alias("start"))
    got = due.join(counts.groupBy("no").agg(F.sum("count").alias("got")), "no", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    got = got.withColumns({"over": F.greatest(F.col("got") - F.col("n"), F.lit(0)), "short": F.greatest(F.col("n") - F.col("got"), F.lit(0))})
    got = written(got.withColumns({"over_before": _upto("over", "no"), "short_before": _upto("short", "no")}), "drawn-totals")

    total = due.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = starts.repartition(min(10_000, max(1, -(-total // _TASK))), "no", "shard").join(small(got), "no")
    each = dealt.select("shard", "no", "n", "got", "over_before", F.explode(F.expr("sequence(start, start + count - 1)")).alias("j"))
    mixed = F.when(F.col("got") <= F.col("n"), F.col("j")).otherwise(_permuted(F.col("j"), F.col("got"), F.xxhash64(F.lit(seed), F.lit("over"), "no"), rounds))
    each = each.select("shard", "no", mixed.alias("slot"), "n", "over_before")
    kept = each.where("slot < n").select("shard", "no", "slot")
    spare = each.where("slot >= n").select("shard", (F.col("over_before") + F.col("slot") - F.col("n")).alias("rank"))
    owed = got.where("short > 0").select("no", "got", "short_before", F.explode(F.expr("sequence(short_before, short_before + short - 1)")).alias("rank"))
    filled = spare.join(owed, "rank").select("shard", "no", (F.col("got") + F.col("rank") - F.col("short_before")).alias("slot"))
    placed = kept.unionByName(filled).join(small(due), "no")
    key = F.xxhash64(F.lit(seed), "no", F.expr("slot DIV blocks"))
    return placed.select(
        "shard",
        "no",
        "slot",
        _permuted(F.expr("slot % blocks"), F.col("blocks"), key, rounds).alias("block"),
        F.when((F.col("slot") == F.col("n") - 1) & (F.col("cut") > 0), F.col("cut")).otherwise(F.lit(block).cast("long")).alias("words"),
    )


def placed_pieces(docs: DataFrame, id_column: str, source: str, text: str, block: int, weights, seed: int) -> tuple[DataFrame, DataFrame]:
    """The targets, and the blocks' contents: (no, doc, size, copy, at, block, source_size, target), `at` being where a document starts in its source."""
    sizes = written(counted(docs, id_column, source, text), "sizes")
    goals = small(written(targets(sizes, weights), "targets"))
    units = sizes.groupBy("source", "doc", "size").agg(F.count(F.lit(1)).alias("n"))
    units = units.join(goals.withColumnRenamed("source", "goal"), F.expr("source <=> goal")).drop("goal")
    # a running sum over each source in two steps, in about sqrt(rows) groups, so that no task has a whole source
    groups = max(1, int(sizes.count() ** 0.5))
    units = written(units.withColumn("h", F.xxhash64(F.lit(seed), "doc")).withColumn("part", F.pmod("h", F.lit(groups))), "units")
    parts = units.groupBy("no", "part").agg(F.sum(F.col("size") * F.col("n")).alias("s"))
    before = Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("no", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("no", "part").orderBy("h", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("at", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))).join(starts, ["no", "part"])
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("at", F.col("start") + F.col("at") + (F.col("copy") - 1) * F.col("size"))
    return goals, copies.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.expr(f"sequence(at DIV {block}, (at + size - 1) DIV {block})"))))


def _stretch(block: int) -> tuple[Column, Column]:
    """Which tokens of its block a slot takes from a document: from the first on, up to the last, which a cut may end."""
    first = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    return first, F.least(F.col("at") + F.col("size") - F.col("block") * block, F.col("words"))


def shards(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, weights=WEIGHTS, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """What the output shards hold: (shard, no, slot, id, start, end), the tokens [start, end) of a document that a slot takes. See mix()."""
    goals, pieces = placed_pieces(docs, id_column, source, text, block, weights, seed)
    first, last = _stretch(block)
    held = pieces.join(slots(goals, block, shard_slots, seed=seed).hint("merge"), ["no", "block"]).withColumns({"first": first, "last": last}).where("first < last")
    offset = F.col("block") * block - F.col("at")
    return held.select("shard", "no", "slot", F.col("doc").alias(id_column), (offset + F.col("first")).alias("start"), (offset + F.col("last")).alias("end"))


def mix(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken) of every row: how many of its tokens the mix takes, repeats counted.

    Reruns agree: order, draws and permutations are hashes of ids, source numbers and the seed. Rows that
    agree in id, source and size are interchangeable. Null ids, sources and texts are values like others;
    texts without words take nothing. An empty table gives an empty one. Other columns are not read.
    """
    goals, pieces = placed_pieces(docs, id_column, source, text, block, weights, seed)
    taken = slots(goals, block, seed=seed).groupBy("no", "block", "words").agg(F.count(F.lit(1)).alias("times"))
    # the tokens of a document in a block, and of these the ones before a slot's cut
    first, last = _stretch(block)
    got = F.coalesce(F.greatest(last - first, F.lit(0)) * F.col("times"), F.lit(0))
    # its size follows the mix, whatever the planner makes of the few rows that its slots come from
    joined = pieces.join(taken.hint("merge"), ["no", "block"], "left")
    return joined.groupBy("no", "doc", "size", "copy", "source_size", "target").agg(F.sum(got).alias("taken")).select(F.col("doc").alias(id_column), "size", "source_size", "target", "taken")
