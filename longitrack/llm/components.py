"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step groups edges by one end and hangs the neighbours on the group's least node (Kiveris et al.,
"Connected Components in MapReduce and Beyond", 2014). Groups are reduced to their minimum before a
join, never gathered, so a node with very many neighbours needs no large task; each round is written to
the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longitrack.llm.common import remove, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b. Large: every larger neighbour of a node joins the least of its
    neighbourhood; small: the node and its smaller neighbours do."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component being the least node it can reach.

    edges: any table with two long columns; direction, repeats and loops do not matter, rows with a null
    end are left out. A node that only has loops is its own component. An empty table gives an empty one.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    loops = pairs.where("x = y").select(F.col("x").alias("node"))
    now = written(pairs.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    size = None
    while True:
        # a fixed point is a forest of stars whose edges no step changes: count and sums tell
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == size:
            break
        size = state
        after = written(_star(_star(now, True), False), "edges")
        remove(now)
        now = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("component").alias("node")).unionByName(loops).distinct()
    alone = roots.join(stars.select("node"), "node", "left_anti")
    return stars.unionByName(alone.select("node", F.col("node").alias("component")))
