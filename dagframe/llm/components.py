"""Connected components of a large edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagframe.llm.common import BROADCAST_BYTES, Scratch

#: Files of a table of few edges.
FEW_FILES = 8


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges (a, b) of any comparable type -> (node, root), root the least node of its component, for all nodes with an edge.

    Every step works on edges alone, counts neighbours with partial aggregation and joins the
    least neighbour back, so that a node with a third of all edges is no single task's work;
    where edges were counted to be few, the least neighbours are broadcast rather than written
    first, and the tables of a round have few files.
    The number of rounds grows with the logarithm of the longest path.
    """
    now, k = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"), 0

    def state() -> tuple[int, bool]:
        """The number of edges, and whether each leads from a node, which has no other, to one that has none."""
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        row = nodes.agg(F.coalesce(F.sum("out"), F.lit(0)).alias("n"), F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).alias("open")).first()
        return row.n, not row.open

    def stars(df: DataFrame, both: bool, few: bool, save_as: str) -> DataFrame:
        # large star: all neighbours, links to the greater ones move; small star: links to lesser ones move
        around = df.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if both:
            around = around.unionByName(df.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = F.broadcast(least) if few else scratch.save(least, f"{save_as}-least")
        joined = around.join(least, "u")
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if both else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        moved = moved.where("a > b").distinct()
        out = scratch.save(moved.coalesce(FEW_FILES) if few else moved, save_as)
        if not few:
            scratch.drop(f"{save_as}-least")
        return out

    while True:
        n, rest = state()
        few = 128 * n <= BROADCAST_BYTES
        if rest:
            break
        k += 1
        large = stars(now, True, few, f"{name}-{k}-large")
        now = stars(large, False, few, f"{name}-{k}")
        scratch.drop(f"{name}-{k}-large")
        scratch.drop(f"{name}-{k - 1}")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return scratch.save(roots.coalesce(FEW_FILES) if few else roots, f"{name}-roots")
