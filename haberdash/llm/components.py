"""Connected components of a graph given as edges, by alternating stars.

Each round links every node's larger neighbours, then its smaller ones, to the smallest
node around it; rounds go on until nothing changes, a number that grows with the
logarithm of the longest path. Each round is stored, so a plan never holds more than
one. No neighbour list is gathered: a node with many edges is reduced by a minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haberdash.llm.tables import stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; ``edges`` has two columns of longs."""
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    pairs = stored(pairs, "edges")
    before = _signature(pairs)
    while before[0]:
        pairs = stored(_small_star(_large_star(pairs)), "stars")
        after = _signature(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(pairs.select(F.col("a").alias("node"), F.col("b").alias("root")))
