"""Connected components of an edge table, and joins on keys that very many rows have."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import written

#: Rows of a key from which on it is hot, at least, and the most keys that can be hot.
HOT_ROWS, HOT_KEYS = 1000, 50_000


def hot_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, rows: int, how: str = "inner") -> DataFrame:
    """left with the columns of right, which has one row for each key and in `weight` the number of left's rows that have
    it (or more); rows: the sum of all weights, or more. how: inner or left.

    Keys with more than HOT_ROWS rows, and more than a HOT_KEYS-th of all rows, are at most HOT_KEYS, so their rows of
    right may be broadcast and those of left stay where they are. All other keys are joined by a shuffle."""
    heavy = max(HOT_ROWS, rows // HOT_KEYS)
    hot = F.broadcast(right.where(F.col(weight) > heavy).withColumn("_hot", F.lit(True)))
    both = left.join(hot, on, "left")
    cold = both.where("_hot IS NULL").select(*left.columns).join(right.where(F.col(weight) <= heavy), on, how)
    names = [*left.columns, *(c for c in right.columns if c not in on)]
    return both.where("_hot").select(*names).union(cold.select(*names))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges, whose columns u and v hold ids that are not
    null.

    Alternates large-star and small-star steps (each node's larger neighbours, then its smaller ones, are tied to the
    smallest node that it knows), until the edges are stars: every node has one edge to a smaller one or none, and none
    that others lead to has one. Each round is a few joins and aggregations on the node, which
    combine before the shuffle, and nodes of very many edges are joined apart; its edges are written to the shared folder,
    so the lineage stays short. The number of rounds grows with the logarithm of the longest path.
    """
    now = written(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct())
    while not is_stars(now):
        total = 2 * now.count()
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).union(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("edges"))
        large = hot_join(both.where("b > a"), least, ["a"], "edges", total).select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges"))
        small = hot_join(large, least, ["u"], "edges", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def is_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty()
