"""Connected components of a table of links, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageaudit.session import dealt, written


def _least(pairs: DataFrame) -> DataFrame:
    """The least neighbour of each left node; written, so that the join with the pairs can split a node that many pairs share."""
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node and component (the least node reachable) of every node in ``links``; each link may come once or often, in either direction.

    Each round links larger neighbours to the least one, then smaller ones; rounds grow with the logarithm of the
    longest chain. Neighbours are never listed: a node's rows are only reduced to their least and joined with it.
    """
    edges = written(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(), "edges"
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(dealt(_least(both)), "u").select(F.greatest("u", "v").alias("x"), "u", "v", F.least("u", "m").alias("m"))
        edges = written(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least = _least(edges)
        small = edges.join(dealt(least), "u")
        edges = written(
            small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges"
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
