"""Connected components of a graph given as an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.common import keep_table


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every node that has an edge: node, root.

    ``edges`` has columns a and b of one ordered type. Nodes are joined to ever smaller
    neighbours, first larger ones and then smaller ones, until only stars are left; the
    number of rounds grows with the logarithm of the size. Each round is a table in the
    shared folder, so nothing is collected and a lost executor costs one round at most.
    """
    now = keep_table(_ordered(edges.select("a", "b")), "edges")
    before = None
    while True:
        mark = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if before == mark:
            return (
                now.select(F.col("a").alias("node"), F.col("b").alias("root"))
                .union(now.select("b", "b")).groupBy("node").agg(F.min("root").alias("root"))
            )
        before = mark
        now = keep_table(_small_star(_large_star(now)), "edges")


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _ordered(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    met = edges.join(least, "a")
    return _ordered(met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")))
