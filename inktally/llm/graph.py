"""Connected components of a table of links, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inktally.llm.common import stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach. Nodes without a link are not listed.

    Large-star and small-star in turn: every node's larger neighbours, then its smaller ones, are hung on its
    smallest. The links end as stars; the number of rounds grows with the logarithm of the longest path.
    Each round is written to the shared folder.
    """
    low, high = F.least(a, b).alias("b"), F.greatest(a, b).alias("a")
    edges, before = stored(links.select(high, low).where("a > b").distinct(), "links"), None
    while True:
        print_of = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if print_of == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = print_of
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
