"""Connected components of links, by alternating large-star and small-star steps.

Each step gives a node's neighbours to the smallest node near it, so long chains shrink quickly and a node with
very many links only ever takes part in joins on a column that Spark can split. Each round is written to the
shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm._shared import cut

#: Rounds after which something must be wrong; the steps need about the square of the logarithm of the nodes.
MOST_ROUNDS = 100


def _least(pairs: DataFrame) -> DataFrame:
    """u and the least of its v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on distinct edges u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = _least(large)
    small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node it is linked to, in however many steps) of every node with a link.

    Links of a node with itself, repeated links and links with a null are ignored.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct())
    state = None
    for _ in range(MOST_ROUNDS):
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == state:
            break
        state = (row.n, row.h)
        edges = cut(_step(edges))
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
