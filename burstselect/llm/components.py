"""Connected components of a graph whose links live in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstselect.llm.common import pin


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that a link (a, b) names; root is the smallest node that can be reached.

    Alternates two steps until each component is a star: every node's larger neighbours are linked to its smallest one, then its
    smaller neighbours are. Each step groups links by node, with partial sums, and takes minima only, so a node with very many
    links costs no more than its rows; the number of rounds grows with the logarithm of the graph's size. Rows are written
    to the shared folder after each round. No links, loops and repeated links are fine; a null end makes no link.
    """
    now = pin(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    )
    for _ in range(max_rounds):
        # Done once every node has one link, to a node that has none: then each component is a star around its smallest node.
        twice = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        onward = now.join(now.select(F.col("a").alias("n")).distinct(), F.col("b") == F.col("n"), "left_semi").select("a")
        if twice.unionByName(onward).isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        now = pin(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(links: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest of its neighbours and itself. Links run from larger to smaller."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    both = links.join(low.withColumnRenamed("a", "n"), F.col("b") == F.col("n"), "left")
    # (a, b): a is a larger neighbour of b, whose smallest neighbour, if it has a smaller one, is low.
    return both.select("a", F.coalesce("low", "b").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    both = links.join(low, "a")
    moved = both.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()
