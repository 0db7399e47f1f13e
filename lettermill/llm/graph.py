"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _round(links: DataFrame) -> DataFrame:
    """links (big, small), big > small; afterwards nodes hang on smaller ones."""
    both = links.select(F.col("big").alias("node"), F.col("small").alias("near")).unionAll(links.select(F.col("small").alias("node"), F.col("big").alias("near")))
    least = both.groupBy("node").agg(F.min("near").alias("near_least")).select("node", F.least("node", "near_least").alias("least"))
    large = both.where("near > node").join(least, "node").select(F.col("near").alias("big"), F.col("least").alias("small")).distinct()
    center = large.groupBy("big").agg(F.min("small").alias("least"))
    small = large.join(center, "big")
    hung = small.where("small > least").select(F.col("small").alias("big"), F.col("least").alias("small"))
    return hung.unionAll(center.select("big", F.col("least").alias("small"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether each node hangs on one other, which hangs on none."""
    most = links.groupBy("big").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if most is None or most > 1:
        return most is None
    return links.join(links.select(F.col("small").alias("big")).distinct(), "big", "left_semi").isEmpty()


def components(links: DataFrame, scratch: list[str] | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link, from links (a, b) in any order; the component
    is its smallest node. Loops and repeated links do no harm; no links give no rows.

    The rounds grow with the logarithm of the longest path. Each is stored in the shared folder.
    A node with very many links is aggregated before the shuffle, and its join is one that Spark
    splits where it is skewed. Nothing but one number goes to the driver.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct(), scratch)
    for _ in range(most_rounds):
        if _settled(now):
            break
        now = written(_round(now), scratch)
    else:
        raise RuntimeError("the components did not settle")
    centers = now.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    return now.select(F.col("big").alias("node"), F.col("small").alias("component")).unionAll(centers)
