"""Connected components of a link table, by alternating large and small stars.

Both steps are an aggregation (combined before the shuffle) and a join that AQE may
split where a node has very many links. Nothing is gathered on the driver but a
count and a checksum for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` has columns a, b (long, no nulls). Returns (node, root) for each node that
    has a link; root is the smallest node of its component.

    Self links and repeated links are allowed; an empty table gives an empty result.
    """
    links = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = _state(links)
    for _ in range(most_rounds):
        # large star: every neighbour above a node is linked to the smallest neighbour
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: every neighbour below a node, and the node, to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        links = materialise(small, "links")
        now = _state(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
