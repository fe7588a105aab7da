"""Connected components by alternating small-star and large-star rounds.

Every round is a handful of aggregates and joins on one column, so a node with a third of
all links is combined on the map side and split by the skew join; no neighbour list is
ever gathered. Rounds go on until nothing changes, and each is written to the shared
checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.session import staged


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("high", "low")).alias("mark"),
    ).first()
    return row["n"], row["mark"] or 0


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """A node's larger neighbours move to the smallest of its neighbours and itself."""
    both = links.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
        links.select(F.col("low").alias("node"), F.col("high").alias("other"))
    )
    least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    larger = both.where("other > node").join(least, "node")
    return larger.select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node but the roots; links are (a, b), long, in any order.

    The root is the smallest node that can be reached. Without links the result is empty.
    Links from a node to itself and repeated links change nothing. Small stars come first:
    they merge the many links of a dense group by a join over each link once.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    pairs = staged(pairs, "links")
    state = _state(pairs)
    while state[0]:
        pairs = staged(_large_star(staged(_small_star(pairs), "links")), "links")
        before, state = state, _state(pairs)
        if before == state:
            break
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("root"))
