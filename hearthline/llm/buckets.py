"""Links from shared keys, complete for buckets of any size.

Small buckets are compared in pairs. In a crowded one, members first meet one pivot each,
which joins what is close in linear work; pairs inside one component need no comparison any
more. The members outside a bucket's largest component are then compared with all members
of other components, so no pair that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.components import connected_components
from hearthline.session import staged

PIVOT_ROUNDS = 3


def complete_links(
    keyed: DataFrame,
    verified: Callable[[DataFrame], DataFrame],
    bucket: int,
    fits: Callable[[Column, Column], Column] = lambda a, b: F.lit(True),
) -> DataFrame:
    """Links (a, b) whose components are those of all verified pairs that share a key.

    ``keyed`` has (key, member), the member a struct with ``node``. ``verified`` keeps the
    rows of distinct (a, b) that are links. ``fits`` may rule out a pair under one key.
    """
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    lists = (
        keyed.join(sizes.where(F.col("n").between(2, bucket)), "key")
        .groupBy("key")
        .agg(F.collect_set("member").alias("members"))
    )
    both = lists.select("members", F.explode("members").alias("x")).select("x", F.explode("members").alias("y"))
    pairs = both.where((F.col("x.node") < F.col("y.node")) & fits(F.col("x"), F.col("y"))).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b")
    )
    crowded = keyed.join(sizes.where(F.col("n") > bucket), "key").select("key", "member").distinct()
    crowded = staged(crowded.withColumn("node", F.col("member.node")), "crowded")
    first = crowded.groupBy("key").agg(F.min("node").alias("a"))
    pivots = crowded.join(first, "key").groupBy(F.col("node").alias("b")).agg(F.min("a").alias("a")).where("a <> b")
    links = staged(verified(pairs.unionByName(pivots.select("a", "b")).distinct()), "found")
    if crowded.isEmpty():
        return links
    for number in range(PIVOT_ROUNDS):
        roots = connected_components(links)
        rooted = crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        kinds = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"))
        mixed = (
            kinds.groupBy("key")
            .agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", "root", "low")).alias("main"))
            .where("kinds > 1")
        )
        rest = staged(rooted.join(mixed, "key").select("key", "member", "node", "root", "main"), "mixed")
        others = rest.where("root <> main.root")
        if others.isEmpty():
            return links
        if number == PIVOT_ROUNDS - 1:
            break
        stars = others.groupBy(F.col("node").alias("b")).agg(F.min("main.low").alias("a")).select("a", "b")
        new = staged(verified(stars), "found")
        if new.isEmpty():
            break
        links = links.unionByName(new)
    x = others.select("key", F.col("member").alias("x"), F.col("root").alias("x_root"))
    y = rest.select("key", F.col("member").alias("y"), F.col("root").alias("y_root"), F.col("main.root").alias("main"))
    cross = x.join(y, "key").where(
        (F.col("x_root") != F.col("y_root"))
        & ((F.col("y_root") == F.col("main")) | (F.col("x.node") < F.col("y.node")))
        & fits(F.col("x"), F.col("y"))
    )
    ends = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    return links.unionByName(staged(verified(ends), "found"))
