"""Exact order statistics that do not put one group's rows into one task.

A group may hold a large share of the table, so neither a window over the whole group
nor a per-group value map is safe. A first aggregate finds each group's range, a second
one counts rows per value bin; a window over the bins of a group tells which bins hold
the wanted ranks. Only their rows are read again, collapsed to counts per distinct value,
and a window over the values of one bin finds the ranks. All shares are found at once.

Ranks and running means of every row come from even parts in order, with a few numbers of the
parts before.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.session import staged

BINS = 4096


def _squash(value: Column) -> Column:
    # Non-decreasing, so bins keep the order; evens out long tails.
    return F.signum(value) * F.log1p(F.abs(value))


def _bin(value: Column, low: Column, high: Column) -> Column:
    share = F.try_divide(_squash(value) - _squash(low), _squash(high) - _squash(low))
    return F.coalesce(F.least(F.floor(share * BINS).cast("int"), F.lit(BINS - 1)), F.lit(0))


def _numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    number = F.col(value).cast("double")
    return df.select(*keys, number.alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))


def _rank_bounds(share: float) -> tuple[Column, Column]:
    place = F.lit(float(share)) * (F.col("_total") - 1)
    return F.floor(place), F.ceil(place)


def _binned(numbers: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Numbers with their bin; per bin the group's size and the number of rows in lower bins."""
    span = numbers.groupBy(*keys).agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    binned = numbers.join(span, keys).select(*keys, "_value", _bin(F.col("_value"), F.col("_low"), F.col("_high")).alias("_bin"))
    group = Window.partitionBy(*keys)
    lower = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_size")).select(
        *keys, "_bin", "_size",
        F.coalesce(F.sum("_size").over(lower), F.lit(0)).alias("_base"),
        F.sum("_size").over(group).alias("_total"),
    )
    return binned, sizes


def _located(binned: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values of the given bins with their count and the number of smaller values in the group."""
    nodes = [*keys, "_bin"]
    counts = binned.join(sizes.drop("_size"), nodes).groupBy(*nodes, "_value").agg(
        F.count(F.lit(1)).alias("_count"), F.first("_base").alias("_base"), F.first("_total").alias("_total")
    )
    smaller = Window.partitionBy(*nodes).orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_below", F.col("_base") + F.coalesce(F.sum("_count").over(smaller), F.lit(0)))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of shares.

    Reads df three times: best a stored table, or a cheap projection of one.
    """
    pooled = not keys
    if pooled:
        df, keys = df.withColumn("_group", F.lit(0)), ["_group"]
    binned, sizes = _binned(_numbers(df, keys, value), keys)
    wanted = [rank for share in shares.values() for rank in _rank_bounds(share)]
    inside = [(rank >= F.col("_base")) & (rank < F.col("_base") + F.col("_size")) for rank in wanted]
    placed = _located(binned, sizes.where(reduce(or_, inside)), keys)

    def at(rank: Column) -> Column:
        covers = (rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_count"))
        return F.max(F.when(covers, F.col("_value")))

    sides, results = [], []
    for name, share in shares.items():
        low, high = _rank_bounds(share)
        sides += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}")]
        fraction = F.lit(float(share)) * (F.col("_total") - 1) - low
        results.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * fraction).alias(name))
    found = placed.groupBy(*keys).agg(F.first("_total").alias("_total"), *sides).select(*keys, *results)
    return found.drop("_group") if pooled else found


def _placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in even parts that follow each other in order, with the part's number in _part.

    A running number tells equal rows apart, so they too are cut into parts. Stored before, so that
    this number and what it is added to are made once, and after, since parts drawn again could differ.
    """
    numbered = staged(df, "unordered").withColumn("_tie", F.monotonically_increasing_id())
    parts = numbered.repartitionByRange(*keys, *order, "_tie").withColumn("_part", F.spark_partition_id())
    return staged(parts, "ordered")


def percentile_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Rank as a share of the group, ties given their average rank; NULL for a missing value.

    Windows span a group's rows of one part. Only a part's least and greatest value can occur in
    other parts too; a row per part carries how many values are below and equal to these.
    """
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    df = df.withColumn("_value", number)
    rows = _placed(df.where(F.col("_value").isNotNull()), keys, ["_value"])
    own = [*keys, "_part"]
    counts = rows.groupBy(*own, "_value").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.groupBy(*own).agg(
        F.sum("n").alias("_n"), F.min(F.struct("_value", "n")).alias("_least"), F.max(F.struct("_value", "n")).alias("_most")
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(
        parts.select(
            "*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("_total")
        ),
        "parts",
    )
    ends = F.array_distinct(
        F.array(
            F.struct(F.col("_least._value").alias("v"), F.col("_least.n").alias("n"), F.col("_before").alias("below")),
            F.struct(F.col("_most._value").alias("v"), F.col("_most.n").alias("n"), (F.col("_before") + F.col("_n") - F.col("_most.n")).alias("below")),
        )
    )
    shared = parts.select(*keys, F.explode(ends).alias("e")).groupBy(*keys, F.col("e.v").alias("_v")).agg(
        F.sum("e.n").alias("n"), F.min("e.below").alias("below")
    )
    shared = staged(shared.select(*keys, "_v", F.struct("n", "below").alias("_end")), "ends")
    for side in ("_least", "_most"):
        ends_of = shared.select(*keys, F.col("_v").alias(f"{side}_v"), F.col("_end").alias(f"{side}_end"))
        parts = parts.withColumn(f"{side}_v", F.col(f"{side}._value")).join(ends_of, [*keys, f"{side}_v"])
    here = Window.partitionBy(*own)
    local = F.struct(
        F.count(F.lit(1)).over(Window.partitionBy(*own, "_value")).alias("n"),
        (F.rank().over(here.orderBy("_value")) - 1).cast("bigint").alias("below"),
    )
    measured = rows.withColumn("_local", local).join(
        parts.select(*own, "_before", "_total", "_least_v", "_least_end", "_most_v", "_most_end"), own
    )
    inside = F.struct(F.col("_local.n").alias("n"), (F.col("_local.below") + F.col("_before")).alias("below"))
    place = (
        F.when(F.col("_value") == F.col("_least_v"), F.col("_least_end"))
        .when(F.col("_value") == F.col("_most_v"), F.col("_most_end"))
        .otherwise(inside)
    )
    names = [c for c in df.columns if c != "_value"]
    found = measured.withColumn("_place", place).select(
        *names, ((F.col("_place.below") + (F.col("_place.n") + 1) / 2) / F.col("_total")).alias(out)
    )
    missing = df.where(F.col("_value").isNull()).select(*names, F.lit(None).cast("double").alias(out))
    return found.unionByName(missing)


def running_mean(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str
) -> DataFrame:
    """Mean of value over this row and all before it, ordered by (bucket, *order).

    Sums of a group's earlier parts are added to a window over its rows of one part.
    """
    rows = _placed(df, keys, [bucket, *order])
    own = [*keys, "_part"]
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*own).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    before = sums.select(
        *own,
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_sum_before"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before"),
    )
    so_far = Window.partitionBy(*own).orderBy(bucket, *order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.try_divide(
        F.col("_sum_before") + F.coalesce(F.sum(value).over(so_far), F.lit(0.0)),
        F.col("_n_before") + F.count(value).over(so_far),
    )
    return rows.join(before, own).withColumn(out, mean).drop("_sum_before", "_n_before", "_part", "_tie")
