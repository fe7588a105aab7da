"""Half-pair counts per tract and year, and tract tables joined to demographics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_sale_years(pairs: DataFrame, keys: list[str]) -> DataFrame:
    # A few rows per tract: everything below works on this, not on the pairs.
    return pairs.groupBy(
        *keys, F.year("first_sale_date").alias("_y1"), F.year("second_sale_date").alias("_y2")
    ).agg(F.count(F.lit(1)).alias("_n"))


def half_pairs(pairs: DataFrame, keys: list[str] = ["tract_id"]) -> DataFrame:
    """Two per pair with either sale in the year."""
    years = F.explode(F.array_distinct(F.array("_y1", "_y2"))).alias("year")
    return (
        _by_sale_years(pairs, keys)
        .select(*keys, years, "_n")
        .groupBy(*keys, "year")
        .agg((2 * F.sum("_n")).alias("half_pairs"))
    )


def half_pairs_of_sales(pairs: DataFrame, keys: list[str] = ["tract_id"]) -> DataFrame:
    """One per sale and pair it belongs to: 1, 2, 1 for three sales of a property."""
    years = F.explode(F.array("_y1", "_y2")).alias("year")
    return (
        _by_sale_years(pairs, keys)
        .select(*keys, years, "_n")
        .groupBy(*keys, "year")
        .agg(F.sum("_n").alias("half_pairs"))
    )


def half_pair_panel(
    pairs: DataFrame, start_year: int | None = None, end_year: int | None = None, window_years: int = 2,
    keys: list[str] = ["tract_id"],
) -> DataFrame:
    """Pairs with a sale in a year or the ones before it in the window, for every year.

    Years are those between the bounds; without a bound, all that a window reaches.
    """
    reach = window_years - 1
    touched = F.array_distinct(
        F.concat(F.sequence("_y1", F.col("_y1") + reach), F.sequence("_y2", F.col("_y2") + reach))
    )
    return (
        _by_sale_years(pairs, keys)
        .select(*keys, F.explode(touched).alias("year"), "_n")
        .where(F.lit(True) if start_year is None else F.col("year") >= start_year)
        .where(F.lit(True) if end_year is None else F.col("year") <= end_year)
        .groupBy(*keys, "year")
        .agg(F.sum("_n").alias("half_pairs"))
    )


def sufficient_years(counts: DataFrame, minimum: int = 40, require_prior_year: bool = False) -> DataFrame:
    """Add whether a tract-year has enough half-pairs, optionally in the prior year too."""
    enough = F.col("half_pairs") >= minimum
    if require_prior_year:
        order = Window.partitionBy("tract_id").orderBy("year")
        prior = F.lag(F.struct("year", "half_pairs")).over(order)
        enough = enough & F.coalesce(
            (prior["year"] == F.col("year") - 1) & (prior["half_pairs"] >= minimum), F.lit(False)
        )
    return counts.withColumn("sufficient", enough)


def tracts_with_demographics(tracts: DataFrame, demographics: DataFrame, year: int | None = None) -> DataFrame:
    """Left join; the given year, or each column's latest known value per tract."""
    values = [c for c in demographics.columns if c not in ("tract_id", "year")]
    if year is not None:
        chosen = demographics.where(F.col("year") == year)
    else:
        latest = [
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("year"))).alias(c) for c in values
        ]
        chosen = demographics.groupBy("tract_id").agg(F.max("year").alias("year"), *latest)
    for name in chosen.columns:
        if name != "tract_id" and name in tracts.columns:
            chosen = chosen.withColumnRenamed(name, f"{name}_demo")
    return tracts.join(chosen, "tract_id", "left")
