"""Consecutive sales of one property become pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.columns import annual_growth, log_ratio, price_ratio, years_between
from hearthline.schemas import PAIR_COLUMNS, require_columns

SALE_COLUMNS = ("property_id", "tract_id", "cbsa_id", "sale_date", "sale_price")


def pair_daily_sales(sales: DataFrame) -> DataFrame:
    """Pair sales that are already unique per property and day.

    A property then has at most one row per calendar day, which bounds the window.
    """
    order = Window.partitionBy("property_id").orderBy("sale_date")
    following = F.lead(F.struct("sale_date", "sale_price")).over(order)
    return (
        require_columns(sales, *SALE_COLUMNS)
        .withColumn("_next", following)
        .where(F.col("_next").isNotNull())
        .select(
            "property_id",
            "tract_id",
            "cbsa_id",
            F.col("sale_date").alias("first_sale_date"),
            F.col("sale_price").alias("first_sale_price"),
            F.col("_next.sale_date").alias("second_sale_date"),
            F.col("_next.sale_price").alias("second_sale_price"),
        )
    )


def pair_sales(transactions: DataFrame) -> DataFrame:
    """Pair every sale with the next sale of the same property.

    Sales of one day are ordered by price, tract and area. Days are first reduced to
    their first and last sale, so no task ever holds a property's whole history; pairs
    inside one day come from a second branch over the days that have several sales.
    """
    sales = require_columns(transactions, *SALE_COLUMNS).select(*SALE_COLUMNS)
    sale = F.struct("sale_price", "tract_id", "cbsa_id")
    days = sales.groupBy("property_id", "sale_date").agg(
        F.min(sale).alias("opening"), F.max(sale).alias("closing"), F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("property_id").orderBy("sale_date")
    following = F.lead(F.struct("sale_date", F.col("opening.sale_price").alias("sale_price"))).over(order)
    between = (
        days.withColumn("_next", following)
        .where(F.col("_next").isNotNull())
        .select(
            "property_id",
            "closing.tract_id",
            "closing.cbsa_id",
            F.col("sale_date").alias("first_sale_date"),
            F.col("closing.sale_price").alias("first_sale_price"),
            F.col("_next.sale_date").alias("second_sale_date"),
            F.col("_next.sale_price").alias("second_sale_price"),
        )
    )
    # Copies collapse to a count before anything is ordered.
    distinct = (
        sales.join(days.where("n > 1").select("property_id", "sale_date"), ["property_id", "sale_date"], "left_semi")
        .groupBy(*SALE_COLUMNS)
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    in_day = Window.partitionBy("property_id", "sale_date").orderBy("sale_price", "tract_id", "cbsa_id")
    stepped = distinct.withColumn("_next_price", F.lead("sale_price").over(in_day))
    base = ["property_id", "tract_id", "cbsa_id", F.col("sale_date").alias("first_sale_date"),
            F.col("sale_price").alias("first_sale_price"), F.col("sale_date").alias("second_sale_date")]
    steps = stepped.where(F.col("_next_price").isNotNull()).select(
        *base, F.col("_next_price").alias("second_sale_price")
    )
    repeats = (
        distinct.where("copies > 1")
        .withColumn("_copy", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("copies"))))
        .select(*base, F.col("sale_price").alias("second_sale_price"))
    )
    return between.unionByName(steps).unionByName(repeats).select(*PAIR_COLUMNS)


def with_metrics(pairs: DataFrame) -> DataFrame:
    """Add log price change, years held and compound annual growth."""
    years = years_between()
    growth = F.when(years != 0, F.pow(price_ratio(), F.try_divide(F.lit(1.0), years)) - 1)
    return pairs.withColumns(
        {
            "log_price_diff": log_ratio(),
            "time_diff_years": years,
            "cagr": growth.otherwise(F.lit(0.0)),
        }
    )


def growth_of(pairs: DataFrame):
    return annual_growth(price_ratio(), years_between())
