"""Annual market level per area, and sales seen against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def annual_market(sales: DataFrame) -> DataFrame:
    """Mean price of each area and year relative to the area's first year, and its return."""
    order = Window.partitionBy("cbsa_id").orderBy("year")
    levels = sales.groupBy("cbsa_id", F.year("sale_date").alias("year")).agg(F.avg("sale_price").alias("_mean"))
    based = levels.withColumn("index_value", F.col("_mean") / F.first("_mean").over(order)).drop("_mean")
    return with_annual_return(based)


def with_annual_return(market: DataFrame) -> DataFrame:
    """Change against the area's previous year, 0 in its first."""
    order = Window.partitionBy("cbsa_id").orderBy("year")
    change = F.try_divide(F.col("index_value"), F.lag("index_value").over(order)) - 1
    return market.withColumn("annual_return", F.coalesce(change, F.lit(0.0)))


def market_appreciation(pairs: DataFrame, market: DataFrame) -> DataFrame:
    """Each pair's own price ratio beside its area's market ratio over the same years."""
    def side(prefix: str) -> DataFrame:
        return market.select("cbsa_id", F.col("year").alias(f"{prefix}_year"), F.col("index_value").alias(f"{prefix}_level"))

    return (
        pairs.withColumns({"first_year": F.year("first_sale_date"), "second_year": F.year("second_sale_date")})
        .join(side("first"), ["cbsa_id", "first_year"])
        .join(side("second"), ["cbsa_id", "second_year"])
        .withColumn("market_ratio", F.try_divide(F.col("second_level"), F.col("first_level")))
        .drop("first_level", "second_level")
    )
