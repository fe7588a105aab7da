"""Sales, tracts and demographics read out of a star schema of orders.

The tables carry no homes, so a part sold in a nation stands for a home, a brand in a
nation for a tract, a nation for an area and a region for a state. Each derivation is
plain SQL over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.columns import round_double
from hearthline.operators.geography import square_tracts, with_codes
from hearthline.operators.pairs import pair_daily_sales

# Hash tables of so many lines took 457 MB in a task, with 6 and with 36 million lines about the same.
LINES_A_TASK = 400_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _areas(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier to nation and region."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return table(spark, folder, "supplier").select("s_suppkey", "s_nationkey").join(nation, "s_nationkey")


def _brand():
    return F.substring("p_brand", 7, 10).cast("int")


def _tract_id():
    return F.concat(
        F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0"),
        F.lpad(F.col("s_nationkey").cast("string"), 3, "0"),
        F.lpad(_brand().cast("string"), 6, "0"),
    )


def _cbsa_id():
    return (F.lit(10000) + F.col("s_nationkey") * 20).cast("string")


def _factor():
    """Price of a line relative to its part's list price."""
    return (
        (1 - F.col("l_discount")) * (1 + F.col("l_tax")) * (1 + F.col("l_quantity") / 50)
        * F.exp(F.lit(0.04) * (F.year("l_shipdate") - 1994))
    )


def _parts_of(lines: DataFrame) -> int:
    """Partitions of a bounded number of lines, whatever the table's size; the count reads file footers only."""
    return max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // LINES_A_TASK))


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Lines summed per property and day: all that sales, tracts and demographics need.

    Almost every line has a day of its own, so sums before a shuffle would only fill memory.
    Lines go to their part's task once; the sums, the part join and later sums per part all
    take place there. The supplier join before it, which sorts lines unless suppliers are
    few enough to broadcast, has tasks of the same bounded size.
    """
    source = table(spark, folder, "lineitem")
    parts = _parts_of(source)
    lines = source.select(
        "l_partkey", F.col("l_suppkey").alias("s_suppkey"), F.col("l_shipdate").cast("date").alias("sale_date"),
        _factor().alias("factor"), (F.col("l_returnflag") == "R").alias("r"), (F.col("l_linestatus") == "O").alias("o"),
    )
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    return (
        lines.repartition(parts, "s_suppkey")
        .join(_areas(spark, folder), "s_suppkey")
        .repartition(parts, "l_partkey")
        .groupBy("l_partkey", "s_nationkey", "n_regionkey", "sale_date")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("factor").alias("factor"),
            F.count_if("r").alias("r"), F.count_if("o").alias("o"),
        )
        .join(part, "l_partkey")
    )


def sales(days: DataFrame) -> DataFrame:
    """One sale per property and day, at the mean price of the day's lines."""
    return days.select(
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("s_nationkey").cast("string")).alias("property_id"),
        _tract_id().alias("tract_id"),
        _cbsa_id().alias("cbsa_id"),
        "sale_date",
        round_double(100 * F.col("p_retailprice") * (F.col("factor") / F.col("n")), 2).alias("sale_price"),
    )


def pairs(days: DataFrame) -> DataFrame:
    return pair_daily_sales(sales(days))


def demographics(days: DataFrame) -> DataFrame:
    """Per tract and year: distinct parts, mean price, price total and two flag shares."""
    yearly = days.groupBy(
        "l_partkey", "s_nationkey", "n_regionkey", "p_brand", "p_retailprice", F.year("sale_date").alias("year")
    ).agg(F.sum("n").alias("n"), F.sum("factor").alias("factor"), F.sum("r").alias("r"), F.sum("o").alias("o"))
    price = F.sum(100 * F.col("p_retailprice") * F.col("factor"))
    n = F.sum("n")
    return yearly.groupBy(_tract_id().alias("tract_id"), _cbsa_id().alias("cbsa_id"), "year").agg(
        F.count(F.lit(1)).cast("int").alias("housing_units"),
        F.round(price / n, 2).alias("median_value"),
        F.round(F.sum("r") / n, 6).alias("college_share"),
        F.round(F.sum("o") / n, 6).alias("non_white_share"),
        F.round(price, 2).alias("upb_total"),
    )


def tracts(days: DataFrame) -> DataFrame:
    """Every brand sold in a nation, as a unit square on a line per nation."""
    sold = days.groupBy("s_nationkey", "n_regionkey", "p_brand").agg(F.sum("n").alias("population"))
    placed = sold.select(
        _tract_id().alias("tract_id"),
        _cbsa_id().alias("cbsa_id"),
        F.col("population"),
        (F.lit(1.0) + _brand() / 100).alias("area_sqmi"),
        (F.col("s_nationkey") * 10.0).alias("centroid_x"),
        _brand().cast("double").alias("centroid_y"),
    )
    return square_tracts(with_codes(placed), 1.0)


def mapping(tract_table: DataFrame) -> DataFrame:
    return tract_table.select("tract_id", "cbsa_id", "state")
