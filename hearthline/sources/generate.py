"""Synthetic homes, sales, tracts and demographics, made where they are needed.

Every value is a function of a row number and the seed, so tables of any size come out
the same on any cluster. Distributions follow three market profiles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.operators.geography import area_summary
from hearthline.operators.market import with_annual_return
from hearthline.operators.pairs import pair_sales


@dataclass(frozen=True)
class MarketProfile:
    base_price_mean: float
    base_price_std: float
    growth_mean: float
    growth_std: float
    volatility: float
    transaction_rate: float


# The three kinds of market.
PROFILES = {
    "high_growth": MarketProfile(500000, 200000, 0.06, 0.02, 0.15, 0.05),
    "moderate_growth": MarketProfile(300000, 100000, 0.04, 0.015, 0.10, 0.04),
    "low_growth": MarketProfile(200000, 50000, 0.02, 0.01, 0.08, 0.03),
}
RECESSION_YEARS = (2001, 2008, 2009, 2020)


def uniform(seed: int, *keys: Column | str) -> Column:
    """Number in (0, 1) fixed by the seed and the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2**31 - 1)) + F.lit(0.5)) / F.lit(2**31 - 1)


def normal(seed: int, *keys: Column | str) -> Column:
    """Standard normal number fixed by the seed and the keys."""
    radius = F.sqrt(-2 * F.ln(uniform(seed, *keys)))
    return radius * F.cos(2 * F.pi() * uniform(seed + 7919, *keys))


def _profile(name: str) -> Column:
    return F.create_map(*[c for k, p in PROFILES.items() for c in (F.lit(k), F.lit(float(getattr(p, name))))])[
        F.col("profile_type")
    ]


def _area_profile(area_number: Column) -> Column:
    names = list(PROFILES)
    return F.element_at(F.array(*map(F.lit, names)), F.pmod(area_number, F.lit(len(names))).cast("int") + 1)


def tract_areas(spark: SparkSession, tracts: int, areas: int, seed: int = 42) -> DataFrame:
    """Tracts spread over areas of unequal size, at least one tract each."""
    number = F.when(F.col("id") < areas, F.col("id")).otherwise(
        F.floor(F.pow(uniform(seed, "id"), F.lit(1.5)) * areas)
    ).cast("long")
    return spark.range(tracts).select(
        F.lpad(F.col("id").cast("string"), 11, "0").alias("tract_id"),
        (F.lit(10000) + 20 * number).cast("string").alias("cbsa_id"),
        _area_profile(number).alias("profile_type"),
    ).withColumns({"state": F.substring("tract_id", 1, 2), "county": F.substring("tract_id", 3, 3)})


def properties(spark: SparkSession, count: int, tracts: DataFrame, tract_count: int, seed: int = 42) -> DataFrame:
    tract = F.lpad(F.floor(uniform(seed + 1, "id") * tract_count).cast("string"), 11, "0")
    price = F.greatest(F.lit(50000.0), _profile("base_price_mean") + _profile("base_price_std") * normal(seed + 2, "property_id"))
    return (
        spark.range(count)
        .select(F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("property_id"), tract.alias("tract_id"))
        .join(tracts.select("tract_id", "cbsa_id", "profile_type"), "tract_id")
        .select("property_id", "tract_id", "cbsa_id", price.alias("base_price"), "profile_type")
    )


def market_indices(areas: DataFrame, start_year: int, end_year: int, seed: int = 42) -> DataFrame:
    """Annual level per area (cbsa_id, profile_type), 1.0 in the first year."""
    cycle = 0.02 * F.sin(2 * F.pi() * (F.col("year") - start_year) / 10)
    shock = normal(seed + 3, "cbsa_id", "year")
    usual = _profile("growth_mean") + cycle + _profile("growth_std") * shock
    growth = F.when(F.col("year").isin(*RECESSION_YEARS), -0.05 + 0.03 * shock).otherwise(usual)
    so_far = Window.partitionBy("cbsa_id").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    levels = (
        areas.select("cbsa_id", "profile_type", F.explode(F.sequence(F.lit(start_year), F.lit(end_year))).alias("year"))
        .withColumn("_step", F.when(F.col("year") == start_year, F.lit(0.0)).otherwise(F.log1p(growth)))
        .select("cbsa_id", "year", F.exp(F.sum("_step").over(so_far)).alias("index_value"))
    )
    return with_annual_return(levels)


def transactions(homes: DataFrame, market: DataFrame, start_year: int, end_year: int, seed: int = 42) -> DataFrame:
    """First sale of every home and its later sales after exponential holding times.

    A home sells at most once a year, so its history is bounded by the years.
    """
    span = max(1, min(10, end_year - 2 - start_year))
    turns = F.explode(F.sequence(F.lit(0), F.lit(end_year - start_year))).alias("turn")
    held = F.greatest(
        F.lit(1), F.least(F.lit(30), F.floor(-F.ln(uniform(seed + 4, "property_id", "turn")) / _profile("transaction_rate")))
    )
    history = Window.partitionBy("property_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    opening = F.lit(start_year) + F.floor(uniform(seed + 5, "property_id") * span)
    sold = (
        homes.select("*", turns)
        .withColumn("_held", F.when(F.col("turn") == 0, F.lit(0)).otherwise(held).cast("int"))
        .withColumn("year", (opening + F.sum("_held").over(history)).cast("int"))
        .where(F.col("year") <= end_year)
        .join(market.select("cbsa_id", "year", "index_value"), ["cbsa_id", "year"])
    )
    order = Window.partitionBy("property_id").orderBy("turn")
    market_step = F.try_divide(F.col("index_value"), F.lag("index_value").over(order))
    noise = normal(seed + 6, "property_id", "turn") * _profile("volatility")
    step = F.when(F.col("turn") == 0, F.col("index_value") * F.greatest(1 + noise, F.lit(0.05))).otherwise(
        F.least(F.lit(3.0), F.greatest(F.lit(0.5), market_step * (1 + noise / F.sqrt(F.greatest("_held", F.lit(1))))))
    )
    month = 1 + F.floor(12 * uniform(seed + 8, "property_id", "turn")).cast("int")
    day = 1 + F.floor(28 * uniform(seed + 9, "property_id", "turn")).cast("int")
    return (
        sold.withColumn("_step", F.ln(step))
        .withColumn("_price", F.col("base_price") * F.exp(F.sum("_step").over(history)))
        .select(
            "property_id", "tract_id", "cbsa_id", F.make_date("year", month, day).alias("sale_date"),
            F.greatest(F.lit(10000.0), F.floor("_price").cast("double")).alias("sale_price"),
        )
    )


def complete_dataset(
    spark: SparkSession, start_year: int = 1975, end_year: int = 2023, areas: int = 20, tracts: int = 1000,
    homes: int = 50000, seed: int = 42,
) -> dict[str, DataFrame]:
    tract_table = tract_areas(spark, tracts, areas, seed)
    home_table = properties(spark, homes, tract_table, tracts, seed)
    market = market_indices(tract_table.select("cbsa_id", "profile_type").distinct(), start_year, end_year, seed)
    sold = transactions(home_table, market, start_year, end_year, seed)
    return {
        "transactions": sold, "pairs": pair_sales(sold), "properties": home_table,
        "tracts": tract_table.drop("profile_type"), "market_indices": market,
    }


def demographics(tracts: DataFrame, years: list[int], seed: int = 42) -> DataFrame:
    """Tract values with a trend over the years; a single year has none."""
    first, width = min(years), max(max(years) - min(years), 1)
    trend = (F.col("year") - first) / F.lit(width)
    units = 100 + F.floor(4900 * uniform(seed + 11, "tract_id"))
    value = 250000 + 100000 * normal(seed + 12, "tract_id")
    share = F.pow(uniform(seed + 13, "tract_id"), F.lit(2.0)) * 0.8
    keep = [c for c in ("cbsa_id",) if c in tracts.columns]
    return tracts.select("tract_id", *keep, F.explode(F.array(*map(F.lit, years))).alias("year")).select(
        "tract_id", "year", *keep,
        F.floor(units * (1 + 0.3 * trend)).cast("int").alias("housing_units"),
        F.greatest(F.lit(50000.0), value * (1 + 0.5 * trend)).alias("median_value"),
        F.least(F.lit(1.0), share * (1 + 0.2 * trend)).alias("college_share"),
        F.sqrt(uniform(seed + 14, "tract_id")).alias("non_white_share"),
        F.abs(units * value * 0.7 * (0.5 + 0.5 * uniform(seed + 15, "tract_id", "year"))).alias("upb_total"),
    )


def tract_geometries(
    spark: SparkSession, tracts: int, clusters: int | None = None,
    bounds: tuple[float, float, float, float] = (-125, 25, -65, 50), seed: int = 42,
) -> DataFrame:
    """Small squares scattered around cluster centres, dense in the middle."""
    clusters = clusters or max(1, int(tracts**0.5))
    left, low, right, top = bounds
    x = left + 5 + (right - left - 10) * uniform(seed + 21, "cluster") + F.col("_radius") * F.cos("_angle")
    y = low + 5 + (top - low - 10) * uniform(seed + 22, "cluster") + F.col("_radius") * F.sin("_angle")
    scale = F.when(uniform(seed + 23, "id") < 0.3, F.lit(0.05)).otherwise(F.lit(0.2))
    size = F.col("_size") / 2
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    return (
        spark.range(tracts)
        .withColumn("cluster", F.pmod(F.col("id"), F.lit(clusters)))
        .withColumns(
            {
                "_radius": -F.ln(uniform(seed + 24, "id")) * scale,
                "_angle": 2 * F.pi() * uniform(seed + 25, "id"),
                "_size": 0.01 + 0.04 * uniform(seed + 26, "id"),
            }
        )
        .withColumns({"centroid_x": x, "centroid_y": y})
        .withColumns(
            {
                "state": F.lpad((F.pmod("cluster", F.lit(50)) + 1).cast("string"), 2, "0"),
                "county": F.lpad((F.pmod("cluster", F.lit(10)) + 1).cast("string"), 3, "0"),
                "cbsa_id": (F.lit(10000) + 20 * F.col("cluster")).cast("string"),
                "population": 1000 + F.floor(9000 * uniform(seed + 27, "id")),
                "area_sqmi": F.col("_size") * F.col("_size") * 1000,
            }
        )
        .select(
            F.concat("state", "county", F.lpad((F.floor(F.col("id") / clusters) + 1).cast("string"), 6, "0")).alias("tract_id"),
            "state", "county", "cbsa_id", "population", "area_sqmi", "centroid_x", "centroid_y",
            F.array(*[F.array(F.col("centroid_x") + dx * size, F.col("centroid_y") + dy * size) for dx, dy in corners]).alias("geometry"),
        )
    )


def area_table(tracts: DataFrame) -> DataFrame:
    """Area summary with a name."""
    return area_summary(tracts).select(
        "cbsa_id", F.concat(F.lit("Metro Area "), "cbsa_id", F.lit(", "), "state").alias("name"), "state",
        F.col("tract_count").cast("int").alias("tract_count"), "total_population", "total_area_sqmi",
    )
