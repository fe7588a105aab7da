"""Column types of every table. Identifiers are strings, so leading zeros survive."""

from __future__ import annotations

from pyspark.sql import DataFrame

TRANSACTIONS = "property_id string, tract_id string, cbsa_id string, sale_date date, sale_price double"

PAIRS = (
    "property_id string, tract_id string, cbsa_id string, first_sale_date date, "
    "first_sale_price double, second_sale_date date, second_sale_price double"
)

PROPERTIES = "property_id string, tract_id string, cbsa_id string, base_price double, profile_type string"

MARKET_INDICES = "cbsa_id string, year int, index_value double, annual_return double"

DEMOGRAPHICS = (
    "tract_id string, year int, housing_units int, median_value double, "
    "college_share double, non_white_share double, upb_total double"
)

CBSAS = (
    "cbsa_id string, name string, state string, tract_count int, "
    "total_population bigint, total_area_sqmi double"
)

TRACT_FEATURE = (
    "struct<type: string, properties: struct<tract_id: string, state: string, county: string, "
    "cbsa_id: string, centroid: string, population: bigint, area_sqmi: double, "
    "centroid_x: double, centroid_y: double>, "
    "geometry: struct<type: string, coordinates: string>>"
)

WEIGHTS = "geography_id string, period int, weight_type string, tract_id string, weight double"

SERIES = "geography_id string, date date, index_value double"

PAIR_COLUMNS = [field.split()[0] for field in PAIRS.split(", ")]


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
