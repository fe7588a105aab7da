"""Column expressions shared by the operators. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25
DAYS_PER_MONTH = 30.44


def clean_number(name: str) -> Column:
    """Double with NaN read as missing, because Spark orders NaN above every number."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def round_double(value: Column, digits: int) -> Column:
    """Round the scaled double itself, ties away from zero, as C and other engines do.

    Spark's own rounding goes by the shortest decimal form, which differs where a product
    misses a tie by its last bit.
    """
    scale = F.lit(10.0**digits)
    return F.round(value * scale) / scale


def holds(condition: Column) -> Column:
    """Missing operands make a rule fail rather than become unknown."""
    return F.coalesce(condition, F.lit(False))


def years_between(first: str = "first_sale_date", second: str = "second_sale_date") -> Column:
    return F.datediff(second, first) / F.lit(DAYS_PER_YEAR)


def calendar_months(first: str = "first_sale_date", second: str = "second_sale_date") -> Column:
    return (F.year(second) - F.year(first)) * 12 + (F.month(second) - F.month(first))


def price_ratio(first: str = "first_sale_price", second: str = "second_sale_price") -> Column:
    return F.try_divide(clean_number(second), clean_number(first))


def log_ratio(first: str = "first_sale_price", second: str = "second_sale_price") -> Column:
    return F.ln(clean_number(second)) - F.ln(clean_number(first))


def annual_growth(ratio: Column, years: Column) -> Column:
    """Compound annual growth; zero when no time has passed."""
    return F.when(
        years > 0, F.pow(ratio, F.try_divide(F.lit(1.0), years)) - 1
    ).otherwise(F.lit(0.0))


def period_number(date: str, period: str) -> Column:
    """Consecutive integers, one per calendar period."""
    if period == "month":
        return F.year(date) * 12 + F.month(date) - 1
    if period == "quarter":
        return F.year(date) * 4 + F.quarter(date) - 1
    if period == "year":
        return F.year(date)
    raise ValueError(f"unknown period: {period}")


def period_start(number: Column, period: str) -> Column:
    """First day of a period; inverse of period_number."""
    per_year = {"month": 12, "quarter": 4, "year": 1}[period]
    year = F.floor(number / F.lit(per_year)).cast("int")
    month = (F.pmod(number, F.lit(per_year)) * (12 // per_year) + 1).cast("int")
    return F.make_date(year, month, F.lit(1))


def state_code(tract: str = "tract_id") -> Column:
    return F.substring(tract, 1, 2)


def county_code(tract: str = "tract_id") -> Column:
    return F.substring(tract, 3, 3)


def sample_skewness(population: Column, n: Column) -> Column:
    """Bias-corrected skewness from Spark's population skewness."""
    n = n.cast("double")
    return F.when(n > 2, population * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def sample_kurtosis(population: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from Spark's population kurtosis."""
    n = n.cast("double")
    return F.when(
        n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * population + 6)
    )


def robust_weight(method: str, scaled: Column, constant: float) -> Column:
    """Weight an M-estimator gives to a residual already divided by its scale."""
    size = F.abs(scaled)
    if method == "huber":
        return F.when(size <= constant, F.lit(1.0)).otherwise(F.try_divide(F.lit(constant), size))
    square = F.pow(scaled / F.lit(constant), F.lit(2.0))
    if method == "bisquare":
        return F.when(size <= constant, F.pow(1 - square, F.lit(2.0))).otherwise(F.lit(0.0))
    if method == "cauchy":
        return 1 / (1 + square)
    if method == "welsch":
        return F.exp(-square)
    return F.lit(1.0)
