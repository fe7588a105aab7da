"""Rules for pairs, tracts, supertracts and weights, and the reports built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.config import ScreenRules, ValidationRules, WeightRules
from hearthline.functions.columns import (
    DAYS_PER_MONTH,
    annual_growth,
    calendar_months,
    clean_number,
    holds,
    log_ratio,
    price_ratio,
    years_between,
)
from hearthline.functions.ordered import exact_quantiles
from hearthline.schemas import require_columns

RULES = {
    "valid_prices": "positive_prices",
    "valid_dates": "date_order",
    "valid_time_diff": "minimum_time_gap",
    "valid_cagr": "cagr_bounds",
    "valid_appreciation": "appreciation_bounds",
}


def first_match(*cases: tuple[Column, Column | str], otherwise: str | None = "") -> Column:
    chain = F
    for condition, value in cases:
        chain = chain.when(condition, value if isinstance(value, Column) else F.lit(value))
    return chain.otherwise(F.lit(otherwise)) if otherwise is not None else chain


def validate_pairs(pairs: DataFrame, rules: ValidationRules = ValidationRules()) -> DataFrame:
    """Add metrics, one flag per rule, the overall flag and the reason for rejection.

    Of several broken rules the reason names the last in the order gap, growth, ratio,
    prices, dates.
    """
    measured = pairs.withColumns(
        {
            "time_diff_months": calendar_months(),
            "appreciation_ratio": price_ratio(),
            "time_diff_years": years_between(),
        }
    ).withColumn("cagr", annual_growth(F.col("appreciation_ratio"), F.col("time_diff_years")))
    flagged = measured.withColumns(
        {
            "valid_time_diff": holds(F.abs("time_diff_months") >= rules.min_months),
            "valid_cagr": holds(F.abs("cagr") <= rules.max_cagr),
            "valid_appreciation": holds(F.col("appreciation_ratio").between(rules.min_ratio, rules.max_ratio)),
            "valid_prices": holds((clean_number("first_sale_price") > 0) & (clean_number("second_sale_price") > 0)),
            "valid_dates": holds(F.col("second_sale_date") > F.col("first_sale_date")),
        }
    )
    return flagged.withColumns(
        {
            "is_valid": F.col("valid_time_diff") & F.col("valid_cagr") & F.col("valid_appreciation")
            & F.col("valid_prices") & F.col("valid_dates"),
            "rejection_reason": first_match(
                (~F.col("valid_dates"), "Invalid date order"),
                (~F.col("valid_prices"), "Invalid prices"),
                (~F.col("valid_appreciation"), "Appreciation out of bounds"),
                (~F.col("valid_cagr"), f"CAGR exceeds ±{rules.max_cagr:.0%}"),
                (~F.col("valid_time_diff"), "Same 12-month period"),
            ),
        }
    )


def valid_pairs(pairs: DataFrame, rules: ValidationRules = ValidationRules()) -> DataFrame:
    """The pairs that pass every rule, in their original columns."""
    return validate_pairs(pairs, rules).where("is_valid").select(*pairs.columns)


def explain_pairs(pairs: DataFrame, rules: ValidationRules = ValidationRules()) -> DataFrame:
    """Add the first broken rule, with its measured value, and whether all rules hold."""
    years, ratio = years_between(), price_ratio()
    growth = F.when(years != 0, F.pow(ratio, F.try_divide(F.lit(1.0), years)) - 1).otherwise(F.lit(0.0))
    high, low = f"{rules.max_ratio:g}", f"{rules.min_ratio:g}"
    message = first_match(
        (F.abs(calendar_months()) < rules.min_months, "Transactions within same 12-month period"),
        (
            F.abs(growth) > rules.max_cagr,
            F.format_string(f"CAGR %.2f%% exceeds ±{rules.max_cagr:.0%}% threshold", F.bround(growth * 100, 2)),
        ),
        (ratio > rules.max_ratio, F.format_string(f"Appreciation %.2fx exceeds {high}x threshold", F.bround(ratio, 2))),
        (ratio < rules.min_ratio, F.format_string(f"Appreciation %.2fx below {low}x threshold", F.bround(ratio, 2))),
        (
            ~holds((clean_number("first_sale_price") > 0) & (clean_number("second_sale_price") > 0)),
            "Invalid price (must be positive)",
        ),
        (F.col("second_sale_date") <= F.col("first_sale_date"), "Second sale must be after first sale"),
        otherwise=None,
    )
    return pairs.withColumn("message", message).withColumn("accepted", F.col("message").isNull())


def _screened(pairs: DataFrame, rules: ScreenRules) -> DataFrame:
    months = F.datediff("second_sale_date", "first_sale_date") / F.lit(DAYS_PER_MONTH)
    measured = pairs.withColumn("months_diff", months).withColumns(
        {"years_diff": F.col("months_diff") / 12, "appreciation": price_ratio()}
    )
    return measured.withColumn("cagr", annual_growth(F.col("appreciation"), F.col("years_diff"))).withColumn(
        "_keep",
        (clean_number("first_sale_price") >= rules.min_price)
        & (clean_number("second_sale_price") >= rules.min_price)
        & (F.col("months_diff") >= rules.min_months)
        & (F.abs("cagr") <= rules.max_cagr)
        & F.col("appreciation").between(rules.min_ratio, rules.max_ratio),
    )


def screen_pairs(pairs: DataFrame, rules: ScreenRules = ScreenRules()) -> DataFrame:
    """Keep pairs that pass the second filter, with its measures."""
    return _screened(pairs, rules).where("_keep").drop("_keep")


def screen_rate(pairs: DataFrame, rules: ScreenRules = ScreenRules()) -> DataFrame:
    """Counts before and after the second filter, in one pass."""
    return (
        _screened(pairs, rules)
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("_keep").alias("kept"))
        .withColumn("rejection_rate", 1 - F.try_divide(F.col("kept"), F.col("total")))
    )


def screen_by_years(pairs: DataFrame, rules: ValidationRules = ValidationRules(), min_years: float = 1.0) -> DataFrame:
    """The filter variant that counts a full year of days and takes growth from the log change."""
    years, change = years_between(), log_ratio()
    growth = F.exp(F.try_divide(change, years)) - 1
    return (
        pairs.where(years >= min_years)
        .withColumns({"time_diff_years": years, "log_price_change": change, "cagr": growth})
        .where((F.abs("cagr") <= rules.max_cagr) & price_ratio().between(rules.min_ratio, rules.max_ratio))
    )


def keep_values(pairs: DataFrame, filters: dict[str, list]) -> DataFrame:
    """Keep rows whose column is in the list; unknown columns are ignored."""
    for column, values in filters.items():
        if column in pairs.columns:
            pairs = pairs.where(F.col(column).isin(list(values)))
    return pairs


def rejection_counts(validated: DataFrame) -> DataFrame:
    return (
        validated.where("not is_valid").groupBy("rejection_reason").agg(F.count(F.lit(1)).alias("pairs"))
    )


def validation_report(validated: DataFrame) -> DataFrame:
    """One row: counts, and growth and holding time of the valid pairs."""
    good = F.col("is_valid")
    growth, held = F.when(good, F.col("cagr")), F.when(good, F.col("time_diff_years"))
    totals = validated.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(good).alias("valid_transactions"),
        F.count_if(~good).alias("invalid_transactions"),
        F.avg(good.cast("double")).alias("validation_rate"),
        F.avg(growth).alias("cagr_mean"),
        F.stddev(growth).alias("cagr_std"),
        F.min(growth).alias("cagr_min"),
        F.max(growth).alias("cagr_max"),
        F.avg(held).alias("mean_years"),
        F.min(held).alias("min_years"),
        F.max(held).alias("max_years"),
    )
    middle = exact_quantiles(validated.where(good), [], "time_diff_years", {"median_years": 0.5})
    # Both sides are single-row aggregates.
    return totals.join(middle, F.lit(True), "left")


def rule_rates(validated: DataFrame) -> DataFrame:
    """Passed, failed and pass rate of each rule and of all together."""
    names = {"is_valid": "overall", **RULES}
    counts = validated.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(flag)).alias(flag) for flag in names]
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(flag).alias("passed")) for flag, rule in names.items()])
    )
    return counts.select("n", rows.alias("r")).select(
        "r.rule",
        "r.passed",
        (F.col("n") - F.col("r.passed")).alias("failed"),
        F.try_divide(F.col("r.passed").cast("double"), F.col("n")).alias("pass_rate"),
    )


def tract_issues(tracts: DataFrame) -> DataFrame:
    """Problems of a tract table as (issue, tract_id or column, rows)."""
    require_columns(tracts, "tract_id", "cbsa_id", "state", "county")
    repeated = (
        tracts.groupBy("tract_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        .select(F.lit("duplicate tract id").alias("issue"), F.col("tract_id").alias("subject"), "rows")
    )
    checked = [c for c in ("cbsa_id", "state", "county", "geometry") if c in tracts.columns]
    nulls = tracts.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in checked]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).alias("rows")) for c in checked])).alias("c")
    )
    missing = nulls.select(F.lit("null values").alias("issue"), "c.subject", "c.rows").where("rows > 0")
    found = repeated.unionByName(missing)
    if "geometry" in tracts.columns:
        ring = F.col("geometry")
        closed = (F.size(ring) >= 4) & (ring[0] == F.element_at(ring, -1)) & (ring_area(ring) > 0)
        broken = tracts.where(ring.isNotNull() & ~holds(closed)).select(
            F.lit("invalid geometry").alias("issue"), F.col("tract_id").alias("subject"), F.lit(1).cast("bigint").alias("rows")
        )
        found = found.unionByName(broken)
    return found


def ring_area(ring: Column) -> Column:
    """Area enclosed by a closed ring of (x, y) points."""
    following = F.slice(ring, F.lit(2), F.size(ring) - 1)
    steps = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("p"), following.alias("q"))
    twice = F.aggregate(
        steps,
        F.lit(0.0),
        lambda total, s: total + s["p"][0] * s["q"][1] - s["q"][0] * s["p"][1],
    )
    return F.abs(twice) / 2


def weight_issues(weights: DataFrame, rules: WeightRules = WeightRules()) -> DataFrame:
    """First broken rule of each weight set, NULL when it is sound."""
    return (
        weights.groupBy("geography_id", "period", "weight_type")
        .agg(
            F.count(F.lit(1)).alias("tracts"),
            F.min("weight").alias("smallest"),
            F.sum("weight").alias("total"),
        )
        .withColumn(
            "issue",
            first_match(
                (F.col("smallest") < 0, "Negative weights found"),
                (F.abs(F.col("total") - 1) >= rules.tolerance, "Weights not normalized"),
                otherwise=None,
            ),
        )
    )
