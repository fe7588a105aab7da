"""Outlying pairs: extreme growth, long gaps, and three regression diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.config import FitOptions, OutlierRules
from hearthline.functions.columns import holds, years_between
from hearthline.functions.ordered import running_mean
from hearthline.operators.pairs import growth_of
from hearthline.operators.regression import leverage_cells, period_cells, residuals

# Reason, score column and flag column of each test, in reporting order.
TESTS = {
    "cagr": "Extreme CAGR",
    "time_gap": "Excessive time gap",
    "cooks": "High Cook's distance",
    "residual": "Large studentized residual",
    "leverage": "High leverage",
}


def growth_flag(pairs: DataFrame, rules: OutlierRules = OutlierRules()) -> Column:
    return holds((years_between() > 0) & (F.abs(growth_of(pairs)) > rules.cagr))


def gap_flag(rules: OutlierRules = OutlierRules()) -> Column:
    return holds(years_between() > rules.gap_years)


def _flags_to_columns(df: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """Turn is_<test> flags into one flag, a summed score and the list of reasons."""
    flags = {test: F.col(f"is_{test}") for test in scores}
    reasons = F.array_compact(F.array(*[F.when(flag, F.lit(TESTS[test])) for test, flag in flags.items()]))
    score = sum((F.when(flags[t], scores[t]).otherwise(F.lit(0.0)) for t in scores), F.lit(0.0))
    return df.withColumns(
        {
            "reasons": reasons,
            "outlier_score": score,
            "is_outlier": F.size(reasons) > 0,
            "outlier_reasons": F.array_join(reasons, "; "),
        }
    )


def flag_outliers(pairs: DataFrame, rules: OutlierRules = OutlierRules()) -> DataFrame:
    """The two tests that need no regression; a plain projection."""
    flagged = pairs.withColumns({"is_cagr": growth_flag(pairs, rules), "is_time_gap": gap_flag(rules)})
    return _flags_to_columns(flagged, {"cagr": F.lit(1.0), "time_gap": F.lit(1.0)})


def remove_outliers(pairs: DataFrame, rules: OutlierRules = OutlierRules()) -> DataFrame:
    return pairs.where(~growth_flag(pairs, rules) & ~gap_flag(rules))


def diagnose(
    pairs: DataFrame,
    fits: DataFrame,
    keys: list[str],
    rules: OutlierRules = OutlierRules(),
    options: FitOptions = FitOptions(),
) -> DataFrame:
    """Add residual, studentised residual, leverage and Cook's distance.

    Where a group's normal matrix is singular the leverage is NULL and so is the distance.
    """
    fit = fits.select(
        *keys,
        F.col("num_observations").cast("double").alias("_n"),
        (F.col("num_periods") - 1).cast("double").alias("_k"),
        F.when(
            F.col("num_observations") > F.col("num_periods") - 1,
            F.col("residual_sum") / (F.col("num_observations") - F.col("num_periods") + 1),
        ).alias("_mse"),
    )
    hat = leverage_cells(period_cells(pairs, keys, options.period), keys)
    h, eps = F.col("leverage"), F.lit(rules.epsilon)
    inner = F.col("residual") / (F.sqrt(F.greatest(F.col("_mse") * (1 - h), F.lit(0.0))) + eps)
    return (
        residuals(pairs, fits, keys, options)
        .join(hat, [*keys, "first_period", "second_period"], "left")
        .join(fit, keys)
        .withColumn("studentized", F.col("residual") / (F.sqrt("_mse") + eps))
        .withColumn(
            "cooks_distance",
            F.when(h.isNotNull(), F.try_divide(inner * inner * h, F.col("_k") * (1 - h + eps))),
        )
    )


def flag_with_regression(
    pairs: DataFrame,
    fits: DataFrame,
    keys: list[str],
    rules: OutlierRules = OutlierRules(),
    options: FitOptions = FitOptions(),
) -> DataFrame:
    """All five tests.

    Cook's cut-off is the running mean of the distances so far, so rows need an order:
    first sale date, then property and second sale date.
    """
    measured = running_mean(
        diagnose(pairs, fits, keys, rules, options),
        keys,
        "first_sale_date",
        ["property_id", "second_sale_date", "second_sale_price"],
        "cooks_distance",
        "_mean_so_far",
    )
    cut = F.greatest(F.try_divide(F.lit(4.0), F.col("_n")), rules.cooks * F.col("_mean_so_far"))
    flagged = measured.withColumns(
        {
            "is_cagr": growth_flag(pairs, rules),
            "is_time_gap": gap_flag(rules),
            "is_cooks": holds(F.col("cooks_distance") > cut),
            "is_residual": holds(F.abs("studentized") > rules.residual),
            "is_leverage": holds(F.col("leverage") > rules.leverage * F.try_divide(F.col("_k"), F.col("_n"))),
        }
    )
    scores = {
        "cagr": F.lit(1.0),
        "time_gap": F.lit(1.0),
        "cooks": F.col("cooks_distance"),
        "residual": F.abs("studentized"),
        "leverage": F.col("leverage"),
    }
    return _flags_to_columns(flagged, scores).drop("_n", "_k", "_mse", "_mean_so_far")


def outlier_statistics(flagged: DataFrame) -> DataFrame:
    """One row: observations, outliers, rate and a count per test that was run."""
    tests = [t for t in TESTS if f"is_{t}" in flagged.columns]
    return flagged.agg(
        F.count(F.lit(1)).alias("total_observations"),
        F.count_if("is_outlier").alias("total_outliers"),
        F.coalesce(F.avg(F.col("is_outlier").cast("double")), F.lit(0.0)).alias("outlier_rate"),
        *[F.count_if(f"is_{t}").alias(f"{t}_outliers") for t in tests],
    )


def outlier_summary(flagged: DataFrame, rules: OutlierRules = OutlierRules()) -> DataFrame:
    """Report rows (category, metric, value): totals, counts by reason, thresholds."""
    statistics = outlier_statistics(flagged)
    tests = [t for t in TESTS if f"is_{t}" in flagged.columns]

    def row(category: str, metric: str, value: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    rows = [
        row("Overall", "Total Observations", F.col("total_observations")),
        row("Overall", "Total Outliers", F.col("total_outliers")),
        row("Overall", "Outlier Rate", F.col("outlier_rate")),
        *[row("By Reason", TESTS[t], F.col(f"{t}_outliers")) for t in tests],
        row("Thresholds", "cooks_distance", F.lit(rules.cooks)),
        row("Thresholds", "leverage", F.lit(rules.leverage)),
        row("Thresholds", "studentized_residual", F.lit(rules.residual)),
        row("Thresholds", "cagr", F.lit(rules.cagr)),
        row("Thresholds", "time_gap_years", F.lit(rules.gap_years)),
    ]
    # A reason only shows when some pair has it.
    return (
        statistics.select(F.explode(F.array(*rows)).alias("r"))
        .select("r.category", "r.metric", "r.value")
        .where((F.col("category") != "By Reason") | (F.col("value") > 0))
    )
