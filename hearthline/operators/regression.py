"""Repeat-sales least squares for any number of groups in one job.

Pairs are reduced to one row per (group, first period, second period), which holds all
that the normal equations, the residual sum and R-squared need. That reduction combines
on the map side, so a group with a large share of the pairs costs one row per period
combination. Only those rows reach the Python task that solves a group.
"""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.config import FitOptions
from hearthline.functions.columns import log_ratio, period_number, period_start
from hearthline.functions.least_squares import PeriodSystem
from hearthline.session import spread

FIT_FIELDS = (
    "first_period int, num_periods int, log_returns array<double>, standard_errors array<double>, "
    "identified array<boolean>, num_observations bigint, all_pairs bigint, rank int, "
    "residual_sum double, r_squared double"
)


def key_fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{key}` {df.schema[key].dataType.simpleString()}" for key in keys)


def within_dates(pairs: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Date range on the second sale only."""
    if start is not None:
        pairs = pairs.where(F.col("second_sale_date") >= F.lit(start))
    if end is not None:
        pairs = pairs.where(F.col("second_sale_date") <= F.lit(end))
    return pairs


def in_range(start: date | None, end: date | None):
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("second_sale_date") >= F.lit(start))
    if end is not None:
        keep = keep & (F.col("second_sale_date") <= F.lit(end))
    return keep


def with_periods(pairs: DataFrame, period: str = "month") -> DataFrame:
    """Add the period numbers of both sales and the log price change."""
    return pairs.withColumns(
        {
            "first_period": period_number("first_sale_date", period),
            "second_period": period_number("second_sale_date", period),
            "log_change": log_ratio(),
        }
    )


def period_cells(
    pairs: DataFrame,
    keys: list[str],
    period: str = "month",
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """One row per group and period combination: n, mean and spread of the log change.

    all_pairs also counts pairs outside the date range, which the minimum group size is
    tested against.
    """
    rows = with_periods(pairs, period).select(
        *keys,
        "first_period",
        "second_period",
        F.when(in_range(start, end), F.col("log_change")).alias("_y"),
    )
    return rows.groupBy(*keys, "first_period", "second_period").agg(
        F.count("_y").alias("n"),
        F.avg("_y").alias("mean_change"),
        (F.var_pop("_y") * F.count("_y")).alias("spread"),
        F.count(F.lit(1)).alias("all_pairs"),
    )


def normal_matrix(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The normal matrix in long form: (group, row period, column period, value)."""
    entry = F.explode(
        F.array(
            F.struct(F.col("first_period").alias("row"), F.col("first_period").alias("col"), F.lit(1).alias("sign")),
            F.struct(F.col("second_period").alias("row"), F.col("second_period").alias("col"), F.lit(1).alias("sign")),
            F.struct(F.col("first_period").alias("row"), F.col("second_period").alias("col"), F.lit(-1).alias("sign")),
            F.struct(F.col("second_period").alias("row"), F.col("first_period").alias("col"), F.lit(-1).alias("sign")),
        )
    )
    return (
        cells.where(F.col("first_period") != F.col("second_period"))
        .select(*keys, "n", entry.alias("e"))
        .groupBy(*keys, F.col("e.row").alias("row_period"), F.col("e.col").alias("col_period"))
        .agg(F.sum(F.col("e.sign") * F.col("n")).alias("value"))
    )


def normal_moments(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The right-hand side: (group, period, summed signed log change)."""
    total = F.col("n") * F.col("mean_change")
    entry = F.explode(
        F.array(
            F.struct(F.col("first_period").alias("period"), (-total).alias("value")),
            F.struct(F.col("second_period").alias("period"), total.alias("value")),
        )
    )
    return (
        cells.where(F.col("first_period") != F.col("second_period"))
        .select(*keys, entry.alias("e"))
        .groupBy(*keys, F.col("e.period").alias("period"))
        .agg(F.sum("e.value").alias("value"))
    )


def design_entries(pairs: DataFrame, keys: list[str], period: str = "year") -> DataFrame:
    """Sparse design matrix as (pair keys, period index, -1 or +1).

    Indices run over the periods that occur, so the period list is a small table.
    """
    rows = with_periods(pairs, period)
    entry = F.explode(
        F.array(
            F.struct(F.col("first_period").alias("period"), F.lit(-1).alias("value")),
            F.struct(F.col("second_period").alias("period"), F.lit(1).alias("value")),
        )
    )
    entries = rows.select(*keys, entry.alias("e")).select(*keys, "e.period", "e.value")
    periods = (
        rows.groupBy("first_period", "second_period")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.explode(F.array("first_period", "second_period")).alias("period"))
        .distinct()
        .withColumn("period_idx", F.row_number().over(Window.orderBy("period")) - 1)
    )
    return entries.join(periods, "period")


def prepare_regression(
    pairs: DataFrame, tract_id: str | None = None, cbsa_id: str | None = None
) -> dict[str, DataFrame]:
    """Pairs of one geography with their log change, and the annual design entries."""
    if tract_id is not None:
        pairs = pairs.where(F.col("tract_id") == tract_id)
    elif cbsa_id is not None:
        pairs = pairs.where(F.col("cbsa_id") == cbsa_id)
    return {
        "pairs": pairs.withColumn("log_price_diff", log_ratio()),
        "design": design_entries(pairs, ["property_id", "first_sale_date", "second_sale_date"]),
    }


def period_grid(pairs: DataFrame, keys: list[str], period: str = "month") -> DataFrame:
    """Every period from a group's first to its last sale, sales or not."""
    rows = with_periods(pairs, period)
    return (
        rows.groupBy(*keys)
        .agg(
            F.min(F.least("first_period", "second_period")).alias("_from"),
            F.max(F.greatest("first_period", "second_period")).alias("_to"),
        )
        .select(*keys, "_from", F.explode(F.sequence("_from", "_to")).alias("period"))
        .select(
            *keys,
            (F.col("period") - F.col("_from")).alias("period_idx"),
            period_start(F.col("period"), period).alias("date"),
        )
    )


def _optional(values: np.ndarray) -> list:
    return [float(v) if np.isfinite(v) else None for v in values]


def solve_cells(cells: DataFrame, keys: list[str], options: FitOptions = FitOptions()) -> DataFrame:
    """One row per group: coefficients, standard errors and fit summary."""
    ridge, min_pairs = options.ridge, options.min_pairs

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        columns = keys + [f.split()[0] for f in FIT_FIELDS.split(", ")]
        all_pairs = int(frame["all_pairs"].sum())
        frame = frame[frame["n"] > 0]
        if all_pairs < min_pairs or frame.empty:
            return pd.DataFrame(columns=columns)
        first, second = frame["first_period"].to_numpy(), frame["second_period"].to_numpy()
        n, mean = frame["n"].to_numpy(float), frame["mean_change"].to_numpy(float)
        origin = min(first.min(), second.min())
        size = int(max(first.max(), second.max()) - origin) + 1
        system = PeriodSystem(size, first - origin, second - origin, n, mean)
        beta = system.solve()
        error = mean - (beta[second - origin] - beta[first - origin])
        within = frame["spread"].sum()
        residual_sum = float(within + (n * error**2).sum())
        count = int(n.sum())
        total_sum = float(within + (n * (mean - (n * mean).sum() / count) ** 2).sum())
        freedom = count - (size - 1)
        if freedom > 0:
            deviation = np.sqrt(system.inverse_diagonal(ridge) * residual_sum / freedom)
        else:
            deviation = np.full(size, np.nan)
        deviation[0] = 0.0
        row = [
            *key, int(origin), size, _optional(beta), _optional(deviation),
            [bool(v) for v in system.labels == 0], count, all_pairs, int(system.rank),
            residual_sum, 1 - residual_sum / total_sum if total_sum else 0.0,
        ]
        return pd.DataFrame([row], columns=columns)

    schema = f"{key_fields(cells, keys)}, {FIT_FIELDS}"
    return spread(cells, keys).groupBy(*keys).applyInPandas(solve, schema)


def fit_repeat_sales(
    pairs: DataFrame,
    keys: list[str],
    options: FitOptions = FitOptions(),
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Bailey-Muth-Nourse estimate of every group."""
    return solve_cells(period_cells(pairs, keys, options.period, start, end), keys, options)


def index_series(fits: DataFrame, keys: list[str], options: FitOptions = FitOptions()) -> DataFrame:
    """Index levels, one row per group and period."""
    zipped = F.arrays_zip("log_returns", "standard_errors", "identified")
    return (
        fits.select(*keys, "first_period", F.posexplode(zipped).alias("period_idx", "p"))
        .select(
            *keys,
            "period_idx",
            period_start(F.col("first_period") + F.col("period_idx"), options.period).alias("date"),
            (F.lit(options.base_value) * F.exp("p.log_returns")).alias("index_value"),
            F.col("p.log_returns").alias("log_return"),
            F.col("p.standard_errors").alias("standard_error"),
            F.col("p.identified").alias("identified"),
        )
    )


def fit_summary(fits: DataFrame, keys: list[str]) -> DataFrame:
    return fits.select(
        *keys,
        "num_observations",
        "num_periods",
        "rank",
        (F.col("rank") == F.col("num_periods") - 1).alias("full_rank"),
        "r_squared",
        F.sqrt("residual_sum").alias("residual_norm"),
    )


def predicted(array: str = "log_returns"):
    """Log change a fit implies for a pair joined to it."""
    def at(period: str):
        return F.get(F.col(array), F.col(period) - F.col("_origin"))

    return at("second_period") - at("first_period")


def residuals(
    pairs: DataFrame, fits: DataFrame, keys: list[str], options: FitOptions = FitOptions()
) -> DataFrame:
    """Pairs with their residual; one join, since a fit is one row per group."""
    fitted = fits.select(*keys, F.col("first_period").alias("_origin"), "log_returns")
    return (
        with_periods(pairs, options.period)
        .join(fitted, keys)
        .withColumn("residual", F.col("log_change") - predicted())
        .drop("_origin", "log_returns")
    )


def optimality(rows: DataFrame, fits: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Largest absolute entry of X'We per group, zero at a least-squares solution.

    rows: the output of residuals, or of a weighted fit with its weight column.
    """
    pull = F.col("residual") if weight is None else F.col("residual") * F.col(weight)
    cells = rows.groupBy(*keys, "first_period", "second_period").agg(
        F.sum(pull).alias("r"), F.count(F.lit(1)).alias("n")
    )
    ends = F.explode(
        F.array(
            F.struct(F.col("first_period").alias("period"), (-F.col("r")).alias("r"), F.col("n")),
            F.struct(F.col("second_period").alias("period"), F.col("r"), F.lit(0).cast("bigint").alias("n")),
        )
    )
    per_period = (
        cells.select(*keys, ends.alias("e"))
        .groupBy(*keys, F.col("e.period").alias("period"))
        .agg(F.sum("e.r").alias("r"), F.sum("e.n").alias("n"))
    )
    origins = fits.select(*keys, F.col("first_period").alias("_origin"))
    free = F.when(F.col("period") != F.col("_origin"), F.abs("r")).otherwise(F.lit(0.0))
    return (
        per_period.join(origins, keys)
        .groupBy(*keys)
        .agg(F.max(free).alias("gradient"), F.sum("n").alias("n_pairs"))
    )


def leverage_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Leverage of each observed period combination; NULL where the matrix is singular."""
    columns = [*keys, "first_period", "second_period", "leverage"]

    def diagonal(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["n"] > 0]
        if frame.empty:
            return pd.DataFrame(columns=columns)
        first, second = frame["first_period"].to_numpy(), frame["second_period"].to_numpy()
        origin = min(first.min(), second.min())
        size = int(max(first.max(), second.max()) - origin) + 1
        inverse = PeriodSystem(
            size, first - origin, second - origin, frame["n"].to_numpy(float), frame["mean_change"].to_numpy(float)
        ).inverse()
        if inverse is None:
            values = [None] * len(frame)
        else:
            f, s = first - origin, second - origin
            values = inverse[s, s] + inverse[f, f] - 2 * inverse[f, s]
        out = pd.DataFrame({"first_period": first, "second_period": second, "leverage": values})
        for position, name in enumerate(keys):
            out.insert(position, name, key[position])
        return out

    schema = f"{key_fields(cells, keys)}, first_period int, second_period int, leverage double"
    return spread(cells, keys).groupBy(*keys).applyInPandas(diagonal, schema)


def period_returns(series: DataFrame, keys: list[str], length: str = "quarterly") -> DataFrame:
    """Change over 1, 3 or 12 periods; the first ones, without a base, are dropped."""
    steps = {"monthly": 1, "quarterly": 3, "annual": 12}
    if length not in steps:
        raise ValueError(f"unknown return length: {length}")
    order = Window.partitionBy(*keys).orderBy("date")
    return (
        series.select(
            *keys,
            "date",
            (F.try_divide(F.col("index_value"), F.lag("index_value", steps[length]).over(order)) - 1).alias("return"),
        )
        .where(F.col("return").isNotNull())
    )


def rebase(series: DataFrame, keys: list[str], base_year: int, base_value: float = 100.0) -> DataFrame:
    """Scale each series so that its first value in base_year is base_value.

    A series without that year is scaled by the first value of the year nearest to it.
    """
    nearest = F.struct(F.abs(F.year("date") - base_year), "date")
    base = series.groupBy(*keys).agg(F.min_by("index_value", nearest).alias("_base"))
    return (
        series.join(base, keys)
        .withColumn("index_value", F.col("index_value") / F.col("_base") * base_value)
        .drop("_base")
    )
