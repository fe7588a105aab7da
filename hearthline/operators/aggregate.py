"""Roll tract or supertract series up to areas, states and the nation.

A series is one long table; weights are the long table of operators.weights.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.config import FitOptions
from hearthline.operators.regression import index_series
from hearthline.operators.weights import NATION, nearest_period, within
from hearthline.session import cut_lineage


def _up_to_here(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def combine_by_year(
    series: DataFrame, bridge: DataFrame, weights: DataFrame, mode: str = "level_mean", base_value: float = 100.0
) -> DataFrame:
    """Geography series from supertract series with the weights of each date's year.

    level_mean averages index levels over the weight that has a value on the date.
    log_chain averages log changes the same way and chains them from base_value.
    series: supertract_id, date, index_value. bridge: tract_id, supertract_id.
    """
    # Tract weights of one supertract add up first, so the date join sees supertracts.
    shares = (
        weights.join(bridge, "tract_id")
        .groupBy("geography_id", "period", "supertract_id")
        .agg(F.sum("weight").alias("w"))
    )
    values = series.select("supertract_id", "date", F.year("date").alias("period"), F.col("index_value").alias("x"))
    if mode == "log_chain":
        order = Window.partitionBy("supertract_id").orderBy("date")
        values = values.withColumn("x", F.ln("x") - F.lag(F.ln("x")).over(order))
    elif mode != "level_mean":
        raise ValueError(f"unknown aggregation mode: {mode}")
    joined = values.join(shares, ["supertract_id", "period"])
    covered = F.sum(F.when(F.col("x").isNotNull(), F.col("w")))
    mean = F.try_divide(F.sum(F.col("w") * F.col("x")), covered)
    combined = joined.groupBy("geography_id", "date").agg(mean.alias("index_value"))
    if mode == "level_mean":
        return combined.where(F.col("index_value").isNotNull()).select("geography_id", "date", "index_value")
    growth = F.sum(F.coalesce("index_value", F.lit(0.0))).over(_up_to_here("geography_id"))
    return combined.select("geography_id", "date", (F.lit(base_value) * F.exp(growth)).alias("index_value"))


@dataclass
class LaspeyresIndex:
    """Index per geography and date, and how much of each weight set it covers throughout."""

    values: DataFrame
    coverage: DataFrame
    base_weights: DataFrame


def laspeyres(
    series: DataFrame,
    weights: DataFrame,
    mapping: DataFrame,
    start: date | None = None,
    end: date | None = None,
    base_period: date | None = None,
) -> LaspeyresIndex:
    """Fixed-weight index: the weights of the base year, or of the year closest to it.

    series: tract_id, date, index_value. mapping: tract_id, geography_id. Dates a
    geography's own members have are its dates; missing members do not rescale it. Where the
    series has a standard_error, the values have one too, NULL where a member's is; errors
    of different members count as independent.
    """
    banded = "standard_error" in series.columns
    columns = ["geography_id", "tract_id", "date", "index_value", *["standard_error"] * banded]
    placed = series.join(mapping, "tract_id").select(*columns)
    if start is not None:
        placed = placed.where(F.col("date") >= F.lit(start))
    if end is not None:
        placed = placed.where(F.col("date") <= F.lit(end))
    per_date = placed.groupBy("geography_id", "date").agg(F.count(F.lit(1)).alias("_n"))
    spans = per_date.groupBy("geography_id").agg(
        F.min("date").alias("_first"), F.count(F.lit(1)).alias("_dates")
    )
    base = F.lit(base_period.year) if base_period else F.year("_first")
    chosen = nearest_period(weights, spans.select("geography_id", base.alias("base_year")))
    members = chosen.select("geography_id", "tract_id", "weight")
    sizes = members.groupBy("geography_id").agg(F.count(F.lit(1)).alias("_tracts"))
    joined = placed.join(members, ["geography_id", "tract_id"])
    spread = []
    if banded:
        known = F.count("standard_error") == F.count(F.lit(1))
        spread = [F.when(known, F.sqrt(F.sum(F.pow(F.col("weight") * F.col("standard_error"), 2)))).alias("_spread")]
    error = [(F.col("_spread") / F.col("coverage")).alias("standard_error")] * banded
    values = (
        joined.groupBy("geography_id", "date")
        .agg(
            F.sum(F.col("weight") * F.col("index_value")).alias("_sum"),
            F.sum("weight").alias("coverage"),
            F.count(F.lit(1)).alias("_seen"),
            *spread,
        )
        .where(F.col("coverage") > 0)
        .join(sizes, "geography_id")
        .select(
            "geography_id",
            "date",
            (F.col("_sum") / F.col("coverage")).alias("index_value"),
            "coverage",
            (F.col("_tracts") - F.col("_seen")).alias("missing_tracts"),
            *error,
        )
    )
    seen = placed.groupBy("geography_id", "tract_id").agg(F.count(F.lit(1)).alias("_seen"))
    throughout = F.col("_seen") == F.col("_dates")
    coverage = (
        members.join(spans, "geography_id")
        .join(seen, ["geography_id", "tract_id"], "left")
        .groupBy("geography_id")
        .agg(
            F.sum(F.when(throughout, F.col("weight")).otherwise(F.lit(0.0))).alias("_covered"),
            F.sum("weight").alias("_total"),
            F.count_if(~F.coalesce(throughout, F.lit(False))).alias("missing_tracts"),
        )
        .select(
            "geography_id",
            F.when(F.col("_total") > 0, F.col("_covered") / F.col("_total")).otherwise(F.lit(0.0)).alias("coverage_rate"),
            "missing_tracts",
        )
    )
    return LaspeyresIndex(values, coverage, chosen)


def laspeyres_from_fits(
    fits: DataFrame,
    weights: DataFrame,
    mapping: DataFrame,
    options: FitOptions = FitOptions(),
    start: date | None = None,
    end: date | None = None,
    base_period: date | None = None,
) -> LaspeyresIndex:
    """The fixed-weight index straight from stored fits, with error bands.

    fits: tract_id and the arrays of fit_repeat_sales or fit_robust. A level is the base value times the
    exponential of its coefficient, and its error that times the coefficient's (delta method); a
    period that no pair links to the first one has a level but no error.
    """
    series = index_series(fits, ["tract_id"], options)
    error = F.when(F.col("identified"), F.col("index_value") * F.col("standard_error"))
    return laspeyres(
        series.select("tract_id", "date", "index_value", error.alias("standard_error")), weights, mapping, start, end, base_period
    )


def aggregate_hierarchy(
    series: DataFrame, raw: DataFrame, mapping: DataFrame, levels: tuple[str, ...] = ("tract_id", "cbsa_id", NATION)
) -> dict[str, LaspeyresIndex]:
    """Laspeyres index at every level above the first, each from the level below it.

    raw: tract_id, period, weight_type, raw, of one weight type. mapping: one column per
    level. The weight of an area in its parent is the sum of its tracts' raw weights.
    Each level's series is materialised before the next is planned.
    """
    if NATION not in mapping.columns:
        mapping = mapping.withColumn(NATION, F.lit("USA"))
    current = series.select(F.col(series.columns[0]).alias("tract_id"), "date", "index_value")
    results: dict[str, LaspeyresIndex] = {}
    bottom = levels[0]
    measured = raw.select(F.col("tract_id").alias(bottom), "period", "weight_type", "raw")
    for child, parent in zip(levels, levels[1:]):
        links = mapping.select(F.col(child).alias("tract_id"), F.col(parent).alias("geography_id")).distinct()
        sums = (
            measured.join(mapping.select(*{bottom: 0, child: 0}).distinct(), bottom)
            .groupBy(F.col(child).alias("tract_id"), "period", "weight_type")
            .agg(F.sum("raw").alias("raw"))
            .join(links, "tract_id")
        )
        result = laspeyres(current, within(sums, "geography_id"), links)
        # Every level above reads this small table several times.
        results[parent] = replace(result, values=cut_lineage(result.values))
        current = results[parent].values.select(F.col("geography_id").alias("tract_id"), "date", "index_value")
    return results


def combine_levels(series: DataFrame, results: dict[str, LaspeyresIndex]) -> DataFrame:
    """All levels in one table (geography_type, geography_id, date, index_value)."""
    columns = ["geography_type", "geography_id", "date", "index_value"]
    combined = series.select(
        F.lit("tract").alias("geography_type"), F.col(series.columns[0]).alias("geography_id"), "date", "index_value"
    )
    for level, result in results.items():
        name = level.removesuffix("_id")
        combined = combined.unionByName(
            result.values.withColumn("geography_type", F.lit(name)).select(*columns)
        )
    return combined


def aggregation_tree(mapping: DataFrame, levels: tuple[str, ...] = ("tract_id", "cbsa_id", NATION)) -> DataFrame:
    """Parent and child of every link between neighbouring levels, one row per link."""
    if NATION not in mapping.columns:
        mapping = mapping.withColumn(NATION, F.lit("USA"))
    links = [
        mapping.select(
            F.lit(parent.removesuffix("_id")).alias("parent_type"),
            F.col(parent).cast("string").alias("parent_id"),
            F.col(child).cast("string").alias("child_id"),
        )
        for child, parent in zip(levels, levels[1:])
    ]
    tree = links[0]
    for more in links[1:]:
        tree = tree.unionByName(more)
    return tree.distinct()


def chain_years(series: DataFrame, keys: list[str] = ["geography_id"], compounding: bool = False) -> DataFrame:
    """Link yearly indices, each based at 100, to the last value of the year before.

    The default links to the previous year's own last value; compounding links to its
    chained value.
    """
    closing = series.groupBy(*keys, "year").agg((F.max_by("index_value", "date") / 100).alias("_close"))
    order = Window.partitionBy(*keys).orderBy("year")
    if compounding:
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        link = F.exp(F.coalesce(F.sum(F.ln("_close")).over(before), F.lit(0.0)))
    else:
        link = F.coalesce(F.lag("_close").over(order), F.lit(1.0))
    links = closing.withColumn("_link", link).drop("_close")
    return series.join(links, [*keys, "year"]).withColumn("chained_index", F.col("index_value") * F.col("_link")).drop("_link")


def weighting_difference(changes: DataFrame, weights: DataFrame, first: str, second: str) -> DataFrame:
    """Difference two weight types make to a geography's change: the sum of (w - w')p.

    changes: tract_id, date, change.
    """
    sign = F.when(F.col("weight_type") == first, F.col("weight")).otherwise(-F.col("weight"))
    gaps = (
        weights.where(F.col("weight_type").isin(first, second))
        .groupBy("geography_id", "period", "tract_id")
        .agg(F.sum(sign).alias("_gap"))
    )
    return (
        changes.withColumn("period", F.year("date"))
        .join(gaps, ["tract_id", "period"])
        .groupBy("geography_id", "date")
        .agg(F.sum(F.col("_gap") * F.col("change")).alias("difference"))
    )


def distance_gradient(changes: DataFrame, tracts: DataFrame, centers: DataFrame) -> DataFrame:
    """Per area and date: slope of the change over distance to the centre, and its variance.

    centers: cbsa_id, center_x, center_y.
    """
    away = tracts.join(centers, "cbsa_id").select(
        "tract_id",
        "cbsa_id",
        F.hypot(F.col("centroid_x") - F.col("center_x"), F.col("centroid_y") - F.col("center_y")).alias("_distance"),
    )
    return (
        changes.join(away, "tract_id")
        .groupBy("cbsa_id", "date")
        .agg(
            F.regr_slope("change", "_distance").alias("gradient"),
            F.var_samp("change").alias("variance"),
            F.count("change").alias("tracts"),
        )
    )


def coverage_statistics(pairs: DataFrame, fits: DataFrame) -> DataFrame:
    """One row: pairs given, pairs used, their ratio and the number of regressions."""
    total = pairs.agg(F.count(F.lit(1)).alias("total_pairs"))
    used = fits.agg(
        F.coalesce(F.sum("num_observations"), F.lit(0)).alias("covered_pairs"), F.count(F.lit(1)).alias("num_regressions")
    )
    # Both sides are single-row aggregates.
    return total.join(used, F.lit(True)).withColumn(
        "coverage_rate", F.coalesce(F.try_divide(F.col("covered_pairs"), F.col("total_pairs")), F.lit(0.0))
    )
