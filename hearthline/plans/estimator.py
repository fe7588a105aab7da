"""From pairs to an index per geography."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.config import FitOptions, RobustOptions, SupertractOptions
from hearthline.operators.aggregate import combine_by_year, coverage_statistics
from hearthline.operators.geography import adjacent_tracts
from hearthline.operators.panel import half_pairs
from hearthline.operators.regression import fit_repeat_sales, index_series
from hearthline.operators.robust import fit_robust
from hearthline.operators.supertracts import build_supertracts, tract_bridge
from hearthline.operators.weights import NATION, merged_national, raw_weights, within
from hearthline.session import cut_lineage

LEVELS = ("tract", "cbsa", "state", "national")


@dataclass
class IndexEstimate:
    index_values: DataFrame
    fits: DataFrame
    supertracts: DataFrame
    bridge: DataFrame
    weights: DataFrame | None
    coverage: DataFrame


def _analysis_span(pairs: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """One row: first and last year of the analysis, from the second sales unless given."""
    if start is not None and end is not None:
        return pairs.sparkSession.createDataFrame([(start.year, end.year)], "_from int, _to int")
    by_year = pairs.groupBy(F.year("second_sale_date").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    first = F.lit(start.year) if start is not None else F.min("y")
    last = F.lit(end.year) if end is not None else F.max("y")
    return by_year.agg(first.alias("_from"), last.alias("_to"))


def _in_span(df: DataFrame, column: str, span: DataFrame) -> DataFrame:
    # span is a single row by construction.
    return df.join(F.broadcast(span), F.col(column).between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def require_demographics(weight_type: str, level: str, demographics: DataFrame | None) -> None:
    """Equal weights are what "sample" means; any other weighting cannot do without the table."""
    if demographics is None and level != "tract" and weight_type != "sample":
        raise ValueError(f"weighting by {weight_type} needs demographics, and there are none")


def level_weights(
    tracts: DataFrame, demographics: DataFrame | None, weight_type: str, level: str, span: DataFrame
) -> DataFrame:
    """Weights of every geography of a level; equal ones without demographics."""
    if demographics is not None:
        known = [c for c in demographics.columns if c not in ("cbsa_id", "state")]
        placed = demographics.select(*known).join(tracts.select("tract_id", "cbsa_id", "state"), "tract_id")
        raw = _in_span(raw_weights(placed, (weight_type,)), "period", span)
    else:
        years = F.explode(F.sequence("_from", "_to")).alias("period")
        raw = tracts.join(F.broadcast(span), F.lit(True)).select(
            "tract_id", years, "cbsa_id", "state", F.lit("sample").alias("weight_type"), F.lit(1.0).alias("raw")
        )
    if level == "state":
        return within(raw, "state")
    by_area = within(raw, "cbsa_id")
    if level == "cbsa":
        return by_area
    return merged_national(by_area) if demographics is not None else within(raw, "", NATION)


def estimate_indices(
    pairs: DataFrame,
    tracts: DataFrame,
    adjacency: DataFrame | None = None,
    demographics: DataFrame | None = None,
    weight_type: str = "sample",
    level: str = "cbsa",
    start: date | None = None,
    end: date | None = None,
    mode: str = "level_mean",
    supertract_options: SupertractOptions = SupertractOptions(),
    fit_options: FitOptions = FitOptions(min_pairs=10),
    robust: RobustOptions | None = None,
    regions: DataFrame | None = None,
) -> IndexEstimate:
    """Supertracts of every year, one regression per supertract, weighted aggregation.

    pairs are the valid pairs, best a stored table, as it is read several times; tracts has tract_id, cbsa_id and state. A supertract with
    fewer than the minimum of pairs gets no regression. The supertracts, a small table
    that several steps read, are materialised at once; with robust set, the fits are
    M-estimates and counting jobs run as well. Without adjacency, tracts whose outlines
    touch are neighbours.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level: {level}")
    if adjacency is None and supertract_options.strategy == "adjacent":
        adjacency = adjacent_tracts(tracts)
    span = _analysis_span(pairs, start, end)
    counts = _in_span(half_pairs(pairs), "year", span)
    supertracts = cut_lineage(build_supertracts(counts, tracts, adjacency, supertract_options, regions))
    bridge = tract_bridge(supertracts)
    assigned = pairs.join(bridge, "tract_id", "left").withColumn(
        "supertract_id", F.coalesce("supertract_id", F.concat(F.lit("super_"), "tract_id"))
    )
    keys = ["supertract_id"]
    if robust is None:
        fits = fit_repeat_sales(assigned, keys, fit_options, start, end)
    else:
        fits = fit_robust(assigned, keys, robust, fit_options, start, end)
    series = index_series(fits, keys, fit_options)
    own = F.concat(F.lit("super_"), "tract_id")
    full_bridge = tracts.select("tract_id").join(bridge, "tract_id", "left").select(
        "tract_id", F.coalesce("supertract_id", own).alias("supertract_id")
    )
    weights = None
    if level == "tract":
        values = series.join(full_bridge, "supertract_id").select("date", F.col("tract_id").alias("geography_id"), "index_value")
    else:
        weights = level_weights(tracts, demographics, weight_type, level, span)
        values = combine_by_year(series, full_bridge, weights, mode, fit_options.base_value)
        if level == "national":
            values = values.withColumn("geography_id", F.lit("USA"))
    values = values.select("date", "geography_id", F.lit(level).alias("geography_type"), "index_value")
    return IndexEstimate(values, fits, supertracts, full_bridge, weights, coverage_statistics(pairs, fits))
