"""Weights as one long table: geography_id, period, weight_type, tract_id, weight.

Totals are aggregates joined back, so a national set is never one task's window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.config import DEMOGRAPHIC_TYPES, WeightRules

SET = ["geography_id", "period", "weight_type"]
NATION = "national"


def raw_weights(demographics: DataFrame, types: tuple[str, ...] = ("sample", *DEMOGRAPHIC_TYPES)) -> DataFrame:
    """Unscaled weight of each tract, year and type, all types in one pass."""
    measure = {
        "sample": F.lit(1.0),
        "value": F.col("housing_units") * F.col("median_value"),
        "unit": F.col("housing_units").cast("double"),
        "upb": F.col("upb_total"),
        "college": F.col("college_share"),
        "non_white": F.col("non_white_share"),
    }
    rows = F.explode(
        F.array(*[F.struct(F.lit(t).alias("weight_type"), measure[t].cast("double").alias("raw")) for t in types])
    )
    keep = [c for c in ("cbsa_id", "state") if c in demographics.columns]
    return demographics.select("tract_id", F.col("year").alias("period"), *keep, rows.alias("r")).select(
        "tract_id", "period", *keep, "r.weight_type", "r.raw"
    )


def normalise(weights: DataFrame, keys: list[str] = SET) -> DataFrame:
    """Scale each set to sum to 1; a set whose sum is not positive stays as it is."""
    totals = weights.groupBy(*keys).agg(F.sum("weight").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("weight") / F.col("_total")).otherwise(F.col("weight"))
    return weights.join(totals, keys).withColumn("weight", share).drop("_total")


def within(raw: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Share of each tract in its geography; sets without a positive sum do not exist."""
    geography = F.lit(name) if name else F.col(column)
    sets = raw.select(geography.alias("geography_id"), "period", "weight_type", "tract_id", F.col("raw").alias("weight"))
    totals = sets.groupBy(*SET).agg(F.sum("weight").alias("_total")).where(F.col("_total") > 0)
    return sets.join(totals, SET).withColumn("weight", F.col("weight") / F.col("_total")).drop("_total")


def demographic_weights(
    demographics: DataFrame, types: tuple[str, ...] = ("sample", *DEMOGRAPHIC_TYPES)
) -> DataFrame:
    """Weights in every area and in the nation as a whole."""
    both = F.explode(F.array("cbsa_id", F.lit(NATION)))
    return within(raw_weights(demographics, types).withColumn("_geography", both), "_geography")


def merged_national(area_weights: DataFrame) -> DataFrame:
    """National weights made of the area sets, so that every area counts the same."""
    return normalise(area_weights.withColumn("geography_id", F.lit(NATION)))


def equal_weights(tracts: DataFrame, periods: DataFrame, column: str = "cbsa_id") -> DataFrame:
    """The same weight for every tract of a geography, in every year of periods (period), a table of a few rows."""
    geography = F.lit(NATION) if column == NATION else F.col(column)
    members = tracts.select(geography.alias("geography_id"), "tract_id").distinct()
    counts = members.groupBy("geography_id").agg(F.count(F.lit(1)).alias("_n"))
    years = periods.agg(F.collect_set("period").alias("_periods"))
    return members.join(counts, "geography_id").crossJoin(years).select(
        "geography_id", F.explode("_periods").alias("period"), F.lit("sample").alias("weight_type"), "tract_id", (1 / F.col("_n")).alias("weight")
    )


def half_pair_weights(counts: DataFrame, tracts: DataFrame, column: str = "cbsa_id") -> DataFrame:
    """Share of a geography's half-pairs in each year."""
    raw = counts.join(tracts.select("tract_id", "cbsa_id"), "tract_id").select(
        "tract_id", F.col("year").alias("period"), "cbsa_id", F.lit("sample").alias("weight_type"),
        F.col("half_pairs").cast("double").alias("raw"),
    )
    return within(raw, "", NATION) if column == NATION else within(raw, column)


def add_demographics(known: DataFrame, new: DataFrame) -> DataFrame:
    return known.unionByName(new, allowMissingColumns=True)


def available_periods(weights: DataFrame) -> DataFrame:
    return weights.select("geography_id", "period").distinct()


def check_sets(weights: DataFrame, rules: WeightRules = WeightRules()) -> DataFrame:
    """One row per set with every problem found."""
    total, largest = F.col("total"), F.col("largest")
    issues = F.array_compact(
        F.array(
            F.when(F.abs(total - 1) >= rules.tolerance, F.format_string("Weights not normalized: sum = %.6f", F.bround(total, 6))),
            F.when(F.col("negative") > 0, F.format_string("Negative weights found for %d tracts", F.col("negative"))),
            F.when(F.abs(total) < rules.tolerance, F.lit("Total weight is zero or near zero")),
            F.when(
                largest > rules.dominance,
                F.format_string("Dominant weights found: %s = %.3f", F.col("largest_tract"), F.bround(largest, 3)),
            ),
        )
    )
    return (
        weights.groupBy(*SET)
        .agg(
            F.count(F.lit(1)).alias("tracts"),
            F.sum("weight").alias("total"),
            F.count_if(F.col("weight") < 0).alias("negative"),
            F.max("weight").alias("largest"),
            F.max_by("tract_id", F.struct("weight", "tract_id")).alias("largest_tract"),
        )
        .withColumns({"issues": issues, "is_valid": F.size(issues) == 0})
    )


def incomplete_sets(weights: DataFrame, demographics: DataFrame) -> DataFrame:
    """Sets whose tracts differ from the geography's tracts in the demographic data."""
    expected = demographic_weights(demographics, ("sample",)).select("geography_id", "period", "tract_id")
    both = weights.select(*SET, "tract_id").withColumn("_given", F.lit(True))
    wanted = expected.join(weights.select(*SET).distinct(), ["geography_id", "period"]).withColumn("_wanted", F.lit(True))
    return (
        both.join(wanted, [*SET, "tract_id"], "full")
        .groupBy(*SET)
        .agg(F.count_if(F.col("_given").isNull()).alias("missing"), F.count_if(F.col("_wanted").isNull()).alias("unexpected"))
        .where("missing > 0 or unexpected > 0")
    )


def _previous_periods(weights: DataFrame) -> DataFrame:
    keys = ["geography_id", "weight_type"]
    order = Window.partitionBy(*keys).orderBy("period")
    return weights.select(*keys, "period").distinct().withColumn("previous", F.lag("period").over(order))


def consistency(weights: DataFrame, rules: WeightRules = WeightRules()) -> DataFrame:
    """Per set after the first: tracts missing, and the largest move against the last period."""
    keys = ["geography_id", "weight_type"]
    known = weights.groupBy(*keys).agg(F.count_distinct("tract_id").alias("_known"))
    sizes = weights.groupBy(*SET).agg(F.count(F.lit(1)).alias("_tracts"))
    periods = _previous_periods(weights).where(F.col("previous").isNotNull())
    earlier = weights.select(*keys, F.col("period").alias("previous"), "tract_id", F.col("weight").alias("_before"))
    moves = (
        weights.join(periods, SET)
        .join(earlier, [*keys, "previous", "tract_id"])
        .withColumn("_change", F.abs(F.col("weight") - F.col("_before")))
        .groupBy(*SET)
        .agg(F.max(F.struct("_change", "tract_id", "_before")).alias("m"))
    )
    return (
        periods.join(sizes, SET)
        .join(known, keys)
        .join(moves, SET, "left")
        .select(
            *SET,
            "previous",
            (F.col("_known") - F.col("_tracts")).alias("missing_tracts"),
            F.col("m.tract_id").alias("moved_tract"),
            F.col("m._change").alias("largest_change"),
            F.coalesce(F.col("m._change") > rules.change * F.col("m._before"), F.lit(False)).alias("large_change"),
        )
        .withColumn("is_consistent", (F.col("missing_tracts") == 0) & ~F.col("large_change"))
    )


def fill_missing(weights: DataFrame, tracts: DataFrame, fill: float = 0.0) -> DataFrame:
    """Give tracts (geography_id, tract_id) absent from a set the fill weight."""
    wanted = weights.select(*SET).distinct().join(tracts.select("geography_id", "tract_id"), "geography_id")
    filled = weights.join(wanted, [*SET, "tract_id"], "full").withColumn(
        "weight", F.coalesce(F.col("weight"), F.lit(float(fill)))
    )
    return normalise(filled) if fill > 0 else filled


def redistribute(weights: DataFrame, available: DataFrame) -> DataFrame:
    """Move the weight of tracts without data to those with; a set without any vanishes."""
    return normalise(weights.join(available.select("tract_id").distinct(), "tract_id", "left_semi"))


def merge_sets(weights: DataFrame, order: str, strategy: str = "average") -> DataFrame:
    """Merge the sets of one (geography, period, type) told apart by the order column."""
    keys = [*SET, "tract_id"]
    if strategy == "first":
        lead = weights.groupBy(*SET).agg(F.min(order).alias(order))
        merged = weights.join(lead, [*SET, order]).select(*keys, "weight")
    else:
        combine = {"average": F.avg, "sum": F.sum}.get(strategy)
        if combine is None:
            raise ValueError(f"unknown merge strategy: {strategy}")
        merged = weights.groupBy(*keys).agg(combine("weight").alias("weight"))
    return normalise(merged)


def effective_coverage(weights: DataFrame, available: DataFrame) -> DataFrame:
    """Share of each set's weight that lies on tracts with data."""
    seen = available.select("tract_id").distinct().withColumn("_seen", F.lit(True))
    covered = F.sum(F.when(F.col("_seen"), F.col("weight")).otherwise(F.lit(0.0)))
    return (
        weights.join(seen, "tract_id", "left")
        .groupBy(*SET)
        .agg(covered.alias("_covered"), F.sum("weight").alias("_total"))
        .select(
            *SET,
            F.when(F.col("_total") > 0, F.col("_covered") / F.col("_total")).otherwise(F.lit(0.0)).alias("coverage"),
        )
    )


def adjustment_report(original: DataFrame, adjusted: DataFrame, rules: WeightRules = WeightRules()) -> DataFrame:
    """Counts, dropped tracts and totals of the sets present on both sides."""
    keys = [*SET, "tract_id"]
    sides = original.select(*keys, F.col("weight").alias("_old")).join(
        adjusted.select(*keys, F.col("weight").alias("_new")), keys, "full"
    )
    return (
        sides.groupBy(*SET)
        .agg(
            F.count("_old").alias("original_tract_count"),
            F.count("_new").alias("adjusted_tract_count"),
            F.count_if(F.col("_old").isNotNull() & F.col("_new").isNull()).alias("tracts_dropped"),
            F.sum("_old").alias("original_total_weight"),
            F.sum("_new").alias("adjusted_total_weight"),
        )
        .where("original_tract_count > 0 and adjusted_tract_count > 0")
        .withColumn("normalized", F.abs(F.col("adjusted_total_weight") - 1) < rules.tolerance)
    )


def nearest_period(weights: DataFrame, wanted: DataFrame) -> DataFrame:
    """The set of each geography whose period is closest to the wanted one, ties earlier.

    wanted: geography_id, base_year.
    """
    keys = ["geography_id", "weight_type"]
    chosen = (
        weights.select(*SET).distinct()
        .join(wanted, "geography_id")
        .groupBy(*keys)
        .agg(F.min_by("period", F.struct(F.abs(F.col("period") - F.col("base_year")), "period")).alias("period"))
    )
    return weights.join(chosen, SET)
