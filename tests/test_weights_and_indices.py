from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.config import FitOptions, SupertractOptions
from hearthline.operators import aggregate, regression, sensitivity, weights
from hearthline.operators.outliers import remove_outliers
from hearthline.plans.estimator import estimate_indices

SHORT = "geography_id string, period int, weight_type string, tract_id string, weight double"


def sets(spark, rows):
    return spark.createDataFrame([("C", year, "value", t, w) for year, t, w in rows], SHORT)


def as_dict(table):
    return {(r.period, r.tract_id): pytest.approx(r.weight) for r in table.collect()}


def test_demographic_weights(spark):
    people = spark.createDataFrame(
        [("T1", 2020, "C1", 1000, 250000.0, 0.3, 0.2, 5.0), ("T2", 2020, "C1", 2000, 300000.0, 0.5, 0.1, 15.0),
         ("T3", 2020, "C2", 500, 200000.0, 0.0, 0.3, 10.0)],
        "tract_id string, year int, cbsa_id string, housing_units int, median_value double, college_share double, "
        "non_white_share double, upb_total double",
    )
    table = weights.demographic_weights(people)
    got = {(r.geography_id, r.weight_type, r.tract_id): r.weight for r in table.collect()}
    assert got["C1", "value", "T1"] == pytest.approx(0.25e9 / 0.85e9)
    assert got["national", "upb", "T2"] == pytest.approx(0.5) and got["C1", "sample", "T1"] == 0.5
    assert ("C2", "college", "T3") not in got  # shares sum to zero
    merged = {r.tract_id: r.weight for r in weights.merged_national(table.where("weight_type = 'unit' and geography_id <> 'national'")).collect()}
    assert merged["T3"] == pytest.approx(0.5)


def test_weight_set_operations(spark):
    base = sets(spark, [(2020, "T1", 0.25), (2020, "T2", 0.5), (2020, "T3", 0.25)])
    some = spark.createDataFrame([("T1",), ("T2",)], "tract_id string")
    assert as_dict(weights.redistribute(base, some)) == {(2020, "T1"): 1 / 3, (2020, "T2"): 2 / 3}
    assert weights.redistribute(base, some.where("tract_id = 'T9'")).count() == 0
    assert weights.effective_coverage(base, some).first().coverage == pytest.approx(0.75)
    known = spark.createDataFrame([("C", t) for t in ("T1", "T2", "T3", "T4")], "geography_id string, tract_id string")
    assert as_dict(weights.fill_missing(base, known))[2020, "T4"] == 0.0
    assert as_dict(weights.fill_missing(base, known, 0.1))[2020, "T2"] == 0.5 / 1.1
    report = weights.adjustment_report(base, weights.redistribute(base, some)).first()
    assert (report.tracts_dropped, report.original_tract_count, report.normalized) == (1, 3, True)
    two = base.selectExpr("*", "1 AS o").unionByName(
        sets(spark, [(2020, "T1", 0.75), (2020, "T4", 0.25)]).selectExpr("*", "2 AS o")
    )
    assert as_dict(weights.merge_sets(two, "o", "average"))[2020, "T1"] == 0.5 / 1.5
    assert as_dict(weights.merge_sets(two, "o", "sum"))[2020, "T1"] == 0.5
    assert as_dict(weights.merge_sets(two, "o", "first")) == as_dict(base)


def test_weight_checks(spark):
    mixed = sets(spark, [(2019, "T1", 0.5), (2019, "T2", 0.5), (2020, "T1", 0.9), (2020, "T2", 0.2), (2021, "T1", 1.0)])
    checked = {r.period: r.issues for r in weights.check_sets(mixed).collect()}
    assert checked[2019] == [] and len(checked[2020]) == 2 and checked[2021][0].startswith("Dominant weights found: T1")
    moved = {r.period: r for r in weights.consistency(mixed).collect()}
    assert moved[2020].large_change and moved[2020].moved_tract == "T1" and moved[2021].missing_tracts == 1
    near = weights.nearest_period(mixed, spark.createDataFrame([("C", 2018)], "geography_id string, base_year int"))
    assert {r.period for r in near.collect()} == {2019}


def series(spark, values):
    return spark.createDataFrame([(t, d, float(x)) for t, d, x in values], "tract_id string, date date, index_value double")


def test_laspeyres_points_and_coverage(spark):
    months = [date(2020, m, 1) for m in range(1, 5)]
    given = [("T1", d, 100 + 10 * i) for i, d in enumerate(months)] + [("T2", d, 100 + 20 * i) for i, d in enumerate(months[:2])]
    base = sets(spark, [(2019, "T1", 0.3), (2019, "T2", 0.5), (2019, "T3", 0.2)])
    mapping = spark.createDataFrame([(t, "C") for t in ("T1", "T2", "T3")], "tract_id string, geography_id string")
    result = aggregate.laspeyres(series(spark, given), base, mapping)
    got = {r.date: r for r in result.values.collect()}
    assert got[months[0]].index_value == pytest.approx(100) and got[months[0]].coverage == pytest.approx(0.8)
    assert got[months[1]].index_value == pytest.approx((0.3 * 110 + 0.5 * 120) / 0.8)
    assert got[months[3]].missing_tracts == 2
    assert result.coverage.first().coverage_rate == pytest.approx(0.3)
    cut = aggregate.laspeyres(series(spark, given), base, mapping, start=months[1], end=months[2])
    assert cut.values.count() == 2


def test_average_chain_and_difference(spark):
    bridge = spark.createDataFrame([("T1", "S1"), ("T2", "S2")], "tract_id string, supertract_id string")
    values = spark.createDataFrame(
        [("S1", date(2020, 1, 1), 100.0), ("S2", date(2020, 1, 1), 100.0), ("S1", date(2020, 2, 1), 110.0), ("S2", date(2020, 2, 1), 120.0)],
        "supertract_id string, date date, index_value double",
    )
    shares = sets(spark, [(2020, "T1", 0.4), (2020, "T2", 0.6)])
    level = {r.date.month: r.index_value for r in aggregate.combine_by_year(values, bridge, shares).collect()}
    assert level == {1: pytest.approx(100), 2: pytest.approx(116)}
    chain = {r.date.month: r.index_value for r in aggregate.combine_by_year(values, bridge, shares, "log_chain").collect()}
    assert chain[2] == pytest.approx(100 * np.exp(0.4 * np.log(1.1) + 0.6 * np.log(1.2)))
    years = spark.createDataFrame(
        [("C", y, date(y, m, 1), float(x)) for y, m, x in ((2020, 1, 100), (2020, 12, 110), (2021, 1, 101), (2021, 12, 105), (2022, 1, 100))],
        "geography_id string, year int, date date, index_value double",
    )
    linked = {r.date: r.chained_index for r in aggregate.chain_years(years).collect()}
    assert linked[date(2021, 1, 1)] == pytest.approx(101 * 1.10) and linked[date(2022, 1, 1)] == pytest.approx(105)
    full = {r.date: r.chained_index for r in aggregate.chain_years(years, compounding=True).collect()}
    assert full[date(2022, 1, 1)] == pytest.approx(100 * 1.10 * 1.05)


def test_error_bands_from_fits_by_the_delta_method(spark, pairs_table, random_pairs):
    rows = [(r[0], r[2], "X", *r[3:]) for r in random_pairs(200, months=6)]  # tracts A and B of area X
    fits = regression.fit_repeat_sales(pairs_table(rows), ["tract_id"])
    members = spark.createDataFrame([("A", "X"), ("B", "X"), ("C", "X")], "tract_id string, geography_id string")
    shares = {"A": 0.5, "B": 0.3, "C": 0.2}
    table = spark.createDataFrame([("X", 2015, "value", t, w) for t, w in shares.items()], "geography_id string, period int, weight_type string, tract_id string, weight double")
    got = {r.date: r for r in aggregate.laspeyres_from_fits(fits, table, members).values.collect()}
    series = {}
    for r in regression.index_series(fits, ["tract_id"]).collect():
        series.setdefault(r.date, {})[r.tract_id] = (r.index_value, r.index_value * r.standard_error)
    assert got.keys() == series.keys()
    for day, own in series.items():
        whole = sum(shares[t] for t in own)
        assert got[day].index_value == pytest.approx(sum(shares[t] * x for t, (x, _) in own.items()) / whole)
        assert got[day].standard_error == pytest.approx(sum((shares[t] * e) ** 2 for t, (_, e) in own.items()) ** 0.5 / whole)
        assert got[day].missing_tracts == 3 - len(own)
    unlinked = fits.withColumn("identified", F.transform("identified", lambda x: F.lit(False)))
    assert {r.standard_error for r in aggregate.laspeyres_from_fits(unlinked, table, members).values.collect()} == {None}


def test_report_lists_kinds_scenarios_and_advice(spark, pairs_table, random_pairs):
    chosen = [s for s in sensitivity.default_scenarios() if s.name in ("weight_upb", "strict_cagr_filter", "robust_huber")]
    text = sensitivity.report_text(sensitivity.scenario_series(pairs_table(random_pairs(120, months=8)), chosen), chosen)
    lines = text.split("\n")
    assert [line for line in lines if line and not line.startswith("  ")][1:] == ["By kind of change", "By scenario", "Advice"]
    assert sum(line.startswith("  ") and "points root mean square" in line for line in lines) == 3


def test_an_error_in_a_fit_becomes_a_warning(spark, pairs_table, random_pairs, monkeypatch):
    table, warnings = pairs_table(random_pairs(120, months=8)), []
    chosen = [s for s in sensitivity.default_scenarios() if s.name in ("robust_huber", "robust_cauchy", "weight_upb")]
    fit = sensitivity.fit_variants

    def failing(pairs, keys, variants, options):
        if "robust_cauchy" in variants:
            raise RuntimeError("singular")
        return fit(pairs, keys, variants, options)

    monkeypatch.setattr(sensitivity, "fit_variants", failing)
    found = {r.scenario for r in sensitivity.scenario_series(table, chosen, warnings=warnings).select("scenario").distinct().collect()}
    assert found == {"base_case", "weight_upb", "robust_huber"}
    assert warnings == ["scenario robust_cauchy left out: singular"]
    with pytest.raises(ValueError):
        sensitivity.scenario_series(table, chosen)


def test_scenarios_equal_their_own_fits(spark, pairs_table, random_pairs):
    table = pairs_table(random_pairs(200, months=10))
    chosen = [s for s in sensitivity.default_scenarios() if s.name in ("outlier_threshold_3.0", "time_window_3y", "weight_upb", "strict_cagr_filter", "min_price_filter", "robust_huber")]
    found = sensitivity.scenario_series(table, chosen)
    got = {}
    for r in found.collect():
        got.setdefault(r.scenario, {})[r.date] = r.index_value
    assert set(got) == {"base_case", *[s.name for s in chosen]}
    for name, kept in (("base_case", table), ("weight_upb", table), ("outlier_threshold_3.0", remove_outliers(table))):
        pooled = kept.selectExpr("*", "1 AS one")
        want = {r.date: r.index_value for r in regression.index_series(regression.fit_repeat_sales(pooled, ["one"]), ["one"]).collect()}
        assert got[name] == {d: pytest.approx(x) for d, x in want.items()}
    impacts = {r.scenario: r for r in sensitivity.impact(found).collect()}
    assert impacts["weight_upb"].max_difference == pytest.approx(0, abs=1e-9)
    effects = sensitivity.impact(found)
    assert sensitivity.recommendations(effects, sensitivity.importance(effects, chosen))[1].startswith("Most sensitive to")


def test_advice_follows_its_rules(spark):
    kinds = spark.createDataFrame([("time_window", 12.0), ("data_filter", 6.0), ("robust_method", 9.0), ("weight_type", 1.0)], "parameter_type string, avg_impact double")
    impacts = spark.createDataFrame([("time_window_3y", 12.0), ("robust_huber", 3.0)], "scenario string, max_pct_difference double")
    advice = sensitivity.recommendations(impacts, kinds)
    assert advice[0].startswith("⚠ High sensitivity detected: Index values can vary by up to 12.0%")
    assert advice[1] == "Most sensitive to: time_window (avg impact: 12.0%)"
    assert advice[2:4] == [sensitivity.ADVICE["time_window"], sensitivity.ADVICE["data_filter"]] and advice[4] == sensitivity.ROBUST
    assert sensitivity.recommendations(impacts.limit(0), kinds.limit(0)) == [sensitivity.LOW % 0.0]


def test_a_scenario_that_fails_leaves_a_warning(spark, pairs_table, random_pairs):
    table, warnings = pairs_table(random_pairs(120, months=8)), []
    chosen = [sensitivity.Scenario("odd", "no_such_kind"), sensitivity.Scenario("robust_odd", "robust_method", {"method": "none"}), sensitivity.default_scenarios()[0]]
    found = {r.scenario for r in sensitivity.scenario_series(table, chosen, warnings=warnings).select("scenario").distinct().collect()}
    assert found == {"base_case", chosen[2].name} and len(warnings) == 2
    with pytest.raises(ValueError):
        sensitivity.scenario_series(table, chosen)


def test_estimate_on_every_level(spark, pairs_table, random_pairs):
    rows = random_pairs(300, months=8)
    tracts = spark.createDataFrame(
        [(f"{a}{i}", a, "01", float(i), 0.0) for a in "AB" for i in range(5)],
        "tract_id string, cbsa_id string, state string, centroid_x double, centroid_y double",
    )
    edges = spark.createDataFrame([(f"{a}{i}", f"{a}{i + 1}") for a in "AB" for i in range(4)], "tract_id string, neighbor_id string")
    found = {}
    for level in ("tract", "cbsa", "state", "national"):
        estimate = estimate_indices(
            pairs_table(rows), tracts, edges, level=level, fit_options=FitOptions(min_pairs=10),
            supertract_options=SupertractOptions(min_half_pairs=40),
        )
        found[level] = estimate.index_values.collect()
    assert {r.geography_id for r in found["cbsa"]} == {"A", "B"} and {r.geography_id for r in found["national"]} == {"USA"}
    assert {r.geography_id for r in found["tract"]} == {f"{a}{i}" for a in "AB" for i in range(5)}
    first = min(r.date for r in found["tract"])
    tract = [r.index_value for r in found["tract"] if r.date == first]
    assert np.allclose([r.index_value for r in found["state"] if r.date == first], np.mean(tract))
    assert estimate.coverage.first().covered_pairs == 300
