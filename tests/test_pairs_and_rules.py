from datetime import date

import numpy as np
import pandas as pd
import pytest

from hearthline import schemas
from hearthline.operators import panel, validate
from hearthline.operators.pairs import pair_daily_sales, pair_sales, with_metrics


def test_three_and_two_sales_make_three_pairs(spark):
    rows = [
        ("P1", "T1", "C1", date(2010, 1, 1), 200000.0), ("P1", "T1", "C1", date(2012, 1, 1), 230000.0),
        ("P1", "T1", "C1", date(2015, 1, 1), 250000.0), ("P2", "T2", "C1", date(2011, 1, 1), 100000.0),
        ("P2", "T2", "C1", date(2014, 1, 1), 90000.0), ("P3", "T2", "C1", date(2014, 1, 1), 90000.0),
    ]
    sales = spark.createDataFrame(rows, schemas.TRANSACTIONS)
    for pair in (pair_sales, pair_daily_sales):
        got = sorted(tuple(r) for r in pair(sales).collect())
        assert len(got) == 3
        assert got[0][3:] == (date(2010, 1, 1), 200000.0, date(2012, 1, 1), 230000.0)


def test_same_day_sales_and_copies_are_chained_like_a_sorted_list(spark):
    rng = np.random.default_rng(3)
    rows = [
        (f"P{rng.integers(4)}", "T", "C", date(2010, 1, 1 + int(rng.integers(6))), float(rng.integers(5)))
        for _ in range(200)
    ]
    got = sorted(tuple(r) for r in pair_sales(spark.createDataFrame(rows, schemas.TRANSACTIONS)).collect())
    want = []
    frame = pd.DataFrame(rows, columns=["p", "t", "c", "d", "x"]).sort_values(["p", "d", "x"])
    for name, group in frame.groupby("p"):
        sold = list(zip(group["d"], group["x"]))
        want += [(name, "T", "C", *a, *b) for a, b in zip(sold, sold[1:])]
    assert got == sorted(want)


def pair(first, price1, second, price2):
    return ("P", "T", "C", first, price1, second, price2)


def test_each_rule_gives_its_reason(pairs_table):
    rows = [
        pair(date(2010, 1, 1), 100.0, date(2010, 6, 1), 101.0),
        pair(date(2010, 1, 1), 100.0, date(2012, 1, 1), 190.0),
        pair(date(2010, 1, 1), 100.0, date(2030, 1, 1), 1100.0),
        pair(date(2010, 1, 1), -1.0, date(2015, 1, 1), 110.0),
        pair(date(2012, 1, 1), 100.0, date(2010, 1, 1), 110.0),
        pair(date(2019, 1, 1), 100.0, date(2020, 1, 1), 105.0),
        pair(date(2010, 1, 1), 0.0, date(2015, 1, 1), 110.0),
        pair(date(2010, 1, 1), None, date(2015, 1, 1), 110.0),
        pair(date(2010, 1, 1), float("nan"), date(2015, 1, 1), 110.0),
    ]
    got = [r.rejection_reason for r in validate.validate_pairs(pairs_table(rows)).collect()]
    assert got == [
        "Same 12-month period", "CAGR exceeds ±30%", "Appreciation out of bounds", "Invalid prices",
        "Invalid date order", "", "Invalid prices", "Invalid prices", "Invalid prices",
    ]


def test_messages_name_the_first_broken_rule(pairs_table):
    rows = [
        pair(date(2010, 1, 1), -1.0, date(2010, 6, 1), 101.0),
        pair(date(2010, 1, 1), 100.0, date(2012, 1, 1), 225.0),
        pair(date(2010, 1, 1), 100.0, date(2020, 1, 1), 74.0),
        pair(date(2010, 1, 1), 100.0, date(2020, 1, 1), 120.0),
    ]
    got = [r.message for r in validate.explain_pairs(pairs_table(rows)).collect()]
    assert got[0] == "Transactions within same 12-month period"
    assert got[1].startswith("CAGR 50.0") and got[1].endswith("% exceeds ±30% threshold")
    assert got[2:] == ["Appreciation 0.74x below 0.75x threshold", None]


def test_report_counts_and_statistics(pairs_table, random_pairs):
    table = validate.validate_pairs(pairs_table(random_pairs()))
    report = validate.validation_report(table).first()
    frame = table.toPandas()
    good = frame[frame.is_valid]
    assert report.total_transactions == len(frame) and report.valid_transactions == len(good)
    assert report.cagr_std == pytest.approx(good.cagr.std())
    assert report.median_years == pytest.approx(good.time_diff_years.median(), abs=1e-12)
    reasons = {r.rejection_reason: r.pairs for r in validate.rejection_counts(table).collect()}
    assert reasons == frame[~frame.is_valid].rejection_reason.value_counts().to_dict()


def test_empty_input_gives_empty_results(spark):
    empty = spark.createDataFrame([], schemas.PAIRS)
    assert validate.validate_pairs(empty).count() == 0
    assert validate.validation_report(validate.validate_pairs(empty)).first().total_transactions == 0


def test_metrics_of_one_pair(pairs_table):
    row = with_metrics(pairs_table([pair(date(2010, 1, 15), 250000.0, date(2015, 6, 20), 325000.0)])).first()
    years = (date(2015, 6, 20) - date(2010, 1, 15)).days / 365.25
    assert row.log_price_diff == pytest.approx(np.log(1.3))
    assert row.cagr == pytest.approx(1.3 ** (1 / years) - 1)


def test_half_pair_counts(pairs_table):
    ten = [("P", "T1", "C", date(2020, 1, 1), 1.0, date(2020, 5, 1), 1.0)] * 10
    assert [r.half_pairs for r in panel.half_pairs(pairs_table(ten)).collect()] == [20]
    chain = [
        ("P", "T1", "C", date(2001, 1, 1), 1.0, date(2003, 5, 1), 1.0),
        ("P", "T1", "C", date(2003, 5, 1), 1.0, date(2006, 5, 1), 1.0),
    ]
    got = {r.year: r.half_pairs for r in panel.half_pairs_of_sales(pairs_table(chain)).collect()}
    assert got == {2001: 1, 2003: 2, 2006: 1}
    window = {r.year: r.half_pairs for r in panel.half_pair_panel(pairs_table(chain), 2001, 2007).collect()}
    assert window == {2001: 1, 2002: 1, 2003: 2, 2004: 2, 2006: 1, 2007: 1}


def test_latest_demographics_take_the_last_known_value(spark):
    tracts = spark.createDataFrame([("T1", "C"), ("T2", "C")], "tract_id string, cbsa_id string")
    people = spark.createDataFrame(
        [("T1", 2010, 5, 1.0), ("T1", 2020, None, 2.0)], "tract_id string, year int, units int, value double"
    )
    got = {r.tract_id: r for r in panel.tracts_with_demographics(tracts, people).collect()}
    assert (got["T1"].year, got["T1"].units, got["T1"].value) == (2020, 5, 2.0)
    assert got["T2"].year is None


def test_tract_checks(spark):
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    rows = [
        ("T1", "C", "01", "001", square), ("T1", "C", "01", "001", square),
        ("T2", None, "01", "001", square), ("T3", "C", "01", "001", square[:3]),
    ]
    tracts = spark.createDataFrame(
        rows, "tract_id string, cbsa_id string, state string, county string, geometry array<array<double>>"
    )
    got = {(r.issue, r.subject, r.rows) for r in validate.tract_issues(tracts).collect()}
    assert got == {("duplicate tract id", "T1", 2), ("null values", "cbsa_id", 1), ("invalid geometry", "T3", 1)}
    with pytest.raises(ValueError):
        validate.tract_issues(tracts.drop("state"))
