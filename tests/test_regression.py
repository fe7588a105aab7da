from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.config import FitOptions, OutlierRules, RobustOptions
from hearthline.operators import outliers, regression, robust
from hearthline.session import cut_lineage

AREA = ["cbsa_id"]


def design(rows):
    """Dense design matrix of one group, first month dropped, and the log changes."""
    f = np.array([r[3].year * 12 + r[3].month for r in rows])
    s = np.array([r[5].year * 12 + r[5].month for r in rows])
    low = min(f.min(), s.min())
    x = np.zeros((len(rows), max(f.max(), s.max()) - low + 1))
    np.add.at(x, (np.arange(len(rows)), s - low), 1)
    np.add.at(x, (np.arange(len(rows)), f - low), -1)
    return x[:, 1:], np.log([r[6] / r[4] for r in rows])


def split(rows):
    return {k: [r for r in rows if r[2] == k] for k in sorted({r[2] for r in rows})}


def test_coefficients_errors_and_fit_equal_dense_least_squares(pairs_table, random_pairs):
    rows = random_pairs(400, months=20)
    fits = {r.cbsa_id: r for r in regression.fit_repeat_sales(pairs_table(rows), AREA).collect()}
    for name, part in split(rows).items():
        x, y = design(part)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        error = y - x @ beta
        n, k = x.shape
        se = np.sqrt(np.diag(np.linalg.inv(x.T @ x + 1e-10 * np.eye(k))) * (error @ error) / (n - k))
        fit = fits[name]
        assert np.allclose(fit.log_returns, np.insert(beta, 0, 0), atol=1e-9)
        assert np.allclose(fit.standard_errors, np.insert(se, 0, 0), rtol=1e-6)
        assert fit.r_squared == pytest.approx(1 - error @ error / ((y - y.mean()) ** 2).sum())
        assert fit.rank == np.linalg.matrix_rank(x) and fit.num_observations == n


def test_months_without_a_link_to_the_first_get_the_smallest_solution(pairs_table):
    def row(f, s, change):
        return ("P", "T", "A", date(2020, f, 5), 100.0, date(2020, s, 5), float(100 * np.exp(change)))

    rows = [row(1, 3, 0.1), row(1, 3, 0.2), row(5, 8, 0.3), row(5, 8, 0.1), row(8, 9, -0.2), row(2, 2, 0.5)]
    fit = regression.fit_repeat_sales(pairs_table(rows), AREA).first()
    x, y = design(rows)
    assert np.allclose(fit.log_returns, np.insert(np.linalg.pinv(x) @ y, 0, 0), atol=1e-10)
    assert fit.log_returns[1] == 0.0 and fit.identified == [i in (0, 2) for i in range(9)]
    assert fit.rank == np.linalg.matrix_rank(x)
    assert all(e is None for e in fit.standard_errors[1:])  # fewer pairs than months
    series = regression.index_series(regression.fit_repeat_sales(pairs_table(rows), AREA), AREA).collect()
    assert [r.index_value for r in series if not r.identified and r.period_idx == 1] == [100.0]


def test_unlinked_months_have_their_ridge_error(pairs_table, random_pairs):
    rows = random_pairs(120, months=6, groups=("A",))
    rows += [("Q", "A0", "A", date(2019, 1, 1), 100.0, date(2019, 3, 1), 101.0 + i) for i in range(3)]
    fit = regression.fit_repeat_sales(pairs_table(rows), AREA).first()
    x, y = design(rows)
    n, k = x.shape
    error = y - x @ (np.linalg.pinv(x) @ y)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x + 1e-10 * np.eye(k))) * (error @ error) / (n - k))
    assert np.allclose(np.array(fit.standard_errors[1:], float), se, rtol=1e-4)


def test_date_range_minimum_and_periods(pairs_table, random_pairs):
    rows = random_pairs(60, groups=("A",))
    table = pairs_table(rows)
    cut = date(2015, 9, 1)
    fit = regression.fit_repeat_sales(table, AREA, FitOptions(min_pairs=10), end=cut).first()
    assert fit.num_observations == sum(r[5] <= cut for r in rows) and fit.all_pairs == 60
    assert regression.fit_repeat_sales(table, AREA, FitOptions(min_pairs=61)).count() == 0
    assert regression.fit_repeat_sales(table, AREA, end=date(1990, 1, 1)).count() == 0
    yearly = regression.index_series(regression.fit_repeat_sales(table, AREA, FitOptions(period="year")), AREA, FitOptions(period="year"))
    assert [r.date for r in yearly.orderBy("date").collect()][0] == date(2015, 1, 1)


def test_known_growth_is_recovered(pairs_table):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(2000):
        f, s = sorted(rng.choice(36, 2, replace=False))
        change = 0.005 * (s - f) + rng.normal(0, 0.02)
        rows.append(("P", "T", "A", date(2015 + f // 12, f % 12 + 1, 3), 100.0, date(2015 + s // 12, s % 12 + 1, 3), float(100 * np.exp(change))))
    fits = regression.fit_repeat_sales(pairs_table(rows), AREA)
    returns = regression.period_returns(regression.index_series(fits, AREA), AREA, "monthly")
    assert returns.agg(F.avg("return")).first()[0] == pytest.approx(0.005, abs=0.001)
    assert fits.first().r_squared > 0.5
    gradient = regression.optimality(regression.residuals(pairs_table(rows), fits, AREA), fits, AREA).first().gradient
    assert gradient < 1e-8


def dense_robust(x, y, method, rounds=50):
    weigh = {
        "huber": lambda r: np.where(np.abs(r) <= 1.345, 1.0, 1.345 / np.maximum(np.abs(r), 1e-300)),
        "bisquare": lambda r: np.where(np.abs(r) <= 4.685, (1 - (r / 4.685) ** 2) ** 2, 0.0),
        "cauchy": lambda r: 1 / (1 + (r / 2.385) ** 2),
        "welsch": lambda r: np.exp(-((r / 2.985) ** 2)),
    }[method]
    new = np.linalg.pinv(x) @ y
    for done in range(1, rounds + 1):
        old = new
        e = y - x @ old
        w = weigh(e / (1.4826 * np.median(np.abs(e - np.median(e)))))
        root = np.sqrt(w)
        new = np.linalg.pinv(x * root[:, None]) @ (y * root)
        if np.abs(new - old).max() < 1e-4:
            break
    return new, w, done


@pytest.mark.parametrize("method", ["huber", "bisquare", "cauchy", "welsch"])
@pytest.mark.parametrize("in_task", [1000, 0])
def test_robust_estimates_equal_dense_reweighting(pairs_table, random_pairs, monkeypatch, method, in_task):
    monkeypatch.setattr(robust, "IN_TASK", in_task)
    rows = random_pairs(300, months=14)
    table = pairs_table(rows)
    for rounds in (50, 2) if in_task else (3,):
        options = RobustOptions(method=method, max_iterations=rounds)
        fits = cut_lineage(robust.fit_robust(table, AREA, options))
        got = {r.cbsa_id: r for r in fits.collect()}
        weights = {(r.cbsa_id, r.property_id): r.weight for r in robust.weighted_residuals(table, fits, AREA, options).collect()}
        for name, part in split(rows).items():
            x, y = design(part)
            beta, w, done = dense_robust(x, y, method, rounds)
            error = y - x @ beta
            n, k = x.shape
            se = np.sqrt(np.diag(np.linalg.inv(x.T @ (x * w[:, None]))) * (w @ error**2) / (n - k))
            assert np.allclose(got[name].log_returns[1:], beta, atol=1e-8)
            assert got[name].iterations == done and got[name].converged == (rounds == 50 or done < rounds)
            assert np.allclose(got[name].standard_errors[1:], se, rtol=1e-6)
            total = w @ (y - (w @ y) / w.sum()) ** 2
            assert got[name].r_squared == pytest.approx(1 - (w @ error**2) / total)
            assert np.allclose([weights[name, r[0]] for r in part], w, atol=1e-8)


def test_two_rounds_may_not_converge_and_perfect_data_keeps_full_weight(pairs_table, random_pairs):
    capped = robust.fit_robust(pairs_table(random_pairs()), AREA, RobustOptions(max_iterations=2, tolerance=1e-12))
    assert {(r.iterations, r.converged) for r in capped.collect()} == {(2, False)}
    exact = [("P", "T", "A", date(2020, 1, 1), 100.0, date(2020, m, 1), 100.0 + m) for m in (2, 3, 4) for _ in range(3)]
    fit = robust.fit_robust(pairs_table(exact), AREA).first()
    assert fit.converged and np.allclose(fit.log_returns, [0, *np.log([1.02, 1.03, 1.04])])
    with pytest.raises(ValueError):
        RobustOptions(method="median")


def test_variants_and_sizes_of_groups_mix(pairs_table, random_pairs, monkeypatch):
    rows = random_pairs(240, months=10, groups=("A", "B", "B", "B"))
    variants = {"mild": RobustOptions(tuning=3.0, tolerance=1e-2), "strict": RobustOptions(method="cauchy", max_iterations=3)}
    want = {(r.variant, r.cbsa_id): r for r in robust.fit_variants(pairs_table(rows), AREA, variants).collect()}
    monkeypatch.setattr(robust, "IN_TASK", 100)  # A in a task, B in rounds
    got = {(r.variant, r.cbsa_id): r for r in robust.fit_variants(pairs_table(rows), AREA, variants).collect()}
    assert got.keys() == want.keys() and len(got) == 4
    for name, fit in want.items():
        assert np.allclose(got[name].log_returns, fit.log_returns, atol=1e-9) and got[name].iterations == fit.iterations
        assert np.allclose(np.array(got[name].standard_errors, float), np.array(fit.standard_errors, float), equal_nan=True)
        assert got[name].r_squared == pytest.approx(fit.r_squared) and got[name].weight_scale == pytest.approx(fit.weight_scale)
    assert want["strict", "A"].iterations <= 3
    with pytest.raises(ValueError):
        robust.fit_variants(pairs_table(rows), AREA, {})


@pytest.mark.parametrize("case", ["normal", "ties", "tiny", "constant", "wide"])
def test_bands_hold_both_medians(case):
    rng = np.random.default_rng(5)
    for trial in range(40):
        size = int(rng.integers(1, 400))
        values = {
            "normal": rng.normal(0, 1, size), "ties": rng.integers(0, 4, size) / 2.0, "tiny": rng.normal(5, 1e-9, size),
            "constant": np.full(size, 0.25), "wide": rng.standard_cauchy(size) * 10.0 ** rng.integers(-8, 8),
        }[case]
        middle, scale = rng.normal(0, 1), abs(rng.normal(0, 1)) * (trial % 3)
        edges = robust.bin_edges(middle, scale)
        bins = np.searchsorted(edges, values, "right") - 1
        kinds, counts = np.unique(bins, return_counts=True)
        found = robust.brackets(kinds, counts, edges)
        inner = (bins >= found["first"]) & (bins <= found["last"])
        got = robust._middle_of(values[inner], np.ones(inner.sum()), found["low"] - found["before"], found["high"] - found["before"])
        assert got == pytest.approx(np.median(values), rel=1e-12, abs=1e-300)
        band = ((bins >= found["left_from"]) & (bins <= found["left_to"])) | ((bins >= found["right_from"]) & (bins <= found["right_to"]))
        away = np.abs(values - got)
        got = robust._middle_of(away[band], np.ones(band.sum()), found["low"] - found["inside"], found["high"] - found["inside"])
        assert got == pytest.approx(np.median(away), rel=1e-12, abs=1e-300)


def test_influence_ranks(pairs_table, random_pairs):
    table = pairs_table(random_pairs())
    rows = robust.influence(robust.weighted_residuals(table, robust.fit_robust(table, AREA), AREA), AREA).toPandas()
    assert rows.weight.between(0, 1).all() and (rows.downweighted == (rows.weight < 0.5)).all()
    assert np.allclose(rows.weight_percentile, rows.groupby("cbsa_id").weight.rank(pct=True))


def test_regression_outliers_equal_row_by_row_diagnostics(pairs_table, random_pairs):
    rows = random_pairs(300, months=8, groups=("A",))
    table = pairs_table(rows)
    fits = regression.fit_repeat_sales(table, AREA)
    got = outliers.flag_with_regression(table, fits, AREA).toPandas().sort_values(["first_sale_date", "property_id"])
    ordered = sorted(rows, key=lambda r: (r[3], r[0]))
    x, y = design(ordered)
    n, k = x.shape
    inverse = np.linalg.inv(x.T @ x)
    error = y - x @ (inverse @ x.T @ y)
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    mse = error @ error / (n - k)
    inner = error / (np.sqrt(mse * (1 - h)) + 1e-8)
    distance = inner**2 * h / (k * (1 - h + 1e-8))
    cut = np.maximum(4 / n, 4 * np.cumsum(distance) / np.arange(1, n + 1))
    assert np.allclose(got.leverage, h) and np.allclose(got.cooks_distance, distance)
    assert (got.is_cooks.to_numpy() == (distance > cut)).all()
    assert (got.is_leverage.to_numpy() == (h > 3 * k / n)).all()
    assert (got.is_residual.to_numpy() == (np.abs(error / (np.sqrt(mse) + 1e-8)) > 3)).all()


def test_growth_and_gap_outliers(pairs_table):
    rows = [
        ("P1", "T", "C", date(2010, 1, 1), 100.0, date(2011, 1, 1), 200.0),
        ("P2", "T", "C", date(1980, 1, 1), 100.0, date(2015, 1, 1), 300.0),
        ("P3", "T", "C", date(2010, 1, 1), 100.0, date(2011, 1, 1), 20.0),
        ("P4", "T", "C", date(2010, 1, 1), 100.0, date(2015, 1, 1), 120.0),
    ]
    flagged = outliers.flag_outliers(pairs_table(rows))
    got = {r.property_id: (r.is_outlier, r.outlier_score, r.outlier_reasons) for r in flagged.collect()}
    assert got["P1"] == (True, 1.0, "Extreme CAGR") and got["P2"] == (True, 1.0, "Excessive time gap")
    assert got["P3"][0] and got["P4"] == (False, 0.0, "")
    assert [r.property_id for r in outliers.remove_outliers(pairs_table(rows)).collect()] == ["P4"]
    summary = {r.metric: r.value for r in outliers.outlier_summary(flagged, OutlierRules()).collect()}
    assert summary["Total Outliers"] == 3 and summary["Extreme CAGR"] == 2
