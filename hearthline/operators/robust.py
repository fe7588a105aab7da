"""Repeat-sales estimates that weigh down outlying pairs (M-estimation).

Each round scales the residuals by their median absolute deviation, weighs the pairs and
solves again. Any number of variants (method, tuning, tolerance) goes through the rounds together,
as one more key of the groups.

What a round needs to know of a group are sums over all its pairs. A group of at most
``IN_TASK`` pairs lies in one task, which so has its sums and goes through all its rounds by itself.
Pairs of a larger group stay spread, and every round merges their sums over the cluster; no
group is gathered, and both ways do the same sums. There a round is three jobs over
the groups still moving:

1. A histogram of the residuals, finest around the last round's median and in units of its scale,
   tells which bins hold the median, and which the median of the distances from it can lie in.
2. Rows of those bins alone, as counts per distinct value, give both medians exactly. Their share of
   a group is small (about 0.3 %) however large the group is.
3. Weighted sums per period combination are solved, and where a group has settled its summary
   is made from the same sums.

Every job combines on the map side, and groups of any size take the same way.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from datetime import date
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.config import FitOptions, OutlierRules, RobustOptions
from hearthline.functions.columns import robust_weight
from hearthline.functions.least_squares import PeriodSystem
from hearthline.functions.ordered import percentile_rank
from hearthline.operators.outliers import remove_outliers
from hearthline.operators.regression import (
    FIT_FIELDS,
    _optional,
    fit_repeat_sales,
    in_range,
    index_series,
    key_fields,
    predicted,
    with_periods,
    within_dates,
)
from hearthline.session import spread, staged

ROBUST_FIELDS = (
    f"{FIT_FIELDS}, iterations int, converged boolean, final_change double, "
    "weight_returns array<double>, weight_scale double"
)
STATE_FIELDS = (
    "_origin int, _all bigint, start array<double>, middle double, scale double, iterations int, settled boolean, "
    "summary struct<" + ROBUST_FIELDS.replace(" ", ":").replace(",:", ", ") + ">"
)
_NAMES = [f.split()[0] for f in ROBUST_FIELDS.split(", ")]
_STATE_NAMES = ["_origin", "_all", "start", "middle", "scale", "iterations", "settled", "summary"]

# Pairs of a group that one task works on: about 20 bytes each in memory.
IN_TASK = 1_000_000

# Bins of a round's histogram; near the middle a bin is 1 / (LEVELS / 2 * FINE / REACH) of the scale wide.
LEVELS = 1 << 14
FINE = 100.0
REACH = float(np.log1p(FINE * 1e6))


def _bin(residual: Column) -> Column:
    """Bin of a residual, non-decreasing in it; the outer bins are open."""
    z = (residual - F.col("middle")) / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    share = F.signum(z) * F.log1p(FINE * F.abs(z)) / REACH
    return F.least(F.greatest(F.floor((share + 1) / 2 * LEVELS), F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def bin_edges(middle: float, scale: float) -> np.ndarray:
    """Lower edges of all bins, and the end of the last one."""
    share = np.linspace(-1.0, 1.0, LEVELS + 1) * REACH
    edges = middle + (scale if scale > 0 else 1.0) * np.sign(share) * np.expm1(np.abs(share)) / FINE
    edges[0], edges[-1] = -np.inf, np.inf
    return edges


def brackets(bins: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> dict[str, int]:
    """Bins that hold the median, and two bands of bins that hold all candidates for the median distance.

    ``inside`` rows lie between the bands and are nearer to the median than any candidate.
    One bin is added on every side, as edges here and bins in the table are rounded apart.
    """
    below = np.zeros(len(edges), np.int64)
    np.add.at(below, bins + 1, counts)
    below = np.cumsum(below)
    low, high = (int(below[-1]) - 1) // 2, int(below[-1]) // 2
    first, last = (int(np.searchsorted(below, rank, "right")) - 1 for rank in (low, high))
    a, b = edges[first], edges[last + 1]
    top = len(edges) - 2

    def holding(value):
        return np.searchsorted(edges, value, "right") - 1

    with np.errstate(invalid="ignore"):
        radii = np.unique(np.abs(np.concatenate([edges[bins], edges[bins + 1]]) - (a + b) / 2))
        radii = radii[np.isfinite(radii)]
        at_most = below[np.minimum(holding(b + radii) + 2, top + 1)] - below[np.maximum(holding(a - radii) - 1, 0)]
        at_least = below[np.clip(holding(a + radii) - 1, 0, top + 1)] - below[np.clip(holding(b - radii) + 2, 0, top + 1)]
    near, far = radii[at_most <= low], radii[at_least > high]
    near, far = near.max() if len(near) else 0.0, far.min() if len(far) else np.inf

    def clipped(value, margin):
        return int(np.clip(holding(value) + margin, 0, top))

    found = {
        "first": first, "last": last, "before": int(below[first]), "low": low, "high": high,
        "left_from": clipped(a - far, -1), "left_to": clipped(b - near, 1),
        "right_from": clipped(a + near, -1), "right_to": clipped(b + far, 1),
    }
    apart = found["right_from"] > found["left_to"]
    return found | {"inside": int(below[found["right_from"]] - below[found["left_to"] + 1]) if apart else 0}


_BRACKET_NAMES = ["first", "last", "before", "low", "high", "left_from", "left_to", "right_from", "right_to", "inside"]


def _middle_of(values: np.ndarray, counts: np.ndarray, low: int, high: int) -> float:
    """Mean of the values at two ranks."""
    order = np.argsort(values)
    ends = np.cumsum(counts[order])
    pair = values[order][np.searchsorted(ends, [low, high], "right")]
    return float(pair[0] + (pair[1] - pair[0]) / 2)


def _residuals(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their residual at the start of the round; the state is small and stored."""
    return rows.where("kept").join(state, keys).withColumn("_r", F.col("log_change") - predicted("start"))


def _bracketed(rows: DataFrame, state: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    left = _residuals(rows, state.select(*names, "_origin", "start", "middle", "scale"), keys)
    bins = left.groupBy(*names, _bin(F.col("_r")).alias("_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("middle").alias("middle"), F.first("scale").alias("scale")
    )

    def narrow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        edges = bin_edges(frame["middle"].iloc[0], frame["scale"].iloc[0])
        found = brackets(frame["_bin"].to_numpy(), frame["n"].to_numpy(), edges)
        return pd.DataFrame([[*key, *(found[n] for n in _BRACKET_NAMES)]], columns=[*names, *_BRACKET_NAMES])

    fields = ", ".join(f"{n} bigint" for n in _BRACKET_NAMES)
    return spread(bins, names).groupBy(*names).applyInPandas(narrow, f"{key_fields(bins, names)}, {fields}")


def _medians(rows: DataFrame, state: DataFrame, found: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Exact median and median absolute deviation of each group."""
    left = _residuals(rows, state.select(*names, "_origin", "start", "middle", "scale"), keys).join(found, names)
    bin_of = _bin(F.col("_r"))
    inner = bin_of.between(F.col("first"), F.col("last"))
    band = bin_of.between(F.col("left_from"), F.col("left_to")) | bin_of.between(F.col("right_from"), F.col("right_to"))
    carried = ["before", "inside", "low", "high"]
    near = left.select(*names, "_r", inner.alias("_inner"), band.alias("_band"), *carried).where("_inner or _band")
    counts = near.groupBy(*names, "_r", "_inner", "_band", *carried).agg(F.count(F.lit(1)).alias("n"))

    def medians(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0]
        values, n = frame["_r"].to_numpy(), frame["n"].to_numpy()
        inner, band = frame["_inner"].to_numpy(), frame["_band"].to_numpy()
        middle = _middle_of(values[inner], n[inner], head["low"] - head["before"], head["high"] - head["before"])
        away = np.abs(values[band] - middle)
        spread_of = _middle_of(away, n[band], head["low"] - head["inside"], head["high"] - head["inside"])
        return pd.DataFrame([[*key, middle, spread_of]], columns=[*names, "_middle", "_mad"])

    return spread(counts, names).groupBy(*names).applyInPandas(
        medians, f"{key_fields(counts, names)}, _middle double, _mad double"
    )


def _cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """Weighted sums of the residuals per period combination; sums of small numbers, so nothing cancels."""
    return rows.groupBy(*names, "first_period", "second_period").agg(
        F.count("_r").alias("n"),
        F.count(F.lit(1)).alias("all_pairs"),
        F.sum("_w").alias("w"),
        F.sum(F.col("_w") * F.col("_r")).alias("wr"),
        F.sum(F.col("_w") * F.col("_r") * F.col("_r")).alias("wrr"),
    )


class _Sums:
    """The cells of a group around the coefficients their residuals were taken at."""

    def __init__(self, frame: pd.DataFrame | Mapping[str, np.ndarray], start: np.ndarray | None) -> None:
        first, second = np.asarray(frame["first_period"]), np.asarray(frame["second_period"])
        self.origin = int(min(first.min(), second.min()))
        self.size = int(max(first.max(), second.max()) - self.origin) + 1
        self.start = np.zeros(self.size) if start is None else start
        self.first, self.second = first - self.origin, second - self.origin
        self.n, self.w, self.wr, self.wrr = (np.asarray(frame[c], float) for c in ("n", "w", "wr", "wrr"))
        self.base = self.start[self.second] - self.start[self.first]
        mean = np.divide(self.wr, self.w, out=np.zeros_like(self.wr), where=self.w > 0)
        self.system = PeriodSystem(self.size, self.first, self.second, self.w, self.base + mean)

    def residual_sum(self, beta: np.ndarray) -> float:
        step = beta[self.second] - beta[self.first] - self.base
        return max(float((self.wrr - 2 * step * self.wr + step**2 * self.w).sum()), 0.0)

    def total_sum(self) -> float:
        weight = self.w.sum()
        if weight <= 0:
            return 0.0
        away = self.base - (self.wr + self.base * self.w).sum() / weight
        return float((self.wrr + 2 * away * self.wr + away**2 * self.w).sum())

    def deviations(self, residual_sum: float) -> np.ndarray:
        freedom = self.n.sum() - (self.size - 1)
        deviation = np.full(self.size, np.nan)
        if freedom > 0:
            variance = residual_sum / freedom
            if self.system.rank == self.size - 1:
                deviation = np.sqrt(np.maximum(self.system.inverse_diagonal(None) * variance, 0))
            else:
                degree = np.diag(self.system.matrix)
                deviation = np.divide(variance, np.sqrt(degree), out=deviation, where=degree > 0)
        deviation[0] = 0.0
        return deviation

    def summary(self, beta: np.ndarray, all_pairs: int, iterations: int, change: float, converged: bool, scale: float) -> dict:
        residual_sum, total = self.residual_sum(beta), self.total_sum()
        values = [
            self.origin, self.size, _optional(beta), _optional(self.deviations(residual_sum)),
            [bool(v) for v in self.system.labels == 0], int(self.n.sum()), all_pairs, int(self.system.rank),
            residual_sum, 1 - residual_sum / total if total else 0.0,
            iterations, converged, change, _optional(self.start), scale,
        ]
        return dict(zip(_NAMES, values))


def _first_state(rows: DataFrame, keys: list[str], min_pairs: int) -> DataFrame:
    """Least-squares coefficients of every group with enough pairs, and its residual deviation."""
    plain = rows.select(
        *keys, "first_period", "second_period", F.when(F.col("kept"), F.col("log_change")).alias("_r"),
        F.when(F.col("kept"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("_w"),
    )
    cells = _cells(plain, keys)

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        names, all_pairs = [*keys, *_STATE_NAMES], int(frame["all_pairs"].sum())
        frame = frame[frame["n"] > 0]
        if all_pairs < min_pairs or frame.empty:
            return pd.DataFrame(columns=names)
        sums = _Sums(frame, None)
        beta = sums.system.solve()
        scale = float(np.sqrt(sums.residual_sum(beta) / sums.n.sum()))
        return pd.DataFrame([[*key, sums.origin, all_pairs, beta.tolist(), 0.0, scale, 0, False, None]], columns=names)

    return spread(cells, keys).groupBy(*keys).applyInPandas(solve, f"{key_fields(cells, keys)}, {STATE_FIELDS}")


def _next_state(
    rows: DataFrame, state: DataFrame, scales: DataFrame, keys: list[str], names: list[str],
    variants: Mapping[str, RobustOptions],
) -> DataFrame:
    """Weigh, solve, and settle the groups that moved little or have had all their rounds."""
    known = staged(state.drop("middle", "scale", "summary", "settled").join(scales, names), "known")
    factor = reduce(lambda rest, v: F.when(F.col("variant") == v[0], v[1]).otherwise(rest), [(n, o.mad_factor) for n, o in variants.items()], F.lit(None))
    left = _residuals(rows, known.select(*names, "_origin", "start", (F.col("_mad") * factor).alias("scale")), keys)
    scaled = F.col("_r") / F.col("scale")
    weight = F.lit(None).cast("double")
    for name, options in variants.items():
        own = F.when(F.col("scale") > options.scale_floor, robust_weight(options.method, scaled, options.constant))
        weight = F.when(F.col("variant") == name, own.otherwise(F.lit(1.0))).otherwise(weight)
    cells = _cells(left.withColumn("_w", weight), names)

    def solve(key: tuple, frame: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        columns = [*names, *_STATE_NAMES]
        if frame.empty or head.empty:
            return pd.DataFrame(columns=columns)
        head = head.iloc[0]
        options = variants[key[0]]
        sums = _Sums(frame, np.asarray(head["start"], float))
        beta = sums.system.solve()
        change = float(np.abs(beta - sums.start).max())
        done = int(head["iterations"]) + 1
        converged = change < options.tolerance
        scale = float(head["_mad"]) * options.mad_factor
        settled = converged or done >= options.max_iterations
        summary = sums.summary(beta, int(head["_all"]), done, change, converged, scale) if settled else None
        row = [*key, sums.origin, int(head["_all"]), beta.tolist(), float(head["_middle"]), scale, done, settled, summary]
        return pd.DataFrame([row], columns=columns)

    # New names for the table's columns, as the cells descend from it too.
    again = known.toDF(*known.columns)
    grouped = spread(cells, names).groupBy(*names).cogroup(spread(again, names).groupBy(*names))
    return grouped.applyInPandas(solve, f"{key_fields(cells, names)}, {STATE_FIELDS}")


class _Pairs:
    """All pairs of a group, and their sums per period combination."""

    def __init__(self, frame: pd.DataFrame) -> None:
        self.change = frame["log_change"].to_numpy()
        codes = frame["first_period"].to_numpy(np.int64) << 32 | frame["second_period"].to_numpy(np.int64)
        cells, self.cell = np.unique(codes, return_inverse=True)
        self.periods = {"first_period": cells >> 32, "second_period": cells & 0xFFFFFFFF}
        self.n = np.bincount(self.cell)

    def sums(self, start: np.ndarray | None, residual: np.ndarray, weight: np.ndarray) -> _Sums:
        pulls = {"w": weight, "wr": weight * residual, "wrr": weight * residual * residual}
        cells = {name: np.bincount(self.cell, pull) for name, pull in pulls.items()}
        return _Sums({**self.periods, "n": self.n, **cells}, start)

    def settle(self, options: RobustOptions, all_pairs: int) -> dict:
        """All rounds of one variant."""
        sums = self.sums(None, self.change, np.ones(len(self.change)))
        beta = sums.system.solve()
        for done in range(1, options.max_iterations + 1):
            start = beta
            residual = self.change - (start[sums.second] - start[sums.first])[self.cell]
            scale = float(np.median(np.abs(residual - np.median(residual)))) * options.mad_factor
            ones = np.ones(len(residual))
            weight = weight_of(options, residual / scale) if scale > options.scale_floor else ones
            sums = self.sums(start, residual, weight)
            beta = sums.system.solve()
            change = float(np.abs(beta - start).max())
            converged = change < options.tolerance
            if converged or done == options.max_iterations:
                break
        return sums.summary(beta, all_pairs, done, change, converged, scale)


def weight_of(options: RobustOptions, scaled: np.ndarray) -> np.ndarray:
    """robust_weight over an array."""
    c, size = options.constant, np.abs(scaled)
    if options.method == "huber":
        return np.where(size <= c, 1.0, c / np.maximum(size, c))
    if options.method == "bisquare":
        return np.where(size <= c, (1 - (scaled / c) ** 2) ** 2, 0.0)
    if options.method == "cauchy":
        return 1 / (1 + (scaled / c) ** 2)
    if options.method == "welsch":
        return np.exp(-((scaled / c) ** 2))
    return np.ones(len(scaled))


def _settled_in_task(rows: DataFrame, keys: list[str], variants: Mapping[str, RobustOptions], min_pairs: int) -> DataFrame:
    fields = ROBUST_FIELDS.split(", ")

    def settle(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        columns, all_pairs = ["variant", *keys, *_NAMES], len(frame)
        frame = frame[frame["kept"]]
        if all_pairs < min_pairs or frame.empty:
            return pd.DataFrame(columns=columns)
        pairs = _Pairs(frame)
        found = [(name, pairs.settle(options, all_pairs)) for name, options in variants.items()]
        return pd.DataFrame([[name, *key, *summary.values()] for name, summary in found], columns=columns)

    schema = f"variant string, {key_fields(rows, keys)}, {', '.join(fields)}"
    return spread(rows, keys).groupBy(*keys).applyInPandas(settle, schema)


def _fit(rows: DataFrame, keys: list[str], variants: Mapping[str, RobustOptions], min_pairs: int) -> DataFrame:
    """Fits of all groups: those within a task in one job, the larger ones in rounds."""
    rows = staged(rows, "rows")
    sizes = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pairs")), "sizes")
    large = sizes.where(F.col("_pairs") > IN_TASK).select(*keys)
    if large.isEmpty():
        return _settled_in_task(rows, keys, variants, min_pairs)
    small = _settled_in_task(rows.join(large, keys, "left_anti"), keys, variants, min_pairs)
    return small.unionByName(_settled_in_rounds(rows.join(large, keys, "left_semi"), keys, variants, min_pairs))


def _settled_in_rounds(rows: DataFrame, keys: list[str], variants: Mapping[str, RobustOptions], min_pairs: int) -> DataFrame:
    """Rounds over all groups and variants at once; what a round knows of a group is one row of a stored table.

    The planner broadcasts that table where its measured size allows, so that rows of a
    large group stay where they are; what is shuffled are sums per bin or period combination.
    """
    rows, names = staged(rows, "rows"), ["variant", *keys]
    each = F.explode(F.array(*[F.lit(name) for name in variants])).alias("variant")
    moving = staged(_first_state(rows, keys, min_pairs).select(each, "*"), "state")
    settled = []
    for _ in range(max(options.max_iterations for options in variants.values())):
        found = staged(_bracketed(rows, moving, keys, names), "brackets")
        scales = staged(_medians(rows, moving, found, keys, names), "scales")
        state = staged(_next_state(rows, moving, scales, keys, names, variants), "state")
        settled.append(state.where("settled"))
        moving = state.where("not settled")
        if moving.isEmpty():
            break
    return reduce(DataFrame.unionByName, settled).select(*names, "summary.*")


def fit_variants(
    pairs: DataFrame,
    keys: list[str],
    variants: Mapping[str, RobustOptions],
    options: FitOptions = FitOptions(),
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """M-estimates of every group under each of the named options, with their name as ``variant``.

    In the shape of fit_repeat_sales plus rounds. Groups are counted at once; those beyond a task
    run their rounds at once too, three jobs a round for all variants together. Variants
    share their pairs, so all or none of them leave outliers out.
    """
    if not variants:
        raise ValueError("no variant to fit")
    if len({v.remove_outliers for v in variants.values()}) > 1:
        raise ValueError("variants must agree on remove_outliers")
    variants = {n: replace(v, max_iterations=1) if v.method == "ols" else v for n, v in variants.items()}
    if any(v.remove_outliers for v in variants.values()):
        pairs = remove_outliers(within_dates(pairs, start, end), OutlierRules())
    rows = (
        with_periods(pairs, options.period)
        .select(*keys, "first_period", "second_period", "log_change", F.coalesce(in_range(start, end), F.lit(False)).alias("kept"))
        .where(F.col("log_change").isNotNull())
    )
    return _fit(rows, keys, variants, options.min_pairs)


def fit_robust(
    pairs: DataFrame,
    keys: list[str],
    robust: RobustOptions = RobustOptions(),
    options: FitOptions = FitOptions(),
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """M-estimate of every group: fit_variants with a single variant."""
    return fit_variants(pairs, keys, {robust.method: robust}, options, start, end).drop("variant")


def weighted_residuals(
    pairs: DataFrame,
    fits: DataFrame,
    keys: list[str],
    robust: RobustOptions = RobustOptions(),
    options: FitOptions = FitOptions(),
) -> DataFrame:
    """Pairs with their final residual and the weight used in the last solve."""
    fitted = fits.select(
        *keys,
        F.col("first_period").alias("_origin"),
        "log_returns",
        F.col("weight_returns").alias("start"),
        F.col("weight_scale").alias("scale"),
    )
    scaled = (F.col("log_change") - predicted("start")) / F.col("scale")
    weight = F.when(F.col("scale") > robust.scale_floor, robust_weight(robust.method, scaled, robust.constant))
    return (
        with_periods(pairs, options.period)
        .join(fitted, keys)
        .withColumns(
            {
                "residual": F.col("log_change") - predicted(),
                "weight": weight.otherwise(F.lit(1.0)),
            }
        )
        .drop("_origin", "log_returns", "start", "scale")
    )


# Weights that differ by rounding alone are ties, and residuals this small are rounding alone.
WEIGHT_DIGITS = 9
NO_SPREAD = 1e-10


def influence(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """Add standardised residual, a flag below half weight and the weight's percentile rank.

    A group that is fitted exactly has no standardised residuals.
    """
    spread = weighted.groupBy(*keys).agg(F.stddev_pop("residual").alias("_spread"))
    scored = weighted.join(spread, keys).withColumns(
        {
            "weight": F.round("weight", WEIGHT_DIGITS),
            "standardized_residual": F.when(F.col("_spread") > NO_SPREAD, F.col("residual") / F.col("_spread")),
        }
    ).withColumn("downweighted", F.col("weight") < 0.5).drop("_spread")
    return percentile_rank(scored, keys, "weight", "weight_percentile")


def compare_with_ols(
    pairs: DataFrame,
    robust_fits: DataFrame,
    keys: list[str],
    options: FitOptions = FitOptions(),
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Robust and ordinary coefficients, errors and index levels by date."""
    ols = index_series(fit_repeat_sales(pairs, keys, options, start, end), keys, options)
    robust = index_series(robust_fits, keys, options)

    def named(series: DataFrame, prefix: str) -> DataFrame:
        return series.select(
            *keys,
            "date",
            F.col("log_return").alias(f"{prefix}_coefficient"),
            F.col("standard_error").alias(f"{prefix}_se"),
            F.col("index_value").alias(f"{prefix}_index"),
        )

    return (
        named(robust, "robust")
        .join(named(ols, "ols"), [*keys, "date"])
        .withColumns(
            {
                "difference": F.col("robust_coefficient") - F.col("ols_coefficient"),
                "index_difference": F.col("robust_index") - F.col("ols_index"),
            }
        )
    )
