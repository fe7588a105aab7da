import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthline.functions.ordered import _placed, exact_quantiles, percentile_rank, running_mean

SHARES = {"low": 0.05, "mid": 0.5, "high": 0.95}


def series():
    rng = np.random.default_rng(5)
    return {
        "normal": rng.normal(size=999),
        "tailed": np.exp(rng.normal(size=1000) * 6) * np.where(rng.random(1000) < 0.5, -1, 1),
        "tied": np.repeat([1.0, 2.0, 2.5], [500, 1, 3]),
        "constant": np.full(7, -3.25),
        "one": np.array([4.0]),
    }


def test_quantiles_equal_the_sorted_ones_in_every_group(spark):
    data = series()
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("normal", None), ("normal", float("nan"))]
    table = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(table, ["k"], "v", SHARES).collect()}
    for name, values in data.items():
        for label, share in SHARES.items():
            assert got[name][label] == pytest.approx(np.quantile(values, share), rel=1e-12, abs=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=60))
def test_pooled_median(spark, values):
    table = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(table, [], "v", {"m": 0.5}).first().m
    assert got == pytest.approx(float(np.median(values)), rel=1e-9, abs=1e-9)


def test_percentile_rank_averages_ties(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"k": np.where(np.arange(500) % 3, "a", "b"), "v": np.round(np.minimum(rng.random(500) * 2, 1), 2)})
    got = percentile_rank(spark.createDataFrame(frame), ["k"], "v", "r").toPandas().drop_duplicates()
    want = frame.assign(r=frame.groupby("k")["v"].rank(pct=True)).drop_duplicates()
    merged = got.merge(want, on=["k", "v"])
    assert len(merged) == len(want)
    assert np.allclose(merged.r_x, merged.r_y)


def test_running_mean_follows_the_order(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"k": "a", "day": rng.integers(0, 20, 300), "i": np.arange(300), "v": rng.random(300)})
    got = running_mean(spark.createDataFrame(frame), ["k"], "day", ["i"], "v", "m").toPandas().sort_values(["day", "i"])
    want = frame.sort_values(["day", "i"])["v"].expanding().mean()
    assert np.allclose(got.m.to_numpy(), want.to_numpy())


@pytest.fixture
def uncoalesced(spark):
    """As many parts as a large table would have."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_ranks_over_parts_that_share_a_value(spark, uncoalesced):
    rng = np.random.default_rng(3)
    value = np.where(rng.random(4000) < 0.9, 1.0, np.round(rng.random(4000), 2))
    frame = pd.DataFrame({"k": np.where(rng.random(4000) < 0.8, "a", "b"), "i": np.arange(4000), "v": value})
    table = spark.createDataFrame(frame)
    sizes = [r["count"] for r in _placed(table, ["k"], ["v"]).groupBy("_part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * 4000 / len(sizes)
    got = percentile_rank(table, ["k"], "v", "r").toPandas().sort_values("i")
    assert np.allclose(got.r.to_numpy(), frame.groupby("k")["v"].rank(pct=True).to_numpy())


def test_missing_values_have_no_rank(spark):
    table = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None), ("a", 2.0)], "k string, v double")
    got = [(r.k, r.v, r.r) for r in percentile_rank(table, ["k"], "v", "r").collect()]
    assert sorted(r for _, _, r in got if r is not None) == [0.5, 1.0] and len(got) == 5


def test_one_day_of_one_group_is_many_parts(spark, uncoalesced):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"k": np.where(np.arange(3000) % 10, "a", "b"), "day": 1, "i": np.arange(3000) // 7, "v": rng.random(3000)})
    frame.loc[::50, "v"] = np.nan
    table = spark.createDataFrame(frame).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    sizes = [r["count"] for r in _placed(table, ["k"], ["day", "i"]).groupBy("_part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * 3000 / len(sizes)
    got = running_mean(table, ["k"], "day", ["i", "v"], "v", "m").toPandas()
    for name, part in frame.groupby("k"):
        own = got[got.k == name].sort_values(["i", "v"], na_position="first")
        want = part.sort_values(["i", "v"], na_position="first")["v"].expanding().mean()
        assert np.allclose(own.m.to_numpy(float), want.to_numpy(), equal_nan=True)
