import pytest
from pyspark.sql import functions as F

from hearthline.plans.steps import Step, in_order, run_steps


def broken(df):
    return df.select(F.raise_error(F.lit("no luck")).alias("x"))


def plan(calls=None):
    def total(doubled, kept):
        return doubled.join(kept, "id").agg(F.sum("twice").alias("total"))

    def kept(df):
        (calls if calls is not None else []).append("kept")
        return df.where("id > 2")

    return [
        Step("total", total, ("doubled", "kept")),
        Step("doubled", lambda df: df.withColumn("twice", 2 * F.col("id")), ("rows",)),
        Step("kept", kept, ("rows",)),
    ]


def test_steps_run_after_what_they_need(spark):
    done = run_steps(plan(), {"rows": spark.range(6)})
    assert done.tables["total"].first().total == 2 * (3 + 4 + 5) and done.left_out == {}
    assert [s.name for s in in_order(plan(), ["rows"])][-1] == "total"


def test_only_what_is_wanted_runs(spark):
    calls = []
    done = run_steps(plan(calls), {"rows": spark.range(6)}, wanted=["doubled"])
    assert set(done.tables) == {"rows", "doubled"} and calls == []
    with pytest.raises(ValueError, match="no step gives other"):
        run_steps(plan(), {"rows": spark.range(2)}, wanted=["other"])


def test_optional_steps_that_fail_while_running_are_left_out(spark):
    extra = [Step("odd", broken, ("rows",), optional=True), Step("after", lambda df: df, ("odd",), optional=True)]
    done = run_steps([*extra, *plan()], {"rows": spark.range(6)})
    assert done.tables["total"].count() == 1 and "no luck" in done.left_out["odd"] and done.left_out["after"] == "needs odd"
    with pytest.raises(RuntimeError, match="step needy needs odd"):
        run_steps([*extra, Step("needy", lambda df: df, ("odd",))], {"rows": spark.range(6)})
    with pytest.raises(RuntimeError, match="step odd failed"):
        run_steps([Step("odd", broken, ("rows",))], {"rows": spark.range(6)})


def test_plans_that_cannot_run(spark):
    with pytest.raises(ValueError, match="need each other"):
        in_order([Step("a", broken, ("b",)), Step("b", broken, ("a",))])
    with pytest.raises(ValueError, match="nothing gives"):
        in_order([Step("a", broken, ("b",))])
    with pytest.raises(ValueError, match="names must differ"):
        in_order([Step("a", broken), Step("a", broken)])
