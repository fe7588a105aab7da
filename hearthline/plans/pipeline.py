"""The full build from stored pairs to index tables and reports.

Each step writes its table below the output folder, so a later step reads a finished
table and a failed run can be looked into. Lost tasks are retried by Spark; a step as a
whole is tried again a few times, and optional steps may fail.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from hearthline.config import FitOptions, OutlierRules, RobustOptions, SupertractOptions
from hearthline.operators import outliers, quality, validate
from hearthline.plans.estimator import estimate_indices, require_demographics
from hearthline.session import ship_package
from hearthline.sources import files, sinks


@dataclass
class StepOutcome:
    status: str
    seconds: float
    attempts: int
    error: str | None = None


@dataclass
class BuildOutcome:
    status: str
    steps: dict[str, StepOutcome] = field(default_factory=dict)

    @property
    def errors(self) -> list[str]:
        return [f"{name}: {step.error}" for name, step in self.steps.items() if step.error]


def attempt(run: Callable[[], None], retries: int = 3) -> StepOutcome:
    """Run until it succeeds, at most 1 + retries times."""
    began = time.perf_counter()
    for tried in range(1, retries + 2):
        try:
            run()
            return StepOutcome("completed", time.perf_counter() - began, tried)
        except Exception as error:  # noqa: BLE001 - reported in the outcome
            last = str(error)
    return StepOutcome("failed", time.perf_counter() - began, tried, last)


def build_index(
    spark: SparkSession,
    folder: str,
    output: str,
    start: date | None = None,
    end: date | None = None,
    level: str = "cbsa",
    weight_type: str = "sample",
    demographics: DataFrame | None = None,
    robust: bool = False,
    reports: bool = True,
    retries: int = 3,
    supertract_options: SupertractOptions = SupertractOptions(),
) -> BuildOutcome:
    """Validate, clean, estimate and report; stops at the first required step that fails."""
    ship_package(spark)
    read = spark.read.parquet

    def validated():
        pairs = files.load_pairs_between(spark, folder, start, end)
        sinks.write_table(validate.validate_pairs(pairs), f"{output}/validated")

    def assessed():
        report = quality.analyze_quality(
            read(f"{output}/validated").where("is_valid"), files.load_stored_tracts(spark, folder)
        )
        sinks.write_table(report.scores, f"{output}/quality_scores", single_file=True)
        scores = report.scores.first().asDict()
        summary = report.summary.first().asDict()
        content = {
            "overall_score": scores["overall"], "scores": scores, "metrics": summary,
            "recommendations": quality.recommendations(report),
        }
        sinks.write_json(spark, content, f"{output}/quality_report.json")

    def cleaned():
        flagged = outliers.flag_outliers(read(f"{output}/validated").where("is_valid"))
        sinks.write_table(flagged, f"{output}/flagged")

    def estimated():
        people = demographics if demographics is not None else files.load_stored_demographics(spark, folder)
        require_demographics(weight_type, level, people)
        pairs = read(f"{output}/flagged").where("not is_outlier")
        estimate = estimate_indices(
            pairs, files.load_stored_tracts(spark, folder), files.load_stored_adjacency(spark, folder), people,
            weight_type, level, start, end, supertract_options=supertract_options,
            fit_options=FitOptions(min_pairs=10), robust=RobustOptions() if robust else None,
        )
        sinks.write_table(estimate.fits, f"{output}/fits")
        sinks.write_table(estimate.supertracts, f"{output}/supertracts")
        sinks.write_table(estimate.coverage, f"{output}/coverage", single_file=True)
        sinks.write_table(estimate.index_values, f"{output}/index_values")

    def reported():
        sinks.write_table(read(f"{output}/index_values"), f"{output}/index_values_csv", "csv", single_file=True)
        rules = OutlierRules()
        found = outliers.outlier_statistics(read(f"{output}/flagged")).first().asDict()
        sinks.write_json(spark, {"statistics": found, "thresholds": vars(rules)}, f"{output}/outlier_report.json")

    steps = [("validate", validated, True), ("outliers", cleaned, True), ("indices", estimated, True)]
    if reports:
        steps.insert(1, ("quality", assessed, False))
        steps.append(("reports", reported, False))
    outcome = BuildOutcome("success")
    for name, run, required in steps:
        step = outcome.steps[name] = attempt(run, retries)
        if step.status == "failed":
            outcome.status = "failed" if required else "partial_success"
            if required:
                break
    return outcome
