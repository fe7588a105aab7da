"""Command line: calculate an index, report on quality, generate test data."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthline.config import WeightType
from hearthline.operators import quality, validate
from hearthline.operators.geography import nearest_tracts
from hearthline.operators.pairs import pair_sales
from hearthline.plans.estimator import LEVELS, estimate_indices, require_demographics
from hearthline.session import build_session, drop_staged, staged
from hearthline.sources import files, generate, sinks


def _calculate(spark, args) -> None:
    pairs = staged(validate.valid_pairs(pair_sales(files.read_transactions(spark, args.input))), "pairs")
    tracts = spark.read.parquet(args.tracts) if args.tracts else None
    if tracts is None:
        tracts = pairs.select("tract_id", "cbsa_id").distinct().selectExpr("*", "substring(tract_id, 1, 2) AS state")
    edges = files.read_adjacency(spark, args.adjacency) if args.adjacency else None
    if edges is None and "geometry" not in tracts.columns:
        print("neither adjacency nor outlines given: thin tracts are not merged", file=sys.stderr)
        edges = spark.createDataFrame([], "tract_id string, neighbor_id string")
    people = files.read_demographics(spark, args.demographics) if args.demographics else None
    require_demographics(args.weighting, args.geography, people)
    estimate = estimate_indices(
        pairs, tracts, edges, people, args.weighting, args.geography, args.start_date, args.end_date
    )
    values = staged(estimate.index_values, "values")
    sinks.write_table(values, args.output, args.format)
    order = Window.partitionBy("geography_id").orderBy("date")
    step = values.select((F.try_divide(F.col("index_value"), F.lag("index_value").over(order)) - 1).alias("change"))
    change = step.agg(F.avg("change")).first()[0]
    print(f"average change from one date to the next: {'n/a' if change is None else format(change, '.4%')}")
    print(f"{args.geography} index, {args.weighting} weights, {args.start_date} to {args.end_date}: {values.count()} rows")


def _quality(spark, args) -> None:
    pairs = staged(files.read_pairs(spark, args.input), "pairs")
    report = quality.analyze_quality(pairs)
    if args.format == "json":
        content = report.summary.first().asDict() | report.scores.first().asDict()
        text = json.dumps(content, default=str, indent=2)
    else:
        text = quality.report_text(report)
        if args.format == "html":
            body = text.replace("&", "&amp;").replace("<", "&lt;")
            text = f"<!DOCTYPE html><html><head><title>Data quality report</title></head><body><pre>{body}</pre></body></html>"
    if args.output:
        with open(args.output, "w", encoding="utf-8") as target:
            target.write(text)
    else:
        print(text)


def _generate(spark, args) -> None:
    data = generate.complete_dataset(
        spark, args.start_year, args.end_year, args.num_cbsas, args.num_cbsas * args.tracts_per_cbsa,
        args.num_cbsas * args.tracts_per_cbsa * args.properties_per_tract,
    )
    sinks.save_results(data, args.output, "csv")
    tracts = generate.tract_geometries(spark, args.num_cbsas * args.tracts_per_cbsa, args.num_cbsas)
    sinks.export_geography(
        {"tracts": tracts, "cbsas": generate.area_table(tracts), "adjacency": nearest_tracts(tracts)}, args.output
    )


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="hearthline")
    commands = parser.add_subparsers(dest="command", required=True)
    calculate = commands.add_parser("calculate")
    calculate.add_argument("--input", required=True)
    calculate.add_argument("--output", required=True)
    calculate.add_argument("--start-date", type=date.fromisoformat, required=True)
    calculate.add_argument("--end-date", type=date.fromisoformat, required=True)
    calculate.add_argument("--geography", choices=LEVELS, default="cbsa")
    calculate.add_argument("--weighting", choices=[w.value for w in WeightType], default="sample")
    calculate.add_argument("--format", choices=("csv", "json", "parquet"), default="csv")
    calculate.add_argument("--tracts")
    calculate.add_argument("--adjacency")
    calculate.add_argument("--demographics")
    calculate.set_defaults(run=_calculate)
    report = commands.add_parser("quality")
    report.add_argument("--input", required=True)
    report.add_argument("--output")
    report.add_argument("--format", choices=("text", "json", "html"), default="text")
    report.set_defaults(run=_quality)
    make = commands.add_parser("generate")
    make.add_argument("--output", required=True)
    for name, default in (
        ("num-cbsas", 5), ("tracts-per-cbsa", 10), ("properties-per-tract", 100), ("start-year", 2010), ("end-year", 2023),
    ):
        make.add_argument(f"--{name}", type=int, default=default)
    make.set_defaults(run=_generate)
    args = parser.parse_args(argv)
    spark = build_session()
    args.run(spark, args)
    drop_staged(spark)


if __name__ == "__main__":
    main()
