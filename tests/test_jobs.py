import glob
import json
import os
import tempfile
from datetime import date

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthline import cli, schemas
from hearthline.config import SupertractOptions, WeightType
from hearthline.operators.geography import nearest_tracts
from hearthline.plans import pipeline, service, store
from hearthline.plans.catalog import QUERIES
from hearthline.plans.oracle import statements
from hearthline.sources import files, generate, retail, sinks
from hearthline.streaming.uploads import append_valid_pairs, arriving_pairs, rejections

TABLES = "/root/testdata/sf0.001"
CHECKED = [
    "sales_by_property_day", "repeat_sale_pairs_of_lines", "validated_pairs", "validation_report", "half_pair_panel",
    "tracts_with_latest_demographics", "normal_moments", "pair_metrics", "area_index_annual", "area_fit_summary", "area_residuals", "weights_nearest_year", "weights_equal", "index_rebased", "area_fit_optimality", "quality_geographic", "tract_nearest",
    "weights_all_types", "weights_consistency", "laspeyres_area", "area_index_log_chain", "metric_summary",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_plain_sql(spark, name):
    frame = QUERIES[name](spark, TABLES)
    base = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    answer = base.execute(statements()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(frame.columns)
    key = sorted(names)
    want = sorted(repr([r[names.index(c)] for c in key]) for r in answer.fetchall())
    assert sorted(repr([r[c] for c in key]) for r in frame.collect()) == want


@pytest.mark.parametrize("name", ["pair_metrics", "validated_pairs"])
def test_prices_at_a_tie_and_growth_at_a_printed_digit_equal_the_sql(spark, tmp_path, name):
    # In 1994 the price trend is exactly one: products of hundredths often end in half a cent.
    base = duckdb.connect()
    for table in ("nation", "region", "supplier"):
        base.execute(f"COPY (FROM '{TABLES}/{table}.parquet') TO '{tmp_path}/{table}.parquet'")
    base.execute(
        f"""COPY (SELECT i AS p_partkey, 'x' AS p_name, 'Brand#' || (i % 9 + 1) AS p_brand, 'x' AS p_type, 1 AS p_size,
                round(900 + i * 37 % 10000 / 100, 2) AS p_retailprice FROM range(2000) r(i)) TO '{tmp_path}/part.parquet'"""
    )
    base.execute(
        f"""COPY (SELECT i AS l_orderkey, i % 2000 AS l_partkey, 1 AS l_suppkey, 1 AS l_linenumber,
                CAST(1 + i * 7 % 50 AS DOUBLE) AS l_quantity, 1.0::DOUBLE AS l_extendedprice, CAST(i // 50 % 11 AS DOUBLE) / 100 AS l_discount,
                CAST(i // 550 % 9 AS DOUBLE) / 100 AS l_tax, 'R' AS l_returnflag, 'O' AS l_linestatus,
                TIMESTAMP '1994-01-01' + to_days(CAST(i // 2000 AS INT)) AS l_shipdate FROM range(700000) r(i)) TO '{tmp_path}/lineitem.parquet'"""
    )
    frame = QUERIES[name](spark, str(tmp_path))
    names = ", ".join(frame.columns)
    frame.write.parquet(str(tmp_path / "given"))
    for path in glob.glob(f"{tmp_path}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    base.execute(f"CREATE TABLE wanted AS {statements()[name]}")
    missing = base.execute(f"SELECT {names} FROM wanted EXCEPT ALL SELECT {names} FROM '{tmp_path}/given/*.parquet'").fetchall()
    assert base.execute("SELECT count(*) FROM wanted").fetchone() == (frame.count(),) and not missing


def test_every_statement_has_its_query():
    assert set(statements()) <= set(QUERIES)


def test_date_filter_and_columns_reach_the_scan(spark):
    folder = tempfile.mkdtemp(prefix="hearthline-")
    spark.createDataFrame([("P", "T", "C", date(2010, 1, 1), 1.0, date(2012, 1, 1), 2.0)], schemas.PAIRS).write.parquet(f"{folder}/transactions")
    found = files.load_pairs_between(spark, folder, date(2011, 1, 1), None).select("tract_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(second_sale_date" in plan
    assert "ReadSchema: struct<tract_id:string,second_sale_date:date>" in plan


@pytest.fixture(scope="module")
def stored(spark):
    """A store of generated pairs, tracts and adjacency."""
    folder = tempfile.mkdtemp(prefix="hearthline-store-")
    data = generate.complete_dataset(spark, 2005, 2020, areas=2, tracts=8, homes=1500, seed=3)
    data["pairs"].write.parquet(f"{folder}/transactions")
    data["tracts"].coalesce(1).write.parquet(f"{folder}/geography/tracts.parquet")
    ids = sorted(r.tract_id for r in data["tracts"].collect())
    lists = ", ".join(f'"{a}": ["{b}"]' for a, b in zip(ids, ids[1:]))
    with open(f"{folder}/geography/adjacency.json", "w") as target:
        target.write("{" + lists + "}")
    return folder


def test_generated_sales_follow_their_bounds(spark, stored):
    pairs = spark.read.parquet(f"{stored}/transactions").toPandas()
    assert len(pairs) > 100 and (pairs.first_sale_price >= 10000).all()
    assert (pairs.second_sale_date > pairs.first_sale_date).all()
    ratio = pairs.second_sale_price / pairs.first_sale_price
    assert ratio.between(0.49, 3.01).mean() > 0.99
    market = generate.market_indices(generate.tract_areas(spark, 8, 2).select("cbsa_id", "profile_type").distinct(), 2005, 2020)
    assert market.where("year = 2005 and index_value <> 1.0").count() == 0
    people = generate.demographics(generate.tract_areas(spark, 8, 2), [2010]).toPandas()
    assert people.college_share.between(0, 1).all() and (people.upb_total > 0).all()


def test_index_request(spark, stored):
    request = service.IndexRequest(date(2005, 1, 1), date(2020, 12, 31), robust_regression=True)
    answer = service.calculate_index(spark, stored, request, supertract_options=SupertractOptions(min_half_pairs=10))
    assert answer.status == "success", answer.error_message
    assert answer.index_values.count() > 0 and answer.coverage_stats["num_regressions"] > 0
    assert 0 <= answer.quality_metrics["overall_score"] <= 1 and answer.outlier_summary["total_outliers"] >= 0
    assert service.calculate_index(spark, "/nowhere", request).status == "error"


def test_build_writes_its_tables_and_optional_steps_may_fail(spark, stored):
    output = tempfile.mkdtemp(prefix="hearthline-out-")
    done = pipeline.build_index(spark, stored, output, supertract_options=SupertractOptions(min_half_pairs=10), retries=0)
    assert done.status == "success", done.errors
    assert spark.read.csv(f"{output}/index_values_csv", header=True).count() > 0
    assert os.path.exists(f"{output}/quality_report.json") and os.path.exists(f"{output}/outlier_report.json")
    assert pipeline.build_index(spark, "/nowhere", output, retries=0).status == "failed"


def test_attempts():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not yet")

    assert pipeline.attempt(flaky).attempts == 3
    failed = pipeline.attempt(lambda: 1 / 0, retries=1)
    assert (failed.status, failed.attempts) == ("failed", 2)


HEADER = "property_id,tract_id,cbsa_id,first_sale_date,first_sale_price,second_sale_date,second_sale_price\n"


def test_upload_keeps_valid_rows_only(spark):
    folder = tempfile.mkdtemp(prefix="hearthline-up-")
    with open(f"{folder}/new.csv", "w") as target:
        target.write(HEADER + "P1,00000000001,10000,2019-01-01,100000,2020-01-01,105000\n")
        target.write("P2,00000000001,10000,2019-01-01,100000,2019-03-01,100500\nP3,00000000001,10000,yesterday,1,2,3\n")
    answer = service.upload(spark, f"{folder}/store", f"{folder}/new.csv", service.UploadRequest("transactions", "csv"))
    assert (answer.status, answer.records_processed, answer.records_valid, answer.records_invalid) == ("success", 3, 1, 2)
    assert {e["rejection_reason"] for e in answer.validation_errors} == {"Same 12-month period", "Unreadable record"}
    assert files.load_pairs_between(spark, f"{folder}/store").first().tract_id == "00000000001"
    assert service.upload(spark, folder, folder, service.UploadRequest("transactions", "xml")).status == "error"


def test_arriving_files_are_appended_once(spark):
    folder = tempfile.mkdtemp(prefix="hearthline-in-")
    os.makedirs(f"{folder}/in")
    for i in range(2):
        with open(f"{folder}/in/{i}.csv", "w") as target:
            target.write(HEADER + f"P{i},01,10000,2019-01-01,100000,2020-01-01,105000\nP{i},01,10000,2019-01-01,1,2019-01-02,1\n")
        append_valid_pairs(arriving_pairs(spark, f"{folder}/in"), f"{folder}/store", f"{folder}/progress").awaitTermination(120)
    assert files.load_pairs_between(spark, f"{folder}/store").count() == 2
    upload = service.UploadRequest("transactions", "csv")
    for count, upload.replace_existing in ((3, False), (4, False), (1, True)):  # replacing takes streamed pairs too
        assert service.upload(spark, f"{folder}/store", f"{folder}/in/0.csv", upload).status == "success"
        assert files.load_pairs_between(spark, f"{folder}/store").count() == count
    with pytest.raises(FileNotFoundError):
        files.load_pairs_between(spark, f"{folder}/none")
    assert rejections(arriving_pairs(spark, f"{folder}/in")).isStreaming


def test_stored_results(spark):
    folder = tempfile.mkdtemp(prefix="hearthline-cache-")
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    key = store.result_key("series", level="cbsa", start=date(2020, 1, 1))
    for _ in range(2):
        assert store.stored(spark, folder, key, build).count() == 3
    assert len(built) == 1 and store.contents(spark, folder).count() > 0
    assert store.stored(spark, folder, key, build, max_age_hours=0).count() == 3 and len(built) == 2
    assert store.invalidate(spark, folder, key) and not store.invalidate(spark, folder, key)


def test_geography_files_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="hearthline-geo-")
    tracts = generate.tract_geometries(spark, 12, 2).selectExpr("*", "'' AS centroid")
    written = sinks.export_geography({"tracts": tracts, "cbsas": generate.area_table(tracts), "adjacency": nearest_tracts(tracts, 3)}, folder)
    back = files.read_tracts(spark, written[0])
    assert back.count() == 12 and len(back.first().geometry) == 5
    assert files.read_adjacency(spark, written[2]).count() == 36
    geography = files.read_geography(spark, folder, cbsas="cbsas")
    assert {name: table.count() for name, table in geography.items()} == {"tracts": 12, "cbsas": 2, "adjacency": 36}
    assert files.read_cbsas(spark, written[1]).count() == 2


def test_geojson_in_any_layout(spark):
    folder = tempfile.mkdtemp(prefix="hearthline-geo-")

    def feature(name, kind, coordinates):
        return {"type": "Feature", "properties": {"tract_id": name}, "geometry": {"type": kind, "coordinates": coordinates}}

    small, large = [[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [9, 5], [9, 9], [5, 5]]]
    whole = {"type": "FeatureCollection", "features": [feature("a", "Polygon", small), feature("b", "MultiPolygon", [small, large])]}
    lines = '{"type": "FeatureCollection", "features": [\n' + ",\n".join(json.dumps(f) for f in whole["features"]) + "\n]}"
    for name, text in (("one", json.dumps(whole)), ("indented", json.dumps(whole, indent=2)), ("lines", lines)):
        with open(f"{folder}/{name}.geojson", "w") as target:
            target.write(text)
        found = {r.tract_id: r.geometry for r in files.read_tracts(spark, f"{folder}/{name}.geojson").collect()}
        assert found == {"a": small[0], "b": large[0]}
        rings = {r.tract_id: r.rings for r in files.read_tracts(spark, f"{folder}/{name}.geojson").collect()}
        assert rings == {"a": small, "b": [small[0], large[0]]}
        sinks.write_features(files.read_tracts(spark, f"{folder}/{name}.geojson"), f"{folder}-again/{name}.geojson")
        again = files.read_tracts(spark, f"{folder}-again/{name}.geojson").collect()
        assert {r.tract_id: r.rings for r in again} == rings
    assert files.read_tracts(spark, folder).count() == 6
    edges = {"a": ["b", "c"], "b": ["a"]}
    for name, indent in (("one", None), ("indented", 2)):
        with open(f"{folder}/{name}.json", "w") as target:
            json.dump(edges, target, indent=indent)
        assert files.read_adjacency(spark, f"{folder}/{name}.json").count() == 3


def test_rejected_rows_are_all_kept(spark):
    folder = tempfile.mkdtemp(prefix="hearthline-up-")
    with open(f"{folder}/new.csv", "w") as target:
        target.write(HEADER + "".join(f"P{i},01,10000,2019-01-01,1,2019-01-02,1\n" for i in range(150)))
    answer = service.upload(spark, f"{folder}/store", f"{folder}/new.csv", service.UploadRequest("transactions", "csv", errors_shown=7))
    assert (answer.status, len(answer.validation_errors), answer.records_invalid) == ("validation_failed", 7, 150)
    assert spark.read.parquet(answer.rejected_path).count() == 150


def test_weights_are_what_they_say(spark, stored):
    request = service.IndexRequest(date(2010, 1, 1), date(2020, 12, 31), weighting_scheme=WeightType.VALUE, include_quality_metrics=False, include_outlier_analysis=False)
    few = SupertractOptions(min_half_pairs=10)
    people = files.load_stored_demographics(spark, stored)
    assert people is None
    answer = service.calculate_index(spark, stored, request, supertract_options=few)
    assert answer.status == "error" and "needs demographics" in answer.error_message
    tracts = files.load_stored_tracts(spark, stored).select("tract_id").distinct()
    rank = F.dense_rank().over(Window.orderBy("tract_id")).cast("double")
    table = tracts.withColumn("value", F.pow(rank, 3)).crossJoin(spark.range(2008, 2022)).selectExpr(
        "tract_id", "cast(id as int) year", "1 housing_units", "value median_value", "0.1D college_share", "0.1D non_white_share", "1D upb_total"
    )
    value = service.calculate_index(spark, stored, request, table, supertract_options=few)
    request.weighting_scheme = WeightType.SAMPLE
    request.filters = {"no_such_column": ["x"]}
    equal = service.calculate_index(spark, stored, request, supertract_options=few)
    assert value.status == equal.status == "success" and equal.seconds > 0
    assert equal.warnings == ["no column no_such_column: that filter keeps all rows"]
    levels = [{(r.geography_id, r.date): r.index_value for r in a.index_values.collect()} for a in (value, equal)]
    assert any(abs(levels[0][k] - levels[1][k]) > 1e-6 for k in levels[0].keys() & levels[1].keys())


def test_command_line(spark, capsys):
    folder = tempfile.mkdtemp(prefix="hearthline-cli-")
    cli.main(["generate", "--output", folder, "--num-cbsas", "2", "--tracts-per-cbsa", "3", "--properties-per-tract", "150"])
    cli.main(["quality", "--input", f"{folder}/pairs"])
    assert "Overall quality score" in capsys.readouterr().out
    cli.main([
        "calculate", "--input", f"{folder}/transactions", "--output", f"{folder}/index", "--start-date", "2010-01-01",
        "--end-date", "2023-12-31", "--geography", "national", "--format", "json",
    ])
    assert spark.read.json(f"{folder}/index").count() > 0


def test_lines_of_a_part_meet_once_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(retail, "LINES_A_TASK", 100)
    days = retail.daily(spark, TABLES)
    lines = retail.table(spark, TABLES, "lineitem").count()
    placed = days.groupBy("l_partkey", F.spark_partition_id().alias("task")).agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in placed) == lines and len({r.l_partkey for r in placed}) == len(placed)
    held = {t: sum(r.n for r in placed if r.task == t) for t in {r.task for r in placed}}
    assert len(held) > lines / 100 / 2 and max(held.values()) < 400
    # The lines are shuffled by part only, and nothing is summed before that.
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("REPARTITION_BY_NUM") and "HashAggregate" not in plan[plan.index("REPARTITION_BY_NUM"):]


def test_lines_meet_their_suppliers_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(retail, "LINES_A_TASK", 100)
    parts = retail._parts_of(retail.table(spark, TABLES, "lineitem"))
    plan = retail.daily(spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    by_supplier = [line for line in plan.splitlines() if "hashpartitioning(s_suppkey" in line and "REPARTITION_BY_NUM" in line]
    assert by_supplier and all(f", {parts})" in line for line in by_supplier)


@pytest.mark.parametrize("name", ["weights_redistributed", "weights_all_types"])
def test_weights_read_stored_demographics(spark, name):
    assert any("/demographics-" in path for path in QUERIES[name](spark, TABLES).inputFiles())
