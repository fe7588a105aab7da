"""Writers. Output stays as many files as there are partitions unless asked otherwise."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, file_format: str = "parquet", single_file: bool = False) -> str:
    """Write as csv, json or parquet. single_file suits report tables only."""
    if file_format not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported file format: {file_format}")
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)
    return path


def save_results(results: dict[str, DataFrame], folder: str, file_format: str = "csv") -> list[str]:
    """Every table in a folder of its own name; tables with outlines also as GeoJSON lines."""
    written = []
    for name, df in results.items():
        if "geometry" in df.columns:
            written.append(write_features(df, f"{folder}/{name}.geojson"))
        else:
            written.append(write_table(df, f"{folder}/{name}", file_format))
    return written


def write_features(tracts: DataFrame, path: str) -> str:
    """GeoJSON features, one per line, written in parallel; tracts of several rings are MultiPolygons."""
    properties = F.struct(*[F.col(c) for c in tracts.columns if c not in ("geometry", "rings")])
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array("geometry").alias("coordinates")))
    if "rings" in tracts.columns:
        several = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("rings", lambda r: F.array(r)).alias("coordinates"))
        one = F.when(F.size("rings") > 1, F.to_json(several)).otherwise(one)
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties")))
    feature = F.concat(F.expr("substr(head, 1, length(head) - 1)"), F.lit(',"geometry":'), F.col("outline"), F.lit("}"))
    rows = tracts.select(head.alias("head"), one.alias("outline"))
    rows.select(feature.alias("value")).write.mode("overwrite").text(path)
    return path


def write_adjacency(edges: DataFrame, path: str) -> str:
    """Neighbour lists, nearest first, as one JSON object per line."""
    lists = edges.groupBy("tract_id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id"))).alias("n"))
    entry = F.create_map("tract_id", F.transform("n", lambda e: e["neighbor_id"]))
    lists.select(F.to_json(entry).alias("value")).write.mode("overwrite").text(path)
    return path


def export_geography(geography: dict[str, DataFrame], folder: str) -> list[str]:
    return [
        write_features(geography["tracts"], f"{folder}/tracts.geojson"),
        write_table(geography["cbsas"], f"{folder}/cbsas", "csv", single_file=True),
        write_adjacency(geography["adjacency"], f"{folder}/tract_adjacency.json"),
    ]


def record_upload(spark: SparkSession, folder: str, upload_id: str, records: int, file_format: str, notes: dict) -> None:
    """Append one line to the upload log; appending never rewrites earlier entries."""
    row = [(upload_id, datetime.now().isoformat(), int(records), file_format, json.dumps(notes, sort_keys=True))]
    fields = "upload_id string, upload_date string, records bigint, file_format string, user_metadata string"
    spark.createDataFrame(row, fields).coalesce(1).write.mode("append").json(f"{folder}/metadata")


def write_json(spark: SparkSession, content: dict, path: str) -> str:
    """A small report as one JSON document on the cluster's file system."""
    text = json.dumps(content, default=str, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
