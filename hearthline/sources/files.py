"""Readers with fixed schemas; nothing is inferred, so ids keep their leading zeros."""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import schemas
from hearthline.operators.regression import within_dates
from hearthline.sources.snapshots import SnapshotTable

# Folders below a store that writers and readers share.
STREAMED = "transactions_streamed"
TRACTS = "geography/tracts.parquet"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.TRANSACTIONS)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.PAIRS)


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.PROPERTIES)


def read_cbsas(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.CBSAS)


def read_demographics(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.DEMOGRAPHICS)


def read_market_indices(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.MARKET_INDICES)


RING = "array<array<double>>"


def _files_without(rows: DataFrame, found: Column) -> list[str]:
    """Files none of whose lines meet the condition; the driver lists the files anyhow."""
    counts = rows.groupBy(F.input_file_name().alias("file")).agg(F.count_if(found).alias("n"))
    return [r["file"] for r in counts.where("n = 0").collect()]


def _outer_rings(geometry: str) -> Column:
    """Outer rings of a polygon or of all polygons of a MultiPolygon."""
    text = F.col(f"{geometry}.coordinates")
    several = F.transform(F.from_json(text, f"array<array<{RING}>>"), lambda polygon: polygon[0])
    one = F.slice(F.from_json(text, f"array<{RING}>"), 1, 1)
    return F.when(F.col(f"{geometry}.type") == "MultiPolygon", several).otherwise(one)


def _largest(rings: Column) -> Column:
    """The ring with the largest bounding box."""

    def extent(ring: Column, axis: int) -> Column:
        along = F.transform(ring, lambda point: point[axis])
        return F.array_max(along) - F.array_min(along)

    sized = F.transform(rings, lambda r: F.struct((extent(r, 0) * extent(r, 1)).alias("size"), r.alias("ring")))
    return F.array_max(sized)["ring"]


def read_tracts(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON tracts: all outer rings as ``rings``, and the largest of them, an array of points, as ``geometry``.

    Files with one feature per line are read in parallel. Any other layout, on one line or
    indented, is read as one document per file, whose size is that of the file.
    """
    line = F.rtrim(F.trim("value"), F.lit(","))
    lines = spark.read.text(path)
    per_line = line.rlike(r'^\{\s*"type"\s*:\s*"Feature"\s*,')
    features = lines.where(per_line).select(F.from_json(line, schemas.TRACT_FEATURE).alias("f"))
    documents = _files_without(lines, per_line)
    if documents:
        whole = spark.read.schema(f"features array<{schemas.TRACT_FEATURE}>").json(documents, multiLine=True)
        features = features.unionByName(whole.select(F.explode("features").alias("f")))
    found = features.select("f.properties.*", _outer_rings("f.geometry").alias("rings"))
    return found.withColumn("geometry", _largest(F.col("rings")))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Edges (tract_id, neighbor_id, rank) from JSON objects of neighbour lists.

    One object per line, the layout of our own sink, is read in parallel. A file without
    such a line is one document, whose size is that of the geography.
    """
    kind = "map<string, array<string>>"
    lines = spark.read.text(path)
    parsed = F.from_json("value", kind)
    maps = lines.select(parsed.alias("m")).where(F.col("m").isNotNull())
    documents = _files_without(lines, parsed.isNotNull())
    if documents:
        maps = maps.unionByName(spark.read.text(documents, wholetext=True).select(parsed.alias("m")))
    lists = maps.select(F.explode("m").alias("tract_id", "neighbors"))
    return lists.select("tract_id", F.posexplode("neighbors").alias("position", "neighbor_id")).select(
        "tract_id", "neighbor_id", (F.col("position") + 1).alias("rank")
    )


def read_geography(
    spark: SparkSession,
    folder: str,
    tracts: str = "tracts.geojson",
    cbsas: str = "cbsas.csv",
    adjacency: str = "tract_adjacency.json",
) -> dict[str, DataFrame]:
    return {
        "tracts": read_tracts(spark, f"{folder}/{tracts}"),
        "cbsas": read_cbsas(spark, f"{folder}/{cbsas}"),
        "adjacency": read_adjacency(spark, f"{folder}/{adjacency}"),
    }


def read_upload(spark: SparkSession, path: str, file_format: str, schema: str = schemas.PAIRS) -> DataFrame:
    """An uploaded file; text rows that do not parse keep their text in _corrupt_record."""
    if file_format == "parquet":
        return spark.read.schema(schema).parquet(path)
    tolerant = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    if file_format == "csv":
        return spark.read.csv(path, schema=f"{schema}, _corrupt_record string", header=True, **tolerant)
    if file_format == "json":
        return spark.read.json(path, schema=f"{schema}, _corrupt_record string", **tolerant)
    raise ValueError(f"unsupported file format: {file_format}")


def _stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A stored Parquet table, or None where there is none."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stored_pairs(spark: SparkSession, folder: str) -> SnapshotTable:
    """The pairs of a store. Plain Parquet folders of pairs in it are where the table starts."""
    origin = tuple(f"{folder}/{name}" for name in ("transactions", STREAMED))
    return SnapshotTable(spark, f"{folder}/transactions_versions", schemas.PAIRS, origin)


def load_pairs_between(
    spark: SparkSession, folder: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Stored pairs whose second sale lies in the range; the filter reaches the Parquet scan.

    All of them belong to one version of the store, whatever uploads and streams do meanwhile.
    """
    table = stored_pairs(spark, folder)
    version = table.version()
    if not version.folders:
        raise FileNotFoundError(f"no stored pairs in {folder}")
    # A folder that a stream's file sink wrote is read by its log, so each folder is read by itself.
    parts = [spark.read.schema(schemas.PAIRS).parquet(f) for f in version.folders if f in table.origin]
    rest = tuple(f for f in version.folders if f not in table.origin)
    if rest:
        parts.append(table.read(replace(version, folders=rest)))
    return within_dates(reduce(DataFrame.unionByName, parts), start, end)


def load_stored_tracts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{TRACTS}")


def load_stored_demographics(spark: SparkSession, folder: str) -> DataFrame | None:
    return _stored(spark, f"{folder}/demographics", schemas.DEMOGRAPHICS)


def load_stored_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return read_adjacency(spark, f"{folder}/geography/adjacency.json")


def pairs_from_rows(spark: SparkSession, rows: list) -> DataFrame:
    """Pairs from Python objects or tuples in schema order."""
    return spark.createDataFrame(rows, schemas.PAIRS)


def area_mapping(areas: DataFrame) -> DataFrame:
    """Tract to area from rows of (cbsa_id, tract_ids)."""
    return areas.select(F.explode("tract_ids").alias("tract_id"), "cbsa_id")
