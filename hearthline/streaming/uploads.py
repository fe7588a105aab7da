"""Pairs that keep arriving as files: check them once, append the valid ones to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthline import schemas
from hearthline.operators.validate import validate_pairs
from hearthline.sources.files import stored_pairs


def arriving_pairs(spark: SparkSession, folder: str, file_format: str = "csv") -> DataFrame:
    """Each new file in the folder, with the result of every validation rule."""
    reader = spark.readStream.schema(schemas.PAIRS)
    if file_format == "csv":
        reader = reader.option("header", True)
    return validate_pairs(reader.format(file_format).load(folder))


def append_valid_pairs(arriving: DataFrame, store: str, progress: str) -> StreamingQuery:
    """Append valid pairs to the store for the files present now.

    Every batch becomes a version of the store's pairs and carries its number, so a batch that is
    run again after a failure is stored once.
    """
    table = stored_pairs(arriving.sparkSession, store)
    valid = arriving.where("is_valid").select(*schemas.PAIR_COLUMNS)
    return (
        valid.writeStream.foreachBatch(lambda pairs, number: table.append(pairs, (progress, number)))
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def rejections(arriving: DataFrame) -> DataFrame:
    """Running count of rejected pairs by reason; the state is one row per reason."""
    return arriving.where("not is_valid").groupBy("rejection_reason").agg(F.count(F.lit(1)).alias("pairs"))
