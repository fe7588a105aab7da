"""Results kept as Parquet under a key made of their parameters."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def result_key(kind: str, **parameters) -> str:
    text = json.dumps(parameters, sort_keys=True, default=str)
    return f"{kind}-{hashlib.md5(text.encode()).hexdigest()}"


def _path(spark: SparkSession, location: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(
    spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame], max_age_hours: float = 24.0
) -> DataFrame:
    """The stored table of this key, built and written first if absent or too old.

    Every build gets a folder of its own, so readers of an older one are not disturbed;
    folders without a success marker are ignored.
    """
    root, files = _path(spark, f"{folder}/{key}")
    newest, stamp = None, 0
    if files.exists(root):
        for entry in files.listStatus(root):
            marker = _path(spark, f"{entry.getPath()}/_SUCCESS")[0]
            if files.exists(marker) and entry.getModificationTime() > stamp:
                newest, stamp = str(entry.getPath()), entry.getModificationTime()
    if newest is None or time.time() - stamp / 1000 > max_age_hours * 3600:
        newest = f"{folder}/{key}/{int(time.time() * 1000)}"
        build().write.parquet(newest)
    return spark.read.parquet(newest)


def invalidate(spark: SparkSession, folder: str, key: str) -> bool:
    """Delete every stored build of a key."""
    root, files = _path(spark, f"{folder}/{key}")
    return bool(files.exists(root) and files.delete(root, True))


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """Stored files with their size and age, as a table."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return found.select("path", "modificationTime", F.col("length").alias("bytes"))
