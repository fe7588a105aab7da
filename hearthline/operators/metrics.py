"""Summaries of run-time measurements kept as a table (name, timestamp, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions.ordered import exact_quantiles

SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def recent(records: DataFrame, retention_hours: int = 24) -> DataFrame:
    """Records no older than the retention, counted back from the newest one."""
    # One row: the newest timestamp.
    newest = records.agg(F.max("timestamp").alias("_newest"))
    age = F.timestamp_diff("SECOND", F.col("timestamp"), F.col("_newest"))
    return records.join(F.broadcast(newest), age < retention_hours * 3600).drop("_newest")


def metric_summary(records: DataFrame) -> DataFrame:
    """Count, latest value, range, mean and exact percentiles per metric."""
    totals = records.groupBy("name").agg(
        F.count(F.lit(1)).alias("count"),
        F.max_by("value", F.struct("timestamp", "value")).alias("latest"),
        F.sum("value").alias("total"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
    )
    return totals.join(exact_quantiles(records, ["name"], "value", SHARES), "name")


def status_counts(records: DataFrame, status: str) -> DataFrame:
    return records.groupBy(status).agg(F.count(F.lit(1)).alias("jobs"))


def bottlenecks(summary: DataFrame, time: str, memory: str, key: str, n: int = 5) -> DataFrame:
    """The n slowest and the n most memory-hungry entries, each once."""
    slow = summary.orderBy(F.desc(time), key).limit(n).withColumn("bottleneck_type", F.lit("time"))
    heavy = summary.orderBy(F.desc(memory), key).limit(n).withColumn("bottleneck_type", F.lit("memory"))
    # An entry in both lists counts as a memory bottleneck.
    only_slow = slow.join(heavy.select(key), key, "left_anti")
    return heavy.unionByName(only_slow.select(*heavy.columns))
