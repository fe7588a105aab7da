"""Spark session and checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "hearthline", **settings: str) -> SparkSession:
    """Session with the settings the engine is written for; the cluster's own win elsewhere."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, unless it was sent with the job already."""
    context = spark.sparkContext
    name = __package__.split(".")[0]
    if not any(os.path.basename(path).startswith(name) for path in context._python_includes):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-package-"), name)
        context.addPyFile(shutil.make_archive(archive, "zip", root, name))
    return spark


def use_checkpoint_folder(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder.

    A machine-local folder is only ever used in local mode, where no other machine
    has to read it back.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hearthline-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; survives the loss of any executor."""
    use_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash by key into the session's shuffle partitions, whatever the size.

    Solving a group costs far more than its few rows suggest, so the partitions must not
    be merged by size. A grouped map on the same keys needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# Places this driver has handed out and not dropped yet.
_handed_out: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new place below the shared checkpoint folder."""
    use_checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


def drop_staged(spark: SparkSession) -> int:
    """Delete what this driver has staged so far; for the end of a run, when its results are written.

    Tables not yet read to their end stand on staged folders and cannot be used after this.
    """
    jvm, count = spark.sparkContext._jvm, len(_handed_out)
    while _handed_out:
        path = jvm.org.apache.hadoop.fs.Path(_handed_out.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return count


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write once as Parquet in the shared checkpoint folder and read back.

    For tables that several later steps scan: each scan reads only its columns.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
