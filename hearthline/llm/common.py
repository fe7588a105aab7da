"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.session import ship_package

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; rows with long texts go to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship_package(spark).read.parquet(f"{folder}/{name}.parquet")


def chunked(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of one string column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(column).cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def column_set(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so that further ones cannot clash with names made here."""
    return df.select(*[F.col(f"`{name}`") for name in wanted])


def columns_besides(df: DataFrame, *results: str) -> list[str]:
    """Columns of df that a result of the same name does not take the place of."""
    return [name for name in df.columns if name not in results]


def blocks_for(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def unsigned_hex(word: Column) -> Column:
    return F.lower(F.lpad(F.hex(word), 16, "0"))
