"""Where intermediate tables go: the library's store, and a checked broadcast."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import cut, discard, shared_dir, stored, without_shuffle_files

__all__ = ["bounded_batches", "broadcast_if_small", "bucketed", "cut", "discard", "shared_dir", "stored"]


def broadcast_if_small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """The table with a broadcast hint if it has no more than ``rows`` rows, else as it is: then joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of an Arrow batch on its way to a Python worker: rows are few where texts are long.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same table, in a session whose Arrow batches are bounded by bytes, not by rows alone."""
    df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def bucketed(df: DataFrame, key: str, name: str = "table") -> DataFrame:
    """The table in the shared folder, in buckets by ``key``, so that joins by it shuffle the other side alone.

    There are as many buckets as the session has shuffle partitions.  The
    session's catalog names the table, as only catalogs keep buckets.
    """
    spark = df.sparkSession
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    with without_shuffle_files(spark):
        writer = df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", path)
        writer.bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out._stored_at = path
    return out
