"""What the operators of this package share: folds, bounded samples, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relgate.session import scratch_path, shuffles_removed

#: The characters that part words: blank and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a table, about, that a Python worker gets at once, and rows that become Python objects at once.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512

_caches: dict[str, Any] = {}


def worker_cache(owner: str, make: Callable[[], Any]) -> Any:
    """What ``owner`` remembers in this Python worker; what others remembered is given up.

    Workers outlive a stage, and the caches of all stages of a run would else add up.
    """
    if (held := _caches.get(owner)) is None:
        _caches.clear()
        held = _caches[owner] = make()
    return held


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand tables to Python in batches of some ``BATCH_BYTES``, from now on.

    By default a batch is 10,000 rows, which for texts is the whole of a file's split, held
    by the JVM and by the worker at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``BATCH_ROWS``."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Some columns of one of the tables in ``sf_dir``, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the folder the cluster shares: lineage ends there.

    A lost executor then costs the reading of files and not the work before them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


#: Leading hash bits by which a sample's rows are counted first.
SAMPLE_BITS = 16


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``rows`` rows at most, those with the smallest hash of the key; the same in every run.

    The rows are counted by leading hash bits first (at most 65,536 counts), and only buckets
    that the sample reaches into are ordered, so a task sends its share and not ``rows``.
    """
    hashed = F.xxhash64(key, F.lit("sample"))
    bucket = F.shiftright(hashed, 64 - SAMPLE_BITS)
    held = df.groupBy(bucket.alias("bucket")).count().collect()
    last, total = -(1 << 63), 0
    for row in sorted(held, key=lambda r: r.bucket):
        if total >= rows:
            break
        last, total = row.bucket, total + row["count"]
    return df.filter(bucket <= last).orderBy(hashed, key).limit(rows)
