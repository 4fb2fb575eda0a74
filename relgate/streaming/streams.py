"""Files as a stream, and tables that a stream fills so that a restart adds nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: The file that a finished write leaves.
FINISHED = "_SUCCESS"


def stream_dataset(
    spark: SparkSession, path: str, schema: StructType | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """A parquet file or folder as a stream: what is there, and what is added later.

    Without a ``schema`` that of the files present is taken, from their footers.
    ``files_per_batch`` bounds a batch, so a backlog is worked off in steps.
    """
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # The file source watches folders: a single file is the one of its name in its folder.
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(name).isFile():
        return reader.option("pathGlobFilter", name.getName()).parquet(name.getParent().toString())
    return reader.parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Works off all that the stream has and appends it to the table ``path``; returns when done.

    The sink lists the files of each finished batch, and readers of the table follow that
    list: files of a batch that was cut short are never read, and the batch is run again.
    State and offsets are in ``checkpoint``, which has to be shared by all executors.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query


def finished_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders below a glob pattern whose write was finished; names only, no data is read."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pattern}/{FINISHED}")
    found = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marker)
    return sorted(s.getPath().getParent().toString() for s in found or [])
