"""Validation of a stream, with the failed records in a table of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from relgate.functions import codes
from relgate.streaming.streams import finished_folders

GOOD, REJECT = "good", "reject"


def write_batch(judged: DataFrame, root: str, batch_id: int) -> None:
    """One batch of judged records, good ones and rejects, in one pass and under its number.

    The folder of a batch is replaced as a whole, so a batch that is run again, after a
    lost driver or on purpose, leaves the same tables.
    """
    outcome = F.when(F.col("code") == codes.PASSED, GOOD).otherwise(REJECT)
    tagged = judged.withColumn("outcome", outcome)
    tagged.write.mode("overwrite").partitionBy("outcome").parquet(f"{root}/batch={batch_id}")


def split_stream(
    stream: DataFrame, judge: Callable[[DataFrame], DataFrame], root: str, checkpoint: str
) -> StreamingQuery:
    """Judges all that the stream has, batch by batch, into ``root``; returns when done.

    ``judge`` adds ``code`` and ``message`` as ``verdict`` does; code 0 is a good record. Batches
    are numbered by the checkpoint: a restart goes on after the last finished one.
    """
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: write_batch(judge(batch), root, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def judged_records(spark: SparkSession, root: str, schema: StructType, outcome: str | None = None) -> DataFrame:
    """The records of finished batches, or only the good ones or the rejects.

    ``schema`` is that of the judged records. A batch without a success marker is not read; no
    finished batch gives no rows.
    """
    folders = finished_folders(spark, f"{root}/batch=*")
    tagged = StructType(list(schema.fields)).add("outcome", "string")
    if not folders:
        return spark.createDataFrame([], tagged)
    rows = spark.read.schema(tagged).option("basePath", root).parquet(*folders).select(*tagged.names)
    return rows.filter(F.col("outcome") == outcome) if outcome else rows
