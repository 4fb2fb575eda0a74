"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A heavy-hitter list is tiny, but the count behind it can run for long.
    "spark.sql.broadcastTimeout": "7200",
}

#: Has Spark remove the shuffle files of a command when it ends, and not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scope: ContextVar[str | None] = ContextVar("scratch scope", default=None)


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators are designed for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="relgate-")
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the folder the cluster shares for checkpoints.

    Without ``spark.checkpoint.dir`` a local temporary folder is made, and only
    in local mode, where driver and executors are one machine. Inside ``scratch_scope``
    the name is below the scope's folder and goes with it.
    """
    return f"{_scope.get() or _shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """A run's own scratch folder, deleted when the run ends, by an error too.

    Results that read scratch tables have to be consumed or written elsewhere before. Scopes
    can be nested; each deletes what was made in it. A run that is killed leaves its folder,
    named ``run-`` and unique, so that it can be told from those of other runs.
    """
    folder = scratch_path(spark, "run")
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        delete_folder(spark, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder and what is in it, in whatever store it lies; no folder is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in this scope leave no shuffle files behind: the table is what is read again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a scratch table: read again where it is used more than once, not computed again."""
    path = scratch_path(df.sparkSession, purpose)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
