"""Sinks: staging builds and immutable published versions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from relgate.functions import codes
from relgate.functions.codes import GateError
from relgate.session import delete_folder
from relgate.sources.datasets import read_dataset


def build(df: DataFrame, staging: str, formats: Sequence[str] = ("parquet",)) -> DataFrame:
    """Replace ``staging/<format>`` by the data, in each format; returns the first, re-read.

    Only the first write runs the plan of ``df``. The others read what it wrote, so
    nothing is cached and an expensive plan is not run twice.
    """
    first, *others = formats
    df.write.mode("overwrite").format(first).save(f"{staging}/{first}")
    built = read_built(df.sparkSession, staging, first, df)
    for other in others:
        built.write.mode("overwrite").format(other).save(f"{staging}/{other}")
    return built


def read_built(spark: SparkSession, staging: str, fmt: str, like: DataFrame) -> DataFrame:
    """One format of a build, with the schema of ``like`` (nothing is inferred)."""
    return spark.read.schema(like.schema).format(fmt).load(f"{staging}/{fmt}")


def version_path(root: str, name: str, version: str) -> str:
    return f"{root}/{name}/version={version}"


def _place(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, whatever store it lies in."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _claim_path(root: str, name: str, version: str) -> str:
    return f"{root}/{name}/_claims/version={version}"


def _claim(spark: SparkSession, path: str, run: str) -> bool:
    """Creates the marker ``path`` that names ``run``; False if there is one already.

    The store decides between two writers: a file is created only where there is none, in one step.
    """
    marker, store = _place(spark, path)
    store.mkdirs(marker.getParent())
    if store.getUri().getScheme() == "file":
        # Hadoop's local files are looked up and then created, in two steps.
        try:
            with open(store.makeQualified(marker).toUri().getPath(), "x") as file:
                file.write(run)
        except FileExistsError:
            return False
        return True
    try:
        out = store.create(marker, False)
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    out.write(bytearray(run, "utf-8"))
    out.close()
    return True


def _finished(spark: SparkSession, root: str, name: str, version: str) -> bool:
    marker, store = _place(spark, f"{version_path(root, name, version)}/_SUCCESS")
    return store.exists(marker)


def _claimed_run(spark: SparkSession, root: str, name: str, version: str) -> str | None:
    """The run that a version was claimed for; None if nobody has claimed it."""
    path = _claim_path(root, name, version)
    marker, store = _place(spark, path)
    if not store.exists(marker):
        return None
    first = spark.read.text(path).first()
    return first[0] if first else ""


def _settle(spark: SparkSession, root: str, name: str, version: str, run: str) -> None:
    """Moves the folder of the claimed run to the version's place, if it is not there yet.

    The data was whole before it was claimed, so anyone can do what a lost writer has not.
    """
    staged, store = _place(spark, f"{root}/{name}/_runs/{run}")
    to, _ = _place(spark, version_path(root, name, version))
    if run and not _finished(spark, root, name, version) and store.exists(staged):
        store.delete(to, True)  # what a write without a claim has left
        store.rename(staged, to)


def published_versions(spark: SparkSession, root: str, name: str) -> list[str]:
    """Versions that were published, unordered: claimed ones, and finished folders from elsewhere.

    Names only are listed, no data is read. A write that has not claimed its version is none.
    """
    found = set()
    for pattern, parent in ((_claim_path(root, name, "*"), False), (f"{version_path(root, name, '*')}/_SUCCESS", True)):
        path, store = _place(spark, pattern)
        for status in store.globStatus(path) or []:
            folder = status.getPath().getParent() if parent else status.getPath()
            found.add(folder.getName().split("=", 1)[1])
    return list(found)


def publish(
    df: DataFrame,
    root: str,
    name: str,
    version: str,
    skip_existing: bool = False,
    replace_unfinished: bool = False,
) -> DataFrame:
    """Write a new version under ``root/name`` and return it, re-read.

    A published version is never changed: it is code 106, or left as it is with
    ``skip_existing``. A folder whose write never finished is code 106 in either case,
    unless ``replace_unfinished``.

    The rows are written to a folder of this run. Then the version is claimed by creating
    its marker, which only one of several writers can do, and the folder takes its place. A writer that
    comes second removes what it wrote: nothing of two writers is ever mixed. A writer lost
    after its claim has published: the next call, or ``read_version``, puts its folder in place.
    """
    spark = df.sparkSession
    taken = GateError(codes.PUBLISH_ERROR, f"{name} {version} is already published")
    if version in published_versions(spark, root, name):
        if not skip_existing:
            raise taken
        return read_version(spark, root, name, version)
    left, store = _place(spark, version_path(root, name, version))
    if store.exists(left) and not replace_unfinished:
        raise taken
    run = uuid.uuid4().hex
    staged = f"{root}/{name}/_runs/{run}"
    df.write.parquet(staged)
    if not _claim(spark, _claim_path(root, name, version), run):
        delete_folder(spark, staged)
        if not skip_existing:
            raise taken
        return read_version(spark, root, name, version)
    _settle(spark, root, name, version, run)
    return read_dataset(spark, root, name, version)


def read_version(spark: SparkSession, root: str, name: str, version: str) -> DataFrame:
    """A published version; one that was claimed and not yet put in place is put there first.

    A claimed version whose folder has been cut short since is code 106 and not read.
    """
    run = _claimed_run(spark, root, name, version)
    if run:
        _settle(spark, root, name, version, run)
    if not _finished(spark, root, name, version):
        raise GateError(codes.PUBLISH_ERROR, f"{name} {version} is claimed, and its rows are not whole")
    return read_dataset(spark, root, name, version)


def new_rows(df: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not published yet."""
    return df.join(published.select(*keys).distinct(), list(keys), "left_anti")
