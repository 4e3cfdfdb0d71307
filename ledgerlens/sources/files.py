"""Folders of any store that Spark's own file layer reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, which all executors share.

    Where it is unset, a local master gets a temporary folder; a cluster raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ledgerlens-shared-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; none if it is not there."""
    fs, place = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def create(spark: SparkSession, path: str) -> None:
    """An empty new file; one that is already there raises."""
    fs, place = _at(spark, path)
    fs.create(place, False).close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of results; one that is not there is no error."""
    fs, place = _at(spark, path)
    fs.delete(place, True)


def move_only_part(spark: SparkSession, folder: str, target: str) -> bool:
    """Make the one part file of ``folder`` the file ``target``; False if there is none."""
    fs, place = _at(spark, folder)
    parts = [s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith("part-")] if fs.exists(place) else []
    if len(parts) > 1:
        raise RuntimeError(f"expected one part file in {folder}, found {len(parts)}")
    for part in parts:
        _, to = _at(spark, target)
        fs.delete(to, False)
        if not fs.rename(part, to):
            raise RuntimeError(f"could not write {target}")
    return bool(parts)
