"""Cut the lineage of an iterative job by a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracefold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cutter(spark: SparkSession, label: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table and rereads it: a lost executor then costs only its running tasks."""

    def cut(df: DataFrame) -> DataFrame:
        return written(df, label)[0]

    return cut


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A table in the shared folder, reread, and its path. What nobody deletes before goes with the session."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tracefold-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), path


class Tables:
    """Tables in the shared folder that one operator writes and rereads; they go when it is done with them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self.paths: dict[int, str] = {}
        self.kept: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        """Write a table and reread it: a lost executor then costs only its running tasks."""
        out, path = written(df, self.label)
        self.paths[id(out)] = path
        self.kept.append(out)  # so that no other table takes its id
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """As :meth:`cut`, for the result: it outlives the operator."""
        return written(df, self.label)[0]

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        if path := self.paths.pop(id(df), None):
            delete(self.spark, path)

    def close(self) -> None:
        for path in self.paths.values():
            delete(self.spark, path)
        self.paths.clear()
        self.kept.clear()


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tables(spark: SparkSession, label: str) -> Tables:
    return Tables(spark, label)
