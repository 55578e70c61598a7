"""Helpers that several training-data operators use: shared tables and text keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the controls from tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local session (tests, a laptop) gets a temporary one; on a
    cluster each executor would write to a disk of its own, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracefold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, written: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it reread.

    This cuts the lineage: a lost executor costs only the tasks it was running. ``written`` takes
    the path; a table that nobody discards goes with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracefold-{label}-{uuid.uuid4().hex}"
    if written is not None:
        written.append(path)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that :func:`materialize` wrote."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A :func:`materialize` whose tables are deleted at the end of the block.

    What leaves the block must be written by then, so that it does not read them.
    """
    written: list[str] = []
    try:
        yield lambda df, label: materialize(df, label, written)
    finally:
        discard(spark, written)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null.

    Replacing the few other white-space characters and splitting at one character is much
    cheaper than splitting at a pattern.
    """
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def by_shuffle(df: DataFrame) -> DataFrame:
    """Join this side by a sort-merge of both: for the side that a table of texts meets.

    Such a side grows with the corpus. Broadcasting it while it is small would only hide what the
    join costs at full size.
    """
    return df.hint("merge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    The optimizer merges projections and moves filters below them, and would otherwise compute
    an array anew for every element of a lambda that refers to it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
