"""Sharded binary fields: one Fortran record of 4-byte floats per shard and tag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points per element edge, and the name of a shard's file.
EDGE = 5
NAME = r"proc(\d{6})_(reg\d)_(\w+)\.bin$"


def decode_record(data: bytes) -> np.ndarray:
    """The floats of a record: its length in bytes stands before and after it."""
    n = int.from_bytes(data[:4], "little")
    if len(data) < n + 8 or int.from_bytes(data[4 + n : 8 + n], "little") != n:
        raise ValueError("a record whose lengths do not agree with the file")
    return np.frombuffer(data, "<f4", n // 4, 4)


def encode_record(values: np.ndarray) -> bytes:
    raw = np.asarray(values, "<f4").tobytes()
    return len(raw).to_bytes(4, "little") + raw + len(raw).to_bytes(4, "little")


def read_field_files(spark: SparkSession, path: str, tag: str, region: str = "reg1") -> DataFrame:
    """(iproc, ispec, igll, <tag>): a row per point, from the files of a tag; a shard is decoded by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"proc*_{region}_{tag}.bin").load(path)
    rows = files.select(F.regexp_extract("path", NAME, 1).cast("int").alias("iproc"), "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for iproc, content in zip(batch.column("iproc").to_pylist(), batch.column("content")):
                values = decode_record(content.as_py())
                at = np.arange(len(values), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), iproc, np.int32)), pa.array(at // EDGE**3), pa.array(at % EDGE**3), pa.array(values)],
                    names=["iproc", "ispec", "igll", tag],
                )

    return rows.mapInArrow(work, f"iproc int, ispec int, igll int, `{tag}` float")


def zip_fields(fields: list[DataFrame]) -> DataFrame:
    """Aligned fields as columns of one table (join on shard, element and point)."""
    out = fields[0]
    for f in fields[1:]:
        out = out.join(f, ["iproc", "ispec", "igll"])
    return out


def write_field(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A field as Parquet by shard; refuses to overwrite unless asked."""
    df.repartition("iproc").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("iproc").parquet(path)
