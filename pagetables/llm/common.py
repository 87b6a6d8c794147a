"""Small helpers that the training-data operators share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.config import work_folder

#: White space of the word rules: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(frame: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, in these types; all other columns are left behind."""
    return frame.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()))


def settled(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read again: computed once, lineage cut."""
    spark, path = frame.sparkSession, work_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def parts_for(frame: DataFrame, text: str, bytes_each: int) -> int:
    """How many parts of about ``bytes_each`` bytes the whole column makes; an odd number."""
    total = frame.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / bytes_each)) | 1


def part_of(column: str, parts: int) -> Column:
    return F.coalesce(F.pmod(F.col(column), F.lit(parts)), F.lit(0)).cast("int")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def planes(values: np.ndarray, width: int) -> bytes:
    """Integers as byte planes, lowest byte first: equal high bytes lie together."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return wide[:, :width].T.tobytes()


def from_planes(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return wide.reshape(-1).view("<u8")


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    n = len(sorted_values)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [n]))
