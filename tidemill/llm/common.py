"""Shared plumbing: written intermediate tables and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, written  # noqa: F401  used throughout the subpackage


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker.

    Operators return plans that run later, in the caller's session, so these two options stay set there. They change
    how many rows travel at a time, never a result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and each row's offsets in them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes (one longer text is a run of its own): first row, end row, bytes, offsets."""
    data, at = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def binaries(blobs: list[bytes | None]) -> pa.Array:
    return pa.array(blobs, pa.binary())


BITS = 1 << 25  # of a bitmap that goes to all tasks: 4 MB


def without(docs: DataFrame, gone: DataFrame, key: Column, gone_key: Column, matched: Column, most: int = BITS) -> DataFrame:
    """docs less the rows that match a row of `gone`, a written table, without moving the rows that can't.

    A bitmap of the hashed keys of `gone` (16 bits a row, `most` at the most, so that its size is fixed) goes to all tasks. A row
    whose key's bit isn't set stays where it is; only the others meet `gone` in an anti-join. Beyond some millions of rows in
    `gone` the bitmap fills and more rows move, up to all of them, with the same result. docs is read twice.
    """
    n = gone.count()
    if not n:
        return docs
    bits = min(most, 1 << (16 * n + 1024).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    set_ = gone.select(place(gone_key).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b"))
    each = docs.sparkSession.range(bits >> 6).join(set_, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    words = each.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("words"))
    bit = F.getbit(F.get(written(words).scalar(), F.shiftright(place(key), 6).cast("int")), place(key).bitwiseAND(63).cast("int"))
    return docs.where(bit == 0).unionByName(docs.where(bit == 1).join(gone, matched, "left_anti"))


def trimmed(run):
    """An Arrow function whose worker, which Spark keeps for later tasks, gives its free memory back when a task ends."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner
