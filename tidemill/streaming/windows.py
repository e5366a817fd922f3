"""Windows over batches, (end - length, end], at every slide; and keyed state carried from batch to batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_windows(df: DataFrame, batch: str, length: int, slide: int, last: int) -> DataFrame:
    """df with window_end: a row of batch b is in every window that ends at a multiple of slide in [b, b + length), up to last.

    Ends count batches from 1: a batch index b starting at 0 closes at b + 1. Slides may exceed the length.
    """
    first = F.ceil((F.col(batch) + 1) / slide).cast("long") * slide
    ends = F.filter(F.sequence(first, F.greatest(first, F.least(F.col(batch) + length, F.lit(last))), F.lit(slide)), lambda e: (e <= F.col(batch) + length) & (e <= last) & (e > F.col(batch)))
    return df.withColumn("window_end", F.explode(ends))


def windowed(df: DataFrame, batch: str, keys: list[str], aggregates: list[Column], length: int, slide: int, last: int) -> DataFrame:
    """Aggregates of each key in each window. One shuffle of per-batch partial results would do for sums; Spark combines map-side."""
    return in_windows(df, batch, length, slide, last).groupBy("window_end", *keys).agg(*aggregates)


def windowed_sum(df: DataFrame, batch: str, key: str, value: str, length: int, slide: int, last: int, drop_zero: bool = False) -> DataFrame:
    """Sums by key as an invertible window keeps them: a key once seen stays, with 0, unless drop_zero."""
    df = df.groupBy(batch, key).agg(F.sum(value).alias(value))  # a row for each batch and key before windows copy rows
    sums = windowed(df, batch, [key], [F.sum(value).alias("total")], length, slide, last)
    if drop_zero:
        return sums.where("total <> 0")
    seen = df.groupBy(key).agg(F.min(batch).alias("__first"))
    ends = seen.withColumn("window_end", F.explode(F.sequence((F.ceil((F.col("__first") + 1) / slide) * slide).cast("long"), F.lit((last // slide) * slide).cast("long"), F.lit(slide).cast("long"))))
    return ends.select("window_end", key).join(sums, ["window_end", key], "left").na.fill(0, ["total"])


def update_state(state: DataFrame | None, batch: DataFrame, key: str, value: Column, empty: Column, update) -> DataFrame:
    """key, state after one more batch. update(old state or null, batch aggregate or null) runs for every known key; null removes it."""
    new = batch.groupBy(key).agg(value.alias("__new"))
    if state is None:
        return new.select(key, update(empty, F.col("__new")).alias("state")).where("state is not null")
    both = state.join(new, key, "full_outer")
    return both.select(key, update(F.col("state"), F.col("__new")).alias("state")).where("state is not null")


def running_state(batches: list[DataFrame], key: str, value: Column, empty: Column, update) -> DataFrame:
    return reduce(lambda s, b: update_state(s, b, key, value, empty, update), batches, None)
