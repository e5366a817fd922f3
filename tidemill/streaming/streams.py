"""Streams as micro-batches: the same text or DataFrame code that runs on a table runs on every batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import scratch


def union_tagged(streams: dict[str, DataFrame]) -> DataFrame:
    """Several streams as one, each row under its stream's name, so that one batch can hold rows of all."""
    out = None
    for name, df in streams.items():
        row = df.select(F.lit(name).alias("__stream"), *[F.struct("*").alias(n) if n == name else F.lit(None).cast(streams[n].schema).alias(n) for n in streams])
        out = row if out is None else out.union(row)
    return out


class StreamQuery:
    """A SQL text (or a function of the batches' DataFrames) over one or more streams and any number of tables."""

    def __init__(self, spark: SparkSession, streams: dict[str, DataFrame], work: str | Callable[..., DataFrame], derived: list[tuple[str, str]] | None = None):
        self.spark, self.streams, self.work, self.derived = spark, streams, work, derived or []

    def _result(self, batch: DataFrame) -> DataFrame:
        parts = {next(iter(self.streams)): batch} if len(self.streams) == 1 else {n: batch.where(F.col("__stream") == n).select(f"{n}.*") for n in self.streams}
        out = self._over(batch, parts)
        # A join without a key takes its tasks from its inputs, and a batch can be one file: its rows are dealt over all cores first.
        if any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "CartesianProduct")):
            out = self._over(batch, {n: df.repartition(batch.sparkSession.sparkContext.defaultParallelism) for n, df in parts.items()})
        return out

    def _over(self, batch: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
        if callable(self.work):
            return self.work(**parts)
        for name, df in parts.items():
            df.createOrReplaceTempView(name)
        for name, text in self.derived:
            batch.sparkSession.sql(text).createOrReplaceTempView(name)
        return batch.sparkSession.sql(self.work)

    def start(self, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, trigger: dict | None = None):
        """Calls sink(result, batch id) for every batch; a checkpoint folder makes a restart go on where it stopped."""
        source = next(iter(self.streams.values())) if len(self.streams) == 1 else union_tagged(self.streams)
        return (
            source.writeStream.foreachBatch(lambda df, n: sink(self._result(df), n))
            .option("checkpointLocation", checkpoint or scratch(self.spark))
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def table(self, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
        """Runs over all that is there now; the results of the batches as one table with batch_id."""
        path = path or scratch(self.spark)
        # a batch that runs again after a failure replaces its own folder
        sink = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch_id={n}")
        self.start(sink, checkpoint).awaitTermination()
        return self.spark.read.option("basePath", path).parquet(path)


def incremental(df: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """A streaming DataFrame with watermarks or cross-batch aggregates, run over all that is there now.

    append: the rows as they became final. complete or update: the newest row set of the last batch, or of each batch with
    its batch_id. Results go to the shared folder batch by batch; a batch that runs again replaces its own.
    """
    path = path or scratch(df.sparkSession)
    last: list[int] = []

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={n}")
        last.append(n)

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}_checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("batch_id", LongType())])).option("basePath", path).parquet(path)
    if mode == "complete":
        return out.where(F.col("batch_id") == (last[-1] if last else -1)).drop("batch_id")
    return out.drop("batch_id") if mode == "append" else out
