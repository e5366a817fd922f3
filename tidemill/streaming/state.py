"""State across micro-batches: values kept by key, and windows of batches that move over a live stream.

Every batch writes its state as a table of its own, numbered by the batch, from the table of the batch before. A batch that
runs again after a failure reads the same table and replaces its own, so that a restart on the same folder goes on exactly
where it stopped. Tables that no later batch needs are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch
from .streams import StreamQuery
from .windows import update_state


class _Tables:
    """Numbered Parquet tables in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, n: int):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={n}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, n: int) -> bool:
        p, fs = self._at(n)
        return n >= 0 and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))

    def put(self, n: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={n}")
        return self.get(n, df.schema)

    def get(self, n: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/batch={n}")

    def forget(self, n: int) -> None:
        p, fs = self._at(n)
        if n >= 0:
            fs.delete(p, True)


class KeyedState:
    """A value by key, updated by every batch: update(old state or null, batch aggregate or null) runs for each known key.

    A key that gets null goes. The update is a Column expression, so the state never leaves the JVM; keys without new rows
    are updated as well, as they are in every batch. Null keys are one key.
    """

    def __init__(self, stream: DataFrame, key: str, value: Column, update: Callable[[Column, Column], Column], empty: Column | None = None, start: DataFrame | None = None, path: str | None = None):
        self.spark, self.stream, self.key, self.value, self.update = stream.sparkSession, stream, key, value, update
        self.empty, self.start, self.path = F.lit(None) if empty is None else empty, start, path or scratch(stream.sparkSession)

    def run(self, sink: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None):
        """Starts the stream; sink(key and state of all keys, batch id) runs after each batch."""
        tables = _Tables(self.spark, f"{self.path}/state")

        def step(batch: DataFrame, n: int) -> None:
            before = tables.get(n - 1, self._schema) if tables.has(n - 1) else self.start
            state = update_state(before, batch, self.key, self.value, self.empty, self.update)
            self._schema = state.schema
            state = tables.put(n, state)
            if sink:
                sink(state, n)
            tables.forget(n - 2)

        self._schema = update_state(None, self.stream, self.key, self.value, self.empty, self.update).schema
        return StreamQuery(self.spark, {"rows": self.stream}, lambda rows: rows).start(step, f"{self.path}/checkpoint", trigger)

    def final(self) -> DataFrame:
        """Runs over all that is there now; key and state after the last batch."""
        last: list[tuple[int, DataFrame]] = []
        self.run(lambda state, n: last.append((n, state))).awaitTermination()
        if last:
            return last[-1][1]
        tables, n = _Tables(self.spark, f"{self.path}/state"), 0
        while tables.has(n + 1) or not tables.has(n):  # a restart with nothing new: the newest table
            n += 1
            if n > 1_000_000:
                raise ValueError("no state has been written")
        return tables.get(n, self._schema)


class Windows:
    """Aggregates by key over the last `length` batches, at every multiple of `slide` batches, on a live stream.

    Each batch is aggregated on its own first and only these partial tables are kept; a window merges at most `length` of
    them. partial and merge are Spark aggregates: merge runs over partial's columns (for a count: count, then sum).
    With inverse, the running totals of sums are carried along: the batch that enters is added and the one that leaves is
    taken away, so that a batch costs two partial tables however long the window is. A key once seen stays, with 0, unless
    drop_zero. Ends count batches from 1.
    """

    def __init__(self, stream: DataFrame, keys: list[str], partial: dict[str, Column], merge: dict[str, Column], length: int, slide: int, inverse: bool = False, drop_zero: bool = False, path: str | None = None):
        self.spark, self.stream, self.keys, self.partial, self.merge = stream.sparkSession, stream, keys, partial, merge
        self.length, self.slide, self.inverse, self.drop_zero = length, slide, inverse, drop_zero
        self.path = path or scratch(stream.sparkSession)

    def run(self, sink: Callable[[DataFrame, int], None], trigger: dict | None = None):
        """sink(window_end, keys, aggregates; batch id) runs at each end of a window."""
        parts, totals = _Tables(self.spark, f"{self.path}/parts"), _Tables(self.spark, f"{self.path}/totals")

        def step(batch: DataFrame, n: int) -> None:
            mine = parts.put(n, batch.groupBy(*self.keys).agg(*[c.alias(k) for k, c in self.partial.items()]))
            end = n + 1
            if self.inverse:
                merged = self._moved(parts, totals, mine, n)
            elif end % self.slide == 0:
                held = [parts.get(i, mine.schema) for i in range(max(0, end - self.length), end) if parts.has(i)]
                merged = held[0]
                for h in held[1:]:
                    merged = merged.union(h)
                merged = merged.groupBy(*self.keys).agg(*[c.alias(k) for k, c in self.merge.items()])
            if end % self.slide == 0:
                sink(merged.select(F.lit(end).cast("long").alias("window_end"), *self.keys, *self.merge), n)
            parts.forget(n - self.length - 1)
            totals.forget(n - 2)

        return StreamQuery(self.spark, {"rows": self.stream}, lambda rows: rows).start(step, f"{self.path}/checkpoint", trigger)

    def _moved(self, parts: _Tables, totals: _Tables, mine: DataFrame, n: int) -> DataFrame:
        signed = mine.select(*self.keys, *self.partial)
        if totals.has(n - 1):
            signed = signed.union(totals.get(n - 1, mine.schema).select(*self.keys, *self.partial))
        if parts.has(n - self.length):
            signed = signed.union(parts.get(n - self.length, mine.schema).select(*self.keys, *[(-F.col(k)).alias(k) for k in self.partial]))
        out = signed.groupBy(*self.keys).agg(*[F.sum(k).alias(k) for k in self.partial])
        if self.drop_zero:
            for k in self.partial:
                out = out.where(F.coalesce(F.col(k), F.lit(0)) != 0)
        for field in mine.schema.fields:
            out = out.withColumn(field.name, F.col(field.name).cast(field.dataType))
        return totals.put(n, out)

    def table(self) -> DataFrame:
        """Runs over all that is there now; every window's rows as one table."""
        out = scratch(self.spark)
        self.run(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch_id={n}")).awaitTermination()
        return self.spark.read.option("basePath", out).parquet(out).drop("batch_id")


def between(results: DataFrame, first: int, last: int) -> DataFrame:
    """The rows of a StreamQuery's result table from batch `first` to batch `last`, both included."""
    return results.where(F.col("batch_id").between(first, last))


def union(streams: list[DataFrame]) -> DataFrame:
    """Streams of one schema as one; columns go by name."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def on_progress(spark: SparkSession, heard: Callable[[dict], None]):
    """Calls heard with started, progress and terminated events of every stream; returns the listener, for removal."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            heard({"event": "started", "id": str(event.id)})

        def onQueryProgress(self, event):
            heard({"event": "progress", "id": str(event.progress.id), "batch": event.progress.batchId, "rows": event.progress.numInputRows})

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            heard({"event": "terminated", "id": str(event.id), "error": event.exception})

    listener = Listener()
    spark.streams.addListener(listener)
    return listener


def stop_gracefully(query, timeout: float | None = None) -> None:
    """Lets the batches of all that has arrived end, then stops."""
    query.processAllAvailable()
    query.stop()
    query.awaitTermination(timeout)
