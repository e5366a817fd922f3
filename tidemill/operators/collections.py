"""Operators of keyed and ordered collections, on DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def cogroup(left: DataFrame, right: DataFrame, key: str, *more: DataFrame) -> DataFrame:
    """key and one array of rows for each input; keys of any input. Each input is grouped on its own before the join."""
    grouped = [d.groupBy(key).agg(F.collect_list(F.struct(*[c for c in d.columns if c != key])).alias(f"rows{i}")) for i, d in enumerate((left, right, *more))]
    out = reduce(lambda a, b: a.join(b, key, "full_outer"), grouped)
    return out.select(key, *[F.coalesce(f"rows{i}", F.array().cast(out.schema[f"rows{i}"].dataType)).alias(f"rows{i}") for i in range(len(grouped))])


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a without equal ones in b; repeated rows of a stay."""
    same = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in a.columns])
    return a.join(b, same, "left_anti")


def subtract_by_key(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Planned as one take-ordered step: k rows from each partition."""
    return df.orderBy(*order).limit(k)


def zip_with_index(df: DataFrame, *order: Column) -> DataFrame:
    """df with index 0.. in the given order, without a single-partition window.

    The rows are sorted and written once with their partition and place; the partitions' offsets are counted from that
    table, so that a sort planned twice, with other range bounds, can't number rows differently.
    """
    placed = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = placed.join(F.broadcast(offsets), "__part")  # a row for each partition
    return out.withColumn("index", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__n", "__first", "__before")


def zipped(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows of both side by side, the i-th with the i-th in the given orders; both must have as many rows, else it raises."""
    a, b = written(zip_with_index(left, *left_order)), written(zip_with_index(right, *right_order))
    if a.count() != b.count():
        raise ValueError("zipped tables must have the same number of rows")
    return a.join(b, "index")


def zip_with_unique_id(df: DataFrame) -> DataFrame:
    return df.withColumn("uid", F.monotonically_increasing_id())


def sliding(df: DataFrame, by: list[str], order: str, value: str, n: int) -> DataFrame:
    """Every run of n consecutive values, within each group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, n - 1)
    return df.withColumn("run", F.collect_list(value).over(w)).where(F.size("run") == n)


def stats(df: DataFrame, *columns: str) -> DataFrame:
    """column, count, mean, variance, stdev, sample variance and deviation, min, max; one pass."""
    rows = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.stddev_pop(c).alias("stdev"), F.var_samp(c).alias("sample_variance"), F.stddev_samp(c).alias("sample_stdev"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """bucket, n: counts in [edge, next edge), the last bucket closed; values outside are left out, empty buckets have 0."""
    c = F.col(column)
    bucket = reduce(lambda e, i: F.when(c < edges[i + 1], i).otherwise(e), range(len(edges) - 2, -1, -1), F.when(c == edges[-1], len(edges) - 2))
    counted = df.where(c.between(edges[0], edges[-1])).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counted, "bucket", "left").na.fill(0, ["n"])


def even_histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    low, high = df.agg(F.min(column), F.max(column)).first()
    return histogram(df, column, [low + (high - low) * i / buckets for i in range(buckets)] + [high])


def approx_distinct(df: DataFrame, column: str, by: list[str] | None = None, error: float = 0.05) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.approx_count_distinct(column, error).alias("n"))


def approx_sum(df: DataFrame, column: str, fraction: float, seed: int = 42, z: float = 1.96) -> DataFrame:
    """Estimate of a sum from a sample, with a confidence interval."""
    s = df.sample(fraction, seed).agg(F.sum(column).alias("s"), F.count(column).alias("n"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("d"), F.avg(column).alias("m"))
    half = z * F.sqrt(F.col("n") * (F.col("d") ** 2 + (1 - fraction) * F.col("m") ** 2)) / fraction
    return s.select((F.col("s") / fraction).alias("estimate"), (F.col("s") / fraction - half).alias("low"), (F.col("s") / fraction + half).alias("high"))


def approx_mean(df: DataFrame, column: str, fraction: float, by: list[str] | None = None, seed: int = 42, z: float = 1.96) -> DataFrame:
    """by, estimate, low, high of a mean, from a sample."""
    s = df.sample(fraction=fraction, seed=seed).groupBy(*(by or [])).agg(F.avg(column).alias("estimate"), (z * F.coalesce(F.stddev_samp(column), F.lit(0.0)) / F.sqrt(F.count(column))).alias("__h"))
    return s.select(*(by or []), "estimate", (F.col("estimate") - F.col("__h")).alias("low"), (F.col("estimate") + F.col("__h")).alias("high"))


def approx_counts(df: DataFrame, columns: list[str], fraction: float, seed: int = 42, z: float = 1.96) -> DataFrame:
    """columns, estimate, low, high: how often each value stands, from a sample; values that the sample lacks have no row."""
    n = df.sample(fraction=fraction, seed=seed).groupBy(*columns).agg(F.count("*").alias("__n"))
    half = z * F.sqrt(F.col("__n") * (1 - fraction)) / fraction
    e = F.col("__n") / fraction
    return n.select(*columns, e.alias("estimate"), F.greatest(F.lit(0.0), e - half).alias("low"), (e + half).alias("high"))


def flat_map(df: DataFrame, fn: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Any number of rows for each row, by a Python function of it; what a higher-order function or explode can't express."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            rows = [x for r in b.to_pylist() for x in fn(r)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return df.mapInArrow(run, schema)


def key_by(df: DataFrame, key: Column) -> DataFrame:
    """key, value: each row, as a struct, under a computed key."""
    return df.select(key.alias("key"), F.struct(*df.columns).alias("value"))


def map_values(df: DataFrame, change: Callable[[Column], Column], value: str = "value") -> DataFrame:
    return df.withColumn(value, change(F.col(value)))


def flat_map_values(df: DataFrame, change: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """change gives an array; a row for each of its elements."""
    return df.withColumn(value, F.explode(change(F.col(value))))


def collect_some(df: DataFrame, wanted: Column, value: Column) -> list:
    """value of the rows for which wanted holds, for the caller."""
    return [r[0] for r in df.where(wanted).select(value).collect()]


def in_order(df: DataFrame, *order: Column):
    """The rows one by one for the caller, who holds one partition at a time."""
    yield from df.orderBy(*order).toLocalIterator()


def reduce_by_key(df: DataFrame, key: str, value: str, merge: Callable, zero=None) -> DataFrame:
    """key, value: an associative, commutative Python function over each key's values, for what Spark has no aggregate.

    Folded on the map side first (a million keys at a time), then each key's partial results, in order of key, one at a
    time: neither side holds a key's values. zero, if given, is merged into each key's result once. Nulls are skipped; a
    key with nulls alone gives zero. An empty table gives an empty result.
    """
    names = [key, value]

    def partial(batches):
        held: dict = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                old = held.get(k)
                held[k] = v if old is None else old if v is None else merge(old, v)
            if len(held) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), b.schema.types[0]), pa.array(held.values(), b.schema.types[1])], names)
                held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), b.schema.types[0]), pa.array(held.values(), b.schema.types[1])], names)

    def final(batches):
        last, so_far, started = None, None, False
        for b in batches:
            keys, out = [], []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if started and k != last:
                    keys.append(last)
                    out.append(so_far)
                    so_far = zero
                elif not started:
                    so_far, started = zero, True
                last = k
                so_far = v if so_far is None else so_far if v is None else merge(so_far, v)
            types = b.schema.types
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, types[0]), pa.array(out, types[1])], names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([last], types[0]), pa.array([so_far], types[1])], names)

    two = df.select(key, value)
    return two.mapInArrow(partial, two.schema).repartition(key).sortWithinPartitions(key).mapInArrow(final, two.schema)


def combine_by_key(df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """Any number of Spark aggregates by key in one pass, partial sums first."""
    return df.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])


def count_by_value(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def lookup(df: DataFrame, key: str, wanted, value: str) -> list:
    """The values under one key: a pushed-down filter, then those rows alone come to the caller."""
    return [r[0] for r in df.where(F.col(key).eqNullSafe(F.lit(wanted))).select(value).collect()]


def collect_as_map(df: DataFrame, key: str, value: str, most: int = 1_000_000) -> dict:
    """A dictionary for the caller; of repeated keys the largest value stays. Raises beyond `most` keys."""
    rows = df.groupBy(key).agg(F.max(value).alias("v")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} keys")
    return {r[0]: r[1] for r in rows}


def take_sample(df: DataFrame, n: int, seed: int = 42, replace: bool = False) -> list:
    """n random rows for the caller (all, if there are fewer and rows are not replaced)."""
    total = df.count()
    if not total or n <= 0:
        return []
    share = min(1.0, (n + 6 * n**0.5 + 10) / total) if not replace else (n + 6 * n**0.5 + 10) / total
    rows = df.sample(withReplacement=replace, fraction=share, seed=seed).orderBy(F.rand(seed)).limit(n).collect()
    return rows


def random_split(df: DataFrame, weights: list[float], seed: int = 42) -> list[DataFrame]:
    """Disjoint parts that make up df, by a hash of the whole row: the same rows fall in the same part on every run. Equal rows stay together."""
    bounds, total = [0.0], sum(weights)
    for w in weights:
        bounds.append(bounds[-1] + w / total)
    place = (F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("p")
    return [df.where((place >= lo) & (place < hi if i < len(weights) - 1 else F.lit(True))) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False))]


def unique_join(tables: list[tuple[DataFrame, str, bool]]) -> DataFrame:
    """Rows of several tables by one key in a single pass: (table, key, preserved). A key of a preserved table that another lacks gives nulls there; the key must stand in all tables that aren't preserved."""
    out = None
    for i, (df, key, _) in enumerate(tables):
        t = df.withColumnRenamed(key, "key").withColumn(f"__in{i}", F.lit(True))
        out = t if out is None else out.join(t, "key", "full_outer")
    needed = [F.col(f"__in{i}").isNotNull() for i, (_, _, preserved) in enumerate(tables) if not preserved]
    kept = [F.col(f"__in{i}").isNotNull() for i, (_, _, preserved) in enumerate(tables) if preserved]
    some = reduce(lambda a, b: a | b, kept) if kept else F.lit(True)
    return out.where(reduce(lambda a, b: a & b, needed, some)).drop(*[f"__in{i}" for i in range(len(tables))])


def map_partitions(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn(partition number, iterator of Arrow batches) -> Arrow batches."""

    def run(batches):
        from pyspark import TaskContext

        yield from fn(TaskContext.get().partitionId(), batches)

    return df.mapInArrow(run, schema)


def zip_partitions(left: DataFrame, right: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn of the i-th partitions of both, as Arrow tables, for each i; both need as many partitions. A pair of partitions meets in memory."""
    if left.rdd.getNumPartitions() != right.rdd.getNumPartitions():
        raise ValueError("both tables must have the same number of partitions")
    l, r = (d.withColumn("__part", F.spark_partition_id()) for d in (left, right))  # noqa: E741
    return l.groupBy("__part").cogroup(r.groupBy("__part")).applyInArrow(lambda a, b: fn(a.drop_columns(["__part"]), b.drop_columns(["__part"])), schema)


def pruned(df: DataFrame, parts: list[int]) -> DataFrame:
    """Only the rows of the numbered partitions."""
    return df.where(F.spark_partition_id().isin(parts))


def group_by(df: DataFrame, key: Column, *aggregates: Column) -> DataFrame:
    """Groups under a computed key, reduced by aggregates; without any, the group's rows as an array."""
    return df.groupBy(key.alias("key")).agg(*(aggregates or [F.collect_list(F.struct(*df.columns)).alias("rows")]))


def background(action: Callable, *args):
    """An action (count, collect, take, foreach) on a thread of its own; result() waits, and jobs run under the caller's session."""
    from concurrent.futures import ThreadPoolExecutor

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(action, *args)
    finally:
        pool.shutdown(wait=False)


def count_within(df: DataFrame, seconds: float, fraction: float = 0.05, seed: int = 42) -> tuple[float, float, float]:
    """(estimate, low, high) of the row count: exact if the count ends in time, else from a sample."""
    from concurrent.futures import TimeoutError

    sc, group = df.sparkSession.sparkContext, f"count-{id(df)}"

    def work():
        sc.setJobGroup(group, "count", True)
        return df.count()

    try:
        n = float(background(work).result(timeout=seconds))
        return n, n, n
    except TimeoutError:
        sc.cancelJobGroup(group)
        seen = df.sample(fraction=fraction, seed=seed).count()
        half = 1.96 * (seen * (1 - fraction)) ** 0.5 / fraction
        return seen / fraction, max(0.0, seen / fraction - half), seen / fraction + half


def partition_arrays(df: DataFrame, column: str) -> DataFrame:
    """One array of values for each partition; each partition's rows stay where they are."""
    kind = df.schema[column].dataType.simpleString()

    def run(part, batches):
        arrays = [b.column(0) for b in batches]
        if any(len(a) for a in arrays):
            items = pa.concat_arrays(arrays)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)], ["part", "items"])

    return map_partitions(df.select(column), run, f"part int, items array<{kind}>")


def bucket_sample(df: DataFrame, bucket: int, of: int, *columns: str) -> DataFrame:
    """Bucket number `bucket` (from 1) of `of`: by the value of one integer column, as bucketed tables are dealt out, else by hash."""
    one = len(columns) == 1 and df.schema[columns[0]].dataType.typeName() in ("byte", "short", "integer", "long")
    return df.where(F.pmod(F.col(columns[0]) if one else F.xxhash64(*columns), F.lit(of)) == bucket - 1)


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int = 16, share: float = 0.001) -> DataFrame:
    """An inner join whose hot keys are spread over `salts` tasks.

    Keys with `share` of big's rows or more (1/share at most) are hot: their rows get a salt by a hash of the row, which a
    retried task repeats, and small has its rows of those keys once for each salt. Other keys join as they are.
    """
    hot = written(big.stat.freqItems([key], share).select(F.explode(F.col(f"{key}_freqItems")).alias(key)))
    salted = F.broadcast(hot.withColumn("__hot", F.lit(True)))  # 1/share keys at most
    left = big.join(salted, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    each = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(salted, key, "left").withColumn("__salt", F.explode(each)).drop("__hot")
    return left.join(right, [key, "__salt"]).drop("__salt")


def runs(df: DataFrame, order: Column, value: str, n: int) -> DataFrame:
    """index, run: every n consecutive values of the whole table in the given order, without a single task for all.

    Rows get their index and are grouped in blocks of 4096; the first n - 1 rows of a block also go to the block before.
    """
    size = max(4096, n)
    placed = zip_with_index(df.select(value), order)
    block = F.floor(F.col("index") / size)
    copied = placed.withColumn("__block", F.explode(F.when((F.col("index") % size < n - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))))
    w = Window.partitionBy("__block").orderBy("index").rowsBetween(0, n - 1)
    out = copied.withColumn("run", F.collect_list(F.struct(F.col(value))).over(w)).where((F.size("run") == n) & (F.floor(F.col("index") / size) == F.col("__block")))
    return out.select("index", F.transform("run", lambda x: x[value]).alias("run"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, columns: list[str]) -> DataFrame:
    """left with the columns of right's latest row at or before it, by a union and a running last value: no range join."""
    tagged = left.select(*by, at, F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("__r"), F.lit(1).alias("__o"))
    other = right.select(*by, at, F.lit(None).cast(tagged.schema["__l"].dataType).alias("__l"), F.struct(*columns).alias("__r"), F.lit(0).alias("__o"))
    w = Window.partitionBy(*by).orderBy(at, "__o").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.union(other).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__o = 1").select("__l.*", *[F.col(f"__r.{c}").alias(f"asof_{c}") for c in columns])
