"""Intermediate tables in the folder that driver and executors share, and scoped session options."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: For loops over tables of the input's size: broadcast joins would collect one after the other on the driver.
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local master may do without one: it gets a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local") and "cluster" not in master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemill/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and losing an executor loses nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemill_path = path  # type: ignore[attr-defined]
    return out


def partitions(df: DataFrame, each: int = 16 << 20) -> dict[str, str]:
    """Options for shuffles of a plan whose tables have so many bytes: a task's share must not grow with the input, nor be put together beyond it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(s for s in sizes if s < 1 << 60)  # more stands for unknown
    name = "spark.sql.shuffle.partitions"
    return {name: str(max(int(df.sparkSession.conf.get(name)), min(-(-size // each), 20_000))), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(each)}


def dropped(*tables: DataFrame | None) -> None:
    """Delete written() tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_tidemill_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def settings(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    """Session options for the jobs that are planned and run inside; the session has its own back afterwards."""
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
