"""Stream sources: files, sockets, rates, Kafka where its package is present, and a table replayed in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_batch: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def rate(spark: SparkSession, per_second: int) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def kafka(spark: SparkSession, servers: str, topics: str, **options) -> DataFrame:
    """Needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).options(**options).load()


def replayed(df: DataFrame, batch: str, path: str) -> DataFrame:
    """A table as a stream: one micro-batch for each value of the integer column `batch`, in ascending order.

    The table is read once and written as one file for each value (a micro-batch's rows, as they would have arrived); the
    files then get ascending times, by which a file stream orders them. Values written to `path` before come first. Rows without
    a number are in no batch.
    """
    spark = df.sparkSession
    made = f"{path}_made"
    df.withColumn("__batch", F.col(batch)).repartition("__batch").write.partitionBy("__batch").parquet(made)
    jvm = spark.sparkContext._jvm
    to, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(made)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(to)
    last = max([s.getModificationTime() for s in fs.listStatus(to)], default=0)
    start = max(last + 1000, jvm.java.lang.System.currentTimeMillis() - 10_000_000)
    folders = sorted((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in fs.listStatus(source) if s.isDirectory() and "=" in s.getPath().getName() and not s.getPath().getName().endswith("__"))
    for i, (b, folder) in enumerate(folders):  # one file each; the number of batches, not of rows
        for s in fs.listStatus(folder):
            if s.getPath().getName().startswith("part-"):
                target = jvm.org.apache.hadoop.fs.Path(to, f"{start + i}-{s.getPath().getName()}")
                fs.rename(s.getPath(), target)
                fs.setTimes(target, start + 1000 * i, -1)
    fs.delete(source, True)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
