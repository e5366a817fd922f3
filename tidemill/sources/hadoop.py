"""Key-value files of the Hadoop formats, as DataFrames. Only these formats need an RDD to read or write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sequence_file(spark: SparkSession, path: str, schema: str = "key string, value string") -> DataFrame:
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)


def save_sequence_file(df: DataFrame, path: str, key: str, value: str, codec: str | None = None) -> None:
    df.select(key, value).rdd.map(tuple).saveAsSequenceFile(path, codec)


def object_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that save_object_file wrote. Python's pickles: read only files of one's own."""
    return spark.createDataFrame(spark.sparkContext.pickleFile(path), schema)


def save_object_file(df: DataFrame, path: str) -> None:
    df.rdd.map(tuple).saveAsPickleFile(path)


def hadoop_file(spark: SparkSession, path: str, input_format: str, key: str, value: str, schema: str, new: bool = True, options: dict[str, str] | None = None) -> DataFrame:
    """Any input format on the class path, of the new API or the old one."""
    sc = spark.sparkContext
    read = sc.newAPIHadoopFile if new else sc.hadoopFile
    return spark.createDataFrame(read(path, input_format, key, value, conf=options), schema)


def save_hadoop_file(df: DataFrame, path: str, output_format: str, key: str, value: str, new: bool = True, options: dict[str, str] | None = None) -> None:
    """df: two columns, key and value; key and value name the Writable classes."""
    rows = df.rdd.map(tuple)
    (rows.saveAsNewAPIHadoopFile if new else rows.saveAsHadoopFile)(path, output_format, key, value, conf=options)


def lines(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """value: the lines of text files."""
    df = spark.read.text(path)
    return df.repartition(parts) if parts else df


def avro_or_orc(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Avro needs Spark's Avro package on the class path."""
    return spark.read.format(kind).load(path)


def regex_rows(df: DataFrame, pattern: str, names: list[str], types: list[str] | None = None) -> DataFrame:
    """Lines (value) by the groups of a pattern, cast to types; lines that don't match give nulls."""
    hit = F.col("value").rlike(f"^(?:{pattern})$")
    kinds = types or ["string"] * len(names)
    return df.select(*[F.when(hit, F.regexp_extract("value", pattern, i + 1)).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])
