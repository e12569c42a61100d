"""File sources and sinks: Spark's own readers, so filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "csv", "json", "orc", "text", "jdbc")


def read(spark: SparkSession, path: str, format: str = "parquet", schema=None, **options) -> DataFrame:
    if format not in FORMATS:
        raise ValueError(f"Unknown format: {format}")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] = (), **options) -> None:
    if format not in FORMATS:
        raise ValueError(f"Unknown format: {format}")
    df.write.format(format).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
