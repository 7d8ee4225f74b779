"""CSV and Parquet. Reads are lazy: nothing is counted or cached here, so that filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, num_partitions: int | None = None) -> DataFrame:
    """With a header; unparsable values become NULL; without ``schema`` types are inferred."""
    df = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None or None)
    return df.repartition(num_partitions) if num_partitions else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None, coalesce: int | None = None) -> None:
    """One folder for each table, overwritten."""
    for name, df in tables.items():
        writer = (df.coalesce(coalesce) if coalesce else df).write.mode("overwrite")
        keys = (partition_by or {}).get(name)
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{path.rstrip('/')}/{name}")
