"""Folder operations through the Hadoop file system of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _resolve(spark, path)
    return fs.exists(hadoop_path)


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _resolve(spark, path)
    fs.delete(hadoop_path, True)


def glob(spark: SparkSession, pattern: str) -> bool:
    """Whether any folder matches."""
    fs, hadoop_path = _resolve(spark, pattern)
    return bool(fs.globStatus(hadoop_path))


def partitions(spark: SparkSession, table: str, *columns: str) -> list[dict[str, str]]:
    """Partition values of the folders under a table, with their ``path``. Reads no data."""
    fs, pattern = _resolve(spark, "/".join([table, *[f"{c}=*" for c in columns]]))
    found = []
    for status in fs.globStatus(pattern) or []:
        path = status.getPath().toString()
        values = dict(part.split("=", 1) for part in path.split("/")[-len(columns) :])
        found.append({**values, "path": path})
    return found


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, or no rows while nothing has been written."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def overwrite_partitions(df: DataFrame, path: str, *columns: str, **options: str) -> None:
    """Replace exactly the partitions ``df`` has rows for: writing the same rows again changes nothing."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options)
    writer.partitionBy(*columns).parquet(path)
