"""Reading the given tables and writing intermediate ones to the shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import trafficloom

from trafficloom.session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
# Batches go to Python by bytes, as 10,000 rows of text are tens of megabytes in the JVM and again in
# Python. Parquet is read by 512 rows: a column of 4,096 texts is one array of 16 MB or more, which
# doubles as it fills and is left on the heap by every task that reads texts.
BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}
# While a frame is worked out, shuffle files also go with the job that made them.
WRITING = {**BATCHES, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and afterwards as it was."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: it is computed once,
    and a lost executor costs no more than reading its part again."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    with settings(spark, WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that do not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_trafficloom_shipped", False):
        return
    root = Path(trafficloom.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="trafficloom-package-")) / "trafficloom.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for file in sorted([*root.rglob("*.py"), *root.rglob("*.csv")]):
            target.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._trafficloom_shipped = True
