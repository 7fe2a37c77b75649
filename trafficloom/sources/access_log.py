"""Access-log files as DataFrames of lines: one sub-folder per branch.

Layout: ``<root>/branch=<name>/<file>``. Files must be closed (rotated) before
they land there: a file stream reads each file once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficloom.fixed_values import DEFAULT_BRANCH
from trafficloom.functions.timeparts import ntz

LINE = T.StructType([T.StructField("value", T.StringType()), T.StructField("branch", T.StringType())])


def _line_columns(modified_since: dt.datetime | None, lines: DataFrame) -> DataFrame:
    if modified_since is not None:
        lines = lines.where(F.col("_metadata.file_modification_time").cast("timestamp_ntz") >= ntz(modified_since))
    branch: Column = F.col("branch") if "branch" in lines.columns else F.lit(None).cast("string")
    return lines.select(
        "value",
        F.coalesce(branch, F.lit(DEFAULT_BRANCH)).alias("branch"),
        F.col("_metadata.file_path").alias("source_file"),
    )


def read_lines(spark: SparkSession, root: str, modified_since: dt.datetime | None = None) -> DataFrame:
    """All lines under ``root``. Only a line feed ends a record; a bare CR is data."""
    lines = spark.read.schema(LINE).option("lineSep", "\n").text(root)
    return _line_columns(modified_since, lines)


def stream_lines(
    spark: SparkSession,
    root: str,
    modified_since: dt.datetime | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The same lines as a stream; the query's checkpoint is the resume position.

    ``modified_since`` is the first-run policy: history older than it is skipped.
    """
    reader = spark.readStream.schema(LINE).option("lineSep", "\n")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _line_columns(modified_since, reader.text(root))


def read_branch_files(spark: SparkSession, paths_by_branch: dict[str, str]) -> DataFrame:
    """Fan-in of one path per branch when the files are not in ``branch=`` folders."""
    parts = [
        _line_columns(None, spark.read.option("lineSep", "\n").text(path)).withColumn("branch", F.lit(branch))
        for branch, path in paths_by_branch.items()
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged
