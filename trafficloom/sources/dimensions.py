"""Small tables the operators look things up in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficloom.fixed_values import (
    BLOCKLIST_FOLDERS,
    BLOCKLIST_PRIORITY,
    CATEGORIES,
    DEFAULT_NON_WORK_MINUTES,
)
from trafficloom.functions.text import strip


def load_hostnames(spark: SparkSession, path: str) -> DataFrame:
    """The curated host list of a deployment, of any size, from a ``hostname,category`` CSV.

    A host listed more than once has the category that is first by name.
    """
    rows = spark.read.schema("hostname string, category string").option("header", True).csv(path)
    cleaned = rows.select(F.lower(strip(F.col("hostname"))).alias("hostname"), strip(F.col("category")).alias("category"))
    return cleaned.where("hostname != ''").groupBy("hostname").agg(F.min("category").alias("category"))


def label_priority() -> list[tuple[str, int]]:
    return [(label, rank) for rank, label in enumerate(BLOCKLIST_PRIORITY)]


def load_blocklist(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<folder>/domains`` as (domain, label, priority), without repeats; each a file or a folder of files.

    Folders that are missing or not mapped to a label are left out.
    """
    ranks = dict(label_priority())
    folders = spark.createDataFrame(
        [(folder, label, ranks[label]) for folder, label in BLOCKLIST_FOLDERS],
        "folder string, label string, priority int",
    )
    lines = spark.read.option("lineSep", "\n").text(f"{root.rstrip('/')}/*/domains")
    named = lines.select(
        strip(F.col("value")).alias("domain"),
        F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/domains(/[^/]*)?$", 1).alias("folder"),
    ).where(F.col("domain") != "")
    return named.join(F.broadcast(folders), "folder").select("domain", "label", "priority").distinct()


def validate_overrides(
    rows: DataFrame, row_number: str = "row_number", max_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(applied, errors) of import rows (row_number, domain, category) and, from several files, (file).

    A row without a domain or with an unknown category is an error that names
    its row; the last valid row of a domain wins, by file and row. Rows of a
    file past ``max_rows``, where that is given, are errors too.
    """
    files = [F.col("file")] if "file" in rows.columns else []
    cleaned = rows.select(
        *files,
        F.col(row_number).alias("row_number"),
        F.lower(strip(F.coalesce("domain", F.lit("")))).alias("domain"),
        strip(F.coalesce("category", F.lit(""))).alias("category"),
    )
    known = F.when(F.col("domain") == "", "missing_domain").when(~F.col("category").isin(*CATEGORIES), "unknown_category")
    reason = known if max_rows is None else F.when(F.col("row_number") > max_rows, "row_limit").otherwise(known)
    checked = cleaned.withColumn("reason", reason)
    applied = (
        checked.where(F.col("reason").isNull())
        .groupBy("domain")
        .agg(F.max_by("category", F.struct(*files, "row_number")).alias("category"))
    )
    errors = checked.where(F.col("reason").isNotNull()).select(
        *files, "row_number", F.nullif("domain", F.lit("")).alias("domain"), "category", "reason"
    )
    return applied, errors


def load_overrides(spark: SparkSession, path: str, max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Override CSVs with header, one file or a folder, read and validated.

    The rows of each file are numbered from 1 in file order, however the files
    were split for reading; files rank by path.
    """
    rows = spark.read.option("header", True).csv(path)
    missing = {"domain", "category"} - set(rows.columns)
    if missing:
        raise ValueError(f"override file lacks the columns {', '.join(sorted(missing))}")
    # Within a split ids grow in file order; the splits of a file are in the order of their first
    # byte. Each split is numbered by itself and begins where those before it end.
    placed = rows.select(
        "domain",
        "category",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__place"),
    )
    before = Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split.
    splits = placed.groupBy("file", "__start").agg(F.count(F.lit(1)).alias("n"))
    splits = splits.select("file", "__start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("file", "__start").orderBy("__place"))
    numbered = placed.withColumn("__row", place).join(F.broadcast(splits), ["file", "__start"])
    numbered = numbered.withColumn("row_number", F.col("__first") + F.col("__row"))
    return validate_overrides(numbered, max_rows=max_rows)


def merge_overrides(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported rows replace the current category of their domain."""
    kept = current.join(imported.select("domain"), "domain", "left_anti")
    return kept.select("domain", "category").unionByName(imported.select("domain", "category"))


def parse_sensitive(raw: str | Column) -> Column:
    """Comma text to an array of known categories; unknown names are dropped."""
    tokens = F.transform(F.split(raw, ","), lambda t: strip(t))
    known = F.array(*[F.lit(c) for c in CATEGORIES])
    return F.coalesce(F.array_intersect(tokens, known), F.array().cast("array<string>"))


def thresholds(branches: DataFrame, settings: DataFrame) -> DataFrame:
    """Alert settings of every branch, defaults where a branch has none."""
    return branches.select("branch").join(settings, "branch", "left").select(
        "branch",
        F.coalesce("sensitive_categories", F.array().cast("array<string>")).alias("sensitive_categories"),
        F.coalesce("non_work_minutes", F.lit(DEFAULT_NON_WORK_MINUTES)).alias("non_work_minutes"),
        "byte_quota",
        "uncategorized_threshold",
    )
