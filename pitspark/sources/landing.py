"""Arrival order and non-empty checks for landed files."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class EmptySourceError(RuntimeError):
    """A source that must hold rows holds none."""


def landing_order() -> Column:
    """Total order of the rows of a file scan: file, split, row within the split.

    A split is read by one task from its first to its last row, so the row id
    is only ever compared between rows of one split. Nothing is shuffled and a
    re-run task yields the same order.
    """
    return F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df`` itself, or an error if it has no row; reads at most one row."""
    if df.isEmpty():
        raise EmptySourceError(f"{what} returned no rows")
    return df


def exact_path(metadata_path: str) -> str:
    """A path that reads the one file ``_metadata.file_path`` names: decoded, and no pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(metadata_path))


def read_csv_by_header(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as text with ``arrival``; every file is read under its own header.

    Files are grouped by their first line, so a column stands under its name in all
    of them whatever its place, and is NULL where a file lacks it. The list of files
    is what Spark itself holds to plan the scan.
    """
    heads = (
        spark.read.text(path).where("_metadata.file_block_start = 0")
        .select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
        .groupBy("file").agg(F.min_by("value", "at").alias("header"))
        .groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    )
    frames = []
    for head in heads:
        raw = spark.read.option("header", True).option("enforceSchema", False).csv([exact_path(f) for f in head.files])
        frames.append(raw.withColumn("arrival", landing_order()))
    if not frames:
        return spark.read.option("header", True).csv(path).withColumn("arrival", landing_order())
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
