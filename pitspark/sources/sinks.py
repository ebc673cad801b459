"""Result files: CSV and JSON exports, replacement of one source's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return path


def write_ordered_csv(df: DataFrame, path: str, keys: list[str]) -> str:
    """CSV in a total order: rows ascend by ``keys`` (null first) within and across part files.

    Rows are dealt by range and sorted where they are written; the number in a part file's name follows
    the ranges, so reading the files by name gives the order.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    return write_csv(df.repartitionByRange(*order).sortWithinPartitions(*order), path)


def order_breaks(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """(breaks): how many neighbouring rows of an exported CSV folder are out of order, across its part files.

    Each split of a file is compared row by row, then the last row of a split with the first of the
    next; only two rows of a split leave the task that read it.
    """
    key = F.struct(*[F.struct(F.col(k).isNotNull().alias("present"), F.col(k).alias("value")).alias(k) for k in keys])
    rows = spark.read.option("header", True).option("emptyValue", "").schema(schema).csv(path).select(
        key.alias("key"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    inside = Window.partitionBy("file", "block").orderBy("at")
    split = rows.withColumn("late", (F.lag("key").over(inside) > F.col("key")).cast("long")).groupBy("file", "block").agg(
        F.coalesce(F.sum("late"), F.lit(0)).alias("late"), F.min_by("key", "at").alias("head"), F.max_by("key", "at").alias("tail"))
    # a row per split of the export
    between = Window.partitionBy(F.lit(0)).orderBy("file", "block")
    crossing = F.lag("tail").over(between) > F.col("head")
    return split.withColumn("crossing", crossing.cast("long")).agg(
        (F.coalesce(F.sum("late"), F.lit(0)) + F.coalesce(F.sum("crossing"), F.lit(0))).alias("breaks"))


def overwrite_sources(df: DataFrame, path: str, key: str = "source_id") -> str:
    """Replace the partitions of the sources in ``df`` and leave all others alone.

    Rows are written by the tasks that hold them; a source with a large share
    of the rows is not gathered first.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )
    return path
