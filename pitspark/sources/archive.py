"""Listing of an archive of CSV files: which files are there, how large, and whether they can be read.

An archive is a folder of files, or packed: a table (file, place, value) with a row per line. A folder costs an open for
each file and read, and its listing passes through the driver, so hundreds of thousands of small files are better packed.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .fundamentals import ARCHIVE_FIELDS
from .landing import read_csv_by_header

LISTING_PATTERN = r"(\d{6})\.csv$"


def listing_of(path: Column, pattern: str = LISTING_PATTERN) -> Column:
    """The listing code a file is named after, null if its name has none."""
    code = F.regexp_extract(path, pattern, 1)
    return F.when(code != "", code)


def _separators(line: Column) -> Column:
    """Commas of a CSV line outside of quotes."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))


def archive_files(spark: SparkSession, path: str, pattern: str = LISTING_PATTERN) -> DataFrame:
    """(file, listing, n_bytes, parsed): a row per file below the (globbed) path that has a byte.

    Sizes come from the file listing, contents are not loaded for them. A file is ``parsed`` if it has
    a header, is valid UTF-8 and no line has more fields than the header; lines with fewer fields are
    read with nulls. A file is reduced to three numbers where it is read, so its size does not matter.
    """
    sizes = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("n_bytes"))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"),
        place.alias("place"), _separators(F.col("value")).alias("n"), F.is_valid_utf8("value").alias("valid"),
    )
    read = lines.groupBy("file").agg(
        F.min_by("n", "place").alias("header"), F.max("n").alias("most"), F.bool_and("valid").alias("valid"))
    # the two readers spell a local scheme differently
    key = F.regexp_replace("file", "^file:/+", "file:/")
    met = sizes.withColumn("key", key).join(read.withColumn("key", key).drop("file"), "key", "left")
    parsed = F.coalesce(F.col("valid") & (F.col("most") <= F.col("header")), F.lit(False))
    return met.select("file", listing_of(F.col("file"), pattern).alias("listing"), "n_bytes", parsed.alias("parsed"))


def archive_records(spark: SparkSession, path: str, pattern: str = LISTING_PATTERN) -> DataFrame:
    """(listing, the archive's fields, arrival) of all rows; each file is read under its own header."""
    raw = read_csv_by_header(spark, path)
    fields = [(F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in ARCHIVE_FIELDS]
    return raw.select(listing_of(F.col("arrival.file_path"), pattern).alias("listing"), *fields, "arrival")


def write_packed(lines: DataFrame, path: str) -> str:
    """Lines (file, place, value) as a packed archive, those of a file beside each other; a row is one line, so no file is held whole."""
    lines.select("file", "place", "value").repartition("file").sortWithinPartitions("file", "place").write.parquet(path)
    return path


def packed_files(packed: DataFrame, pattern: str = LISTING_PATTERN) -> DataFrame:
    """As ``archive_files``, of a packed archive, with each file's ``header`` line and its place.

    Lines are reduced to a row per file where they are read. ``n_bytes`` counts a line end for every line.
    """
    read = packed.groupBy("file").agg(
        F.min_by(F.struct("value", "place"), "place").alias("h"), F.max(_separators(F.col("value"))).alias("most"),
        F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.sum(F.octet_length("value") + 1).cast("long").alias("n_bytes"))
    parsed = F.coalesce(F.col("valid") & (F.col("most") <= _separators(F.col("h.value"))), F.lit(False))
    return read.select(
        "file", listing_of(F.col("file"), pattern).alias("listing"), "n_bytes", parsed.alias("parsed"),
        F.col("h.value").alias("header"), F.col("h.place").alias("header_place"))


def packed_records(packed: DataFrame, files: DataFrame) -> DataFrame:
    """As ``archive_records``, of a packed archive and its ``packed_files`` (best written once).

    Each line is read under its own file's header; of the headers only the different ones come to the driver.
    Fields do not span lines.
    """
    headers = [r.header for r in files.select("header").distinct().orderBy("header").collect()]
    record = F.lit(None)
    for header in headers:
        names = next(csv.reader([header]), [])
        cells = F.from_csv("value", ", ".join(f"_{i} string" for i in range(max(1, len(names)))))
        fields = F.struct(*[
            (cells[f"_{names.index(c)}"] if c in names else F.lit(None)).cast("string").alias(c) for c in ARCHIVE_FIELDS])
        record = F.when(F.col("header") == header, fields).otherwise(record)
    rows = packed.join(files.select("file", "listing", "header", "header_place"), "file").where(
        (F.col("place") > F.col("header_place")) & (F.trim("value") != ""))
    empty = F.struct(*[F.lit(None).cast("string").alias(c) for c in ARCHIVE_FIELDS])
    return rows.withColumn("_r", F.coalesce(record, empty) if headers else empty).select(
        "listing", "_r.*", F.struct("file", "place").alias("arrival"))
