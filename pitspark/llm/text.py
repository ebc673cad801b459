"""Text measures shared by the operators, as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

# The word patterns that the operators' contracts name; words are what the breaks
# leave, and splitting at them is several times faster than matching words.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN_BREAK = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Only A-Z become lower case; every other character stays."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """The words of a text in order, A-Z in lower case; null has none."""
    found = F.array_remove(F.split(lower_ascii(text), WORD_BREAK), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """Number of runs without white space; null has none."""
    found = F.size(F.array_remove(F.split(text, TOKEN_BREAK), ""))
    return F.when(text.isNull(), 0).otherwise(found).cast("long")


def text_key(text: Column) -> Column:
    """64-bit digest that tells rows of one id apart; null has its own."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def two_digests(*values: Column) -> Column:
    """Two 64-bit digests of columns and of which are null, as one struct that is never null."""
    marked = [v for c in values for v in (c, c.isNull())]
    return F.struct(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit("second"), *marked).alias("b"))


def row_key(doc_id: Column, text: Column) -> Column:
    """128-bit digest of id and text, never null; equal rows share it."""
    return two_digests(doc_id, text)


def packed_rows(rows: DataFrame, key: Column) -> DataFrame:
    """(key, row): one of the rows of each key, its columns in one struct, so no name clashes.

    Rows of a key are folded where they are read; a row landed any number of times never meets itself.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.select(key.alias("key"), whole.alias("row")).groupBy("key").agg(F.first("row").alias("row"))


def unpacked(packed: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row`` again, some of them ``changed``."""
    return packed.select(*[
        changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns])


def repeated(rows: DataFrame, times: Column, copy: str, step: int = 10_000) -> DataFrame:
    """Each row ``times`` times, numbered from 1 in ``copy``; in two steps, so no list of copies is long."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / step)))
    dealt = rows.where(times > 0).withColumn(copy, part)
    first = F.col(copy) * step + 1
    return dealt.withColumn(copy, F.explode(F.sequence(first, F.least(times.cast("long"), first + step - 1))))
