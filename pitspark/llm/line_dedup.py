"""Remove passages of lines that repeat anywhere: overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitspark.session import materialize

from .text import repeated, row_key

WINDOW = 3
_COPIES = 10_000


def text_lines(text: Column) -> Column:
    """The lines of a text, ends of line not included; null has none."""
    return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_key, start, hash, check) of every window of consecutive lines.

    A text of fewer lines has none. Two 64-bit digests identify a window's lines.
    """
    lines = docs.select(
        "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("doc_key"), text_lines(F.col("text")).alias("lines"),
    ).where(F.size("lines") >= window)
    placed = lines.select(
        "doc_id", "doc_key",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("lines") - (window - 1)),
                lambda i: F.struct(i.alias("start"), F.array_join(F.slice("lines", i, window), "\n").alias("passage")),
            )
        ).alias("w"),
    )
    return placed.select(
        "doc_id", "doc_key", F.col("w.start").alias("start"),
        F.xxhash64("w.passage").alias("hash"), F.xxhash64(F.lit("check"), "w.passage").alias("check"),
    )


def repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_key, covered): the lines of later occurrences, as sorted merged spans (first, last).

    The first occurrence of a window is the one with the least (doc_id, row key, start);
    a null doc_id comes after all others. The windows of a document are narrow rows;
    the first places come from an aggregate that folds copies where they are read, and
    they meet the windows in one join, whose skewed partitions Spark can split.
    """
    windows = materialize(line_windows(docs, window), "line-windows")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("doc_key"), F.col("start"))
    counted = windows.groupBy("hash", "check").agg(F.count("*").alias("times"))
    shared = windows.join(counted.where(F.col("times") > 1).drop("times"), ["hash", "check"])
    first = shared.groupBy("hash", "check").agg(F.min(order).alias("first"))
    later = shared.join(first, ["hash", "check"]).where(
        (F.col("doc_key") != F.col("first.doc_key")) | (F.col("start") != F.col("first.start"))
    )
    # equal rows share a key: their windows are one here, and a start counts once
    starts = later.select("doc_key", "start").distinct()
    before = W.partitionBy("doc_key").orderBy("start")
    opened = starts.withColumn(
        "opens", (F.col("start") > F.coalesce(F.lag("start").over(before) + (window - 1), F.lit(-1)) + 1).cast("int"),
    ).withColumn("span", F.sum("opens").over(before))
    spans = opened.groupBy("doc_key", "span").agg(
        F.min("start").alias("first"), (F.max("start") + (window - 1)).alias("last"),
    )
    return spans.groupBy("doc_key").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("covered")
    )


def drop_repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per input row: (doc_id, text, n_lines, n_removed), later occurrences of windows cut out.

    Lines covered by any later occurrence go, the others stay in order, joined by a line
    end. A text with every line covered becomes empty. Texts of fewer lines than a
    window, empty texts and nulls stay as they are (null counts no lines, an empty text
    one). Of equal rows (same id and text) one is the first occurrence, and every window of
    the others is a later one: as many empty texts, unless they have fewer lines than a window. An
    empty table gives an empty result; columns beside doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    covered = repeated_lines(docs, window)
    # equal rows are folded with a count, and dealt out again after the join
    rows = docs.withColumn("doc_key", row_key(F.col("doc_id"), F.col("text"))).groupBy("doc_key").agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"),
    )
    met = rows.join(covered, "doc_key", "left").withColumn("lines", text_lines(F.col("text")))
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("covered")),
            lambda k: _between(
                F.when(k == 0, F.lit(1)).otherwise(F.get("covered", k - 1)["last"] + 1),
                F.when(k == F.size("covered"), F.size("lines")).otherwise(F.get("covered", k)["first"] - 1),
            ),
        )
    )
    removed = F.coalesce(
        F.aggregate("covered", F.lit(0), lambda a, c: a + c["last"] - c["first"] + 1), F.lit(0)
    )
    cut = met.select(
        "doc_id",
        F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), "copies",
    )
    dealt = repeated(cut, F.col("copies"), "copy", _COPIES)
    gone = (F.col("copy") > 1) & (F.col("n_lines") >= window)
    return dealt.select(
        "doc_id", F.when(gone, F.lit("")).otherwise(F.col("text")).alias("text"), "n_lines",
        F.when(gone, F.col("n_lines")).otherwise(F.col("n_removed")).alias("n_removed"),
    )


def _between(first: Column, last: Column) -> Column:
    return F.slice("lines", first, F.greatest(F.lit(0), last - first + 1))
