"""Series of companies whose listing code changed, and the choice among sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def ranked_aliases(alias: DataFrame) -> DataFrame:
    """``alias`` with alias_rank: entries of a code in order of validity, an open start first."""
    if "alias_rank" in alias.columns:
        return alias
    by_start = Window.partitionBy("canonical_code").orderBy(F.col("valid_from").asc_nulls_first(), "historical_code")
    return alias.withColumn("alias_rank", F.row_number().over(by_start))


def alias_stitch(bars: DataFrame, alias: DataFrame, day: str = "trade_date") -> DataFrame:
    """Bars per canonical code, each alias only within its inclusive validity.

    ``alias`` has canonical_code, historical_code, valid_from and valid_to, and
    may have alias_rank; on a day covered twice the later alias wins. A code that heads
    no alias entry passes unrestricted and without a shuffle; only the bars of
    listed codes are joined and reduced.
    """
    alias = ranked_aliases(alias)
    payload = [c for c in bars.columns if c not in ("code", day)]
    heads = alias.select(F.col("canonical_code").alias("code")).distinct()
    plain = bars.join(heads, "code", "left_anti")
    rules = alias.select(
        "canonical_code", F.col("historical_code").alias("code"), "valid_from", "valid_to",
        "alias_rank",
    )
    inside = (F.col("valid_from").isNull() | (F.col(day) >= F.col("valid_from"))) & (
        F.col("valid_to").isNull() | (F.col(day) <= F.col("valid_to"))
    )
    stitched = (
        bars.join(rules, "code")
        .where(inside)
        .groupBy("canonical_code", day)
        .agg(F.max_by(F.struct(*payload), F.col("alias_rank")).alias("_row"))
        .select(F.col("canonical_code").alias("code"), day, "_row.*")
    )
    return plain.unionByName(stitched.select(*bars.columns))


def raw_with_adjusted(raw: DataFrame, adjusted: DataFrame, columns: list[str]) -> DataFrame:
    """Raw bars with the adjusted prices of the same day; adjusted-only days drop."""
    return raw.join(adjusted.select("code", "trade_date", *columns), ["code", "trade_date"], "left")


def first_source(
    rows: DataFrame, entity: str, rank: str, accepted: DataFrame | None = None
) -> DataFrame:
    """Rows of the best-ranked candidate of each entity.

    A candidate counts once it has a row; with ``accepted`` (entity, rank) it
    counts once it is listed there, even if it turns out to hold no row. The
    best rank per entity is a map-side aggregate. The join back is on the
    entity, where AQE broadcasts the small side or splits a skewed entity.
    """
    candidates = rows if accepted is None else accepted
    best = candidates.groupBy(entity).agg(F.min(rank).alias("_best"))
    return rows.join(best, entity).where(F.col(rank) == F.col("_best")).drop("_best")


def archive_candidates(files: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Archive files that count as found: larger than ``min_bytes`` and readable."""
    return files.where((F.col("n_bytes") > min_bytes) & F.col("parsed")).select("code", "rank")
