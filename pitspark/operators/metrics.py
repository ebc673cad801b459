"""Classification metrics and the exact area under the ROC curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import decide
from ..session import materialize

THRESHOLD = 0.5


def _rate(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def outcome_of(target: str = "target") -> Column:
    """The true label the row's target names."""
    return F.when(F.col(target) == "opportunity_label", F.col("opportunity_label")).otherwise(
        F.col("risk_label")
    )


def ranked_totals(scored: DataFrame, keys: list[str], distinct: str | None = None) -> DataFrame:
    """Per group: class counts, decisions and ranking wins of rows (``truth``, ``prob``).

    With ``distinct`` also the set of values of that column, which must have few.

    Rows are first reduced to distinct scores. Ranking those in one window per
    group would send a whole model to one task, so they are range-partitioned by
    group and score into slices of like size, wherever the scores crowd, and
    written with their slice number. Negatives below a score are those of the
    slices before (a row per group and slice) plus those before it in its slice.
    """
    chosen = decide(F.col("prob"), THRESHOLD)
    counts = ["pos", "neg", "tp", "fp"]
    level = (
        scored.groupBy(*keys, "prob")
        .agg(
            F.sum(F.col("truth").cast("long")).alias("pos"),
            F.sum((1 - F.col("truth")).cast("long")).alias("neg"),
            *([F.collect_set(distinct).alias("_set")] if distinct else []),
        )
        .withColumns(
            {
                "tp": F.col("pos") * chosen,
                "fp": F.col("neg") * chosen,
                "wins": F.col("pos") * F.col("neg") / 2,
            }
        )
    )
    sliced = level.repartitionByRange(*keys, "prob").withColumn("_slice", F.spark_partition_id())
    level = materialize(sliced, "score-slices")
    sets = [F.array_distinct(F.flatten(F.collect_set("_set"))).alias("_set")] if distinct else []
    for partition, order in ((["_slice"], "prob"), ([], "_slice")):
        w = (
            Window.partitionBy(*keys, *partition)
            .orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        below = F.coalesce(F.sum("neg").over(w), F.lit(0))
        level = (
            level.withColumn("wins", F.col("wins") + F.col("pos") * below)
            .groupBy(*keys, *partition)
            .agg(*[F.sum(c).alias(c) for c in counts + ["wins"]], *sets)
        )
    return level


def exact_auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Rank AUC with ties at half weight; NULL where a group has a single class."""
    return ranked_totals(scored, keys).select(*keys, _auc().alias("auc"))


def _auc() -> Column:
    return F.try_divide(F.col("wins"), F.col("pos").cast("double") * F.col("neg").cast("double"))


def classification_metrics(scored: DataFrame, keys: list[str], years: str | None = None) -> DataFrame:
    """All metrics per group from one pass over scored rows; undefined rates are 0.

    With ``years`` also the number of distinct values of that column.
    """
    pos, n = F.col("pos"), F.col("pos") + F.col("neg")
    tp, chosen = F.col("tp"), F.col("tp") + F.col("fp")
    hits = F.col("tp") + F.col("neg") - F.col("fp")
    return ranked_totals(scored, keys, years).select(
        *keys,
        n.alias("n"),
        _rate(pos, n).alias("positive_rate"),
        chosen.alias("predicted_positive"),
        _rate(hits, n).alias("accuracy"),
        _rate(tp, chosen).alias("precision_win_rate"),
        _rate(tp, pos).alias("recall"),
        _rate(2 * tp, chosen + pos).alias("f1"),
        _auc().alias("auc"),
        *([F.size("_set").cast("long").alias("years")] if years else []),
    )


def metrics_by_year(scored: DataFrame) -> DataFrame:
    return classification_metrics(scored, ["target", "model", "test_year"])


def metrics_pooled(scored: DataFrame) -> DataFrame:
    """Metrics over the predictions of all years, with the number of test years."""
    return classification_metrics(scored, ["target", "model"], "test_year")
