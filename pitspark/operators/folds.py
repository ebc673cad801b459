"""Walk-forward folds and their purged training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import FEATURE_SETS, FIN, TARGETS, TECH

BURN_IN_YEARS = 3
FEATURES = TECH + FIN


def labelled(panel: DataFrame, target: str) -> Column:
    return F.col(target).isNotNull() & F.col("label_end_date").isNotNull()


def fold_table(panel: DataFrame, targets: list[str] = TARGETS, burn_in: int = BURN_IN_YEARS) -> DataFrame:
    """(target, test_year, start, test_n): one fold per target and calendar year.

    Years come from the whole panel, the first ``burn_in`` are never tested, and
    ``start`` is the first labelled test day. The result holds at most one row
    per target and calendar year, whatever the size of the panel.
    """
    per_year = panel.groupBy(F.year("trade_date").alias("test_year")).agg(
        *[F.min(F.when(labelled(panel, t), F.col("trade_date"))).alias(f"start_{t}") for t in targets],
        *[F.count(F.when(labelled(panel, t), 1)).alias(f"n_{t}") for t in targets],
    )
    # Ranks calendar years, after the panel was reduced to one row per year.
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("test_year"))
    folds = F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.col(f"start_{t}").alias("start"),
                     F.col(f"n_{t}").alias("test_n"))
            for t in targets
        ]
    )
    return (
        per_year.withColumn("_nth", nth)
        .where(F.col("_nth") > burn_in)
        .select("test_year", F.explode(folds).alias("_f"))
        .select("_f.target", "test_year", "_f.start", "_f.test_n")
        .where("test_n > 0")
    )


def labelled_rows(panel: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    """Labelled panel rows once per target, with the target's label."""
    per_target = F.array(
        *[F.struct(F.lit(t).alias("target"), F.col(t).alias("label")) for t in targets]
    )
    rest = [c for c in panel.columns if c not in targets]
    return (
        panel.where("label_end_date is not null")
        .select(*rest, F.explode(per_target).alias("_t"))
        .select(*rest, "_t.target", "_t.label")
        .where("label is not null")
    )


def purge(rows: DataFrame, start: Column) -> DataFrame:
    """Rows whose day and whose outcome both lie strictly before the test start."""
    return rows.where((F.col("trade_date") < start) & (F.col("label_end_date") < start))


def training_rows(panel: DataFrame, folds: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Purged training rows of every fold.

    The fold table is broadcast: its size is bounded by targets times calendar
    years. Rows repeat per fold they train; sums over training sets are better taken from
    ``fold_stats``, which reads every row once.
    """
    rows = labelled_rows(panel.select("trade_date", "label_end_date", *columns, *TARGETS))
    return purge(rows.join(F.broadcast(folds), "target"), F.col("start"))


def first_training_year(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Per labelled row and target the first fold that may train on it.

    Starts grow with the year, so this one number says which folds see the row.
    """
    keys = ["code", "trade_date", "label_end_date", "target", "label"]
    starts = folds.groupBy("target").agg(
        F.array_sort(F.collect_list(F.struct("start", "test_year"))).alias("_folds")
    )
    rows = labelled_rows(panel.select("code", "trade_date", "label_end_date", *TARGETS))
    later = F.filter("_folds", lambda f: f["start"] > F.col("label_end_date"))
    # One row per target, each with one entry per calendar year.
    return rows.join(F.broadcast(starts), "target", "left").select(
        *keys, F.get(later, F.lit(0))["test_year"].alias("first_training_year")
    )


def fold_eligibility(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Training size, classes and non-NULL feature cells per fold, and whether it can run.

    The panel is reduced to one row per target and outcome day before it meets
    the folds, so no row is repeated. An outcome day before the start implies
    an earlier trade day.
    """
    def cells(columns: list[str]) -> Column:
        return F.sum(sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)))

    columns = [*dict.fromkeys(c for s in FEATURE_SETS.values() for c in s)]
    per_day = (
        labelled_rows(panel.select("trade_date", "label_end_date", *columns, *TARGETS))
        .groupBy("target", "label_end_date")
        .agg(
            F.count("*").alias("n"), F.sum("label").alias("pos"),
            *[cells(cols).alias(f"cells_{name}") for name, cols in FEATURE_SETS.items()],
        )
        .withColumnRenamed("target", "_target")
    )
    match = (F.col("target") == F.col("_target")) & (F.col("label_end_date") < F.col("start"))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("long")

    sums = (
        folds.join(per_day, match, "left")
        .groupBy("target", "test_year", "start", "test_n")
        .agg(
            total("n").alias("train_n"), total("pos").alias("train_pos"),
            F.max("label_end_date").alias("train_last_label_end"),
            *[total(f"cells_{name}").alias(f"cells_{name}") for name in FEATURE_SETS],
        )
    )
    both = (F.col("train_pos") > 0) & (F.col("train_pos") < F.col("train_n"))
    return sums.withColumns(
        {"train_classes": both.cast("int") + (F.col("train_n") > 0).cast("int")}
        | {f"runs_{n}": both & (F.col(f"cells_{n}") > 0) for n in FEATURE_SETS}
    )
