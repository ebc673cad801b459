"""What imputation and scaling learn from the training rows of every fold.

Training sets of one target are nested: a row trains the first fold that starts after its outcome
and all later ones. So each row is counted once, for its first fold, and sums over folds give
every training set. The panel is read twice, whatever the number of folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import FIN, TARGETS, TECH
from ..session import materialize
from .folds import labelled

FEATURES = TECH + FIN
CELLS_PER_FACTOR = 128  # first cells: so many for each factor of e in a value's size
SUB_CELLS = 4096
# Values left in all brackets together that are counted one by one instead of in sub-cells.
MAX_VALUES = 1_000_000
_LABEL = "label:"


def fold_numbers(folds: DataFrame) -> dict[str, list]:
    """Per target its folds (test_year, start) in order; a row per target and calendar year at most."""
    found: dict[str, list] = {}
    for row in sorted(folds.select("target", "test_year", "start").collect(), key=lambda r: r.start):
        found.setdefault(row.target, []).append((row.test_year, row.start))
    return found


def tagged_rows(panel: DataFrame, numbers: dict[str, list], columns: list[str]) -> DataFrame:
    """Labelled rows with ``first_<target>``: the number of the first fold a row trains, null for none."""
    def first(target: str) -> Column:
        starts = [start for _, start in numbers.get(target, [])]
        if not starts:
            return F.lit(None).cast("int")
        passed = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("label_end_date")))
        return F.when(labelled(panel, target) & (passed < len(starts)), passed)

    tags = {f"first_{t}": first(t) for t in TARGETS}
    some = F.coalesce(*[F.col(t) for t in tags]).isNotNull()
    return panel.select("label_end_date", *columns, *TARGETS).withColumns(tags).where(some)


def _entries(columns: list[str], keep) -> Column:
    """The present values of a row as (feature, value); a label is named with its prefix."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.when(keep(c), F.col(c.removeprefix(_LABEL)).cast("double")).alias("value"))
        for c in columns
    ])
    return F.explode(F.filter(pairs, lambda e: e["value"].isNotNull()))


def first_cell(value: Column) -> Column:
    """A whole number that never falls as the value grows: logarithmic in its size, signed."""
    size = F.floor((F.ln(F.abs(value)) + 800) * CELLS_PER_FACTOR) + 1
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)


def value_cells(tagged: DataFrame, columns: list[str]) -> DataFrame:
    """(first_..., feature, cell, n, mean, var, lo, hi): every value counted once, where it is read."""
    tags = [f"first_{t}" for t in TARGETS]
    named = columns + [_LABEL + t for t in TARGETS]
    cells = tagged.select(*tags, _entries(named, lambda c: F.lit(True)).alias("_e")).select(
        *tags, "_e.feature", "_e.value")
    return cells.groupBy(*tags, "feature", first_cell(F.col("value")).alias("cell")).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
    )


def _per_target(cells: DataFrame) -> DataFrame:
    """Counts of cells once per target, with ``first`` for its folds."""
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"first_{t}").alias("first")) for t in TARGETS])
    rest = [c for c in cells.columns if not c.startswith("first_")]
    return cells.select(*rest, F.explode(each).alias("_t")).select(*rest, "_t.target", "_t.first").where("first is not null")


def _joined_moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and variance of unions, from those of disjoint parts."""
    whole = Window.partitionBy(*keys)
    total = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    return rows.withColumn("_mean", total).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"),
        (F.sum(F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("_mean"), 2))) / F.sum("n")).alias("var"),
    )


def fold_moments(cells: DataFrame, fold_rows: DataFrame) -> DataFrame:
    """(target, fold, feature, n, mean, var) over the training set of every fold."""
    parts = _joined_moments(_per_target(cells), ["target", "first", "feature"])
    trained = parts.join(F.broadcast(fold_rows), "target").where("first <= fold")
    return _joined_moments(trained, ["target", "fold", "feature"])


def locate(cells: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` ranks (target, fold, feature, side, rank) as (lo, hi, rank, left): the cell that holds each.

    ``left`` counts all rows in the cell, of any fold; ``rank`` is then the rank inside it. Windows hold the
    cells of one feature, not its values.
    """
    per_cell = _per_target(cells).groupBy("target", *keys, "cell").agg(
        F.collect_list(F.struct("first", "n")).alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    met = per_cell.join(F.broadcast(wanted), ["target", *keys])
    inside = F.aggregate(
        F.filter("parts", lambda p: p["first"] <= F.col("fold")), F.lit(0).cast("long"), lambda a, p: a + p["n"])
    everyone = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    upto = Window.partitionBy("target", "fold", "feature", "side").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    summed = met.withColumns({"inside": inside, "left": everyone}).withColumn("upto", F.sum("inside").over(upto))
    before = F.col("upto") - F.col("inside")
    return summed.where((before < F.col("rank")) & (F.col("rank") <= F.col("upto"))).select(
        "target", "fold", "feature", "side", "lo", "hi", (F.col("rank") - before).alias("rank"), "left")


def narrowed_cells(tagged: DataFrame, brackets: list, exact: bool) -> DataFrame:
    """Cells inside the brackets (feature, lo, hi) only, by value or by equal parts of a bracket.

    There are at most two brackets for each target, fold and feature, so they are broadcast.
    """
    spark = tagged.sparkSession
    ends: dict[str, tuple] = {}
    listed: dict[str, list] = {}
    for feature, lo, hi in brackets:
        a, b = ends.get(feature, (lo, hi))
        ends[feature] = min(a, lo), max(b, hi)
        listed.setdefault(feature, []).append((lo, hi))
    table = spark.createDataFrame(list(listed.items()), "feature string, brackets array<struct<from: double, to: double>>")
    tags = [f"first_{t}" for t in TARGETS]
    near = tagged.select(
        *tags, _entries(sorted(ends), lambda c: F.col(c).between(*map(F.lit, ends[c]))).alias("_e"),
    ).select(*tags, "_e.feature", "_e.value").join(F.broadcast(table), "feature")
    value = F.col("value")
    mine = F.get(F.filter("brackets", lambda b: (b["from"] <= value) & (value <= b["to"])), F.lit(0))
    placed = near.withColumn("_b", mine).where("_b is not null").withColumn("bracket", F.col("_b.from"))
    half = F.col("_b.to") / 2 - F.col("_b.from") / 2  # no overflow between the ends
    part = F.floor((value / 2 - F.col("_b.from") / 2) / half * SUB_CELLS)
    cell = value if exact else F.when(half > 0, part).otherwise(0).cast("double")
    return placed.groupBy(*tags, "feature", "bracket", cell.alias("cell")).agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def select_medians(tagged: DataFrame, cells: DataFrame, moments: DataFrame, max_values: int = MAX_VALUES) -> DataFrame:
    """(target, fold, feature, median): exact medians of all training sets at once.

    Each middle rank is followed into the cell that holds it. The brackets of all folds are narrowed
    together, a scan of their columns each time, until few values are left; those are counted one by one.
    """
    middle = F.array(*[
        F.struct(F.lit(s).alias("side"), F.floor((F.col("n") + s) / 2).alias("rank")) for s in (1, 2)])
    wanted = moments.select("target", "fold", "feature", F.explode(middle).alias("_m")).select(
        "target", "fold", "feature", "_m.side", "_m.rank").where(~F.col("feature").startswith(_LABEL))
    found = materialize(locate(cells, wanted, ["feature"]), "median-brackets")
    while True:
        open_ = found.where("lo < hi")
        brackets = open_.groupBy("feature", "lo", "hi").agg(F.max("left").alias("left")).collect()
        if not brackets:
            break
        exact = sum(b["left"] for b in brackets) <= max_values
        inner = narrowed_cells(tagged, [(b["feature"], b["lo"], b["hi"]) for b in brackets], exact)
        ranks = open_.select("target", "fold", "feature", "side", "rank", F.col("lo").alias("bracket"))
        narrowed = locate(inner, ranks, ["feature", "bracket"])
        found = materialize(found.where("lo = hi").unionByName(narrowed), "median-brackets")
    return found.groupBy("target", "fold", "feature").agg(F.avg("lo").alias("median"))


def fold_statistics(panel: DataFrame, folds: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """(target, test_year, feature): what imputation and scaling learn from training rows.

    Exact median (0 for a column without values), then mean and population standard deviation
    *after* imputation, and the balanced class weights. Mean and spread follow from those of the present
    values and the number of imputed copies of the median. ``panel`` should be a written table.
    """
    numbers = fold_numbers(folds)
    spark = panel.sparkSession
    listed = [(t, k, year) for t, years in numbers.items() for k, (year, _) in enumerate(years)]
    fold_rows = spark.createDataFrame(listed, "target string, fold int, test_year int")
    tagged = tagged_rows(panel, numbers, columns)
    cells = materialize(value_cells(tagged, columns), "fold-cells")
    moments = materialize(fold_moments(cells, fold_rows.drop("test_year")), "fold-moments")
    medians = select_medians(tagged, cells, moments)
    keys = ["target", "fold"]
    own_label = F.col("feature") == F.concat(F.lit(_LABEL), F.col("target"))
    sizes = moments.where(own_label).select(
        *keys, F.col("n").alias("train_n"), F.round(F.col("n") * F.col("mean")).cast("long").alias("train_pos"))
    names = F.explode(F.array(*map(F.lit, columns))).alias("feature")
    rows = (
        sizes.select(*keys, "train_n", "train_pos", names)
        .join(moments, [*keys, "feature"], "left").join(medians, [*keys, "feature"], "left")
        .join(F.broadcast(fold_rows), keys).withColumn("fill", F.coalesce("median", F.lit(0.0)))
    )
    n, present = F.col("train_n"), F.coalesce("n", F.lit(0))
    avg, var = F.coalesce("mean", F.lit(0.0)), F.coalesce("var", F.lit(0.0))
    gap, absent = avg - F.col("fill"), n - present
    mean = (present * avg + absent * F.col("fill")) / n
    spread = F.sqrt((present * var + present * absent / n * gap * gap) / n)
    return rows.select(
        "target", "test_year", "feature", "train_n", "train_pos", F.col("fill").alias("median"),
        mean.alias("mean"), spread.alias("std"),
        F.try_divide(n, 2 * F.col("train_pos")).alias("weight_pos"),
        F.try_divide(n, 2 * (n - F.col("train_pos"))).alias("weight_neg"),
    )
