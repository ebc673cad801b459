"""Walk-forward evaluation of a class-balanced logistic regression."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import decide
from ..schemas import FEATURE_SETS, TARGETS
from ..session import materialize
from .fold_stats import fold_statistics
from .folds import fold_eligibility, fold_table, labelled, purge
from .metrics import metrics_by_year, outcome_of

OUTCOMES = ["fwd_ret_60d", "max_drawdown_60d", "opportunity_label", "risk_label"]
EPOCH = dt.date(1970, 1, 1)
PREDICTION_COLUMNS = ["trade_date", "code", *OUTCOMES, "target", "model", "test_year", "prob", "pred"]


@dataclass(frozen=True)
class Scaling:
    """Imputation and scaling of one feature as learnt on the training rows."""

    median: float
    mean: float
    std: float

    def apply(self, column: str) -> Column:
        filled = F.coalesce(F.col(column), F.lit(self.median))
        return (filled - F.lit(self.mean)) / F.lit(self.std if self.std > 0 else 1.0)


@dataclass(frozen=True)
class Fit:
    """A fitted model as plain numbers, scored by a column expression."""

    columns: list[str]
    scaling: dict[str, Scaling]
    coefficients: list[float]
    intercept: float

    def prob(self) -> Column:
        margin = F.lit(self.intercept)
        for column, weight in zip(self.columns, self.coefficients):
            margin = margin + F.lit(weight) * self.scaling[column].apply(column)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit(
    train: DataFrame, target: str, columns: list[str], scaling: dict[str, Scaling],
    train_n: int, weight_pos: float, weight_neg: float, max_iter: int = 2000,
) -> Fit:
    """L2-penalised fit with an unpenalised intercept.

    The balanced weights sum to the number of rows, so a penalty of 1/n equals
    a unit inverse regularisation strength. Features are scaled beforehand with
    the population deviation, hence no standardisation inside.
    """
    features = array_to_vector(F.array(*[scaling[c].apply(c) for c in columns]))
    weight = F.when(F.col(target) == 1, F.lit(weight_pos)).otherwise(F.lit(weight_neg))
    rows = train.select(
        features.alias("features"), F.col(target).cast("double").alias("label"),
        weight.alias("weight"),
    )
    estimator = LogisticRegression(
        regParam=1.0 / train_n, elasticNetParam=0.0, standardization=False, weightCol="weight",
        maxIter=max_iter, tol=1e-7,
    )
    model = estimator.fit(rows)
    return Fit(columns, scaling, [float(v) for v in model.coefficients], float(model.intercept))


def coefficient_table(spark: SparkSession, fits: dict[tuple, dict[str, Fit]], columns: list[str]) -> DataFrame:
    """(target, test_year, models): a row per fold with the numbers of its fitted sets.

    ``models`` has per set the name, the intercept and, in the order of ``columns``, median,
    mean, deviation, weight and whether the set uses the column; the weight of one it does not is 0.
    """
    rows = []
    for (target, year), sets in fits.items():
        models = []
        for name, f in sets.items():
            weight = dict(zip(f.columns, f.coefficients))
            terms = []
            for c in columns:
                s = f.scaling[c] if c in weight else Scaling(0.0, 0.0, 1.0)
                terms.append((s.median, s.mean, s.std if s.std > 0 else 1.0, weight.get(c, 0.0), c in weight))
            models.append((name, f.intercept, terms))
        rows.append((target, year, models))
    return spark.createDataFrame(
        rows,
        "target string, test_year int, models array<struct<model: string, intercept: double, "
        "terms: array<struct<median: double, mean: double, std: double, weight: double, used: boolean>>>>",
    )


def score_folds(panel: DataFrame, fits: dict[tuple, dict[str, Fit]], targets: list[str] = TARGETS) -> DataFrame:
    """Predictions of all folds and feature sets from one scan of the panel.

    Every labelled row meets the models of its target and year through a broadcast table
    bounded by folds, sets and features.
    """
    columns = [*dict.fromkeys(c for s in FEATURE_SETS.values() for c in s)]
    table = F.broadcast(coefficient_table(panel.sparkSession, fits, columns))
    each = F.array(*[F.struct(F.lit(t).alias("target"), labelled(panel, t).alias("known")) for t in targets])
    rows = (
        panel.select("trade_date", "code", *OUTCOMES, *columns, year_of(panel).alias("test_year"), F.explode(each).alias("_t"))
        .where("_t.known").withColumn("target", F.col("_t.target"))
        .join(table, ["target", "test_year"])
        .withColumn("_m", F.explode("models"))
    )
    margin = F.col("_m.intercept")
    for i, c in enumerate(columns):
        t = F.col("_m.terms")[i]
        value = (F.coalesce(F.col(c), t["median"]) - t["mean"]) / t["std"]
        margin = margin + F.when(t["weight"] != 0, t["weight"] * value).otherwise(0.0)
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    scored = rows.withColumns({"model": F.col("_m.model"), "prob": prob})
    return scored.withColumn("pred", decide(F.col("prob"))).select(*PREDICTION_COLUMNS)


def fold_plan(panel: DataFrame, targets: list[str] = TARGETS) -> list[dict]:
    """Runnable folds with their statistics, on the driver.

    At most one entry per target and calendar year, each with one number set per
    feature; no data row is collected.
    """
    folds = materialize(fold_table(panel, targets), "folds")
    stats: dict[tuple, list] = defaultdict(list)
    for row in fold_statistics(panel, folds).collect():
        stats[row.target, row.test_year].append(row)
    plan = []
    for row in fold_eligibility(panel, folds).collect():
        sets = [name for name in FEATURE_SETS if row[f"runs_{name}"]]
        if sets:
            plan.append({"fold": row, "sets": sets, "stats": stats[row.target, row.test_year]})
    return sorted(plan, key=lambda p: (p["fold"].target, p["fold"].test_year))


def year_of(panel: DataFrame) -> Column:
    """The partition column of a panel written by year, which prunes files, or the date's year."""
    return F.col("year") if "year" in panel.columns else F.year("trade_date")


def fit_fold(panel: DataFrame, item: dict, name: str) -> Fit:
    """Fit one feature set on the purged training rows of one fold."""
    fold, first = item["fold"], item["stats"][0]
    usable = panel.where(labelled(panel, fold.target))
    # The year bound prunes partitions; the purge decides.
    train = purge(usable.where(year_of(panel) <= fold.test_year), F.lit(fold.start))
    scaling = {s.feature: Scaling(s.median, s.mean, s.std) for s in item["stats"]}
    return fit(train, fold.target, FEATURE_SETS[name], scaling, first.train_n,
               first.weight_pos, first.weight_neg)


def fit_folds(panel: DataFrame, targets: list[str] = TARGETS, max_steps: int = 100) -> tuple[list[dict], dict[tuple, dict[str, Fit]]]:
    """(plan, fits by (target, test_year) and set): every runnable fold fitted, all of them together.

    Newton's method on the loss ``fit`` minimises. Each step is one scan of the panel that sums the loss, gradient and
    curvature of all open fits where the rows are read; the driver solves a system as small as a feature set. A step that
    raises a loss is halved, and a fit is closed once what a further step could gain is below 1e-12 of its loss.
    """
    plan = fold_plan(panel, targets)
    columns = [*dict.fromkeys(c for s in FEATURE_SETS.values() for c in s)]
    solvers = {
        (item["fold"].target, item["fold"].test_year, name): Newton(np.zeros(len(FEATURE_SETS[name]) + 1))
        for item in plan for name in item["sets"]
    }
    for _ in range(max_steps):
        open_ = {key: s.weights for key, s in solvers.items() if not s.done}
        if not open_:
            break
        for key, sums in fit_sums(panel, plan, open_, columns).items():
            solvers[key].advance(*sums)
    else:
        raise RuntimeError(f"fits still open after {max_steps} steps: {sorted(k for k, s in solvers.items() if not s.done)}")
    fits: dict[tuple, dict[str, Fit]] = defaultdict(dict)
    for item in plan:
        scaling = {s.feature: Scaling(s.median, s.mean, s.std) for s in item["stats"]}
        for name in item["sets"]:
            target, year = item["fold"].target, item["fold"].test_year
            *weights, intercept = (float(v) for v in solvers[target, year, name].weights)
            fits[target, year][name] = Fit(FEATURE_SETS[name], scaling, weights, intercept)
    return plan, fits


class Newton:
    """Damped Newton steps on a balanced logistic loss with a unit ridge on all weights but the last, the intercept."""

    def __init__(self, weights: np.ndarray, tolerance: float = 1e-12):
        self.weights, self.tolerance, self.done = weights, tolerance, False
        self.base, self.loss, self.step = weights, np.inf, np.zeros_like(weights)

    def advance(self, loss: float, gradient: np.ndarray, curvature: np.ndarray) -> None:
        """Move on from ``weights``, of which the sums over the training rows are given."""
        ridge = np.append(np.ones(len(self.weights) - 1), 0.0)
        loss = loss + (ridge * self.weights**2).sum() / 2
        if not loss <= self.loss + 1e-10 * abs(self.loss):
            self.step = self.step / 2
            self.weights = self.base + self.step
            return
        gradient = gradient + ridge * self.weights
        step = -np.linalg.lstsq(curvature + np.diag(ridge), gradient, rcond=None)[0]
        self.done = -gradient @ step / 2 <= self.tolerance * loss
        self.base, self.loss, self.step = self.weights, loss, step
        self.weights = self.weights + step


def fit_sums(
    panel: DataFrame, plan: list[dict], weights: dict[tuple, np.ndarray], columns: list[str],
) -> dict[tuple, tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, curvature) of each fit (target, test_year, set) at its weights, from one scan of the panel.

    A batch of rows is reduced to these sums for every fold it trains; a task emits them once, and they are added
    up by fit and place. Their number depends on folds, sets and features only.
    """
    tasks = []
    for item in plan:
        target, year = item["fold"].target, item["fold"].test_year
        stats = {s.feature: s for s in item["stats"]}
        sets = [(n, [columns.index(c) for c in FEATURE_SETS[n]], weights[target, year, n])
                for n in item["sets"] if (target, year, n) in weights]
        if sets:
            first = item["stats"][0]
            tasks.append((
                target, year, (item["fold"].start - EPOCH).days, float(first.weight_pos), float(first.weight_neg),
                *[np.array([[f(stats[c])] for c in columns], float) for f in (
                    lambda s: s.median, lambda s: s.mean, lambda s: s.std if s.std > 0 else 1.0)], sets))
    used = sorted({t[0] for t in tasks})

    def sums(batches):
        import pyarrow as pa

        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            table = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            x = np.stack([table[c] for c in columns]).astype(float, copy=False)
            absent = np.isnan(x)
            for target, year, start, pos, neg, median, mean, std, sets in tasks:
                label = table[target]
                rows = np.flatnonzero((table["_last"] < start) & ~np.isnan(label))
                if not len(rows):
                    continue
                y = label[rows]
                z = np.ones((len(columns) + 1, len(rows)))
                z[:-1] = (np.where(absent, median, x)[:, rows] - mean) / std
                sign, share = 1 - 2 * y, np.where(y == 1, pos, neg)
                for name, places, w in sets:
                    own = z[[*places, len(columns)]]
                    margin = w @ own
                    decay = np.exp(-np.abs(margin))
                    p = np.where(margin >= 0, 1, decay) / (1 + decay)
                    loss = share @ (np.maximum(sign * margin, 0) + np.log1p(decay))
                    bend = (own * (share * p * (1 - p))) @ own.T
                    parts = np.concatenate([[loss], own @ (share * (p - y)), bend.ravel()])
                    key = target, year, name
                    total[key] = total[key] + parts if key in total else parts
        for (target, year, name), parts in total.items():
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([target] * n), pa.array([year] * n, pa.int32()), pa.array([name] * n),
                 pa.array(range(n), pa.int32()), pa.array(parts)], names=["target", "test_year", "model", "place", "value"])

    known = F.lit(False)
    for t in used:
        known = known | labelled(panel, t)
    last = F.datediff(F.greatest("trade_date", "label_end_date"), F.lit(EPOCH)).alias("_last")
    rows = panel.where(known & (year_of(panel) <= max(t[1] for t in tasks))).select(
        last, *[F.col(c).cast("double") for c in columns], *[F.col(t).cast("double") for t in used])
    added = rows.mapInArrow(sums, "target string, test_year int, model string, place int, value double").groupBy(
        "target", "test_year", "model", "place").agg(F.sum("value").alias("value"))
    found: dict[tuple, dict[int, float]] = defaultdict(dict)
    for r in added.collect():
        found[r.target, r.test_year, r.model][r.place] = r.value
    result = {}
    for key, parts in found.items():
        k = len(weights[key])
        values = np.array([parts[i] for i in range(len(parts))])
        result[key] = float(values[0]), values[1:k + 1], values[k + 1:].reshape(k, k)
    return result


def fit_certificates(panel: DataFrame, plan: list[dict], fits: dict[tuple, dict[str, Fit]], tolerance: float = 1e-5) -> DataFrame:
    """(target, test_year, model, train_n, loss, gap, optimal): how far each fit is from its optimum, at most.

    The penalised loss (inverse strength 1) is strongly convex in the weights, so half the squared gradient bounds
    what an exact minimiser could still gain; ``gap`` is this bound relative to the loss and ``optimal`` says that it is
    below ``tolerance``. One scan of the panel gives the gradients of all fits: a row meets the models of the folds it
    trains through a broadcast table bounded by folds, sets and features, and is summed where it is read.
    """
    columns = [*dict.fromkeys(c for s in FEATURE_SETS.values() for c in s)]
    spark = panel.sparkSession
    heads = spark.createDataFrame(
        [(i["fold"].target, i["fold"].test_year, i["fold"].start, i["fold"].train_n, i["stats"][0].weight_pos, i["stats"][0].weight_neg)
         for i in plan],
        "target string, test_year int, start date, train_n long, weight_pos double, weight_neg double")
    each = coefficient_table(spark, fits, columns).select("target", "test_year", F.explode("models").alias("m"))
    models = each.join(F.broadcast(heads), ["target", "test_year"]).groupBy("target").agg(
        F.collect_list(F.struct("test_year", "start", "train_n", "weight_pos", "weight_neg", "m")).alias("models"))
    known = F.array(*[F.struct(F.lit(t).alias("target"), F.when(labelled(panel, t), F.col(t)).alias("label")) for t in {t for t, _ in fits}])
    trained = F.filter("models", lambda f: (f["start"] > F.col("label_end_date")) & (f["start"] > F.col("trade_date")))
    rows = (
        panel.select("trade_date", "label_end_date", *columns, *TARGETS, F.explode(known).alias("_t"))
        .where("_t.label is not null").withColumns({"target": F.col("_t.target"), "label": F.col("_t.label")})
        .join(F.broadcast(models), "target").withColumn("_f", F.explode(trained))
    )
    x = {}
    margin = F.col("_f.m.intercept")
    for i, c in enumerate(columns):
        t = F.col("_f.m.terms")[i]
        x[c] = F.when(t["used"], (F.coalesce(F.col(c), t["median"]) - t["mean"]) / t["std"]).otherwise(0.0)
        margin = margin + t["weight"] * x[c]
    sample = F.when(F.col("label") == 1, F.col("_f.weight_pos")).otherwise(F.col("_f.weight_neg"))
    rest = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z"))) - F.col("label")
    signed = F.when(F.col("label") == 1, -F.col("_z")).otherwise(F.col("_z"))
    loss = F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))
    scored = rows.select(
        "target", "label", F.col("_f.test_year").alias("test_year"), F.col("_f.train_n").alias("train_n"), F.col("_f.m").alias("_m"),
        sample.alias("_s"), margin.alias("_z"), *[v.alias(f"x_{c}") for c, v in x.items()])
    summed = scored.groupBy("target", "test_year", F.col("_m.model").alias("model"), "train_n").agg(
        F.first("_m.terms").alias("terms"), F.sum(F.col("_s") * loss).alias("fit"), F.sum(F.col("_s") * rest).alias("g"),
        *[F.sum(F.col("_s") * rest * F.col(f"x_{c}")).alias(f"g_{c}") for c in columns],
    )
    squares, norm = F.pow("g", F.lit(2)), F.lit(0.0)
    for i, c in enumerate(columns):
        t = F.col("terms")[i]
        squares = squares + F.when(t["used"], F.pow(F.col(f"g_{c}") + t["weight"], 2)).otherwise(0.0)
        norm = norm + t["weight"] * t["weight"]
    total = F.col("fit") + norm / 2
    return summed.select(
        "target", "test_year", "model", "train_n", total.alias("loss"), (squares / 2 / total).alias("gap"),
        (squares / 2 / total < tolerance).alias("optimal"))


def walk_forward(
    panel: DataFrame, targets: list[str] = TARGETS,
) -> tuple[DataFrame, DataFrame]:
    """(metrics per fold and feature set, predictions) over all runnable folds.

    ``panel`` should be a written table, best partitioned by a ``year`` column:
    every step of the fits reads it again, all folds together. The driver keeps coefficients
    and sums over training rows. All folds are scored in one scan, and the predictions
    are written before the metrics read them.
    """
    return evaluate(panel, *fit_folds(panel, targets), targets)


def evaluate(
    panel: DataFrame, plan: list[dict], fits: dict[tuple, dict[str, Fit]], targets: list[str] = TARGETS,
) -> tuple[DataFrame, DataFrame]:
    """(metrics per fold and feature set, predictions) of fitted folds."""
    info = [
        (i["fold"].target, name, i["fold"].test_year, i["fold"].train_n, i["fold"].train_last_label_end, i["fold"].start)
        for i in plan for name in i["sets"]
    ]
    schema = (
        "target string, model string, test_year int, train_n long, "
        "train_last_label_end date, test_start date"
    )
    # One row per fold and feature set.
    notes = F.broadcast(panel.sparkSession.createDataFrame(info, schema))
    predictions = materialize(score_folds(panel, fits, targets), "predictions")
    metrics = metrics_by_year(predictions.withColumn("truth", outcome_of()))
    return metrics.join(notes, ["target", "model", "test_year"]), predictions
