import datetime as dt
import itertools
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import fold_stats as fs, folds as fd, metrics as mt
from pitspark.operators.model import FEATURE_SETS, Newton, fit_certificates, fit_fold, fit_folds, fold_plan, walk_forward
from pitspark.schemas import FIN, TECH
from pitspark.session import materialize

FEATURES = TECH + FIN


def make_panel(spark, n_codes=6, years=(2018, 2019, 2020, 2021, 2022), step=9, seed=4, blank=()):
    rng = np.random.default_rng(seed)
    rows = []
    for code in range(n_codes):
        d = dt.date(years[0], 1, 3)
        while d.year <= years[-1]:
            x = rng.normal(size=len(FEATURES)).round(3)
            x = [None if f in blank or (f == "roe_weighted_pct" and rng.random() < 0.3) else float(v)
                 for f, v in zip(FEATURES, x)]
            z = (x[0] or 0) - 0.5 * (x[4] or 0) + rng.normal()
            late = d.year == years[-1] and d.month > 9
            label = None if late else int(z > 0.8)
            rows.append((f"{code:06d}", d, None if late else d + dt.timedelta(days=90),
                         None if late else float(z), None if late else -0.1, label,
                         None if late else int(z < -0.3), *x))
            d += dt.timedelta(days=step)
    schema = ("code string, trade_date date, label_end_date date, fwd_ret_60d double, "
              "max_drawdown_60d double, opportunity_label int, risk_label int, "
              + ", ".join(f"{f} double" for f in FEATURES))
    return materialize(spark.createDataFrame(rows, schema), "test-panel")


@pytest.fixture(scope="module")
def panel(spark):
    return make_panel(spark)


@pytest.fixture(scope="module")
def pdf(panel):
    return panel.toPandas()


def train_of(pdf, target, start):
    ok = pdf[target].notna() & (pdf.label_end_date.notna())
    t = pdf[ok]
    return t[(t.trade_date < start) & (t.label_end_date < start)]


def test_folds_and_purge(panel, pdf):
    folds = fd.fold_table(panel).collect()
    assert sorted((f.target, f.test_year) for f in folds) == sorted(
        itertools.product(["opportunity_label", "risk_label"], [2021, 2022]))
    for f in folds:
        assert f.start == min(d for d in pdf.trade_date if d.year == f.test_year)
    table = fd.fold_table(panel)
    rows = fd.training_rows(panel, table)
    assert rows.where("label_end_date >= start or trade_date >= start").count() == 0
    for r in fd.fold_eligibility(panel, table).collect():
        want = train_of(pdf, r.target, r.start)
        assert (r.train_n, r.train_pos) == (len(want), want[r.target].sum())
        assert r.train_last_label_end == want.label_end_date.max()
        assert r.cells_FIN == want[FIN].notna().sum().sum() and r.train_classes == 2


def test_statistics_equal_numpy(spark):
    panel = make_panel(spark, blank=("gross_margin_pct",))
    pdf = panel.toPandas()
    folds = materialize(fd.fold_table(panel), "f")
    starts = {(f.target, f.test_year): f.start for f in folds.collect()}
    got = fs.fold_statistics(panel, folds).collect()
    assert len(got) == len(starts) * len(FEATURES)
    for r in got:
        train = train_of(pdf, r.target, starts[r.target, r.test_year])
        x = train[r.feature].astype(float)
        median = 0.0 if x.notna().sum() == 0 else x.median()
        filled = x.fillna(median)
        np.testing.assert_allclose([r.median, r.mean, r.std], [median, filled.mean(), filled.std(ddof=0)], atol=1e-12)
        y = train[r.target]
        np.testing.assert_allclose([r.weight_pos, r.weight_neg], [len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum())])


@pytest.mark.parametrize("limit", [10**6, 20])
def test_medians_of_ties_and_extreme_values(spark, limit):
    rng = np.random.default_rng(0)
    groups = [np.round(rng.normal(size=n), 2) for n in (1, 2, 5, 800, 801)]
    groups += [np.array(v) for v in ([0.0, -0.0, 1e-300, -1e-300], [1e308, -1e308, 1e307, 3.0], [7.0] * 50 + [7.0000001] * 50)]
    for x in groups:
        late = dt.date(2020, 1, 1)
        rows = [(late, float(v), 1, None) for v in x] + [(dt.date(2021, 1, 1), 5.0, 0, None)] * 2
        panel = spark.createDataFrame(rows, "label_end_date date, v double, opportunity_label int, risk_label int")
        numbers = {"opportunity_label": [(2021, dt.date(2020, 6, 1)), (2022, dt.date(2022, 1, 1))]}
        tagged = fs.tagged_rows(panel, numbers, ["v"])
        cells = fs.value_cells(tagged, ["v"])
        folds = spark.createDataFrame([("opportunity_label", 0), ("opportunity_label", 1)], "target string, fold int")
        moments = fs.fold_moments(cells, folds)
        got = {r.fold: r.median for r in fs.select_medians(tagged, cells, moments, limit).collect()}
        for fold, values in ((0, x), (1, np.append(x, [5.0, 5.0]))):
            low, high = np.sort(values)[[(len(values) - 1) // 2, len(values) // 2]]
            assert got[fold] == pytest.approx(low / 2 + high / 2, rel=1e-15)


def test_statistics_repeat_no_row_by_folds(panel):
    numbers = fs.fold_numbers(fd.fold_table(panel))
    text = fs.value_cells(fs.tagged_rows(panel, numbers, FEATURES), FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Scan") + text.count("LogicalRDD") <= 1


def newton(x, y, w):
    x = np.c_[x, np.ones(len(x))]
    b, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ b)
        b -= step
    return b


def test_fit_equals_newton(panel, pdf):
    item = fold_plan(panel)[-1]
    fold = item["fold"]
    got = fit_fold(panel, item, "TECH_FIN")
    train = train_of(pdf, fold.target, fold.start)
    x = train[FEATURES].astype(float)
    x = x.fillna(x.median())
    x = (x - x.mean()) / x.std(ddof=0)
    y = train[fold.target].to_numpy(float)
    w = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    want = newton(x.to_numpy(), y, w)
    np.testing.assert_allclose([*got.coefficients, got.intercept], want, atol=2e-5)


def test_fits_of_all_folds_are_exact_and_share_their_scans(spark, panel, pdf):
    plan, fits = fit_folds(panel)
    assert {(t, y): set(sets) for (t, y), sets in fits.items()} == {
        (i["fold"].target, i["fold"].test_year): set(i["sets"]) for i in plan}
    for item in plan:
        fold = item["fold"]
        train = train_of(pdf, fold.target, fold.start)
        y = train[fold.target].to_numpy(float)
        w = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
        for name, f in fits[fold.target, fold.test_year].items():
            x = train[FEATURE_SETS[name]].astype(float)
            x = x.fillna(x.median())
            x = (x - x.mean()) / x.std(ddof=0)
            np.testing.assert_allclose([*f.coefficients, f.intercept], newton(x.to_numpy(), y, w), atol=1e-9)


def test_newton_halves_a_step_that_raises_the_loss():
    rng = np.random.default_rng(2)
    x = np.c_[rng.normal(size=(40, 2)) * [1, 30], np.ones(40)]
    y = (x[:, 1] > 1).astype(float)
    solver = Newton(np.array([9.0, -4.0, 25.0]))
    for _ in range(200):
        if solver.done:
            break
        z = x @ solver.weights
        p = 0.5 * (1 + np.tanh(z / 2))
        solver.advance(np.logaddexp(0, np.where(y == 1, -z, z)).sum(), x.T @ (p - y), (x.T * (p * (1 - p))) @ x)
    z = x @ solver.weights
    gradient = x.T @ (0.5 * (1 + np.tanh(z / 2)) - y) + np.append(solver.weights[:2], 0)
    assert solver.done and np.abs(gradient).max() < 1e-6


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float((pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2)


def test_walk_forward(panel, pdf):
    metrics, predictions = walk_forward(panel)
    rows = predictions.toPandas()
    assert set(rows.model) == set(FEATURE_SETS) and set(rows.test_year) == {2021, 2022}
    assert (rows.pred == (rows.prob >= 0.5).astype(int)).all()
    for m in metrics.collect():
        g = rows[(rows.target == m.target) & (rows.model == m.model) & (rows.test_year == m.test_year)]
        y, p = g[m.target].to_numpy(int), g.prob.to_numpy()
        assert m.n == len(g) and m.auc == pytest.approx(brute_auc(y, p), abs=1e-12)
        assert m.accuracy == pytest.approx(((p >= 0.5) == (y == 1)).mean())
        assert m.train_last_label_end < m.test_start
    assert metrics.where("model = 'TECH' and auc < 0.6").count() == 0
    pooled = mt.metrics_pooled(predictions.withColumn("truth", mt.outcome_of())).collect()
    assert len(pooled) == 6 and all(r.years == 2 for r in pooled)


def test_all_null_feature_set_is_skipped(spark):
    plan = fold_plan(make_panel(spark, blank=FIN))
    assert plan and all(p["sets"] == ["TECH", "TECH_FIN"] for p in plan)


def test_no_runnable_fold_gives_empty_results(spark):
    metrics, predictions = walk_forward(make_panel(spark, years=(2020, 2021)))
    assert metrics.count() == 0 and predictions.count() == 0


def test_auc_over_close_and_tied_scores(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([0.5 + rng.integers(0, 50, 300) * 1e-12, rng.random(300).round(2), [0.0, 1.0, 0.5]])
    y = rng.integers(0, 2, len(p))
    df = spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(y, p)] + [("one", 1, 0.3)], "g string, truth int, prob double")
    got = {r.g: r for r in mt.classification_metrics(df, ["g"]).collect()}
    assert got["g"].auc == pytest.approx(brute_auc(y, p), abs=1e-12)
    assert got["one"].auc is None and got["one"].precision_win_rate == 0.0
    assert got["g"].predicted_positive == (p >= 0.5).sum()


def test_certificates_tell_a_fit_from_a_spoilt_one(panel, pdf):
    plan, fits = fit_folds(panel)
    rows = fit_certificates(panel, plan, fits).collect()
    assert len(rows) == sum(len(i["sets"]) for i in plan) and all(r.optimal and 0 <= r.gap < 1e-5 for r in rows)
    (target, year), sets = next(iter(fits.items()))
    name, good = next(iter(sets.items()))
    fold = next(i for i in plan if (i["fold"].target, i["fold"].test_year) == (target, year))
    train = train_of(pdf, target, fold["fold"].start)
    z = np.full(len(train), good.intercept)
    for c, w in zip(good.columns, good.coefficients):
        s = good.scaling[c]
        z += w * (train[c].astype(float).fillna(s.median) - s.mean) / (s.std or 1.0)
    y, stats = train[target].to_numpy(float), fold["stats"][0]
    weight = np.where(y == 1, stats.weight_pos, stats.weight_neg)
    loss = (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + np.square(good.coefficients).sum() / 2
    mine = next(r for r in rows if (r.target, r.test_year, r.model) == (target, year, name))
    np.testing.assert_allclose(mine.loss, loss, rtol=1e-9)
    sets[name] = replace(good, coefficients=[c + 0.3 for c in good.coefficients])
    spoilt = fit_certificates(panel, plan, fits).where("not optimal").collect()
    assert [(r.target, r.test_year, r.model) for r in spoilt] == [(target, year, name)]
