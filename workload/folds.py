"""Walk-forward folds, their training statistics, metrics and the fitted runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pitspark.operators import fold_stats as fs, folds as fd, metrics as mt
from pitspark.operators.model import Fit, evaluate, fit_certificates, fit_folds
from pitspark.operators.quality import gate_report, panel_summary, run_summary
from pitspark.session import materialize
from pitspark.schemas import FIN, TARGETS, TECH
from pitspark.sources.bars import tradable_bars

from .fixtures import Tables
from .panel import PANEL_VIEWS, SQL_PANEL, panel_of
from .membership import ACTIVE_SQL, AUDIT_SQL
from .quality import GATE_SQL, jobs_of
from .registry import query, rounded, sql_round

FEATURES = TECH + FIN


def written_panel(t: Tables) -> DataFrame:
    """The panel as a table by year: many jobs read it, each a few columns or years."""
    panel = panel_of(t).withColumn("year", F.year("trade_date"))
    return materialize(panel, "panel", ["year"])


# What folds and their statistics read.
TRAINING_COLUMNS = ["trade_date", "label_end_date", *FEATURES, *TARGETS]


def written_training_columns(t: Tables) -> DataFrame:
    """The panel's columns that training reads, as a table without folders by year: every job reads all years."""
    return materialize(panel_of(t).select(*TRAINING_COLUMNS), "training")


SQL_FOLDS = SQL_PANEL | {
    "tested": """
  SELECT y FROM (SELECT y, row_number() OVER (ORDER BY y) AS k
                 FROM (SELECT DISTINCT year(trade_date) AS y FROM panel)) WHERE k > 3""",
    "long": f"""
  SELECT code, trade_date, label_end_date, 'opportunity_label' AS target,
    opportunity_label AS label, {", ".join(FEATURES)} FROM panel
  WHERE opportunity_label IS NOT NULL AND label_end_date IS NOT NULL
  UNION ALL
  SELECT code, trade_date, label_end_date, 'risk_label', risk_label, {", ".join(FEATURES)}
  FROM panel WHERE risk_label IS NOT NULL AND label_end_date IS NOT NULL""",
    "folds": """
  SELECT target, CAST(year(trade_date) AS INTEGER) AS test_year, min(trade_date) AS start,
    count(*) AS test_n
  FROM long WHERE year(trade_date) IN (SELECT y FROM tested) GROUP BY 1, 2""",
    "train": """
  SELECT f.test_year, f.start, f.test_n, l.* FROM folds f JOIN long l
    ON l.target = f.target AND l.trade_date < f.start AND l.label_end_date < f.start""",
}


@query("folds", "SELECT target, test_year, start, test_n FROM folds", PANEL_VIEWS, SQL_FOLDS)
def folds(t: Tables) -> DataFrame:
    return fd.fold_table(panel_of(t))


@query(
    "labelled_rows",
    "SELECT code, trade_date, label_end_date, target, label FROM long", PANEL_VIEWS, SQL_FOLDS,
)
def labelled_rows(t: Tables) -> DataFrame:
    columns = ["code", "trade_date", "label_end_date", "opportunity_label", "risk_label"]
    return fd.labelled_rows(panel_of(t).select(*columns))


@query(
    "first_training_year",
    """SELECT l.code, l.trade_date, l.label_end_date, l.target, l.label,
         min(f.test_year) AS first_training_year
       FROM long l LEFT JOIN folds f ON f.target = l.target
         AND l.trade_date < f.start AND l.label_end_date < f.start
       GROUP BY 1, 2, 3, 4, 5""",
    PANEL_VIEWS, SQL_FOLDS,
)
def first_training_year(t: Tables) -> DataFrame:
    panel = written_panel(t)
    return fd.first_training_year(panel, fd.fold_table(panel))


def _cells(columns: list[str]) -> str:
    return " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in columns)


_RUNS = ", ".join(
    f"train_pos > 0 AND train_pos < train_n AND cells_{s} > 0 AS runs_{s}"
    for s in ("TECH", "FIN", "TECH_FIN")
)
ELIGIBLE_SQL = f"""
  SELECT f.target, f.test_year, f.start, f.test_n, count(t.label) AS train_n,
    coalesce(sum(t.label), 0) AS train_pos, max(t.label_end_date) AS train_last_label_end,
    coalesce(sum({_cells(TECH)}) FILTER (WHERE t.label IS NOT NULL), 0) AS cells_TECH,
    coalesce(sum({_cells(FIN)}) FILTER (WHERE t.label IS NOT NULL), 0) AS cells_FIN,
    coalesce(sum({_cells(FEATURES)}) FILTER (WHERE t.label IS NOT NULL), 0) AS cells_TECH_FIN,
    count(DISTINCT t.label) AS train_classes
  FROM folds f LEFT JOIN train t ON t.target = f.target AND t.test_year = f.test_year
  GROUP BY 1, 2, 3, 4"""


@query(
    "fold_eligibility", f"SELECT *, {_RUNS} FROM e", PANEL_VIEWS, SQL_FOLDS | {"e": ELIGIBLE_SQL}
)
def eligibility(t: Tables) -> DataFrame:
    panel = written_panel(t)
    return fd.fold_eligibility(panel, fd.fold_table(panel))


STATS_SQL = "\n  UNION ALL ".join(
    f"""
  SELECT target, test_year, '{c}' AS feature, count(*) AS train_n, sum(label) AS train_pos,
    median AS median, avg(coalesce({c}, median)) AS mean,
    stddev_pop(coalesce({c}, median)) AS std,
    count(*) / (2.0 * sum(label)) AS weight_pos,
    count(*) / (2.0 * (count(*) - sum(label))) AS weight_neg
  FROM (SELECT *, coalesce(median({c}) OVER (PARTITION BY target, test_year), 0) AS median
        FROM train)
  GROUP BY target, test_year, median"""
    for c in FEATURES
)


@query(
    "fold_statistics",
    f"""SELECT target, test_year, feature, train_n, train_pos,
          {sql_round(["median", "mean", "std", "weight_pos", "weight_neg"])} FROM s""",
    PANEL_VIEWS, SQL_FOLDS | {"s": STATS_SQL},
)
def statistics(t: Tables) -> DataFrame:
    panel = written_training_columns(t)
    table = materialize(fd.fold_table(panel), "folds")
    return rounded(fs.fold_statistics(panel, table))


def metrics_sql(keys: list[str], extra: str = "") -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = m.{c}" for c in keys)
    select = ", ".join(f"m.{c}" for c in keys)
    part = f"PARTITION BY {k}"
    return f"""
  SELECT {select}, m.n, round(m.pos / m.n, 6) AS positive_rate, m.chosen AS predicted_positive,
    round(m.hits / m.n, 6) AS accuracy,
    CASE WHEN m.chosen = 0 THEN 0.0 ELSE round(m.tp / m.chosen, 6) END AS precision_win_rate,
    CASE WHEN m.pos = 0 THEN 0.0 ELSE round(m.tp / m.pos, 6) END AS recall,
    CASE WHEN m.chosen + m.pos = 0 THEN 0.0 ELSE round(2 * m.tp / (m.chosen + m.pos), 6) END AS f1,
    CASE WHEN m.pos = 0 OR m.pos = m.n THEN NULL
      ELSE round((a.ranks - m.pos * (m.pos + 1) / 2) / (CAST(m.pos AS DOUBLE) * (m.n - m.pos)), 6)
      END AS auc{extra}
  FROM (SELECT {k}, CAST(count(*) AS BIGINT) AS n, CAST(sum(truth) AS BIGINT) AS pos,
          count(*) FILTER (WHERE prob >= 0.5) AS chosen,
          count(*) FILTER (WHERE prob >= 0.5 AND truth = 1) AS tp,
          count(*) FILTER (WHERE (prob >= 0.5) = (truth = 1)) AS hits,
          count(DISTINCT test_year) AS years
        FROM fx_scored GROUP BY {k}) m
  JOIN (SELECT {k}, sum(mid) FILTER (WHERE truth = 1) AS ranks FROM (
          SELECT *, rank() OVER ({part} ORDER BY prob)
            + (count(*) OVER ({part}, prob) - 1) / 2.0 AS mid FROM fx_scored)
        GROUP BY {k}) a ON {on}"""


@query("metrics_by_year", metrics_sql(["target", "model", "test_year"]), ["fx_scored"])
def metrics_by_year(t: Tables) -> DataFrame:
    return rounded(mt.metrics_by_year(t.scored()))


@query("metrics_pooled", metrics_sql(["target", "model"], ", m.years"), ["fx_scored"])
def metrics_pooled(t: Tables) -> DataFrame:
    return rounded(mt.metrics_pooled(t.scored()))


@query(
    "auc_exact", "SELECT target, model, auc FROM m", ["fx_scored"],
    {"m": metrics_sql(["target", "model"])},
)
def auc_exact(t: Tables) -> DataFrame:
    return rounded(mt.exact_auc(t.scored(), ["target", "model"]))


@dataclass(frozen=True)
class Walk:
    panel: DataFrame
    plan: list[dict]
    fits: dict[tuple, dict[str, Fit]]
    metrics: DataFrame
    predictions: DataFrame


_WALKS: dict[tuple[str, str], Walk] = {}


def walk_of(t: Tables) -> Walk:
    """The walk-forward of a folder of tables: run and written once per application, read by all its queries."""
    key = t.spark.sparkContext.applicationId, t.dir
    if key not in _WALKS:
        panel = written_panel(t)
        plan, fits = fit_folds(panel)
        metrics, predictions = evaluate(panel, plan, fits)
        _WALKS[key] = Walk(panel, plan, fits, materialize(metrics, "walk-metrics"), predictions)
    return _WALKS[key]


@query("walk_forward_predictions")
def predictions(t: Tables) -> DataFrame:
    return walk_of(t).predictions


@query("walk_forward_metrics")
def walk_metrics(t: Tables) -> DataFrame:
    return walk_of(t).metrics


WALK_SQL = SQL_FOLDS | {
    "e": ELIGIBLE_SQL,
    "runs": "\n  UNION ALL ".join(
        f"""
  SELECT target, test_year, start, train_n, train_last_label_end, '{s}' AS model FROM e
  WHERE train_pos > 0 AND train_pos < train_n AND cells_{s} > 0"""
        for s in ("TECH", "FIN", "TECH_FIN")
    ),
    "tests": """
  SELECT l.code, l.trade_date, l.label, r.* FROM long l JOIN runs r
    ON r.target = l.target AND r.test_year = year(l.trade_date)""",
}


@query(
    "walk_forward_rows",
    f"""SELECT trade_date, code, target, model, test_year, opportunity_label, risk_label,
          {sql_round(["fwd_ret_60d", "max_drawdown_60d"])}
        FROM tests JOIN panel USING (code, trade_date)""",
    PANEL_VIEWS, WALK_SQL,
)
def walk_rows(t: Tables) -> DataFrame:
    """Everything of the predictions that does not depend on a fit."""
    return rounded(walk_of(t).predictions.drop("prob", "pred"))


@query(
    "walk_forward_folds",
    """SELECT target, model, test_year, count(*) AS n, round(avg(label), 6) AS positive_rate,
         train_n, train_last_label_end, start AS test_start
       FROM tests GROUP BY target, model, test_year, train_n, train_last_label_end, start""",
    PANEL_VIEWS, WALK_SQL,
)
def walk_folds(t: Tables) -> DataFrame:
    """The metrics' columns that do not depend on a fit."""
    return rounded(walk_of(t).metrics.select(
        "target", "model", "test_year", "n", "positive_rate", "train_n", "train_last_label_end", "test_start"))


@query(
    "fit_certificates",
    """SELECT target, test_year, model, train_n, true AS optimal FROM runs""",
    PANEL_VIEWS, WALK_SQL,
)
def certificates(t: Tables) -> DataFrame:
    """Every fold and set that can be fitted, with the fit shown to be optimal by its own gradient."""
    walk = walk_of(t)
    return fit_certificates(walk.panel, walk.plan, walk.fits).drop("loss", "gap")


@query(
    "backtest_summary_facts",
    """SELECT CASE WHEN formal THEN 'FORMAL' ELSE 'PARTIAL' END AS status, g.job_status, g.membership_rows, g.market_rows, g.missing_codes,
         (SELECT count(*) FROM panel) AS panel_rows, (SELECT count(DISTINCT code) FROM panel) AS panel_codes,
         target, model, count(*) AS n, round(avg(label), 6) + 0.0 AS positive_rate, count(DISTINCT test_year) AS years
       FROM tests, (SELECT *, job_status = 'LOADED' AND membership_rows > 0 AND market_rows > 5000 AND missing_codes = 0 AS formal FROM g) g
       GROUP BY ALL""",
    [*PANEL_VIEWS, "fx_members", "fx_trad", "fx_company"], WALK_SQL | {"active": ACTIVE_SQL, "audit": AUDIT_SQL, "g": GATE_SQL},
)
def summary_facts(t: Tables) -> DataFrame:
    """All of the summary that depends on no fit, a row per pooled metric."""
    s = summary(t).withColumn("m", F.explode("aggregate"))
    gate = ["job_status", "membership_rows", "market_rows", "missing_codes"]
    return rounded(s.select(
        "status", *[f"gate.{c}" for c in gate], "panel_rows", "panel_codes", *[f"m.{c}" for c in ("target", "model", "n", "positive_rate", "years")]))


@query("backtest_summary")
def summary(t: Tables) -> DataFrame:
    walk = walk_of(t)
    panel, scored = walk.panel, walk.predictions.withColumn("truth", mt.outcome_of())
    members = materialize(t.membership(), "summary-members")
    gate = gate_report(members, tradable_bars(t.bars()), jobs_of(t, members))
    return run_summary(gate, panel_summary(panel), mt.metrics_pooled(scored))
