"""Features, labels, universe gate, as-of join and the assembled panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitspark.operators.asof import asof_fundamentals
from pitspark.operators.features import (
    unique_bars, with_forward, with_labels, with_prev_close, with_technical,
)
from pitspark.operators.membership import universe_semi_join
from pitspark.operators.quality import panel_summary
from pitspark.plans.panel import build_panel
from pitspark.schemas import FIN, TECH
from pitspark.session import materialize
from pitspark.sources.bars import tradable_bars

from .fixtures import Tables
from .registry import query, rounded, sql_round

BAR_VALUES = [
    "open_qfq", "high_qfq", "low_qfq", "close_qfq", "volume_shares", "amount_cny", "turnover_pct",
]
OUTCOMES = ["fwd_ret_60d", "max_drawdown_60d", "max_upside_60d"]
LABEL_COLUMNS = ["label_end_date", "opportunity_label", "risk_label"]

_ZSCORE = """CASE WHEN count({c}) OVER w20 = 20 THEN
      ({c} - avg({c}) OVER w20) / nullif(stddev_pop({c}) OVER w20, 0) END"""

SQL_FEATURES = {
    "returns": """
  SELECT *, close_qfq / nullif(lag(close_qfq) OVER w, 0) - 1 AS r1 FROM fx_trad
  WINDOW w AS (PARTITION BY code ORDER BY trade_date)""",
    "features": f"""
  SELECT *,
    close_qfq / nullif(lag(close_qfq, 5) OVER w, 0) - 1 AS ret_5d,
    close_qfq / nullif(lag(close_qfq, 20) OVER w, 0) - 1 AS ret_20d,
    close_qfq / nullif(lag(close_qfq, 60) OVER w, 0) - 1 AS ret_60d,
    CASE WHEN count(r1) OVER w20 = 20 THEN stddev_pop(r1) OVER w20 END AS vol_20d,
    CASE WHEN count(close_qfq) OVER w20 = 20
      THEN close_qfq / avg(close_qfq) OVER w20 - 1 END AS ma20_gap,
    CASE WHEN count(close_qfq) OVER w60 = 60
      THEN close_qfq / avg(close_qfq) OVER w60 - 1 END AS ma60_gap,
    {_ZSCORE.format(c="turnover_pct")} AS turnover_z20,
    {_ZSCORE.format(c="amount_cny")} AS amount_z20,
    CASE WHEN count(high_qfq) OVER w20 = 20 AND count(low_qfq) OVER w20 = 20
      THEN max(high_qfq) OVER w20 / min(low_qfq) OVER w20 - 1 END AS range_20d,
    lead(close_qfq, 60) OVER w / close_qfq - 1 AS fwd_ret_60d,
    lead(trade_date, 60) OVER w AS label_end_date,
    CASE WHEN lead(trade_date, 60) OVER w IS NOT NULL
      THEN min(low_qfq) OVER a60 / close_qfq - 1 END AS max_drawdown_60d,
    CASE WHEN lead(trade_date, 60) OVER w IS NOT NULL
      THEN max(high_qfq) OVER a60 / close_qfq - 1 END AS max_upside_60d
  FROM returns
  WINDOW w AS (PARTITION BY code ORDER BY trade_date),
    w20 AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    w60 AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
    a60 AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)""",
    "labelled": """
  SELECT *,
    CASE WHEN fwd_ret_60d IS NULL THEN NULL
      WHEN fwd_ret_60d >= 0.15 AND max_drawdown_60d > -0.10 THEN 1 ELSE 0 END AS opportunity_label,
    CASE WHEN fwd_ret_60d IS NULL THEN NULL
      WHEN max_drawdown_60d <= -0.15 THEN 1 ELSE 0 END AS risk_label
  FROM features""",
}
SQL_GATE = """
  SELECT * FROM labelled b WHERE EXISTS (
    SELECT 1 FROM fx_members m WHERE m.code = b.code AND m.in_date <= b.trade_date
      AND (m.out_date IS NULL OR b.trade_date <= m.out_date))"""
SQL_LATEST = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, available_date
      ORDER BY report_period DESC, revision_id DESC, ann_date DESC) AS r FROM fx_facts
    WHERE available_date IS NOT NULL) WHERE r = 1"""
SQL_PANEL = SQL_FEATURES | {
    "gated": SQL_GATE,
    "latest": SQL_LATEST,
    "panel": f"""
  SELECT b.*, {", ".join("f." + c for c in FIN)}, f.available_date AS financial_available_date
  FROM gated b ASOF LEFT JOIN latest f ON b.code = f.code AND b.trade_date >= f.available_date""",
}
PANEL_VIEWS = ["fx_trad", "fx_members", "fx_facts"]


def panel_of(t: Tables) -> DataFrame:
    """The panel from a written membership table, which it reads more than once."""
    membership = materialize(t.membership(), "membership")
    return build_panel(t.bars(), membership, t.facts())


@query(
    "tradable_bars", f"SELECT trade_date, code, {sql_round(BAR_VALUES)} FROM fx_trad", ["fx_trad"]
)
def tradable(t: Tables) -> DataFrame:
    return rounded(tradable_bars(t.bars()))


@query(
    "tech_features", f"SELECT code, trade_date, {sql_round(TECH)} FROM features", ["fx_trad"],
    SQL_FEATURES,
)
def tech_features(t: Tables) -> DataFrame:
    return rounded(with_technical(tradable_bars(t.bars())).select("code", "trade_date", *TECH))


@query(
    "forward_labels",
    f"SELECT code, trade_date, {sql_round(OUTCOMES)}, {', '.join(LABEL_COLUMNS)} FROM labelled",
    ["fx_trad"], SQL_FEATURES,
)
def forward_labels(t: Tables) -> DataFrame:
    labelled = with_labels(with_forward(tradable_bars(t.bars())))
    return rounded(labelled.select("code", "trade_date", *OUTCOMES, *LABEL_COLUMNS))


@query(
    "prev_close",
    """SELECT code, trade_date, close_qfq AS close_raw,
         lag(close_qfq) OVER (PARTITION BY code ORDER BY trade_date) AS prev_close_raw
       FROM fx_bars""",
    ["fx_bars"],
)
def prev_close(t: Tables) -> DataFrame:
    raw = t.bars().select("code", "trade_date", F.col("close_qfq").alias("close_raw"))
    return with_prev_close(raw)


@query(
    "unique_bars",
    """SELECT code, trade_date, arg_max(px, seq) AS price FROM (
         SELECT code, trade_date, seq, px FROM lines) GROUP BY code, trade_date""",
    extra={
        "lines": """
  SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS trade_date,
    l_extendedprice AS px,
    (l_orderkey * 8 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq
  FROM lineitem"""
    },
)
def unique(t: Tables) -> DataFrame:
    lines = t.read("lineitem").select(
        F.col("l_suppkey").cast("string").alias("code"),
        F.to_date("l_shipdate").alias("trade_date"),
        F.col("l_extendedprice").alias("price"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000000
         + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("arrival"),
    )
    return unique_bars(lines, "arrival")


@query(
    "universe_semi_join",
    f"""SELECT code, trade_date, {sql_round(["close_qfq"])} FROM fx_trad b WHERE EXISTS (
          SELECT 1 FROM fx_members m WHERE m.code = b.code AND m.in_date <= b.trade_date
            AND (m.out_date IS NULL OR b.trade_date <= m.out_date))""",
    ["fx_trad", "fx_members"],
)
def universe_gate(t: Tables) -> DataFrame:
    bars = tradable_bars(t.bars()).select("code", "trade_date", "close_qfq")
    return rounded(universe_semi_join(bars, t.membership()))


@query(
    "asof_fundamentals",
    f"""SELECT b.code, b.trade_date, {sql_round(FIN)}, f.available_date AS financial_available_date
        FROM fx_trad b ASOF LEFT JOIN latest f
          ON b.code = f.code AND b.trade_date >= f.available_date""",
    ["fx_trad", "fx_facts"], {"latest": SQL_LATEST},
)
def asof(t: Tables) -> DataFrame:
    bars = tradable_bars(t.bars()).select("code", "trade_date")
    return rounded(asof_fundamentals(bars, t.facts()))


@query(
    "look_ahead_count",
    """SELECT count(*) AS n_rows, count(financial_available_date) AS n_matched,
         count(*) FILTER (WHERE financial_available_date > trade_date) AS n_ahead FROM panel""",
    PANEL_VIEWS, SQL_PANEL,
)
def look_ahead(t: Tables) -> DataFrame:
    panel = panel_of(t)
    ahead = F.col("financial_available_date") > F.col("trade_date")
    return panel.agg(
        F.count("*").alias("n_rows"), F.count("financial_available_date").alias("n_matched"),
        F.count(F.when(ahead, 1)).alias("n_ahead"),
    )


@query(
    "pit_panel",
    f"""SELECT code, trade_date, {sql_round(BAR_VALUES + TECH + OUTCOMES + FIN)},
          {', '.join(LABEL_COLUMNS)}, financial_available_date FROM panel""",
    PANEL_VIEWS, SQL_PANEL,
)
def pit_panel(t: Tables) -> DataFrame:
    return rounded(panel_of(t))


@query(
    "panel_summary",
    "SELECT count(*) AS panel_rows, count(DISTINCT code) AS panel_codes FROM gated",
    PANEL_VIEWS, SQL_PANEL,
)
def summary(t: Tables) -> DataFrame:
    return panel_summary(panel_of(t))


