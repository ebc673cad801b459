"""The whole evaluation: gate, panel, walk-forward, pooled metrics and result files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import quality as ql
from ..operators.metrics import metrics_pooled, outcome_of
from ..operators.model import walk_forward
from ..session import materialize
from ..sources import sinks
from ..sources.bars import tradable_bars
from .panel import build_panel


@dataclass
class Backtest:
    gate: DataFrame
    panel: DataFrame
    by_year: DataFrame
    overall: DataFrame
    predictions: DataFrame
    summary: DataFrame


def run_backtest(
    bars: DataFrame, membership: DataFrame, facts: DataFrame, jobs: DataFrame,
    allow_partial: bool = False, out_dir: str | None = None,
) -> Backtest:
    """Stop at the gate unless it is met or a partial run is allowed.

    With ``out_dir`` the gate report and the missing codes are written before the stop,
    so that a stopped run leaves them behind.
    """
    gate = ql.gate_report(membership, tradable_bars(bars), jobs)
    gate = materialize(gate, "gate")
    if out_dir is not None:
        sinks.write_json(gate, f"{out_dir}/gate")
        sinks.write_csv(ql.gate_missing(membership, tradable_bars(bars)).orderBy("code"), f"{out_dir}/gate_missing")
    ql.enforce_gate(gate, allow_partial)
    panel = build_panel(bars, membership, facts).withColumn("year", F.year("trade_date"))
    panel = materialize(panel, "panel", ["year"])
    by_year, predictions = walk_forward(panel)
    overall = metrics_pooled(predictions.withColumn("truth", outcome_of()))
    summary = ql.run_summary(gate, ql.panel_summary(panel), overall)
    return Backtest(gate, panel.drop("year"), by_year, overall, predictions, summary)


def write_results(result: Backtest, out_dir: str) -> None:
    """All result files but the gate's, which ``run_backtest`` writes first."""
    sinks.write_csv(result.panel.orderBy("code", "trade_date"), f"{out_dir}/pit_panel")
    sinks.write_csv(result.by_year, f"{out_dir}/walk_forward_metrics_by_year")
    sinks.write_csv(result.overall, f"{out_dir}/walk_forward_metrics_overall")
    sinks.write_csv(result.predictions, f"{out_dir}/walk_forward_predictions")
    sinks.write_json(result.summary, f"{out_dir}/backtest_summary")
