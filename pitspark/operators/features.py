"""Rolling features, forward outcomes and labels over daily bars.

All windows share one (code, trade_date) specification: Spark plans one
exchange and one sort for the whole stack. The key of the bar table is
(code, trade_date), so a code holds at most one row per calendar day and a
window partition is bounded by the length of the calendar, however large the
table grows; ``unique_bars`` enforces the key where an input does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rolling import (
    BLOCK, BLOCKS, WINDOW, block_mean, block_spread, by_time, change, merged_mean, merged_std,
    present,
)
from ..schemas import LABEL_HORIZON, TECH

OUTCOMES = ["fwd_ret_60d", "max_drawdown_60d", "max_upside_60d", "label_end_date"]


def unique_bars(bars: DataFrame, arrival: str) -> DataFrame:
    """Enforce the (code, trade_date) key: the last row that arrived wins.

    Copies are reduced on the map side, so a code or day that was landed many
    times over never reaches one task whole.
    """
    keys = ["code", "trade_date"]
    rest = [c for c in bars.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.col(arrival)).alias("_row")
    return bars.groupBy(*keys).agg(latest).select(*keys, "_row.*").drop(arrival)


def with_rolling(bars: DataFrame, horizon: int = LABEL_HORIZON) -> DataFrame:
    """Add the nine technical features, the forward outcomes and the day they are known.

    Three window steps on one specification: five-row blocks, 20-row windows
    from blocks, and 60-row windows (backward and forward) from those. What a
    caller does not select is pruned from the steps.
    """
    if horizon % WINDOW:
        raise ValueError(f"horizon must be a multiple of {WINDOW}")
    w = by_time("code", "trade_date")
    close = F.col("close_qfq")

    def back(column: str, rows: int) -> Column:
        return F.lag(column, rows).over(w) if rows else F.col(column)

    # Step 1: the last five values of each column, and closes further away.
    values = {"c": "close_qfq", "h": "high_qfq", "l": "low_qfq", "t": "turnover_pct", "a": "amount_cny"}
    near = {f"_{k}{i}": back(c, i) for k, c in values.items() for i in range(1, BLOCK)}
    near |= {f"_c{i}": back("close_qfq", i) for i in (BLOCK, 20, 60)}
    near |= {
        "_ahead": F.lead("close_qfq", horizon).over(w),
        "label_end_date": F.lead("trade_date", horizon).over(w),
    }
    last = {k: [F.col(c)] + [F.col(f"_{k}{i}") for i in range(1, BLOCK)] for k, c in values.items()}
    closes = last["c"] + [F.col("_c5")]
    last["r"] = [change(closes[i], closes[i + 1]) for i in range(BLOCK)]
    stats = {"_sum": sum(last["c"][1:], last["c"][0])}
    for k in ("r", "t", "a"):
        stats |= {f"_m_{k}": block_mean(last[k]), f"_s_{k}": block_spread(last[k])}
    stats |= {
        "_top": F.greatest(*last["h"]), "_low": F.least(*last["l"]),
        "_all": F.when(present(last["h"] + last["l"]), True),
    }

    # Step 2: the blocks that end 0, 5, 10 and 15 rows back.
    def blocks(name: str) -> list[Column]:
        return [back(name, i * BLOCK) for i in range(BLOCKS)]

    totals = blocks("_sum")
    windows = {"_sum20": sum(totals[1:], totals[0]), "_vol": merged_std(blocks("_m_r"), blocks("_s_r"))}
    for k in ("t", "a"):
        windows |= {
            f"_m20_{k}": merged_mean(blocks(f"_m_{k}")),
            f"_sd_{k}": merged_std(blocks(f"_m_{k}"), blocks(f"_s_{k}")),
        }
    windows |= {
        "_top20": F.greatest(*blocks("_top")), "_low20": F.least(*blocks("_low")),
        "_all20": present(blocks("_all")),
    }

    # Step 3: the 20-row windows 20 and 40 rows back, and those inside the horizon.
    def ahead(name: str) -> list[Column]:
        extremes = [F.lead(name, n).over(w) for n in range(WINDOW, horizon + 1, WINDOW)]
        return extremes if len(extremes) > 1 else extremes * 2

    def zscore(value: str, k: str) -> Column:
        spread = F.nullif(F.col(f"_sd_{k}"), F.lit(0.0))
        return F.try_divide(F.col(value) - F.col(f"_m20_{k}"), spread)

    known = F.col("label_end_date").isNotNull()
    sums = [back("_sum20", i * WINDOW) for i in range(3)]
    mean20, mean60 = F.col("_sum20") / WINDOW, sum(sums[1:], sums[0]) / (3 * WINDOW)
    added = {
        "ret_5d": change(close, F.col("_c5")),
        "ret_20d": change(close, F.col("_c20")),
        "ret_60d": change(close, F.col("_c60")),
        "vol_20d": F.col("_vol"),
        "ma20_gap": change(close, mean20),
        "ma60_gap": change(close, mean60),
        "turnover_z20": zscore("turnover_pct", "t"),
        "amount_z20": zscore("amount_cny", "a"),
        "range_20d": F.when(F.col("_all20"), change(F.col("_top20"), F.col("_low20"))),
        "fwd_ret_60d": change(F.col("_ahead"), close),
        "max_drawdown_60d": F.when(known, change(F.least(*ahead("_low20")), close)),
        "max_upside_60d": F.when(known, change(F.greatest(*ahead("_top20")), close)),
    }
    stepped = bars.withColumns(near).withColumns(stats).withColumns(windows).withColumns(added)
    return stepped.select(*bars.columns, *TECH, *OUTCOMES)


def with_technical(bars: DataFrame) -> DataFrame:
    """Add the nine technical features."""
    return with_rolling(bars).select(*bars.columns, *TECH)


def with_forward(bars: DataFrame, horizon: int = LABEL_HORIZON) -> DataFrame:
    """Add forward return, drawdown, upside and the day the outcome is known.

    Must see the full bar history, before any universe filter.
    """
    return with_rolling(bars, horizon).select(*bars.columns, *OUTCOMES)


def with_labels(
    outcomes: DataFrame, op_ret: float = 0.15, op_dd: float = -0.10, risk_dd: float = -0.15
) -> DataFrame:
    """Add the two 0/1 labels; NULL where no forward return exists.

    A missing drawdown on a valid row counts as "condition not met", not NULL.
    """
    valid = F.col("fwd_ret_60d").isNotNull()
    drawdown = F.col("max_drawdown_60d")
    rises = (F.col("fwd_ret_60d") >= op_ret) & (drawdown > op_dd)
    falls = drawdown <= risk_dd
    return outcomes.withColumns(
        {
            "opportunity_label": F.when(valid, F.coalesce(rises, F.lit(False)).cast("int")),
            "risk_label": F.when(valid, F.coalesce(falls, F.lit(False)).cast("int")),
        }
    )


def with_prev_close(bars: DataFrame) -> DataFrame:
    """Previous raw close of the stitched series; NULL on the first day."""
    w = by_time("code", "trade_date")
    return bars.withColumn("prev_close_raw", F.lag("close_raw").over(w))
