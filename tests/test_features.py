import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitspark.operators.features import unique_bars, with_labels, with_rolling
from pitspark.schemas import TECH
from pitspark.sources.bars import tradable_bars

OUT = ["fwd_ret_60d", "max_drawdown_60d", "max_upside_60d"]
COLUMNS = ["code", "trade_date", "open_qfq", "high_qfq", "low_qfq", "close_qfq", "volume_shares",
           "amount_cny", "turnover_pct"]


def series(code, n, seed):
    rng = np.random.default_rng(seed)
    close = np.exp(np.cumsum(rng.normal(0, 0.04, n))) * 10
    high, low = close * (1 + rng.random(n) * 0.05), close * (1 - rng.random(n) * 0.05)
    start = dt.date(2020, 1, 1)
    return pd.DataFrame({
        "code": code, "trade_date": [start + dt.timedelta(days=2 * i) for i in range(n)],
        "open_qfq": close, "high_qfq": high, "low_qfq": low, "close_qfq": close,
        "volume_shares": 1.0, "amount_cny": rng.random(n) * 1e6, "turnover_pct": rng.random(n),
    })


def expected(g):
    g = g.sort_values("trade_date").reset_index(drop=True)
    c, h, lo, t, a = (g[x] for x in ("close_qfq", "high_qfq", "low_qfq", "turnover_pct", "amount_cny"))
    out = g[["code", "trade_date"]].copy()

    def ratio(x, y):
        return (x / y.where(y != 0)) - 1

    def frame(x, n, fn):
        values = [fn(x[i - n + 1:i + 1].to_numpy()) if i >= n - 1 and x[i - n + 1:i + 1].notna().all()
                  else np.nan for i in range(len(x))]
        return pd.Series(values, dtype=float)

    for k in (5, 20, 60):
        out[f"ret_{k}d"] = ratio(c, c.shift(k))
    out["vol_20d"] = frame(ratio(c, c.shift(1)), 20, np.std)
    out["ma20_gap"] = ratio(c, frame(c, 20, np.mean))
    out["ma60_gap"] = ratio(c, frame(c, 60, np.mean))
    for name, x in (("turnover_z20", t), ("amount_z20", a)):
        sd = frame(x, 20, lambda v: 0.0 if np.ptp(v) == 0 else np.std(v))
        out[name] = (x - frame(x, 20, np.mean)) / sd.where(sd != 0)
    out["range_20d"] = ratio(frame(h, 20, np.max), frame(lo, 20, np.min))
    n = len(g)
    for name in OUT:
        out[name] = np.nan
    for i in range(n - 60):
        out.loc[i, "fwd_ret_60d"] = c[i + 60] / c[i] - 1
        out.loc[i, "max_drawdown_60d"] = lo[i + 1:i + 61].min() / c[i] - 1
        out.loc[i, "max_upside_60d"] = h[i + 1:i + 61].max() / c[i] - 1
    return out


@pytest.fixture(scope="module")
def bars():
    a, b, c = series("000001", 150, 1), series("000002", 30, 2), series("000003", 130, 3)
    a.loc[40, "turnover_pct"] = None
    a.loc[70:75, "low_qfq"] = None
    b["amount_cny"] = 0.1
    c.loc[:, "turnover_pct"] = 0.3
    c.loc[90, "amount_cny"] = None
    return pd.concat([a, b, c], ignore_index=True)


def to_spark(spark, pdf):
    rows = [tuple(None if v is None or (isinstance(v, float) and np.isnan(v)) else v for v in r)
            for r in pdf[COLUMNS].itertuples(index=False)]
    types = "code string, trade_date date, " + ", ".join(f"{c} double" for c in COLUMNS[2:])
    return spark.createDataFrame(rows, types)


def test_rolling_equals_brute_force(spark, bars):
    got = with_rolling(to_spark(spark, bars)).toPandas().sort_values(["code", "trade_date"])
    want = pd.concat([expected(g) for _, g in bars.groupby("code")], ignore_index=True)
    for name in TECH + OUT:
        np.testing.assert_allclose(
            got[name].to_numpy(float), want[name].to_numpy(float), rtol=1e-9, atol=1e-12, err_msg=name
        )


def test_constant_window_has_no_zscore(spark, bars):
    got = with_rolling(to_spark(spark, bars))
    assert got.where("code = '000002' and amount_z20 is not null").count() == 0
    assert got.where("code = '000003' and turnover_z20 is not null").count() == 0


def test_features_do_not_depend_on_other_codes_or_the_future(spark, bars):
    alone = bars[bars.code == "000001"]
    cut = alone.iloc[:100]
    full = with_rolling(to_spark(spark, bars)).where("code = '000001'").toPandas()
    part = with_rolling(to_spark(spark, cut)).toPandas()
    full, part = full.sort_values("trade_date").iloc[:100], part.sort_values("trade_date")
    for name in TECH:
        np.testing.assert_array_equal(full[name].to_numpy(float), part[name].to_numpy(float))


def test_zero_close_is_null_not_infinite(spark, bars):
    pdf = bars[bars.code == "000001"].copy()
    pdf.loc[10, "close_qfq"] = 0.0
    got = with_rolling(to_spark(spark, pdf)).toPandas().sort_values("trade_date").reset_index()
    assert np.isnan(got.ret_5d[15]) and np.isnan(got.fwd_ret_60d[10])
    assert not np.isinf(got[TECH + OUT].to_numpy(float)).any()


def test_labels(spark):
    rows = [(0.15, -0.09), (0.15, -0.10), (0.20, None), (0.0, -0.15), (None, -0.5)]
    df = spark.createDataFrame(rows, "fwd_ret_60d double, max_drawdown_60d double")
    got = [(r.opportunity_label, r.risk_label) for r in with_labels(df).collect()]
    assert got == [(1, 0), (0, 0), (0, 0), (0, 1), (None, None)]


def test_tradable(spark):
    df = spark.createDataFrame(
        [(1.0, 1), (1.0, None), (1.0, 0), (None, 1)], "close_qfq double, is_trade int"
    )
    for c in COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None))
    assert tradable_bars(df).count() == 2


def test_unique_bars_keeps_last_arrival(spark):
    df = spark.createDataFrame(
        [("a", "2020-01-01", 1, 5.0), ("a", "2020-01-01", 2, None), ("b", "2020-01-01", 1, 7.0)],
        "code string, trade_date string, arrival int, px double",
    )
    assert sorted(map(tuple, unique_bars(df, "arrival").collect())) == [
        ("a", "2020-01-01", None), ("b", "2020-01-01", 7.0)
    ]
