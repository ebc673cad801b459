"""Landed files and payloads: universe CSV, bar archives, k-line text, fundamentals pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitspark.operators.quality import membership_stats
from pitspark.session import scratch_path
from pitspark.sources import bars as bar_source, fundamentals as fund, sinks
from pitspark.sources.universe import read_universe

from .fixtures import Tables
from .registry import query, rounded, sql_round

KLINE_NUMBERS = ["open", "close", "high", "low", "volume", "amount", "amplitude", "pct", "change"]


def kline_lines(t: Tables) -> DataFrame:
    """Bars as text lines: suspended days are cut short, a missing turnover is a dash."""
    day, rest = F.col("trade_date"), F.col("turnover_pct").cast("string")
    o, c, h, lo = (F.col(f"{n}_qfq") for n in ("open", "close", "high", "low"))
    fields = [o, c, h, lo, F.col("volume_shares"), F.col("amount_cny"), h - lo, c / o - 1, c - o]
    text = F.concat_ws(
        ",", day.cast("string"), F.transform(F.array(*fields), lambda x: x.cast("string")),
        F.coalesce(rest, F.lit("-")),
    )
    short = F.concat_ws(",", day.cast("string"), o.cast("string"), c.cast("string"))
    return t.bars().select(
        "code", F.date_format(day, "yyyy-MM").alias("payload"),
        F.when(F.col("is_trade") == 0, short).otherwise(text).alias("line"),
    )


KLINE_SQL = """
  SELECT code, strftime(trade_date, '%Y-%m') AS payload, trade_date AS date, open_qfq AS open,
    close_qfq AS close, high_qfq AS high, low_qfq AS low, volume_shares AS volume,
    amount_cny AS amount, high_qfq - low_qfq AS amplitude, close_qfq / open_qfq - 1 AS pct,
    close_qfq - open_qfq AS change, turnover_pct AS turnover, turnover_pct IS NULL AS malformed
  FROM fx_bars WHERE is_trade IS DISTINCT FROM 0"""


@query(
    "parse_kline_lines",
    f"""SELECT code, payload, date, {sql_round(KLINE_NUMBERS + ["turnover"])}, malformed FROM k""",
    ["fx_bars"], {"k": KLINE_SQL},
)
def parse_kline(t: Tables) -> DataFrame:
    return rounded(bar_source.parse_kline_lines(kline_lines(t)))


@query(
    "kline_quarantine",
    f"""SELECT code, payload, date, {sql_round(KLINE_NUMBERS + ["turnover"])} FROM k
        WHERE NOT EXISTS (SELECT 1 FROM k b
          WHERE b.malformed AND b.code = k.code AND b.payload = k.payload)""",
    ["fx_bars"], {"k": KLINE_SQL},
)
def quarantine(t: Tables) -> DataFrame:
    parsed = bar_source.parse_kline_lines(kline_lines(t))
    return rounded(bar_source.quarantine_payloads(parsed, ["code", "payload"]))


def _archive(t: Tables) -> str:
    """Bars landed as two archive files, the older one with unpadded codes."""
    root = scratch_path(t.spark, "archive")
    bars = t.bars().select(
        "code", F.col("trade_date").alias("date"),
        *[F.col(f"{n}_qfq").alias(n) for n in ("open", "high", "low", "close")],
        F.col("volume_shares").alias("volume"), F.col("amount_cny").alias("amount"),
        F.col("turnover_pct").alias("turn"),
        (F.col("close_qfq") / F.col("open_qfq") - 1).alias("pctChg"),
    )
    old = F.col("date") < F.lit("1998-01-01")
    unpadded = F.col("code").cast("long").cast("string")
    bars.where(old).withColumn("code", unpadded).write.parquet(f"{root}/kline_1.parquet")
    bars.where(~old).write.parquet(f"{root}/kline_2.parquet")
    return f"{root}/kline_*.parquet"


ARCHIVE_SQL = """
  SELECT code, trade_date AS date, open_qfq AS open, high_qfq AS high, low_qfq AS low,
    close_qfq AS close, volume_shares AS volume, amount_cny AS amount, turnover_pct AS turn,
    close_qfq / open_qfq - 1 AS pctChg
  FROM fx_bars WHERE code IN (SELECT code FROM fx_company WHERE current_member = 1)"""


@query(
    "bar_archive_scan",
    f"""SELECT code, date,
          {sql_round(["open", "high", "low", "close", "volume", "amount", "turn", "pctChg"])}
        FROM a""",
    ["fx_bars", "fx_company"], {"a": ARCHIVE_SQL},
)
def archive_scan(t: Tables) -> DataFrame:
    universe = t.company().where("current_member = 1")
    return rounded(bar_source.read_bar_archive(t.spark, _archive(t), universe).drop("arrival"))


@query(
    "normalise_bars",
    f"""SELECT date AS trade_date, code, CAST(NULL AS DOUBLE) AS close_raw,
          round(pctChg, 6) + 0.0 AS pct_chg_pct, round(volume, 6) AS volume_shares,
          round(amount, 6) AS amount_cny, round(turn, 6) AS turnover_pct, close AS close_qfq,
          CASE WHEN close IS NULL THEN 0 ELSE 1 END AS is_trade, 'S014' AS source_id,
          open AS open_qfq, high AS high_qfq, low AS low_qfq
        FROM a""",
    ["fx_bars"],
    {
        "a": """
  SELECT code, trade_date AS date, open_qfq AS open, high_qfq AS high, low_qfq AS low,
    CASE WHEN is_trade = 0 THEN NULL ELSE close_qfq END AS close, volume_shares AS volume,
    amount_cny AS amount, turnover_pct AS turn, close_qfq / open_qfq - 1 AS pctChg
  FROM fx_bars"""
    },
)
def normalise_bars(t: Tables) -> DataFrame:
    """Archive rows in which a suspended day carries a NaN close."""
    close = F.when(F.col("is_trade") == 0, F.lit(float("nan"))).otherwise(F.col("close_qfq"))
    landed = t.bars().select(
        F.col("code").cast("long").alias("code"), F.col("trade_date").alias("date"),
        F.col("open_qfq").alias("open"), F.col("high_qfq").alias("high"),
        F.col("low_qfq").alias("low"), close.alias("close"),
        F.col("volume_shares").alias("volume"), F.col("amount_cny").alias("amount"),
        F.col("turnover_pct").alias("turn"),
        (F.col("close_qfq") / F.col("open_qfq") - 1).alias("pctChg"),
    )
    return rounded(
        bar_source.normalise_archive_bars(landed).select(
            "trade_date", "code", "close_raw", "pct_chg_pct", "volume_shares", "amount_cny",
            "turnover_pct", "close_qfq", "is_trade", "source_id", "open_qfq", "high_qfq", "low_qfq",
        )
    )


def fundamental_pages(t: Tables) -> DataFrame:
    """Fundamentals as landed response pages, records in arrival order within a page."""
    def text(name: str, value) -> F.Column:
        return value.cast("string").alias(name)

    revenue, odd = F.col("revenue_yoy_pct"), F.col("arrival") % 2
    record = F.struct(
        F.col("arrival").alias("_n"),
        F.concat(F.col("report_period").cast("string"), F.lit(" 00:00:00")).alias("REPORTDATE"),
        text("NOTICE_DATE", F.col("ann_date")), text("UPDATE_DATE", F.col("update_date")),
        F.when(odd == 0, "").alias("DATATYPE"), F.date_format("report_period", "yyyy").alias("QDATE"),
        F.coalesce(revenue.cast("string"), F.lit("-")).alias("YSTZ"),
        F.when(odd == 0, "1.5").alias("TOTAL_OPERATE_INCOME_YOY"),
        text("SJLTZ", F.col("net_profit_yoy_pct")),
        text("WEIGHTAVG_ROE", F.col("roe_weighted_pct")), text("XSMLL", F.col("gross_margin_pct")),
    )
    # A page holds at most 5,000 records, whatever the size of the table.
    page = F.floor(F.col("arrival") / 5000).cast("int")
    data = F.transform(F.array_sort(F.collect_list(record)), lambda r: r.dropFields("_n"))
    return (
        t.fundamentals()
        .groupBy("code", page.alias("page"))
        .agg(data.alias("data"))
        .select("code", "page", F.to_json(F.struct(
            F.struct(F.lit(1).alias("pages"), F.col("data")).alias("result"))).alias("body"))
    )


FACT_OUT = [
    "revenue_yoy_pct", "net_profit_yoy_pct", "roe_weighted_pct", "gross_margin_pct",
]


@query(
    "parse_fundamental_json",
    f"""SELECT code, report_period, report_type, ann_date, available_date, revision_id,
          {sql_round(FACT_OUT)}, update_date, source_id FROM r WHERE rn = 1""",
    ["fx_fund"],
    {
        "r": """
  SELECT code, report_period, CAST(year(report_period) AS VARCHAR) AS report_type, ann_date,
    greatest(ann_date, update_date) AS available_date,
    coalesce(CAST(update_date AS VARCHAR), CAST(ann_date AS VARCHAR)) AS revision_id,
    coalesce(revenue_yoy_pct, CASE WHEN arrival % 2 = 0 THEN 1.5 END) AS revenue_yoy_pct,
    net_profit_yoy_pct, roe_weighted_pct, gross_margin_pct, update_date, 'S010' AS source_id,
    row_number() OVER (PARTITION BY code, report_period,
      coalesce(CAST(update_date AS VARCHAR), CAST(ann_date AS VARCHAR)) ORDER BY arrival) AS rn
  FROM fx_fund"""
    },
)
def parse_json(t: Tables) -> DataFrame:
    records = fund.parse_fundamental_pages(fundamental_pages(t))
    return rounded(
        fund.normalise_primary(records).select(
            "code", "report_period", "report_type", "ann_date", "available_date", "revision_id",
            *FACT_OUT, "update_date", "source_id",
        )
    )


def archive_records(t: Tables) -> DataFrame:
    """Archive records as text; a third of the announcement dates is unreadable."""
    bad = F.col("arrival") % 3 == 0
    return t.fundamentals().select(
        F.col("code").alias("SECURITY_CODE"),
        F.col("report_period").cast("string").alias("REPORT_DATE"),
        F.when(bad, "n/a").otherwise(F.col("ann_date").cast("string")).alias("NOTICE_DATE"),
        F.concat(F.col("update_date").cast("string"), F.lit("T08:00:00")).alias("UPDATE_DATE"),
        F.lit(None).cast("string").alias("REPORT_TYPE"),
        F.lit("oops").alias("TOTAL_OPERATE_INCOME"),
        F.col("revenue_yoy_pct").cast("string").alias("TOTAL_OPERATE_INCOME_YOY"),
        F.lit("").alias("PARENT_NETPROFIT"),
        F.col("net_profit_yoy_pct").cast("string").alias("PARENT_NETPROFIT_YOY"),
        F.col("gross_margin_pct").cast("string").alias("DEDUCT_PARENT_NETPROFIT"),
        "arrival",
    )


ARCHIVE_FACT_SQL = """
  SELECT code, report_period, '' AS report_type, coalesce(ann, upd) AS ann_date,
    greatest(ann, upd) AS available_date,
    coalesce(CAST(upd AS VARCHAR), CAST(ann AS VARCHAR), '0') AS revision_id,
    CAST(NULL AS DOUBLE) AS revenue_cny, revenue_yoy_pct,
    CAST(NULL AS DOUBLE) AS net_profit_parent_cny, net_profit_yoy_pct,
    gross_margin_pct AS deduct_np_cny, upd AS update_date, 'S015' AS source_id, arrival
  FROM (SELECT *, CASE WHEN arrival % 3 = 0 THEN NULL ELSE ann_date END AS ann,
          update_date AS upd FROM fx_fund)
  WHERE coalesce(ann, upd) IS NOT NULL"""
ARCHIVE_FACT_COLUMNS = [
    "code", "report_period", "report_type", "ann_date", "available_date", "revision_id",
    "revenue_cny", "revenue_yoy_pct", "net_profit_parent_cny", "net_profit_yoy_pct",
    "deduct_np_cny", "update_date", "source_id",
]
_NUMBERS = [
    "revenue_cny", "revenue_yoy_pct", "net_profit_parent_cny", "net_profit_yoy_pct",
    "deduct_np_cny",
]
_TEXTS = [c for c in ARCHIVE_FACT_COLUMNS if c not in _NUMBERS]


@query(
    "fundamentals_norm",
    f"SELECT {', '.join(_TEXTS)}, {sql_round(_NUMBERS)}, arrival FROM a",
    ["fx_fund"], {"a": ARCHIVE_FACT_SQL},
)
def fundamentals_norm(t: Tables) -> DataFrame:
    rows = fund.normalise_archive(archive_records(t))
    return rounded(rows.select(*ARCHIVE_FACT_COLUMNS, "arrival"))


@query(
    "fundamentals_csv",
    f"SELECT {', '.join(_TEXTS)}, {sql_round(_NUMBERS)} FROM a",
    ["fx_fund"], {"a": ARCHIVE_FACT_SQL},
)
def fundamentals_csv(t: Tables) -> DataFrame:
    """The same records through a landed CSV file."""
    path = scratch_path(t.spark, "fundamentals")
    sinks.write_csv(archive_records(t).drop("arrival"), path)
    rows = fund.normalise_archive(fund.read_fundamental_archive(t.spark, path))
    return rounded(rows.select(*ARCHIVE_FACT_COLUMNS))


def universe_file(t: Tables) -> str:
    """A universe file with three lines per code, landed in customer order."""
    path = scratch_path(t.spark, "universe")
    key = F.floor(F.col("c_custkey") / 3)
    lines = (
        t.read("customer")
        .repartitionByRange("c_custkey")
        .sortWithinPartitions("c_custkey")
        .select(
            F.concat(F.lit(" "), F.lpad(key.cast("string"), 8, "0")).alias("code"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_nationkey") < 5, "bj").alias("exchange"),
        )
    )
    return sinks.write_csv(lines, path)


def _universe_sql(direction: str) -> str:
    return f"""
  SELECT code, name, CASE WHEN c_nationkey < 5 THEN 'BJ'
      WHEN substr(code, 1, 2) IN ('60', '68') THEN 'SH'
      WHEN substr(code, 1, 2) IN ('92', '43', '83', '87') THEN 'BJ' ELSE 'SZ' END AS exchange
  FROM (SELECT lpad(CAST(c_custkey // 3 AS VARCHAR), 8, '0') AS code, c_name AS name, c_nationkey,
          row_number() OVER (PARTITION BY c_custkey // 3 ORDER BY c_custkey {direction}) AS rn
        FROM customer) WHERE rn = 1"""


@query("universe_csv", _universe_sql("ASC"))
def universe_first(t: Tables) -> DataFrame:
    return read_universe(t.spark, universe_file(t), "first")


@query("universe_csv_last", _universe_sql("DESC"))
def universe_last(t: Tables) -> DataFrame:
    return read_universe(t.spark, universe_file(t), "last")


@query(
    "membership_export",
    """SELECT code, source_code, industry_code, CAST(in_date AS VARCHAR) AS in_date,
         CAST(end_exclusive - 1 AS VARCHAR) AS out_date FROM fx_islands""",
    ["fx_islands"],
)
def membership_export(t: Tables) -> DataFrame:
    """Membership export written as CSV and read back; an open end is an empty field."""
    path = scratch_path(t.spark, "membership")
    rows = t.islands().select(
        "code", "source_code", "industry_code", "in_date",
        F.date_sub("end_exclusive", 1).alias("out_date"),
    )
    sinks.write_csv(rows, path)
    return t.spark.read.option("header", True).csv(path)


@query(
    "json_report",
    """SELECT count(DISTINCT code) AS loaded_entities, count(*) AS loaded_rows,
         CAST(min(in_date) AS VARCHAR) AS min_date,
         CAST(max(end_exclusive) - 1 AS VARCHAR) AS max_date
       FROM fx_islands""",
    ["fx_islands"],
)
def json_report(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "report")
    sinks.write_json(membership_stats(t.islands()), path)
    schema = "loaded_entities bigint, loaded_rows bigint, min_date string, max_date string"
    return t.spark.read.schema(schema).json(path)


