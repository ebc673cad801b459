"""Column names and declared schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the model features, labels and industry categories.
TECH = [
    "ret_5d", "ret_20d", "ret_60d", "vol_20d", "ma20_gap", "ma60_gap",
    "turnover_z20", "amount_z20", "range_20d",
]
FIN = ["revenue_yoy_pct", "net_profit_yoy_pct", "roe_weighted_pct", "gross_margin_pct"]
FEATURE_SETS = {"TECH": TECH, "FIN": FIN, "TECH_FIN": TECH + FIN}
TARGETS = ["opportunity_label", "risk_label"]
LABEL_HORIZON = 60
INDUSTRY_CODES = ["220303", "220803"]
SLOT_TYPES = ["fruit", "bud", "wood", "water", "fire", "leaf", "pollen", "moon", "wither"]
EMPTY_SLOT = "empty"
SLOTS_PER_DAY = 48


_F = T.StructField
_INT, _LONG, _DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
_TEXT, _DATE, _TIME = T.StringType(), T.DateType(), T.TimestampType()

# Tables and columns of the data model.
COMPANY_MASTER = T.StructType([
    _F("seq", _INT), _F("company_id", _TEXT), _F("code", _TEXT), _F("name", _TEXT),
    _F("exchange", _TEXT), _F("board", _TEXT), _F("sw_l1", _TEXT), _F("sw_l2", _TEXT),
    _F("sw_l3", _TEXT), _F("sw_code", _TEXT), _F("current_member", _INT), _F("snapshot_date", _DATE),
    _F("status_name", _TEXT), _F("source_url", _TEXT), _F("source_asof", _DATE),
])
INDUSTRY_SNAPSHOT = T.StructType([
    _F("code", _TEXT), _F("sw_code", _TEXT), _F("sw_name", _TEXT), _F("snapshot_date", _DATE),
    _F("is_member", _INT), _F("source_id", _TEXT),
])
CODE_ALIAS = T.StructType([
    _F("canonical_code", _TEXT), _F("historical_code", _TEXT), _F("exchange", _TEXT),
    _F("valid_from", _DATE), _F("valid_to", _DATE), _F("source_url", _TEXT), _F("note", _TEXT),
])
SOURCE_REGISTRY = T.StructType([
    _F("source_id", _TEXT), _F("data_layer", _TEXT), _F("source_name", _TEXT), _F("url", _TEXT),
    _F("coverage", _TEXT), _F("source_type", _TEXT), _F("reliability", _TEXT), _F("v1_status", _TEXT),
    _F("notes", _TEXT),
])
INGESTION_JOB = T.StructType([
    _F("job_id", _TEXT), _F("layer", _TEXT), _F("source_id", _TEXT), _F("status", _TEXT),
    _F("target_entities", _LONG), _F("loaded_entities", _LONG), _F("loaded_rows", _LONG),
    _F("min_date", _DATE), _F("max_date", _DATE), _F("last_attempt_ts", _TIME), _F("note", _TEXT),
])
META = T.StructType([
    _F("key", _TEXT), _F("value", _TEXT),
])
MARKET_DAILY = T.StructType([
    _F("trade_date", _DATE), _F("code", _TEXT), _F("open_raw", _DOUBLE), _F("high_raw", _DOUBLE),
    _F("low_raw", _DOUBLE), _F("close_raw", _DOUBLE), _F("prev_close_raw", _DOUBLE),
    _F("pct_chg_pct", _DOUBLE), _F("volume_shares", _DOUBLE), _F("amount_cny", _DOUBLE),
    _F("turnover_pct", _DOUBLE), _F("adj_factor", _DOUBLE), _F("close_qfq", _DOUBLE),
    _F("is_trade", _INT), _F("is_st", _INT), _F("limit_status", _TEXT), _F("source_id", _TEXT),
    _F("ingest_ts", _TIME), _F("open_qfq", _DOUBLE), _F("high_qfq", _DOUBLE), _F("low_qfq", _DOUBLE),
    _F("amplitude_pct", _DOUBLE), _F("change_amt", _DOUBLE),
])
FINANCIAL_QUARTERLY = T.StructType([
    _F("code", _TEXT), _F("report_period", _DATE), _F("report_type", _TEXT), _F("ann_date", _DATE),
    _F("available_date", _DATE), _F("revision_id", _TEXT), _F("revenue_cny", _DOUBLE),
    _F("revenue_yoy_pct", _DOUBLE), _F("net_profit_parent_cny", _DOUBLE),
    _F("net_profit_yoy_pct", _DOUBLE), _F("deduct_np_cny", _DOUBLE), _F("roe_weighted_pct", _DOUBLE),
    _F("gross_margin_pct", _DOUBLE), _F("net_margin_pct", _DOUBLE), _F("cfo_cny", _DOUBLE),
    _F("total_assets_cny", _DOUBLE), _F("total_liab_cny", _DOUBLE), _F("equity_parent_cny", _DOUBLE),
    _F("inventory_cny", _DOUBLE), _F("ar_cny", _DOUBLE), _F("capex_cny", _DOUBLE),
    _F("source_id", _TEXT), _F("ingest_ts", _TIME), _F("update_date", _DATE), _F("source_asof", _DATE),
])
MEMBERSHIP_HISTORY = T.StructType([
    _F("code", _TEXT), _F("source_code", _TEXT), _F("sw_name", _TEXT), _F("sw_index_code", _TEXT),
    _F("source_industry_code", _TEXT), _F("source_industry_name", _TEXT),
    _F("classification_version", _TEXT), _F("in_date", _DATE), _F("out_date", _DATE),
    _F("source_update_time", _TIME), _F("source_id", _TEXT), _F("loaded_at", _TIME),
])
CLASSIFICATION_RAW = T.StructType([
    _F("source_code", _TEXT), _F("canonical_code", _TEXT), _F("start_date", _DATE),
    _F("industry_code", _TEXT), _F("industry_name", _TEXT), _F("update_time", _TIME),
    _F("source_id", _TEXT), _F("raw_json", _TEXT), _F("loaded_at", _TIME),
])
FUNDAMENTAL_PAGE = (
    "result struct<pages:int,data:array<struct<REPORTDATE:string,NOTICE_DATE:string,"
    "UPDATE_DATE:string,DATATYPE:string,QDATE:string,TOTAL_OPERATE_INCOME:string,YSTZ:string,"
    "TOTAL_OPERATE_INCOME_YOY:string,PARENT_NETPROFIT:string,SJLTZ:string,"
    "PARENT_NETPROFIT_YOY:string,DEDUCT_PARENT_NETPROFIT:string,WEIGHTAVG_ROE:string,XSMLL:string>>>"
)
TODO_ARRAY = "array<struct<text:string,type:string,created:bigint,lastDone:bigint>>"
