"""Quarterly fundamentals: paged JSON responses and archived CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import (
    availability_date, date_prefix, first_number, first_text, revision_id, to_number,
)
from ..schemas import FINANCIAL_QUARTERLY, FUNDAMENTAL_PAGE
from .landing import read_csv_by_header

ARCHIVE_FIELDS = [
    "SECURITY_CODE", "REPORT_DATE", "NOTICE_DATE", "UPDATE_DATE", "REPORT_TYPE",
    "TOTAL_OPERATE_INCOME", "TOTAL_OPERATE_INCOME_YOY", "PARENT_NETPROFIT",
    "PARENT_NETPROFIT_YOY", "DEDUCT_PARENT_NETPROFIT",
]


def parse_fundamental_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per record of each landed page; a missing or NULL result gives none.

    Page columns (code, page number) are kept and ``pos`` is the place within
    the page, so arrival order survives the explode.
    """
    keep = [c for c in pages.columns if c != body]
    return (
        pages.select(*keep, F.from_json(body, FUNDAMENTAL_PAGE).alias("_j"))
        .select(*keep, F.posexplode("_j.result.data").alias("pos", "_r"))
        .select(*keep, "pos", "_r.*")
    )


def read_fundamental_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages landed as JSON lines with the request's code and page number beside the body."""
    return parse_fundamental_pages(spark.read.schema("code string, page int, body string").json(path))


def read_fundamental_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived CSV rows as text, each file under its own header, with their landing order."""
    raw = read_csv_by_header(spark, path)
    cols = [
        (F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(c)
        for c in ARCHIVE_FIELDS
    ]
    return raw.select(*cols, "arrival")


def _target(rows: DataFrame, values: dict[str, Column], extra: list[str]) -> DataFrame:
    cols = []
    for field in FINANCIAL_QUARTERLY.fields:
        value = values.get(field.name, F.lit(None))
        cols.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*cols, *extra)


def _dated(rows: DataFrame, period: str) -> DataFrame:
    """Report period, announcement, update and availability; rows without the first or last drop."""
    dated = rows.withColumns(
        {
            "_rp": date_prefix(F.col(period)),
            "_ann": date_prefix(F.col("NOTICE_DATE")),
            "_upd": date_prefix(F.col("UPDATE_DATE")),
        }
    )
    dated = dated.withColumn("_av", availability_date(F.col("_ann"), F.col("_upd")))
    return dated.where("_rp is not null and _av is not null")


def _common(source_id: str, ingest_ts: Column | None) -> dict[str, Column]:
    now = F.current_timestamp() if ingest_ts is None else ingest_ts
    return {
        "report_period": F.col("_rp"),
        "ann_date": F.coalesce("_ann", "_av"),
        "available_date": F.col("_av"),
        "revision_id": revision_id(F.col("_ann"), F.col("_upd")),
        "update_date": F.col("_upd"),
        "source_id": F.lit(source_id),
        "ingest_ts": now,
        "source_asof": now.cast("date"),
    }


def normalise_primary(
    records: DataFrame, source_id: str = "S010", ingest_ts: Column | None = None
) -> DataFrame:
    """Page records in the fundamentals schema, first record per (code, period, revision).

    Keeps ``page`` and ``pos``. First-in-arrival is an aggregate, so repeated
    records shrink on the map side.
    """
    values = _common(source_id, ingest_ts) | {
        "code": F.col("code"),
        "report_type": first_text(F.col("DATATYPE"), F.col("QDATE")),
        "revenue_cny": first_number(F.col("TOTAL_OPERATE_INCOME")),
        "revenue_yoy_pct": first_number(F.col("YSTZ"), F.col("TOTAL_OPERATE_INCOME_YOY")),
        "net_profit_parent_cny": first_number(F.col("PARENT_NETPROFIT")),
        "net_profit_yoy_pct": first_number(F.col("SJLTZ"), F.col("PARENT_NETPROFIT_YOY")),
        "deduct_np_cny": first_number(F.col("DEDUCT_PARENT_NETPROFIT")),
        "roe_weighted_pct": first_number(F.col("WEIGHTAVG_ROE")),
        "gross_margin_pct": first_number(F.col("XSMLL")),
    }
    rows = _target(_dated(records, "REPORTDATE"), values, ["page", "pos"])
    return keep_first(rows, ["code", "report_period", "revision_id"], ["page", "pos"])


def normalise_archive(
    records: DataFrame, source_id: str = "S015", ingest_ts: Column | None = None
) -> DataFrame:
    """Archive records in the fundamentals schema with ``arrival``; duplicates fold on merge."""
    values = _common(source_id, ingest_ts) | {
        "code": F.col("SECURITY_CODE"),
        "report_type": first_text(F.col("REPORT_TYPE")),
        "revenue_cny": to_number(F.col("TOTAL_OPERATE_INCOME")),
        "revenue_yoy_pct": to_number(F.col("TOTAL_OPERATE_INCOME_YOY")),
        "net_profit_parent_cny": to_number(F.col("PARENT_NETPROFIT")),
        "net_profit_yoy_pct": to_number(F.col("PARENT_NETPROFIT_YOY")),
        "deduct_np_cny": to_number(F.col("DEDUCT_PARENT_NETPROFIT")),
    }
    return _target(_dated(records, "REPORT_DATE"), values, ["arrival"])


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order."""
    rest = [c for c in rows.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(picked).select(*keys, "_first.*").select(*rows.columns)
