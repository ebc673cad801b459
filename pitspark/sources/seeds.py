"""Seed tables packaged with the library (fixed, a few dozen rows)."""

from __future__ import annotations

import csv
import datetime as dt
from importlib import resources

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.scalars import exchange_of

SNAPSHOT_SOURCE = "S001"


# Fixed values shared by all master rows.
BOARDS = {"60": "沪市主板", "68": "科创板", "30": "创业板", "00": "深市主板", "92": "北交所"}
SECTORS = ("化工", "化学制品", "农药", "220303")
SNAPSHOT_DATE = dt.date(2026, 1, 21)
MASTER_URL = "https://www.lixinger.com/equity/industry/detail/sw/220303/220303/constituents/list"


def _read(file_name: str) -> list[dict[str, str | None]]:
    text = resources.files("pitspark.data").joinpath(file_name).read_text(encoding="utf-8")
    return [{k: v or None for k, v in row.items()} for row in csv.DictReader(text.splitlines())]


def company_master(spark: SparkSession) -> DataFrame:
    """Current members on the snapshot day; all but code and name follows from rules."""
    rows = [(seq, r["code"], r["name"]) for seq, r in enumerate(_read("company_master.csv"), 1)]
    base = spark.createDataFrame(rows, "seq int, code string, name string")
    exchange = exchange_of(F.col("code"))
    board = F.create_map(*[F.lit(x) for pair in BOARDS.items() for x in pair])
    values = {
        "company_id": F.concat_ws(".", F.lit("CN"), exchange, "code"),
        "exchange": exchange,
        "board": board[F.substring("code", 1, 2)],
        "sw_l1": F.lit(SECTORS[0]),
        "sw_l2": F.lit(SECTORS[1]),
        "sw_l3": F.lit(SECTORS[2]),
        "sw_code": F.lit(SECTORS[3]),
        "current_member": F.lit(1),
        "snapshot_date": F.lit(SNAPSHOT_DATE),
        "status_name": F.when(F.col("name").startswith("*ST"), "ST").otherwise("Normal"),
        "source_url": F.lit(MASTER_URL),
        "source_asof": F.lit(SNAPSHOT_DATE),
    }
    return base.withColumns(values).select(*schemas.COMPANY_MASTER.fieldNames())


def code_alias(spark: SparkSession) -> DataFrame:
    """Listing codes a company traded under, with inclusive validity (NULL = open)."""
    def day(text: str | None) -> dt.date | None:
        return dt.date.fromisoformat(text) if text else None

    rows = [
        (r["canonical_code"], r["historical_code"], r["exchange"], day(r["valid_from"]),
         day(r["valid_to"]), r["source_url"], r["note"])
        for r in _read("code_alias.csv")
    ]
    return spark.createDataFrame(rows, schemas.CODE_ALIAS)


def initial_jobs(spark: SparkSession) -> DataFrame:
    """The three ledger rows a fresh workspace starts with; ids, counts and states are fixed, the notes are ours."""
    rows = [
        ("J001", "market_daily", "S009", "PIPELINE_READY", 33, 0, 0, None, None, None,
         "market ingestion"),
        ("J002", "financial_quarterly", "S010", "PIPELINE_READY", 33, 0, 0, None, None, None,
         "point-in-time fundamentals ingestion"),
        ("J003", "industry_membership_history", "S013", "PIPELINE_READY", None, 0, 0, None, None,
         None, "historical membership required"),
    ]
    return spark.createDataFrame(rows, schemas.INGESTION_JOB)


def initial_meta(spark: SparkSession) -> DataFrame:
    """The rows of the key-value table a fresh workspace starts with; keys and the date are fixed, the wording is ours."""
    rows = [
        ("database_version", "bootstrap-v1"), ("snapshot_date", "2026-01-21"),
        ("formal_universe", "level-3 category, point in time"),
    ]
    return spark.createDataFrame(rows, schemas.META)


def snapshot_membership(master: DataFrame, source_id: str = SNAPSHOT_SOURCE) -> DataFrame:
    """Membership rows on the snapshot day, one per master row."""
    return master.select(
        "code", "sw_code", F.col("sw_l3").alias("sw_name"), "snapshot_date",
        F.lit(1).alias("is_member"), F.lit(source_id).alias("source_id"),
    )
