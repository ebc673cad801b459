"""Coverage, load counters, the formal gate and the job ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitspark.operators import quality as ql
from pitspark.session import materialize
from pitspark.sources import seeds
from pitspark.sources.bars import tradable_bars

from .fixtures import Tables
from .membership import ACTIVE_SQL, AUDIT_SQL, audit_of
from .registry import query


@query(
    "coverage_bars",
    """SELECT count(DISTINCT CASE WHEN turnover_pct IS NOT NULL THEN code END) AS loaded_entities,
         min(trade_date) AS min_date, max(trade_date) AS max_date FROM fx_bars""",
    ["fx_bars"],
)
def coverage_bars(t: Tables) -> DataFrame:
    return ql.coverage(t.bars(), "trade_date", "turnover_pct")


@query(
    "coverage_facts",
    """SELECT count(DISTINCT code) AS loaded_entities, min(available_date) AS min_date,
         max(available_date) AS max_date FROM fx_facts""",
    ["fx_facts"],
)
def coverage_facts(t: Tables) -> DataFrame:
    return ql.coverage(t.facts(), "available_date")


@query(
    "ingest_outcome",
    """SELECT count(DISTINCT code) AS loaded_entities, count(*) AS loaded_rows,
         CASE WHEN count(DISTINCT code) > 0 THEN 'FETCHED' ELSE 'FAILED' END AS status
       FROM fx_bars""",
    ["fx_bars"],
)
def ingest_outcome(t: Tables) -> DataFrame:
    return ql.ingest_outcome(ql.load_counters(t.bars()))


def jobs_of(t: Tables, members: DataFrame | None = None) -> DataFrame:
    """Ledger after the membership audit reported for J003."""
    numbers = audit_of(t, members).agg(
        F.when(F.count(F.when(F.col("status") == "MISSING_OFFICIAL", 1)) == 0, "LOADED")
        .otherwise("AUDIT_FAILED").alias("status"),
        F.sum("expected_current").alias("target_entities"),
    )
    return ql.ledger_update(seeds.initial_jobs(t.spark), "J003", numbers, "audited")


GATE_SQL = """
  SELECT (SELECT CASE WHEN count(*) FILTER (WHERE status = 'MISSING_OFFICIAL') = 0 THEN 'LOADED'
            ELSE 'AUDIT_FAILED' END FROM audit) AS job_status,
    (SELECT count(*) FROM fx_members) AS membership_rows,
    (SELECT count(DISTINCT code) FROM fx_members) AS membership_codes,
    (SELECT count(*) FROM fx_trad) AS market_rows,
    (SELECT count(DISTINCT code) FROM fx_trad) AS market_codes,
    (SELECT count(DISTINCT code) FROM fx_members
      WHERE code NOT IN (SELECT code FROM fx_trad)) AS missing_codes"""


@query(
    "gate_report",
    """SELECT *, CASE WHEN formal_ok THEN 'FORMAL' ELSE 'PARTIAL' END AS run_status
       FROM (SELECT *, job_status = 'LOADED' AND membership_rows > 0 AND market_rows > 5000
                AND missing_codes = 0 AS formal_ok FROM g)""",
    ["fx_members", "fx_trad", "fx_company"],
    {"active": ACTIVE_SQL, "audit": AUDIT_SQL, "g": GATE_SQL},
)
def gate_report(t: Tables) -> DataFrame:
    members = materialize(t.membership(), "gate-members")  # built once, read by the audit and the gate
    return ql.gate_report(members, tradable_bars(t.bars()), jobs_of(t, members))


@query(
    "gate_missing",
    "SELECT DISTINCT code FROM fx_members WHERE code NOT IN (SELECT code FROM fx_trad)",
    ["fx_members", "fx_trad"],
)
def gate_missing(t: Tables) -> DataFrame:
    return ql.gate_missing(t.membership(), tradable_bars(t.bars()))


@query(
    "job_ledger",
    """SELECT j.job_id, j.source_id,
         CASE WHEN j.job_id = 'J001' THEN 'FETCHED' ELSE 'PIPELINE_READY' END AS status,
         j.target_entities,
         CASE WHEN j.job_id = 'J001' THEN s.entities ELSE 0 END AS loaded_entities,
         CASE WHEN j.job_id = 'J001' THEN s.n ELSE 0 END AS loaded_rows,
         CASE WHEN j.job_id = 'J001' THEN s.lo END AS min_date,
         CASE WHEN j.job_id = 'J001' THEN s.hi END AS max_date,
         CASE WHEN j.job_id = 'J001' THEN concat('loaded ', s.entities, ' codes') ELSE j.note END
           AS note
       FROM (VALUES ('J001', 'S009', 33, 'market ingestion'),
                    ('J002', 'S010', 33, 'point-in-time fundamentals ingestion'),
                    ('J003', 'S013', NULL, 'historical membership required'))
              AS j(job_id, source_id, target_entities, note),
            (SELECT count(DISTINCT code) AS entities, count(*) AS n, min(trade_date) AS lo,
               max(trade_date) AS hi FROM fx_bars) s""",
    ["fx_bars"],
)
def job_ledger(t: Tables) -> DataFrame:
    """The market job reports entities, rows and the date range of the whole table."""
    numbers = t.bars().agg(
        F.countDistinct("code").alias("loaded_entities"), F.count("*").alias("loaded_rows"),
        F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date"),
    ).withColumn("status", F.lit("FETCHED"))
    note = F.format_string("loaded %d codes", "loaded_entities")
    jobs = ql.ledger_update(seeds.initial_jobs(t.spark), "J001", numbers, note)
    return jobs.drop("layer", "last_attempt_ts")
