"""Membership build: history to intervals, replacement by source, audit and ledger."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import inclusive_end
from ..operators import intervals as iv, membership as mb
from ..operators.merge import insert_or_replace, replace_source
from ..operators.quality import ledger_update, membership_stats
from ..schemas import SOURCE_REGISTRY
from ..session import materialize
from ..sources.classification import read_history
from ..sources.landing import require_rows
from ..sources.sinks import write_csv, write_ordered_csv

# How the registry names the source.
SOURCE_ID = "S013"
SOURCE_URL = "https://www.swsresearch.com/swindex/pdf/SwClass2021/StockClassifyUse_stock.xls"
JOB_ID = "J003"


class AuditError(RuntimeError):
    """Expected current members are missing from the derived membership."""


@dataclass
class MembershipRun:
    raw: DataFrame
    history: DataFrame
    audit: DataFrame
    jobs: DataFrame
    registry: DataFrame
    intervals: DataFrame
    status: str


def build(
    landed: DataFrame, alias: DataFrame, master: DataFrame, jobs: DataFrame, registry: DataFrame,
    raw: DataFrame, history: DataFrame, asof: dt.date,
) -> MembershipRun:
    """New states of all tables a membership build touches."""
    rows = iv.dedupe_history(iv.canonical_codes(read_history(landed), alias))
    rows = materialize(rows, "classification")
    islands = iv.merge_islands(iv.in_category(iv.derive_intervals(rows)))
    islands = materialize(islands, "islands")
    require_rows(islands, "membership intervals")
    members = replace_source(history, iv.membership_rows(islands, SOURCE_ID), SOURCE_ID)
    audit = mb.membership_audit(master, members, asof)
    outcome = mb.audit_outcome(audit).first()
    numbers = membership_stats(islands).select(
        "*", F.lit(outcome.expected).alias("target_entities"),
        F.lit(SOURCE_ID).alias("source_id"), F.lit(outcome.status).alias("status"),
        F.current_timestamp().alias("last_attempt_ts"),
    )
    note = "classification history audited against current members"
    entry = registry.sparkSession.createDataFrame(
        [(SOURCE_ID, "industry_membership_history", "classification history", SOURCE_URL,
          "classification history of all stocks", "OFFICIAL_XLS", "HIGH", outcome.status,
          "intervals are derived before the category filter")],
        SOURCE_REGISTRY,
    )
    return MembershipRun(
        raw=replace_source(raw, iv.raw_rows(rows, SOURCE_ID), SOURCE_ID),
        history=members,
        audit=audit,
        jobs=ledger_update(jobs, JOB_ID, numbers, note),
        registry=insert_or_replace(registry, entry, ["source_id"]),
        intervals=islands.withColumn("out_date", inclusive_end(F.col("end_exclusive"))),
        status=outcome.status,
    )


def export_universe(master: DataFrame, membership: DataFrame, path: str) -> str:
    """Current and historical members with their flags as CSV, ordered by code."""
    return write_csv(mb.universe_flags(master, membership).orderBy("code"), path)


def export(run: MembershipRun, out_dir: str) -> None:
    """Write the audit and this run's intervals, open ends empty; fail afterwards unless the audit passed."""
    write_csv(run.audit.orderBy(F.desc("expected_current"), "code"), f"{out_dir}/membership_audit")
    write_ordered_csv(run.intervals, f"{out_dir}/membership_history", ["code", "in_date"])
    if run.status != "LOADED":
        raise AuditError(f"membership audit: {run.status}")
