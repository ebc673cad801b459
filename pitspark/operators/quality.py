"""Coverage, load counters, gates and the job ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import run_status
from ..schemas import INGESTION_JOB
from .merge import INSERT_ONLY, OVERWRITE, fold

MIN_BARS = 5000


class GateError(RuntimeError):
    """A run was stopped by its quality gate."""


def coverage(df: DataFrame, date: str, value: str | None = None) -> DataFrame:
    """Distinct codes (with ``value`` present, if named) and the date range of the whole table."""
    code = F.col("code") if value is None else F.when(F.col(value).isNotNull(), F.col("code"))
    return df.agg(
        F.countDistinct(code).alias("loaded_entities"),
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
    )


def load_counters(batch: DataFrame) -> DataFrame:
    """Entities with at least one row and all rows of a batch."""
    return batch.agg(
        F.countDistinct("code").alias("loaded_entities"), F.count("*").alias("loaded_rows")
    )


def ingest_outcome(counters: DataFrame, loaded_status: str = "FETCHED") -> DataFrame:
    """Add the run status: ``loaded_status`` once an entity was loaded, else FAILED."""
    return counters.withColumn(
        "status", F.when(F.col("loaded_entities") > 0, loaded_status).otherwise("FAILED")
    )


def membership_stats(islands: DataFrame) -> DataFrame:
    """Ledger numbers of a membership build from its half-open intervals."""
    return islands.agg(
        F.countDistinct("code").alias("loaded_entities"),
        F.count("*").alias("loaded_rows"),
        F.min("in_date").alias("min_date"),
        F.date_sub(F.max("end_exclusive"), 1).alias("max_date"),
    )


def _gate_codes(membership: DataFrame, bars: DataFrame, jobs: DataFrame | None, job_id: str) -> DataFrame:
    none = F.lit(None).cast("string")
    stacked = membership.select("code", F.lit(1).alias("m"), F.lit(0).alias("b"), none.alias("status"))
    stacked = stacked.unionByName(
        bars.select("code", F.lit(0).alias("m"), F.lit(1).alias("b"), none.alias("status"))
    )
    if jobs is not None:
        stacked = stacked.unionByName(
            jobs.where(F.col("job_id") == job_id).select(
                none.alias("code"), F.lit(0).alias("m"), F.lit(0).alias("b"), "status"
            )
        )
    return stacked.groupBy("code").agg(
        F.sum("m").alias("m"), F.sum("b").alias("b"), F.max("status").alias("status")
    )


def gate_report(
    membership: DataFrame, bars: DataFrame, jobs: DataFrame, job_id: str = "J003",
    min_bars: int = MIN_BARS,
) -> DataFrame:
    """One row deciding whether a run is formal. ``bars`` are the tradable ones.

    All inputs are stacked and reduced per code on the map side, so one small
    exchange answers every number. The missing codes are a table of their own
    (``gate_missing``), since a list in one row would grow with the universe.
    """
    per_code = _gate_codes(membership, bars, jobs, job_id)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    report = per_code.agg(
        F.max("status").alias("job_status"),
        total(F.col("m")).alias("membership_rows"),
        total((F.col("m") > 0).cast("int")).alias("membership_codes"),
        total(F.col("b")).alias("market_rows"),
        total((F.col("b") > 0).cast("int")).alias("market_codes"),
        total(((F.col("m") > 0) & (F.col("b") == 0)).cast("int")).alias("missing_codes"),
    )
    ok = (
        F.coalesce(F.col("job_status") == "LOADED", F.lit(False))
        & (F.col("membership_rows") > 0)
        & (F.col("market_rows") > min_bars)
        & (F.col("missing_codes") == 0)
    )
    return report.withColumn("formal_ok", ok).withColumn("run_status", run_status(ok))


def gate_missing(membership: DataFrame, bars: DataFrame) -> DataFrame:
    """Membership codes without a tradable bar."""
    return _gate_codes(membership, bars, None, "").where("m > 0 and b = 0").select("code")


def enforce_gate(report: DataFrame, allow_partial: bool = False) -> dict:
    """Read the one-row report and raise unless the run may go on."""
    row = report.first().asDict()
    if not row["formal_ok"] and not allow_partial:
        raise GateError(f"formal gate not met: {row}")
    if row["membership_rows"] == 0 or row["market_rows"] == 0:
        raise GateError(f"empty inputs: {row}")
    return row


def panel_summary(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count("*").alias("panel_rows"), F.countDistinct("code").alias("panel_codes")
    )


def run_summary(gate: DataFrame, summary: DataFrame, pooled: DataFrame) -> DataFrame:
    """One nested row: status, gate, panel size and the pooled metrics.

    Each input is one row, or one row per (target, model), hence the plain union
    and global reduction.
    """
    parts = [
        gate.select(F.struct(*gate.columns).alias("gate")),
        summary.select(F.struct(*summary.columns).alias("panel")),
        pooled.select(F.struct(*pooled.columns).alias("metric")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    merged = stacked.agg(
        F.first("gate", ignorenulls=True).alias("gate"),
        F.first("panel", ignorenulls=True).alias("panel"),
        F.array_sort(F.collect_list("metric")).alias("aggregate"),
    )
    return merged.select(
        run_status(F.col("gate.formal_ok")).alias("status"), "gate", "panel.*", "aggregate"
    )


def ledger_update(jobs: DataFrame, job_id: str, numbers: DataFrame, note: str | Column) -> DataFrame:
    """Ledger after one job reported: listed columns are set, all others kept.

    ``numbers`` is a one-row frame with any of the ledger's columns; ``note`` may
    refer to them. A job the ledger does not list is not added.
    """
    known = [c for c in INGESTION_JOB.fieldNames() if c in numbers.columns]
    text = F.lit(note) if isinstance(note, str) else note
    update = numbers.select(F.lit(job_id).alias("job_id"), *known, text.alias("note"))
    steps = jobs.withColumn("_step", F.lit(0)).unionByName(
        update.withColumn("_step", F.lit(1)), allowMissingColumns=True
    )
    policy = dict.fromkeys([*known, "note"], OVERWRITE)
    rest = [c for c in jobs.columns if c != "job_id"]
    folded = [fold(c, policy.get(c, INSERT_ONLY), F.col("_step")) for c in rest]
    return (
        steps.groupBy("job_id")
        .agg(*folded, F.min("_step").alias("_step"))
        .where("_step = 0")
        .select(*jobs.columns)
    )
