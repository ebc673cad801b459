"""Ingestion of bars and fundamentals from landed files into the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..operators import aliases as al, landed as ld, merge as mg, quality as ql
from ..operators.features import with_prev_close
from ..schemas import FINANCIAL_QUARTERLY, MARKET_DAILY
from ..session import materialize
from ..sources import bars as bar_source, fundamentals as fund, versions


class IngestError(RuntimeError):
    """Not one entity of the universe was loaded."""


ADJUSTED = ["open_qfq", "high_qfq", "low_qfq", "close_qfq"]


# --- what a job loads -----------------------------------------------------------

@dataclass(frozen=True)
class Loaded:
    """A batch written once, with what was observed while it was written."""

    batch: DataFrame
    rows: int
    entities: int


def load_batch(batch: DataFrame, name: str = "batch") -> Loaded:
    """Write ``batch`` and count its rows in the same job; its codes come from the written column alone."""
    seen = Observation()
    written = materialize(batch.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    entities = written.agg(F.countDistinct("code")).first()[0]
    return Loaded(written, seen.get["rows"], entities)


def _as_loaded(batch: DataFrame | Loaded) -> Loaded:
    return batch if isinstance(batch, Loaded) else load_batch(batch)


# --- bars -----------------------------------------------------------------------

@dataclass(frozen=True)
class LineRun:
    """Landed lines of one price basis: the bars they give, the rejects, and the account of all lines."""

    bars: DataFrame
    rejects: DataFrame
    accounts: DataFrame


def run_lines(lines: DataFrame, alias: DataFrame, universe: DataFrame) -> LineRun:
    """Parse, route and account for landed lines; the lines are read by one job, which also counts them."""
    seen = Observation()
    parsed = materialize(
        ld.parsed_lines(lines).observe(seen, F.count(F.lit(1)).alias("landed")), "landed-lines")
    routed = ld.routed_lines(parsed, alias, universe)
    accepted = materialize(ld.accepted_bars(routed), "accepted-bars")
    return LineRun(
        accepted.drop("landed"), ld.rejected_lines(routed), ld.line_accounts(routed, seen.get["landed"], accepted))


def _series(lines: DataFrame, alias: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars of one price basis, without the account of their lines.

    Parsed lines are written, for their fields are read twice, and so are the bars.
    """
    parsed = materialize(ld.parsed_lines(lines), "landed-lines")
    return materialize(ld.accepted_bars(ld.routed_lines(parsed, alias, universe)).drop("landed"), "accepted-bars")


def primary_bars(
    raw_lines: DataFrame, adjusted_lines: DataFrame, alias: DataFrame, universe: DataFrame,
    source_id: str = "S009", ingest_ts: Column | None = None,
) -> DataFrame:
    """Text payloads in the bar schema; raw bars drive, adjusted prices join by day.

    A day landed twice counts once, with the line that arrived last (``arrival``; where the lines have none, the
    greatest line).
    """
    raw = _series(raw_lines, alias, universe)
    adjusted = raw if adjusted_lines is raw_lines else _series(adjusted_lines, alias, universe)
    return bars_of_lines(raw, adjusted, source_id, ingest_ts)


def bars_of_lines(
    raw: DataFrame, adjusted: DataFrame, source_id: str = "S009", ingest_ts: Column | None = None,
) -> DataFrame:
    """The bars of both price bases in the bar schema."""
    names = ("open", "high", "low", "close")
    raw = raw.withColumnsRenamed({n: f"{n}_raw" for n in names})
    adjusted = adjusted.withColumnsRenamed({n: f"{n}_qfq" for n in names})
    bars = al.raw_with_adjusted(with_prev_close(raw), adjusted, ADJUSTED)
    now = F.current_timestamp() if ingest_ts is None else ingest_ts
    bars = bars.withColumnsRenamed(
        {"pct": "pct_chg_pct", "volume": "volume_shares", "amount": "amount_cny",
         "turnover": "turnover_pct", "amplitude": "amplitude_pct", "change": "change_amt"}
    ).withColumns(
        {"is_trade": F.lit(1), "source_id": F.lit(source_id), "ingest_ts": now}
    )
    return _conform(bars)


def archive_bars(bars: DataFrame, source_id: str = "S014") -> DataFrame:
    """Archive rows in the bar schema, with their ``arrival`` if the scan gave one."""
    return _conform(bar_source.normalise_archive_bars(bars, source_id))


def _conform(df: DataFrame) -> DataFrame:
    """All columns of the bar table, absent ones NULL, and ``arrival`` where there is one."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in MARKET_DAILY.fields
        ],
        *[F.col(c) for c in ("arrival",) if c in df.columns],
    )


def rejected_bars(batch: DataFrame) -> DataFrame:
    """Rows of a batch without a date or code; a merge leaves them out."""
    return mg.without_keys(batch, mg.BAR_KEYS)


def merge_bars(target: DataFrame, batch: DataFrame, primary: bool, order: str | None = None) -> DataFrame:
    """Upsert a batch; only the years it touches are joined.

    Rows apply in the order of ``order``, by default of the batch's ``arrival``; a batch
    without either must hold each key once. Rows without a whole key (``rejected_bars``)
    are not merged.
    """
    policy = mg.PRIMARY_BAR_POLICY if primary else mg.FALLBACK_BAR_POLICY
    if order is None and "arrival" in batch.columns:
        order = "arrival"
    keyed = mg.with_keys(batch, mg.BAR_KEYS)
    part = F.year("trade_date")
    if "year" in target.columns:  # the partition column of a stored table: the split is a partition filter
        keyed, part = keyed.withColumn("year", part), F.col("year")
    return mg.merge_touched(target, keyed, mg.BAR_KEYS, policy, order, part)


def candidates(universe: DataFrame, alias: DataFrame) -> DataFrame:
    """(code, listing, rank): a company's own code first, then its other listings."""
    own = universe.select("code", F.col("code").alias("listing"), F.lit(0).alias("rank"))
    others = al.ranked_aliases(alias).where("historical_code <> canonical_code").select(
        F.col("canonical_code").alias("code"), F.col("historical_code").alias("listing"),
        F.col("alias_rank").cast("int").alias("rank"),
    )
    return own.unionByName(others.join(universe.select("code"), "code", "left_semi"))


def whole_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages of each listing's last whole fetch, ledger of all fetches) of (code, fetch, page, arrival, body)."""
    facts = materialize(ld.page_facts(pages), "landed-pages")
    ledger = ld.page_ledger(facts)
    return ld.last_whole_pages(facts, ledger).select("code", "page", "body"), ledger


def primary_facts(pages: DataFrame, universe: DataFrame, alias: DataFrame) -> DataFrame:
    """Landed pages (listing in ``code``) to facts of the first listing that has records."""
    records = fund.parse_fundamental_pages(pages).withColumnRenamed("code", "listing")
    ranked = records.join(candidates(universe, alias), "listing")
    return fund.normalise_primary(al.first_source(ranked, "code", "rank"))


def archive_facts(
    files: DataFrame, records: DataFrame, universe: DataFrame, alias: DataFrame, min_bytes: int = 100,
) -> DataFrame:
    """Archived records to facts of the first listing whose file was found.

    ``files`` has (listing, n_bytes, parsed), a row per archive file; ``records`` the rows
    of the files (listing, the archive's fields, arrival). A listing's file counts if it is
    larger than ``min_bytes`` and was readable, even if it then holds no row.
    """
    ranked = candidates(universe, alias)
    found = al.archive_candidates(files.join(ranked, "listing"), min_bytes)
    rows = records.drop("code").join(ranked, "listing")
    best = al.first_source(rows, "code", "rank", found)
    return fund.normalise_archive(best.withColumn("SECURITY_CODE", F.col("code")))


def merge_facts(target: DataFrame, batch: DataFrame, primary: bool, order: str | list[str] | None) -> DataFrame:
    policy = mg.PRIMARY_FACT_POLICY if primary else mg.ARCHIVE_FACT_POLICY
    return mg.merge_upsert(target, batch, mg.FACT_KEYS, policy, order)


def publish_bars(
    spark: SparkSession, root: str, loaded: Loaded, primary: bool, order: str | None = None,
) -> versions.Snapshot:
    """Merge a batch into the stored bars, partitioned by year, and commit the next version."""
    batch = loaded.batch

    def change(old: DataFrame | None) -> DataFrame:
        if old is None:
            old = spark.createDataFrame([], MARKET_DAILY).withColumn("year", F.lit(None).cast("int"))
        return merge_bars(old, batch, primary, order)

    return versions.update(spark, root, change, ["year"], {"rows": loaded.rows, "entities": loaded.entities})


def publish_facts(
    spark: SparkSession, root: str, loaded: Loaded, primary: bool, order: str | list[str] | None,
) -> versions.Snapshot:
    """Merge a batch into the stored facts and commit the next version."""
    def change(old: DataFrame | None) -> DataFrame:
        old = spark.createDataFrame([], FINANCIAL_QUARTERLY) if old is None else old
        return merge_facts(old, loaded.batch, primary, order)

    return versions.update(spark, root, change, info={"rows": loaded.rows, "entities": loaded.entities})


def fallback_report(
    jobs: DataFrame, job_id: str, batch: DataFrame | Loaded, table: DataFrame, date: str, value: str,
    universe: DataFrame, status: str = "FALLBACK",
) -> DataFrame:
    """Ledger after an archive run: rows of the batch, entities with a value over the whole table."""
    loaded = _as_loaded(batch)
    numbers = ql.coverage(table, date, value).select(
        F.lit(universe.select("code").distinct().count()).alias("target_entities"), "loaded_entities",
        F.lit(loaded.rows).alias("loaded_rows"),
        "min_date", "max_date", F.lit(status).alias("status"), F.current_timestamp().alias("last_attempt_ts"),
    )
    return ql.ledger_update(jobs, job_id, numbers, f"archive run {status}")


def source_entry(
    registry: DataFrame, source_id: str, layer: str, name: str, url: str, coverage: str, kind: str,
    reliability: str, status: str, notes: str,
) -> DataFrame:
    """The source registry after a run announced its source, an earlier row of it replaced."""
    values = (source_id, layer, name, url, coverage, kind, reliability, status, notes)
    entry = registry.sparkSession.createDataFrame([values], registry.schema)
    return mg.insert_or_replace(registry, entry, ["source_id"])


def report(
    jobs: DataFrame, job_id: str, batch: DataFrame | Loaded, table: DataFrame, date: str, universe: DataFrame,
    status: str = "FETCHED",
) -> DataFrame:
    """Ledger after an ingest: counters of the batch, date range of the whole table."""
    loaded = _as_loaded(batch)
    numbers = ql.coverage(table, date).select(
        F.lit(universe.select("code").distinct().count()).alias("target_entities"),
        F.lit(loaded.entities).alias("loaded_entities"), F.lit(loaded.rows).alias("loaded_rows"), "min_date", "max_date",
        F.lit(status if loaded.entities else "FAILED").alias("status"), F.current_timestamp().alias("last_attempt_ts"),
    )
    return ql.ledger_update(jobs, job_id, numbers, f"ingest {status if loaded.entities else 'FAILED'}")


def require_loaded(batch: DataFrame) -> DataFrame:
    if batch.isEmpty():
        raise IngestError("no entity was loaded")
    return batch
