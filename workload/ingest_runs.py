"""Whole ingest runs from landed files to merged tables, with their awkward rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitspark.operators import merge as mg, metrics as mt
from pitspark.plans import ingest, membership
from pitspark.schemas import MARKET_DAILY
from pitspark.session import scratch_path
from pitspark.sources import bars as bar_source, seeds
from pitspark.sources.universe import read_universe

from .fixtures import Tables
from .membership import FLAGS_SQL
from .merges import BATCH_SQL, bar_batch, bar_merge_sql, old_bars
from .registry import query, rounded

TARGET_BEFORE, OVERLAP = "1995-01-01", "1998-01-01"


def _landed(t: Tables) -> str:
    """Two archive files that overlap in time: the later one raises the close by one, repeats each of
    its rows and has a row without a date per code."""
    root = scratch_path(t.spark, "overlap")
    bars = t.bars().select(
        "code", F.col("trade_date").alias("date"), *[F.col(f"{n}_qfq").alias(n) for n in ("open", "high", "low")],
        F.col("close_qfq").alias("close"), F.col("volume_shares").alias("volume"), F.col("amount_cny").alias("amount"),
        F.col("turnover_pct").alias("turn"), F.lit(None).cast("double").alias("pctChg"),
    )
    bars.write.parquet(f"{root}/kline_1.parquet")
    late = bars.where(F.col("date") >= OVERLAP).withColumn("close", F.col("close") + 1)
    undated = late.select("code").distinct().join(late.limit(0), "code", "left").select(*bars.columns)
    late.union(late).union(undated).write.parquet(f"{root}/kline_2.parquet")
    return f"{root}/kline_*.parquet"


@query(
    "ingest_archive_bars",
    f"""SELECT code, trade_date,
          CASE WHEN current_member IS NULL THEN 0.0
               ELSE close_qfq + CASE WHEN trade_date >= DATE '{OVERLAP}' THEN 1 ELSE 0 END END AS close_qfq,
          CASE WHEN current_member IS NULL THEN NULL ELSE volume_shares END AS volume_shares,
          CASE WHEN current_member IS NULL OR trade_date < DATE '{TARGET_BEFORE}' THEN 'T' ELSE 'S014' END AS source_id
        FROM fx_bars LEFT JOIN (SELECT code, current_member FROM fx_company WHERE current_member = 1) USING (code)
        WHERE current_member = 1 OR trade_date < DATE '{TARGET_BEFORE}'""",
    ["fx_bars", "fx_company"],
)
def ingest_archive_bars(t: Tables) -> DataFrame:
    """An archive over a table that already holds the early bars, with other closes."""
    early = t.bars().where(F.col("trade_date") < TARGET_BEFORE)
    target = early.select(*[
        {"close_qfq": F.lit(0.0), "source_id": F.lit("T"), "code": F.col("code"), "trade_date": F.col("trade_date")}
        .get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in MARKET_DAILY.fields
    ])
    universe = t.company().where("current_member = 1")
    batch = ingest.archive_bars(bar_source.read_bar_archive(t.spark, _landed(t), universe))
    merged = ingest.merge_bars(target, batch, primary=False)
    return merged.select("code", "trade_date", "close_qfq", "volume_shares", "source_id")


@query("merge_null_slice", bar_merge_sql(mg.FALLBACK_BAR_POLICY), ["fx_bars"], BATCH_SQL)
def merge_null_slice(t: Tables) -> DataFrame:
    """A batch with rows that have no date, merged by year: they are left out, all other years stay."""
    batch = bar_batch(t)
    undated = batch.where("code <= '000010'").withColumn("trade_date", F.lit(None).cast("date"))
    whole = mg.with_keys(batch.unionByName(undated), mg.BAR_KEYS)
    return rounded(mg.merge_touched(
        old_bars(t), whole, mg.BAR_KEYS, mg.FALLBACK_BAR_POLICY, "arrival", F.year("trade_date")))


@query(
    "universe_two_headers",
    """SELECT code, exchange, name FROM (
         SELECT printf('%06d', c_custkey) AS code, CASE WHEN c_custkey % 2 = 0 THEN 'BJ' ELSE 'SH' END AS exchange, c_name AS name
         FROM customer)""",
)
def universe_two_headers(t: Tables) -> DataFrame:
    """Two files with their columns in different order, and a third without a name column for rows seen before."""
    root = scratch_path(t.spark, "headers")
    rows = t.read("customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, "bj").otherwise("sh").alias("exchange"), "c_custkey",
    )
    rows.where("c_custkey % 2 = 0").select("code", "name", "exchange").write.option("header", True).csv(f"{root}/a")
    rows.where("c_custkey % 2 = 1").select("exchange", "name", "code").write.option("header", True).csv(f"{root}/b")
    rows.select("exchange", "code").write.option("header", True).csv(f"{root}/c")
    return read_universe(t.spark, f"{root}/*", "first")


SKEWED_SQL = """
  SELECT target, model, truth, CASE WHEN prob < 0.5 THEN pow(10, -20 * (1 - prob)) ELSE 1 - pow(2, -40 * prob) END AS prob
  FROM fx_scored"""


@query(
    "auc_skewed",
    """SELECT target, model,
         round((sum(CASE WHEN truth = 1 THEN rnk ELSE 0 END) - sum(truth) * (sum(truth) + 1) / 2.0)
           / (sum(truth) * (count(*) - sum(truth))), 6) + 0.0 AS auc
       FROM (
         SELECT target, model, truth, rank() OVER w + (count(*) OVER (PARTITION BY target, model, prob) - 1) / 2.0 AS rnk
         FROM s WINDOW w AS (PARTITION BY target, model ORDER BY prob))
       GROUP BY target, model""",
    ["fx_scored"], {"s": SKEWED_SQL},
)
def auc_skewed(t: Tables) -> DataFrame:
    """Scores crowded at 0 and at 1."""
    p = F.col("prob")
    crowded = F.when(p < 0.5, F.pow(F.lit(10.0), -20 * (1 - p))).otherwise(1 - F.pow(F.lit(2.0), -40 * p))
    return rounded(mt.exact_auc(t.scored().withColumn("prob", crowded), ["target", "model"]))


@query(
    "universe_export",
    """SELECT code, name, exchange, CAST(current_member_snapshot AS VARCHAR) AS current_member_snapshot,
         CAST(historical_member AS VARCHAR) AS historical_member, universe_status FROM flags""",
    ["fx_company", "fx_members"], {"flags": FLAGS_SQL},
)
def universe_export(t: Tables) -> DataFrame:
    """The universe written as CSV and read back as text."""
    path = membership.export_universe(t.company(), t.membership(), scratch_path(t.spark, "universe"))
    return t.spark.read.option("header", True).csv(path)


@query(
    "archive_ledger",
    """SELECT 'J001' AS job_id, 'FALLBACK' AS status,
         count(DISTINCT CASE WHEN close_qfq IS NOT NULL THEN code END) AS loaded_entities,
         count(*) FILTER (WHERE trade_date >= DATE '1998-01-01') AS loaded_rows,
         min(trade_date) AS min_date, max(trade_date) AS max_date FROM fx_bars""",
    ["fx_bars"],
)
def archive_ledger(t: Tables) -> DataFrame:
    """A batch of late bars reported against the whole table."""
    bars = t.bars()
    jobs = ingest.fallback_report(
        seeds.initial_jobs(t.spark), "J001", bars.where(F.col("trade_date") >= OVERLAP), bars, "trade_date",
        "close_qfq", t.company(),
    )
    return jobs.where("job_id = 'J001'").select(
        "job_id", "status", "loaded_entities", "loaded_rows", "min_date", "max_date")
