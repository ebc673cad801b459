"""Upserts by policy, keyed inserts, alias stitching and the choice among sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitspark.operators import aliases as al, merge as mg

from .fixtures import Tables
from .registry import query, rounded, sql_round

BAR_VALUES = [
    "open_qfq", "high_qfq", "low_qfq", "close_qfq", "volume_shares", "amount_cny", "turnover_pct",
]
BAR_COLUMNS = ["code", "trade_date", *BAR_VALUES, "is_trade"]


def old_bars(t: Tables) -> DataFrame:
    return t.bars().where("trade_date < date '2000-01-01'").select(*BAR_COLUMNS)


def bar_batch(t: Tables) -> DataFrame:
    """Later bars restated twice; every other day of the month lacks the turnover."""
    later = t.bars().where("trade_date >= date '1999-07-01'").withColumn(
        "turnover_pct", F.when(F.dayofmonth("trade_date") % 2 == 1, F.col("turnover_pct"))
    )
    copies = later.withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2))))
    factor = F.when(F.col("arrival") == 1, 1.01).otherwise(1.02)
    return copies.withColumn("close_qfq", F.col("close_qfq") * factor).withColumn(
        "is_trade", F.when(F.col("arrival") == 2, F.col("is_trade"))
    ).select(*BAR_COLUMNS, "arrival")


BATCH_SQL = {
    "copies": """
  SELECT * REPLACE (CASE WHEN day(trade_date) % 2 = 1 THEN turnover_pct END AS turnover_pct)
  FROM fx_bars WHERE trade_date >= DATE '1999-07-01'""",
    "steps": """
  SELECT *, 0 AS seq FROM fx_bars WHERE trade_date < DATE '2000-01-01'
  UNION ALL SELECT * REPLACE (close_qfq * 1.01 AS close_qfq, CAST(NULL AS INTEGER) AS is_trade), 1
  FROM copies
  UNION ALL SELECT * REPLACE (close_qfq * 1.02 AS close_qfq), 2 FROM copies""",
}
_SQL_FOLD = {
    mg.OVERWRITE: "arg_max_null({c}, seq)", mg.COALESCE: "arg_max({c}, seq)",
    mg.INSERT_ONLY: "arg_min_null({c}, seq)",
}


def fold_sql(keys: list[str], columns: list[str], policy: dict[str, str], exact: set[str]) -> str:
    """The merge as one row-by-row fold over target (step 0) and batch."""
    parts = []
    for c in columns:
        value = _SQL_FOLD[policy.get(c, mg.INSERT_ONLY)].format(c=c)
        parts.append(f"{value} AS {c}" if c in exact else f"round({value}, 6) + 0.0 AS {c}")
    k = ", ".join(keys)
    return f"SELECT {k}, {', '.join(parts)} FROM steps GROUP BY {k}"


def bar_merge_sql(policy: dict[str, str]) -> str:
    return fold_sql(["code", "trade_date"], [*BAR_VALUES, "is_trade"], policy, {"is_trade"})


def merged_bars(t: Tables, policy: dict[str, str]) -> DataFrame:
    return rounded(mg.merge_upsert(old_bars(t), bar_batch(t), mg.BAR_KEYS, policy, "arrival"))


@query("merge_overwrite", bar_merge_sql(mg.PRIMARY_BAR_POLICY), ["fx_bars"], BATCH_SQL)
def merge_overwrite(t: Tables) -> DataFrame:
    return merged_bars(t, mg.PRIMARY_BAR_POLICY)


@query("merge_coalesce", bar_merge_sql(mg.FALLBACK_BAR_POLICY), ["fx_bars"], BATCH_SQL)
def merge_coalesce(t: Tables) -> DataFrame:
    return merged_bars(t, mg.FALLBACK_BAR_POLICY)


@query("merge_insert_only", bar_merge_sql({}), ["fx_bars"], BATCH_SQL)
def merge_insert_only(t: Tables) -> DataFrame:
    return merged_bars(t, {})


@query("merge_touched_years", bar_merge_sql(mg.FALLBACK_BAR_POLICY), ["fx_bars"], BATCH_SQL)
def merge_touched(t: Tables) -> DataFrame:
    return rounded(
        mg.merge_touched(
            old_bars(t), bar_batch(t), mg.BAR_KEYS, mg.FALLBACK_BAR_POLICY, "arrival",
            F.year("trade_date"),
        )
    )


FACT_VALUES = ["revenue_yoy_pct", "net_profit_yoy_pct", "roe_weighted_pct", "gross_margin_pct"]
FACT_COLUMNS = [*mg.FACT_KEYS, "available_date", *FACT_VALUES]
FACT_STEPS = {
    "steps": f"""
  SELECT {", ".join(FACT_COLUMNS)}, -1 AS seq FROM fx_facts WHERE ann_date < DATE '1999-01-01'
  UNION ALL
  SELECT {", ".join(mg.FACT_KEYS)}, available_date + 1, revenue_yoy_pct * 2,
    net_profit_yoy_pct * 2, roe_weighted_pct * 2, NULL, arrival
  FROM fx_arrivals WHERE ann_date >= DATE '1998-07-01'"""
}


def merged_facts(t: Tables, policy: dict[str, str]) -> DataFrame:
    old = t.facts().where("ann_date < date '1999-01-01'").select(*FACT_COLUMNS)
    doubled = {c: F.col(c) * 2 for c in FACT_VALUES[:3]}
    batch = t.facts_with_arrival().where("ann_date >= date '1998-07-01'").withColumns(
        doubled | {"available_date": F.date_add("available_date", 1),
                   "gross_margin_pct": F.lit(None).cast("double")}
    ).select(*FACT_COLUMNS, "arrival")
    return rounded(mg.merge_upsert(old, batch, mg.FACT_KEYS, policy, "arrival"))


def fact_merge_sql(policy: dict[str, str]) -> str:
    return fold_sql(mg.FACT_KEYS, ["available_date", *FACT_VALUES], policy, {"available_date"})


@query("merge_facts_primary", fact_merge_sql(mg.PRIMARY_FACT_POLICY), ["fx_facts"], FACT_STEPS)
def merge_facts_primary(t: Tables) -> DataFrame:
    return merged_facts(t, mg.PRIMARY_FACT_POLICY)


@query("merge_facts_archive", fact_merge_sql(mg.ARCHIVE_FACT_POLICY), ["fx_facts"], FACT_STEPS)
def merge_facts_archive(t: Tables) -> DataFrame:
    return merged_facts(t, mg.ARCHIVE_FACT_POLICY)


def snapshot(t: Tables, source_id: str) -> DataFrame:
    return t.company().select(
        "code", "current_member", F.lit("220303").alias("sw_code"), F.col("name").alias("sw_name"),
        F.lit("2026-01-21").cast("date").alias("snapshot_date"),
        F.lit(source_id).alias("source_id"),
    )


@query(
    "insert_ignore",
    """SELECT code, '220303' AS sw_code, name AS sw_name, DATE '2026-01-21' AS snapshot_date,
         CASE WHEN current_member = 1 THEN 'S000' ELSE 'S001' END AS source_id
       FROM fx_company""",
    ["fx_company"],
)
def insert_ignore(t: Tables) -> DataFrame:
    """Only current members exist already; all companies are inserted."""
    existing = snapshot(t, "S000").where("current_member = 1").drop("current_member")
    incoming = snapshot(t, "S001").drop("current_member")
    return mg.insert_ignore(existing, incoming, ["code", "sw_code", "snapshot_date"])


@query(
    "insert_or_replace",
    """SELECT code, CASE WHEN current_member = 1 THEN upper(name) ELSE name END AS name,
         CASE WHEN current_member = 1 THEN NULL ELSE 'old' END AS note
       FROM fx_company""",
    ["fx_company"],
)
def insert_or_replace(t: Tables) -> DataFrame:
    """Current members are written again without a note."""
    existing = t.company().select("code", "name", F.lit("old").alias("note"))
    incoming = t.company().where("current_member = 1").select("code", F.upper("name").alias("name"))
    return mg.insert_or_replace(existing, incoming, ["code"])


@query(
    "replace_source",
    """SELECT code, in_date, end_exclusive - 1 AS out_date, 'S900' AS source_id FROM fx_islands
       WHERE industry_code LIKE '%220803%'
       UNION ALL SELECT code, in_date, end_exclusive, 'S013' FROM fx_islands""",
    ["fx_islands"],
)
def replace_source(t: Tables) -> DataFrame:
    """Rows of one source give way to a new set, those of the other stay."""
    islands = t.islands()
    other = F.col("industry_code").contains("220803")
    existing = islands.select(
        "code", "in_date", F.date_sub("end_exclusive", 1).alias("out_date"),
        F.when(other, "S900").otherwise("S013").alias("source_id"),
    )
    fresh = islands.select(
        "code", "in_date", F.col("end_exclusive").alias("out_date"), F.lit("S013").alias("source_id")
    )
    return mg.replace_source(existing, fresh, "S013")


@query(
    "alias_stitch",
    f"""SELECT code, trade_date, {sql_round(["close_qfq", "volume_shares"])} FROM (
          SELECT a.canonical_code AS code, b.trade_date, b.close_qfq, b.volume_shares,
            row_number() OVER (PARTITION BY a.canonical_code, b.trade_date
              ORDER BY a.alias_rank DESC) AS rn
          FROM fx_bars b JOIN fx_alias a ON a.historical_code = b.code
            AND (a.valid_from IS NULL OR b.trade_date >= a.valid_from)
            AND (a.valid_to IS NULL OR b.trade_date <= a.valid_to)
          UNION ALL
          SELECT code, trade_date, close_qfq, volume_shares, 1 FROM fx_bars
          WHERE code NOT IN (SELECT canonical_code FROM fx_alias))
        WHERE rn = 1""",
    ["fx_bars", "fx_alias"],
)
def alias_stitch(t: Tables) -> DataFrame:
    bars = t.bars().select("code", "trade_date", "close_qfq", "volume_shares")
    return rounded(al.alias_stitch(bars, t.alias()))


@query(
    "raw_adjusted",
    """SELECT r.code, r.trade_date, r.close_qfq AS close_raw, a.close_qfq * 2 AS close_qfq,
         a.high_qfq * 2 AS high_qfq
       FROM fx_bars r LEFT JOIN fx_trad a ON a.code = r.code AND a.trade_date = r.trade_date""",
    ["fx_bars", "fx_trad"],
)
def raw_adjusted(t: Tables) -> DataFrame:
    raw = t.bars().select("code", "trade_date", F.col("close_qfq").alias("close_raw"))
    adjusted = t.bars().where("is_trade is null or is_trade = 1").select(
        "code", "trade_date", (F.col("close_qfq") * 2).alias("close_qfq"),
        (F.col("high_qfq") * 2).alias("high_qfq"),
    )
    return al.raw_with_adjusted(raw, adjusted, ["close_qfq", "high_qfq"])


def ranked_facts(t: Tables) -> DataFrame:
    """Fundamentals as fetched under several candidate listings of a company."""
    return t.fundamentals().select(
        "code", "ann_date", "arrival", (F.col("arrival") % 4 + 1).cast("int").alias("rank")
    )


FIRST_SQL = """
  SELECT code, ann_date, arrival, CAST(arrival % 4 + 1 AS INTEGER) AS rank FROM fx_fund"""


@query(
    "first_source",
    """SELECT code, ann_date, arrival, rank
       FROM (SELECT *, min(rank) OVER (PARTITION BY code) AS best FROM r) WHERE rank = best""",
    ["fx_fund"], {"r": FIRST_SQL},
)
def first_source(t: Tables) -> DataFrame:
    return al.first_source(ranked_facts(t), "code", "rank")


@query(
    "first_archive_file",
    """SELECT r.* FROM r JOIN (
         SELECT code, min(rank) AS best FROM files WHERE n_bytes > 100 AND parsed GROUP BY code) f
         ON f.code = r.code AND f.best = r.rank""",
    ["fx_fund", "fx_company"],
    {
        "r": FIRST_SQL,
        "files": """
  SELECT code, rank, 60 * count(*) AS n_bytes, true AS parsed FROM r GROUP BY code, rank
  UNION ALL
  SELECT code, 0, 500, current_member = 1 FROM fx_company""",
    },
)
def first_archive_file(t: Tables) -> DataFrame:
    """A readable file of rank 0 without rows beats later ones; short files do not count."""
    rows = ranked_facts(t)
    files = rows.groupBy("code", "rank").agg(
        (F.count("*") * 60).alias("n_bytes"), F.lit(True).alias("parsed")
    ).unionByName(
        t.company().select(
            "code", F.lit(0).alias("rank"), F.lit(500).cast("long").alias("n_bytes"),
            (F.col("current_member") == 1).alias("parsed"),
        )
    )
    return al.first_source(rows, "code", "rank", al.archive_candidates(files))
