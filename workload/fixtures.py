"""Views that stand in for the workload's tables on the star-schema test data.

Each view is given twice: as a DataFrame (what runs on Spark) and as SQL text
(what the oracle runs). Both read whole tables; nothing is subset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitspark.functions.scalars import (
    availability_date, inclusive_end, pad_code, revision_id, slot_of,
)
from pitspark.operators.intervals import build_membership
from pitspark.operators.merge import FACT_KEYS, OVERWRITE, collapse_batch
from pitspark.session import bound_tasks

CUT_OVER = "1998-06-30"


class Tables:
    """Lazy readers of the test tables and the views built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        bound_tasks(spark)
        self.spark = spark
        self.dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def bars(self) -> DataFrame:
        """One bar per supplier and ship day.

        First and last price of a day ride in the low digits of the row's
        sequence number, which keeps the aggregate on plain longs.
        """
        px = (F.lit(100) + 2 * F.round(100 * (F.col("l_discount") - F.col("l_tax")))).cast("long")
        seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000 + F.col("px")
        lines = self.read("lineitem").select(
            pad_code(F.col("l_suppkey")).alias("code"),
            F.to_date("l_shipdate").alias("trade_date"),
            px.alias("px"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        )

        def price(agg: Column) -> Column:
            return agg.cast("double")

        no_turnover = (F.max("l_quantity") == 50) & (F.min("l_linenumber") == 5)
        first_line = F.min("l_linenumber")
        return lines.groupBy("code", "trade_date").agg(
            price(F.min(seq) % 1000).alias("open_qfq"),
            price(F.max("px")).alias("high_qfq"),
            price(F.min("px")).alias("low_qfq"),
            price(F.max(seq) % 1000).alias("close_qfq"),
            F.sum("l_quantity").alias("volume_shares"),
            F.sum("l_extendedprice").alias("amount_cny"),
            F.when(~no_turnover, F.sum("l_quantity") / 100).alias("turnover_pct"),
            F.when(first_line == 7, 0).when(first_line != 6, 1).alias("is_trade"),
        )

    def class_history(self) -> DataFrame:
        return (
            self.read("orders")
            .select(
                pad_code(F.col("o_custkey")).alias("source_code"),
                F.to_date("o_orderdate").alias("start_date"),
                F.when(F.col("o_orderpriority") == "1-URGENT", "220303")
                .when(F.col("o_orderpriority") == "2-HIGH", "220803")
                .otherwise("999999").alias("industry_code"),
            )
            .distinct()
        )

    def fundamentals(self) -> DataFrame:
        ann = F.to_date("o_orderdate")
        upd = F.when(
            F.col("o_orderstatus") != "F", F.date_add(ann, (F.col("o_orderkey") % 3).cast("int"))
        )
        return self.read("orders").select(
            pad_code(F.col("o_custkey")).alias("code"),
            F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("report_period"),
            ann.alias("ann_date"),
            upd.alias("update_date"),
            F.col("o_orderkey").alias("arrival"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") / 10000 - 20)
            .alias("revenue_yoy_pct"),
            (F.col("o_totalprice") / 5000 - 40).alias("net_profit_yoy_pct"),
            (F.col("o_custkey") % 30).cast("double").alias("roe_weighted_pct"),
            F.when(F.col("o_custkey") % 7 != 0, (F.col("o_orderkey") % 60).cast("double"))
            .alias("gross_margin_pct"),
        )

    def facts(self) -> DataFrame:
        """Fundamentals with availability and revision, one row per key."""
        rows = self.facts_with_arrival()
        policy = dict.fromkeys([c for c in rows.columns if c not in FACT_KEYS], OVERWRITE)
        return collapse_batch(rows, FACT_KEYS, policy, "arrival")

    def facts_with_arrival(self) -> DataFrame:
        ann, upd = F.col("ann_date"), F.col("update_date")
        return self.fundamentals().withColumns(
            {"available_date": availability_date(ann, upd), "revision_id": revision_id(ann, upd)}
        )

    def company(self) -> DataFrame:
        return self.read("customer").select(
            pad_code(F.col("c_custkey")).alias("code"),
            F.col("c_name").alias("name"),
            (F.col("c_mktsegment") == "BUILDING").cast("int").alias("current_member"),
        )

    def alias(self) -> DataFrame:
        """Suppliers in debt traded under the next code until the cut-over."""
        renamed = self.read("supplier").where("s_acctbal < 0")
        head = pad_code(F.col("s_suppkey")).alias("canonical_code")
        none = F.lit(None).cast("date")
        cut = F.lit(CUT_OVER).cast("date")
        before = renamed.select(
            head, pad_code(F.col("s_suppkey") + 1).alias("historical_code"),
            none.alias("valid_from"), cut.alias("valid_to"), F.lit(1).alias("alias_rank"),
        )
        after = renamed.select(
            head, pad_code(F.col("s_suppkey")).alias("historical_code"),
            F.date_add(cut, 1).alias("valid_from"), none.alias("valid_to"),
            F.lit(2).alias("alias_rank"),
        )
        return before.unionByName(after)

    def islands(self) -> DataFrame:
        return build_membership(self.class_history(), self.alias())

    def membership(self) -> DataFrame:
        """Membership rows with inclusive ends, as the panel reads them."""
        return self.islands().select(
            "code", "in_date", inclusive_end(F.col("end_exclusive")).alias("out_date")
        )

    def paint(self) -> DataFrame:
        slot = slot_of(F.col("ts"))
        span = (F.col("event_id") % 4).cast("int")
        return self.read("events").select(
            "user_id",
            F.when(F.col("event_id") % 2 == 0, "plan").otherwise("actual").alias("kind"),
            F.to_date("ts").alias("day"),
            slot.alias("start_slot"),
            F.least(F.lit(47), slot + span).alias("end_slot"),
            F.when(F.col("event_type") == "view", "bud").when(F.col("event_type") == "click", "wood")
            .when(F.col("event_type") == "purchase", "fruit")
            .when(F.col("event_type") == "signup", "water").otherwise("empty").alias("type"),
            F.col("event_id").alias("paint_order"),
        )

    def todos(self) -> DataFrame:
        day = F.to_date("ts")
        last = F.when(F.col("event_id") % 6 == 0, F.lit("2024-01-30").cast("date")).when(
            F.col("event_id") % 9 == 0, day
        )
        return self.read("events").select(
            F.col("event_id").alias("todo_id"), "user_id",
            F.when(F.col("event_id") % 3 == 0, "daily").otherwise("once").alias("type"),
            day.alias("created"), last.alias("last_done"),
        )

    def scored(self) -> DataFrame:
        """Two models' scores per line: one with heavy ties, one nearly without."""
        scores = F.array(
            F.struct(F.lit("coarse").alias("model"),
                     F.round(F.col("l_discount") * 10, 2).alias("prob")),
            F.struct(F.lit("fine").alias("model"),
                     (F.col("l_extendedprice") / 110000.0).alias("prob")),
        )
        return self.read("lineitem").select(
            F.lit("risk_label").alias("target"),
            F.year("l_shipdate").alias("test_year"),
            (F.col("l_returnflag") == "R").cast("int").alias("truth"),
            F.explode(scores).alias("_s"),
        ).select("target", "test_year", "truth", "_s.model", "_s.prob")


def _pad(expr: str) -> str:
    text = f"CAST({expr} AS VARCHAR)"
    return f"CASE WHEN length({text}) < 6 THEN lpad({text}, 6, '0') ELSE {text} END"


SQL = {
    "fx_bars": f"""
  SELECT code, trade_date,
    CAST(min(seq * 1000 + px) % 1000 AS DOUBLE) AS open_qfq,
    CAST(max(px) AS DOUBLE) AS high_qfq, CAST(min(px) AS DOUBLE) AS low_qfq,
    CAST(max(seq * 1000 + px) % 1000 AS DOUBLE) AS close_qfq,
    sum(l_quantity) AS volume_shares, sum(l_extendedprice) AS amount_cny,
    CASE WHEN max(l_quantity) = 50 AND min(l_linenumber) = 5 THEN NULL
         ELSE sum(l_quantity) / 100 END AS turnover_pct,
    CASE min(l_linenumber) WHEN 7 THEN 0 WHEN 6 THEN NULL ELSE 1 END AS is_trade
  FROM (SELECT {_pad("l_suppkey")} AS code, CAST(l_shipdate AS DATE) AS trade_date,
          CAST(100 + 2 * round(100 * (l_discount - l_tax)) AS BIGINT) AS px,
          l_orderkey * 8 + l_linenumber AS seq, l_quantity, l_extendedprice, l_linenumber
        FROM lineitem) li
  GROUP BY code, trade_date""",
    "fx_class": f"""
  SELECT DISTINCT {_pad("o_custkey")} AS source_code, CAST(o_orderdate AS DATE) AS start_date,
    CASE o_orderpriority WHEN '1-URGENT' THEN '220303' WHEN '2-HIGH' THEN '220803'
         ELSE '999999' END AS industry_code
  FROM orders""",
    "fx_fund": f"""
  SELECT {_pad("o_custkey")} AS code,
    CAST(date_trunc('quarter', o_orderdate) AS DATE) AS report_period,
    CAST(o_orderdate AS DATE) AS ann_date,
    CASE WHEN o_orderstatus = 'F' THEN NULL
         ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) END AS update_date,
    o_orderkey AS arrival,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice / 10000 - 20 END
      AS revenue_yoy_pct,
    o_totalprice / 5000 - 40 AS net_profit_yoy_pct,
    CAST(o_custkey % 30 AS DOUBLE) AS roe_weighted_pct,
    CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) END
      AS gross_margin_pct
  FROM orders""",
    "fx_arrivals": """
  SELECT *, greatest(ann_date, update_date) AS available_date,
    coalesce(CAST(update_date AS VARCHAR), CAST(ann_date AS VARCHAR), '0') AS revision_id
  FROM fx_fund""",
    "fx_facts": """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY code, report_period, ann_date, revision_id
        ORDER BY arrival DESC) AS rn FROM fx_arrivals)
  WHERE rn = 1""",
    "fx_company": f"""
  SELECT {_pad("c_custkey")} AS code, c_name AS name,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS current_member
  FROM customer""",
    "fx_alias": f"""
  SELECT {_pad("s_suppkey")} AS canonical_code, {_pad("s_suppkey + 1")} AS historical_code,
    CAST(NULL AS DATE) AS valid_from, DATE '{CUT_OVER}' AS valid_to, 1 AS alias_rank
  FROM supplier WHERE s_acctbal < 0
  UNION ALL
  SELECT {_pad("s_suppkey")}, {_pad("s_suppkey")}, DATE '{CUT_OVER}' + 1, CAST(NULL AS DATE), 2
  FROM supplier WHERE s_acctbal < 0""",
    "fx_canon": """
  SELECT historical_code, canonical_code FROM (
    SELECT *, row_number() OVER (PARTITION BY historical_code
        ORDER BY valid_from DESC NULLS LAST, canonical_code DESC) AS rn FROM fx_alias)
  WHERE rn = 1""",
    "fx_dedup": """
  SELECT coalesce(a.canonical_code, h.source_code) AS code, h.start_date, h.industry_code,
    max(h.source_code) AS source_code
  FROM fx_class h LEFT JOIN fx_canon a ON a.historical_code = h.source_code
  GROUP BY 1, 2, 3""",
    "fx_intervals": """
  SELECT code, source_code, industry_code, start_date AS in_date,
    lead(start_date) OVER (PARTITION BY code ORDER BY start_date, industry_code) AS end_exclusive
  FROM fx_dedup""",
    "fx_islands": """
  SELECT code, arg_min(source_code, n) AS source_code,
    string_agg(industry_code, '->' ORDER BY n) AS industry_code, min(in_date) AS in_date,
    CASE WHEN count(*) = count(end_exclusive) THEN max(end_exclusive) END AS end_exclusive
  FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY code ORDER BY n) AS island FROM (
      SELECT *, row_number() OVER w AS n,
        CASE WHEN lag(end_exclusive) OVER w = in_date THEN 0 ELSE 1 END AS fresh
      FROM fx_intervals WHERE industry_code IN ('220303', '220803')
      WINDOW w AS (PARTITION BY code ORDER BY in_date, industry_code)))
  GROUP BY code, island""",
    "fx_members": """
  SELECT code, in_date, end_exclusive - 1 AS out_date FROM fx_islands""",
    "fx_paint": """
  SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'plan' ELSE 'actual' END AS kind,
    CAST(ts AS DATE) AS day,
    CAST(extract(HOUR FROM ts) * 2 + floor(extract(MINUTE FROM ts) / 30) AS INTEGER) AS start_slot,
    CAST(least(47, extract(HOUR FROM ts) * 2 + floor(extract(MINUTE FROM ts) / 30) + event_id % 4)
      AS INTEGER) AS end_slot,
    CASE event_type WHEN 'view' THEN 'bud' WHEN 'click' THEN 'wood' WHEN 'purchase' THEN 'fruit'
      WHEN 'signup' THEN 'water' ELSE 'empty' END AS type,
    event_id AS paint_order
  FROM events""",
    "fx_slots": """
  SELECT user_id, kind, day, slot, arg_max(type, paint_order) AS type
  FROM (SELECT user_id, kind, day, type, paint_order,
          unnest(range(start_slot, end_slot + 1)) AS slot FROM fx_paint)
  GROUP BY user_id, kind, day, slot""",
    "fx_todos": """
  SELECT event_id AS todo_id, user_id,
    CASE WHEN event_id % 3 = 0 THEN 'daily' ELSE 'once' END AS type, CAST(ts AS DATE) AS created,
    CASE WHEN event_id % 6 = 0 THEN DATE '2024-01-30'
         WHEN event_id % 9 = 0 THEN CAST(ts AS DATE) END AS last_done
  FROM events""",
    "fx_scored": """
  SELECT 'risk_label' AS target, CAST(year(l_shipdate) AS INTEGER) AS test_year,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS truth, 'coarse' AS model,
    round(l_discount * 10, 2) AS prob
  FROM lineitem
  UNION ALL
  SELECT 'risk_label', CAST(year(l_shipdate) AS INTEGER),
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, 'fine', l_extendedprice / 110000.0
  FROM lineitem""",
    "fx_trad": """
  SELECT trade_date, code, open_qfq, high_qfq, low_qfq, close_qfq, volume_shares, amount_cny,
    turnover_pct
  FROM fx_bars WHERE close_qfq IS NOT NULL AND (is_trade IS NULL OR is_trade = 1)""",
}
# The views each view reads.
NEEDS = {
    "fx_trad": ["fx_bars"], "fx_arrivals": ["fx_fund"], "fx_facts": ["fx_arrivals"], "fx_canon": ["fx_alias"],
    "fx_dedup": ["fx_class", "fx_canon"], "fx_intervals": ["fx_dedup"],
    "fx_islands": ["fx_intervals"], "fx_members": ["fx_islands"], "fx_slots": ["fx_paint"],
}


def with_views(body: str, views: list[str], extra: dict[str, str] | None = None) -> str:
    """SQL text with the views it needs (in dependency order) in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    parts = [f"{v} AS ({SQL[v]})" for v in ordered]
    parts += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
