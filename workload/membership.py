"""Classification history to intervals, active members, universe flags and the audit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from pitspark.operators import intervals as iv, membership as mb
from pitspark.operators.quality import membership_stats
from pitspark.sources.bars import tradable_bars
from pitspark.sources.classification import normalise_history

from .fixtures import Tables
from .registry import query

ASOF = dt.date(1999, 6, 30)
ACTIVE_SQL = f"""
  SELECT DISTINCT code FROM fx_members
  WHERE in_date <= DATE '{ASOF}' AND (out_date IS NULL OR out_date >= DATE '{ASOF}')"""
AUDIT_SQL = """
  SELECT coalesce(e.code, a.code) AS code, coalesce(e.name, '') AS name,
    CASE WHEN e.code IS NULL THEN 0 ELSE 1 END AS expected_current,
    CASE WHEN a.code IS NULL THEN 0 ELSE 1 END AS active_official,
    CASE WHEN e.code IS NULL THEN 'EXTRA_OFFICIAL' WHEN a.code IS NULL THEN 'MISSING_OFFICIAL'
      ELSE 'MATCH' END AS status
  FROM (SELECT * FROM fx_company WHERE current_member = 1) e
  FULL OUTER JOIN active a ON a.code = e.code"""


def audit_of(t: Tables, members: DataFrame | None = None) -> DataFrame:
    return mb.membership_audit(t.company(), t.membership() if members is None else members, ASOF)


@query(
    "classification_scan",
    """SELECT source_code, start_date, industry_code FROM fx_class""",
    ["fx_class"],
)
def classification_scan(t: Tables) -> DataFrame:
    """The history as it lands (exchange suffix, trailing ``.0``), normalised again."""
    landed = t.class_history().select(
        F.concat("source_code", F.lit(".SZ")).alias("symbol"),
        F.col("start_date").cast("string").alias("start_date"),
        F.concat(F.lit(" "), "industry_code", F.lit(".0 ")).alias("industry_code"),
    )
    return normalise_history(landed)


@query(
    "canonical_codes",
    """SELECT h.source_code, h.start_date, h.industry_code,
         coalesce(a.canonical_code, h.source_code) AS code
       FROM fx_class h LEFT JOIN fx_canon a ON a.historical_code = h.source_code""",
    ["fx_class", "fx_canon"],
)
def canonical(t: Tables) -> DataFrame:
    return iv.canonical_codes(t.class_history(), t.alias())


@query(
    "dedupe_history", "SELECT code, start_date, industry_code, source_code FROM fx_dedup",
    ["fx_dedup"],
)
def dedupe(t: Tables) -> DataFrame:
    return iv.dedupe_history(iv.canonical_codes(t.class_history(), t.alias()))


def _intervals(t: Tables) -> DataFrame:
    return iv.derive_intervals(dedupe(t))


@query(
    "membership_intervals",
    "SELECT code, source_code, industry_code, in_date, end_exclusive FROM fx_intervals",
    ["fx_intervals"],
)
def intervals(t: Tables) -> DataFrame:
    return _intervals(t)


@query(
    "category_intervals",
    """SELECT code, source_code, industry_code, in_date, end_exclusive FROM fx_intervals
       WHERE industry_code IN ('220303', '220803')""",
    ["fx_intervals"],
)
def category(t: Tables) -> DataFrame:
    return iv.in_category(_intervals(t))


@query(
    "membership_islands",
    "SELECT code, source_code, industry_code, in_date, end_exclusive FROM fx_islands",
    ["fx_islands"],
)
def islands(t: Tables) -> DataFrame:
    return t.islands()


@query(
    "membership_rows",
    """SELECT code, source_code, '农药' AS sw_name, '850333' AS sw_index_code,
         industry_code AS source_industry_code, '农药' AS source_industry_name,
         CASE WHEN industry_code LIKE '%220803%' THEN 'SW2021' ELSE 'SW_LEGACY' END
           AS classification_version,
         in_date, end_exclusive - 1 AS out_date, 'S013' AS source_id
       FROM fx_islands""",
    ["fx_islands"],
)
def membership_rows(t: Tables) -> DataFrame:
    return iv.membership_rows(t.islands()).drop("source_update_time", "loaded_at")


@query(
    "membership_stats",
    """SELECT count(DISTINCT code) AS loaded_entities, count(*) AS loaded_rows,
         min(in_date) AS min_date, max(end_exclusive) - 1 AS max_date FROM fx_islands""",
    ["fx_islands"],
)
def stats(t: Tables) -> DataFrame:
    return membership_stats(t.islands())


@query("active_asof", ACTIVE_SQL, ["fx_members"])
def active(t: Tables) -> DataFrame:
    return mb.active_asof(t.membership(), ASOF)


FLAGS_SQL = """
  SELECT code, coalesce(max(name), '') AS name,
    CASE WHEN substr(code, 1, 2) IN ('60', '68') THEN 'SH'
      WHEN substr(code, 1, 2) IN ('92', '43', '83', '87') THEN 'BJ' ELSE 'SZ' END AS exchange,
    max(cur) AS current_member_snapshot, max(hist) AS historical_member,
    'OFFICIAL_SW_HISTORY_PLUS_CURRENT' AS universe_status
  FROM (SELECT code, name, current_member AS cur, 0 AS hist FROM fx_company
        UNION ALL SELECT code, NULL, 0, 1 FROM fx_members)
  GROUP BY code HAVING max(cur) = 1 OR max(hist) = 1"""


@query("universe_flags", FLAGS_SQL, ["fx_company", "fx_members"])
def flags(t: Tables) -> DataFrame:
    return mb.universe_flags(t.company(), t.membership())


@query(
    "universe_counts",
    """SELECT count(*) AS universe_codes, sum(historical_member) AS historical_codes,
         sum(current_member_snapshot) AS current_codes FROM flags""",
    ["fx_company", "fx_members"], {"flags": FLAGS_SQL},
)
def counts(t: Tables) -> DataFrame:
    return mb.universe_counts(flags(t))


@query("membership_audit", AUDIT_SQL, ["fx_company", "fx_members"], {"active": ACTIVE_SQL})
def audit(t: Tables) -> DataFrame:
    return audit_of(t)


@query(
    "audit_outcome",
    """SELECT sum(expected_current) AS expected,
         count(*) FILTER (WHERE status = 'MISSING_OFFICIAL') AS missing, sum(active_official) AS active_asof,
         CASE WHEN count(*) FILTER (WHERE status = 'MISSING_OFFICIAL') = 0 THEN 'LOADED'
           ELSE 'AUDIT_FAILED' END AS status
       FROM audit""",
    ["fx_company", "fx_members"], {"active": ACTIVE_SQL, "audit": AUDIT_SQL},
)
def audit_outcome(t: Tables) -> DataFrame:
    return mb.audit_outcome(audit_of(t))


@query(
    "missing_codes",
    "SELECT DISTINCT code FROM fx_members WHERE code NOT IN (SELECT code FROM fx_trad)",
    ["fx_members", "fx_trad"],
)
def missing(t: Tables) -> DataFrame:
    return mb.missing_codes(t.membership(), tradable_bars(t.bars()))
