"""Upserts with a policy per column, and the simpler keyed inserts.

The rows of a batch apply in arrival order, one after the other, so copies of
a key inside one batch fold as well. The fold has a closed form per policy
(last value, last non-NULL value, first value), which makes the whole batch one
aggregation followed by one outer join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values below: key and column names of the stored tables.
OVERWRITE = "overwrite"
COALESCE = "coalesce"
INSERT_ONLY = "insert_only"

MAX_SLICES = 10_000

BAR_KEYS = ["trade_date", "code"]
FACT_KEYS = ["code", "report_period", "ann_date", "revision_id"]

_STALE_BAR = ["adj_factor", "is_trade", "is_st", "limit_status"]
_PRIMARY_BAR = [
    "open_raw", "high_raw", "low_raw", "close_raw", "prev_close_raw", "pct_chg_pct",
    "volume_shares", "amount_cny", "turnover_pct", "close_qfq", "open_qfq", "high_qfq", "low_qfq",
    "amplitude_pct", "change_amt", "source_id", "ingest_ts",
]
_FALLBACK_BAR = [
    "pct_chg_pct", "volume_shares", "amount_cny", "turnover_pct",
    "close_qfq", "open_qfq", "high_qfq", "low_qfq",
]
_FACT = [
    "available_date", "revenue_cny", "revenue_yoy_pct", "net_profit_parent_cny",
    "net_profit_yoy_pct", "source_id", "ingest_ts", "update_date", "source_asof",
]

# Columns a policy does not name are insert-only.
PRIMARY_BAR_POLICY = dict.fromkeys(_PRIMARY_BAR, OVERWRITE) | dict.fromkeys(_STALE_BAR, INSERT_ONLY)
FALLBACK_BAR_POLICY = dict.fromkeys(_FALLBACK_BAR, COALESCE) | {"ingest_ts": OVERWRITE}
PRIMARY_FACT_POLICY = dict.fromkeys(
    _FACT + ["roe_weighted_pct", "gross_margin_pct"], OVERWRITE
)
ARCHIVE_FACT_POLICY = dict.fromkeys(_FACT + ["deduct_np_cny"], OVERWRITE)


def fold(column: str, policy: str, order: Column) -> Column:
    """Net value of a column after rows apply one by one in ``order``."""
    if policy == OVERWRITE:
        return F.max_by(column, order).alias(column)
    if policy == COALESCE:
        return F.max_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)
    if policy == INSERT_ONLY:
        return F.min_by(column, order).alias(column)
    raise ValueError(f"unknown merge policy {policy!r}")


def collapse_batch(
    batch: DataFrame, keys: list[str], policy: dict[str, str], order: str | list[str]
) -> DataFrame:
    """The net effect of a batch per key; copies of a key shrink on the map side.

    Columns that are overwritten, and those only inserted, travel together: an order that holds a path is then kept
    twice in a row, and once for each coalesced column, instead of once for every column.
    """
    names = [order] if isinstance(order, str) else order
    by = F.col(names[0]) if len(names) == 1 else F.struct(*names)
    rest = [c for c in batch.columns if c not in keys and c not in names]
    rules = {c: policy.get(c, INSERT_ONLY) for c in rest}
    joint = {rule: [c for c in rest if rules[c] == rule] for rule in (OVERWRITE, INSERT_ONLY)}
    whole = {OVERWRITE: F.max_by, INSERT_ONLY: F.min_by}
    folded = batch.groupBy(*keys).agg(
        *[whole[rule](F.struct(*columns), by).alias(f"_{rule}") for rule, columns in joint.items() if columns],
        *[fold(c, rules[c], by) for c in rest if rules[c] not in joint],
    ) if rest else batch.select(*keys).distinct()
    return folded.select(*keys, *[F.col(f"_{rules[c]}.{c}").alias(c) if rules[c] in joint else F.col(c) for c in rest])


def unique_keys(batch: DataFrame, keys: list[str]) -> DataFrame:
    """``batch``, failing at run time on a repeated key; the merge's join reuses its shuffle."""
    rest = [c for c in batch.columns if c not in keys]
    counted = batch.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.first(F.struct(F.lit(0).alias("_one"), *rest)).alias("_row")
    )
    once = F.when(F.col("_n") > 1, F.raise_error(F.lit("merge batch repeats a key"))).otherwise(F.col("_row"))
    checked = counted.select(*keys, once.alias("_row"))
    return checked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def with_keys(batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a whole key; a NULL key matches nothing, so each run would add its row again."""
    return batch.dropna(how="any", subset=keys)


def without_keys(batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows ``with_keys`` leaves out, to be kept as rejects."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return batch.where(missing)


def merge_upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: list[str],
    policy: dict[str, str],
    order: str | list[str] | None = None,
) -> DataFrame:
    """``target`` after the batch. Without ``order`` a repeated key in the batch is an error.

    Both sides hold a key once when they meet, so the join has no skewed group.
    Columns the batch lacks keep the target's value.
    """
    incoming = unique_keys(batch, keys) if order is None else collapse_batch(batch, keys, policy, order)
    shared = [c for c in target.columns if c not in keys and c in incoming.columns]
    new = incoming.select(*keys, F.struct(*shared).alias("_new"), F.lit(True).alias("_in_new"))
    old = target.withColumn("_in_old", F.lit(True))
    joined = old.join(new, keys, "full_outer")

    def value(name: str) -> Column:
        if name in keys or name not in shared:
            return F.col(name)
        before, after = F.col(name), F.col(f"_new.{name}")
        rule = policy.get(name, INSERT_ONLY)
        if rule == OVERWRITE:
            return F.when(F.col("_in_new"), after).otherwise(before).alias(name)
        if rule == COALESCE:
            return F.coalesce(after, before).alias(name)
        return F.when(F.col("_in_old"), before).otherwise(after).alias(name)

    return joined.select(*[value(c) for c in target.columns])


def merge_touched(
    target: DataFrame,
    batch: DataFrame,
    keys: list[str],
    policy: dict[str, str],
    order: str | list[str] | None,
    part: Column,
) -> DataFrame:
    """As ``merge_upsert``, but only the slices of the target a batch touches are joined.

    ``part`` is a function of the key with few values (the year of a bar). The
    untouched slices, normally nearly all of the table, pass through without a
    shuffle; with ``part`` as partition column the split is a partition filter.
    A NULL slice of the batch touches no slice of the target; rows of the target
    with a NULL slice always pass through. More than ``MAX_SLICES`` touched
    slices are an error: ``part`` is then not a calendar unit.
    """
    slices = batch.select(part.alias("part")).where("part is not null").distinct()
    touched = [r[0] for r in slices.limit(MAX_SLICES + 1).collect()]
    if len(touched) > MAX_SLICES:
        raise ValueError(f"a batch may touch {MAX_SLICES} slices; choose a coarser part")
    hit = F.coalesce(part.isin(touched), F.lit(False))
    merged = merge_upsert(target.where(hit), batch, keys, policy, order)
    return target.where(~hit).unionByName(merged)


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Append the rows whose key is new; of several new rows the first in ``order`` is kept.

    Without ``order`` a repeated key in the batch is an error.
    """
    fresh = unique_keys(batch, keys) if order is None else collapse_batch(batch, keys, {}, order)
    fresh = fresh.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def insert_or_replace(target: DataFrame, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Replace whole rows by key, the last in ``order``; columns the batch does not list fall back to NULL.

    Without ``order`` a repeated key in the batch is an error.
    """
    rest = dict.fromkeys([c for c in batch.columns if c not in keys], OVERWRITE)
    fresh = unique_keys(batch, keys) if order is None else collapse_batch(batch, keys, rest, order)
    kept = target.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True).select(*target.columns)


def replace_source(target: DataFrame, batch: DataFrame, source_id: str, key: str = "source_id") -> DataFrame:
    """Drop all rows of one source and add the new set, which may be empty."""
    return target.where(~F.col(key).eqNullSafe(F.lit(source_id))).unionByName(
        batch.select(*target.columns)
    )
