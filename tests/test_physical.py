"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from pitspark.operators.features import with_rolling
from pitspark.operators.merge import FALLBACK_BAR_POLICY, BAR_KEYS, merge_touched
from pitspark.operators.model import year_of
from pitspark.plans.panel import build_panel
from pitspark.session import TASK_SIZES, materialize
from pitspark.sources.bars import tradable_bars
from workload import QUERIES
from workload.fixtures import Tables
from workload.folds import TRAINING_COLUMNS, written_training_columns

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    t = Tables(spark, SF)
    bars = t.bars().withColumn("year", F.year("trade_date"))
    return (materialize(bars, "bars", ["year"]), materialize(t.membership(), "membership"),
            materialize(t.facts(), "facts"))


def test_bars_are_filtered_and_pruned_in_the_scan(stored):
    text = plan(tradable_bars(stored[0]).select("code", "close_qfq"))
    assert "IsNotNull(close_qfq)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "amount_cny" not in schema and "high_qfq" not in schema


def test_features_and_labels_take_one_exchange_and_one_sort(stored):
    text = plan(with_rolling(tradable_bars(stored[0])))
    assert len(re.findall(r"\bExchange hashpartitioning", text)) == 1
    assert len(re.findall(r"- \*?(?:\(\d+\) )?Sort \[", text)) == 1


def test_the_panel_shuffles_the_bars_once(stored):
    text = plan(build_panel(*stored))
    above_union = text.split("Union")[0]
    assert "Exchange" not in above_union


def test_a_merge_prunes_untouched_partitions(stored):
    bars = stored[0]
    batch = bars.where("year = 1998")
    merged = merge_touched(bars, batch, BAR_KEYS, FALLBACK_BAR_POLICY, None, F.col("year"))
    assert merged.count() == bars.count()
    text = plan(merged)
    assert "PartitionFilters: [isnotnull(year" in text and "(year#" in text


def test_a_fold_reads_only_the_years_it_needs(stored):
    panel = build_panel(*stored).withColumn("year", F.year("trade_date"))
    panel = materialize(panel, "panel", ["year"])
    text = plan(panel.where(year_of(panel) <= 1998).select("ret_5d"))
    assert re.search(r"PartitionFilters: \[isnotnull\(year#\d+\), \(year#\d+ <= 1998\)\]", text)


FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython",
             "PythonMapInArrow", "MapInPandas", "CollectLimit", "GlobalLimit"]
# Loops over fits and writes; covered by the parts they are made of.
HEAVY = {n for n in QUERIES if n.startswith(("walk_forward", "backtest_summary"))} | {"fit_certificates"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY))
def test_no_query_crosses_rows_or_runs_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not [op for op in FORBIDDEN if op in text]


def test_tasks_are_bounded_in_any_session(spark):
    """Also in a session that was built elsewhere, whose tasks read 128 MB of a file and 64 MB of a shuffle."""
    before = {key: spark.conf.get(key) for key in TASK_SIZES}
    for key in TASK_SIZES:
        spark.conf.set(key, "128m")
    Tables(spark, SF)
    assert {key: spark.conf.get(key) for key in TASK_SIZES} == TASK_SIZES == before


def test_statistics_write_what_they_read(spark):
    """Not the whole panel in a folder for each year, with a file of each task in all of them."""
    table = written_training_columns(Tables(spark, SF))
    assert table.columns == TRAINING_COLUMNS
    assert not any("year=" in path for path in table.inputFiles())
