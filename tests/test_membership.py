import datetime as dt
import random

from pyspark.sql import functions as F

from pitspark.operators import intervals as iv, membership as mb
from pitspark.operators.asof import (
    asof_fundamentals, assert_no_look_ahead, guard_look_ahead, LookAheadError,
)
import pytest

D0 = dt.date(2020, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def alias(spark, rows=()):
    return spark.createDataFrame(
        list(rows), "canonical_code string, historical_code string, valid_from date, valid_to date"
    )


def brute_islands(rows):
    """(code, start, category) -> merged intervals of category A/B."""
    out = []
    for code in {r[0] for r in rows}:
        recs = sorted({(r[1], r[2]) for r in rows if r[0] == code})
        ivs = [(s, c, recs[i + 1][0] if i + 1 < len(recs) else None) for i, (s, c) in enumerate(recs)]
        cur = None
        for s, c, e in [x for x in ivs if x[1] in ("220303", "220803")]:
            if cur and cur[3] is not None and cur[3] == s:
                cur = [code, cur[1] + "->" + c, cur[2], e]
            else:
                if cur:
                    out.append(tuple(cur))
                cur = [code, c, s, e]
        if cur:
            out.append(tuple(cur))
    return sorted(out, key=str)


def test_islands_equal_brute_force(spark):
    rnd = random.Random(5)
    cats = ["220303", "220803", "999999"]
    rows = [(f"{rnd.randrange(12):06d}", day(rnd.randrange(40)), rnd.choice(cats)) for _ in range(300)]
    df = spark.createDataFrame(rows, "source_code string, start_date date, industry_code string")
    got = iv.build_membership(df, alias(spark)).select(
        "code", "industry_code", "in_date", "end_exclusive").collect()
    assert sorted(map(tuple, got), key=str) == brute_islands(rows)


def test_filter_comes_after_interval_ends(spark):
    rows = [("000001", day(0), "220303"), ("000001", day(10), "999999")]
    df = spark.createDataFrame(rows, "source_code string, start_date date, industry_code string")
    row = iv.build_membership(df, alias(spark)).first()
    assert row.end_exclusive == day(10)
    member = iv.membership_rows(iv.build_membership(df, alias(spark))).first()
    assert member.out_date == day(9) and member.classification_version == "SW_LEGACY"


def test_canonical_code_merges_two_listings(spark):
    rows = [("833819", day(0), "220303"), ("920819", day(10), "220803")]
    df = spark.createDataFrame(rows, "source_code string, start_date date, industry_code string")
    names = alias(spark, [("920819", "833819", None, day(9)), ("920819", "920819", day(10), None)])
    got = iv.build_membership(df, names).collect()
    assert [(r.code, r.source_code, r.industry_code) for r in got] == [
        ("920819", "833819", "220303->220803")]


def test_universe_gate_equals_brute_force(spark):
    rnd = random.Random(7)
    bars = [(f"c{c}", day(d)) for c in range(8) for d in range(60) if rnd.random() < 0.8]
    mem = []
    for _ in range(40):
        start = rnd.randrange(60)
        end = rnd.choice([None, start + rnd.randrange(-1, 15)])
        mem.append((f"c{rnd.randrange(8)}", rnd.choice([day(start), day(start), None]),
                    None if end is None else day(end)))
    mem.append(("c0", day(3), day(2)))
    b = spark.createDataFrame(bars, "code string, trade_date date").withColumn("x", F.lit(1))
    m = spark.createDataFrame(mem, "code string, in_date date, out_date date")
    got = sorted((r.code, r.trade_date) for r in mb.universe_semi_join(b, m).collect())
    want = sorted((c, d) for c, d in bars if any(
        mc == c and i is not None and i <= d and (o is None or d <= o) for mc, i, o in mem))
    assert got == want and 0 < len(want) < len(bars)


FACT = "code string, report_period date, ann_date date, available_date date, revision_id string, v double"


def test_asof_equals_brute_force(spark):
    rnd = random.Random(9)
    bars = [(f"c{c}", day(d)) for c in range(6) for d in range(50)]
    facts = []
    for i in range(60):
        a = day(rnd.randrange(50))
        facts.append((f"c{rnd.randrange(5)}", day(rnd.randrange(-90, 0)), a, a, str(i % 3),
                      rnd.choice([None, rnd.random()])))
    best = {}
    for f in facts:
        key = (f[0], f[3])
        if key not in best or (f[1], f[4], f[2]) > (best[key][1], best[key][4], best[key][2]):
            best[key] = f
    facts = list({(f[0], f[1], f[2], f[4]): f for f in facts}.values())
    b = spark.createDataFrame(bars, "code string, trade_date date")
    got = asof_fundamentals(b, spark.createDataFrame(facts, FACT), ["v"]).collect()
    assert len(got) == len(bars)
    for r in got:
        known = [f for (c, a), f in best.items() if c == r.code and a <= r.trade_date]
        if not known:
            assert r.v is None and r.financial_available_date is None
        else:
            f = max(known, key=lambda f: f[3])
            assert (r.v, r.financial_available_date) == (f[5], f[3])


def test_same_day_fact_counts_and_null_payload_is_not_filled(spark):
    facts = [("c", day(0), day(1), day(1), "0", 5.0), ("c", day(0), day(3), day(3), "0", None)]
    b = spark.createDataFrame([("c", day(0)), ("c", day(1)), ("c", day(3))], "code string, trade_date date")
    got = asof_fundamentals(b, spark.createDataFrame(facts, FACT), ["v"]).orderBy("trade_date").collect()
    assert [(r.v, r.financial_available_date) for r in got] == [
        (None, None), (5.0, day(1)), (None, day(3))]


def test_no_facts_gives_null_columns(spark):
    b = spark.createDataFrame([("c", day(0))], "code string, trade_date date")
    row = asof_fundamentals(b, spark.createDataFrame([], FACT), ["v"]).first()
    assert row.v is None and row.financial_available_date is None


def test_look_ahead_guard(spark):
    df = spark.createDataFrame([("c", day(0), day(1))], "code string, trade_date date, financial_available_date date")
    with pytest.raises(LookAheadError):
        assert_no_look_ahead(df)
    with pytest.raises(Exception, match="look ahead"):
        guard_look_ahead(df).collect()
    fine = df.withColumn("financial_available_date", F.lit(None).cast("date"))
    assert guard_look_ahead(fine).count() == 1


def test_audit_and_flags(spark):
    master = spark.createDataFrame(
        [("600001", "A", 1), ("920001", "B", 1), ("000003", "C", 0)], "code string, name string, current_member int")
    mem = spark.createDataFrame(
        [("600001", day(0), None), ("300009", day(0), day(5)), ("000003", day(0), day(1))],
        "code string, in_date date, out_date date")
    audit = {r.code: r for r in mb.membership_audit(master, mem, day(5)).collect()}
    assert {c: r.status for c, r in audit.items()} == {
        "600001": "MATCH", "920001": "MISSING_OFFICIAL", "300009": "EXTRA_OFFICIAL"}
    assert audit["300009"].name == ""
    out = mb.audit_outcome(mb.membership_audit(master, mem, day(5))).first()
    assert (out.missing, out.status) == (1, "AUDIT_FAILED")
    flags = {r.code: (r.name, r.exchange, r.current_member_snapshot, r.historical_member)
             for r in mb.universe_flags(master, mem).collect()}
    assert flags == {
        "600001": ("A", "SH", 1, 1), "920001": ("B", "BJ", 1, 0), "300009": ("", "SZ", 0, 1),
        "000003": ("C", "SZ", 0, 1)}
