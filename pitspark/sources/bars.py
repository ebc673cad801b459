"""Daily bars: Parquet archives, text payloads and projected table reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import date_prefix, nan_to_null, pad_code, to_number
from ..session import materialize
from .landing import landing_order, require_rows

# Field order of one k-line text line.
KLINE_FIELDS = [
    "open", "close", "high", "low", "volume", "amount", "amplitude", "pct", "change", "turnover",
]
ARCHIVE_SLOTS = 1024
FEATURE_BAR_COLUMNS = [
    "trade_date", "code", "open_qfq", "high_qfq", "low_qfq", "close_qfq",
    "volume_shares", "amount_cny", "turnover_pct",
]


def scan_bar_archive(spark: SparkSession, path: str, universe: DataFrame) -> DataFrame:
    """Bars of the universe from a (globbed) Parquet path, codes padded, with ``arrival``.

    Matching is on the padded code, as a semi join whose strategy Spark picks
    from measured sizes. ``arrival`` is the landing order, for merges.
    """
    targets = universe.select(pad_code(F.col("code")).alias("code")).distinct()
    bars = spark.read.parquet(path).withColumns({
        "code": pad_code(F.col("code")), "date": F.col("date").cast("date"), "arrival": landing_order(),
    })
    return bars.join(targets, "code", "left_semi")


def read_bar_archive(spark: SparkSession, path: str, universe: DataFrame) -> DataFrame:
    """As ``scan_bar_archive``, but an archive without a row of the universe is an error."""
    return require_rows(scan_bar_archive(spark, path, universe), "bar archive")


def archive_slot(code: Column, slots: int = ARCHIVE_SLOTS) -> Column:
    """The slot of the clustered archive that holds a code's bars."""
    return F.pmod(F.xxhash64(pad_code(code)), F.lit(slots)).cast("int")


def write_clustered_archive(bars: DataFrame, path: str, slots: int = ARCHIVE_SLOTS) -> str:
    """An archive laid out so that a universe reads only its own share.

    Bars are partitioned by a hash slot of their code and, inside, ranged and sorted by code and day, so that
    the statistics of a row group cover few codes. A crowded slot is several files: ranges are cut by
    day as well. The number of slots bounds the folders, whatever the number of codes.
    """
    keys = ["slot", "code", "date"]
    placed = bars.withColumn("code", pad_code(F.col("code"))).withColumn("slot", archive_slot(F.col("code"), slots))
    placed.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("slot").option(
        "parquet.bloom.filter.enabled#code", "true").parquet(path)
    return path


def scan_clustered_archive(spark: SparkSession, path: str, universe: DataFrame, slots: int = ARCHIVE_SLOTS) -> DataFrame:
    """As ``scan_bar_archive``, from a clustered archive: only the slots of the universe are read.

    The slots, at most ``slots`` numbers, come to the driver and become a partition filter; the codes stay a semi join.
    """
    targets = universe.select(pad_code(F.col("code")).alias("code")).distinct()
    wanted = [r[0] for r in targets.select(archive_slot(F.col("code"), slots)).distinct().collect()]
    bars = spark.read.parquet(path).where(F.col("slot").isin(wanted)).withColumns({
        "date": F.col("date").cast("date"), "arrival": landing_order()})
    return bars.join(targets, "code", "left_semi").drop("slot")


def normalise_archive_bars(
    bars: DataFrame, source_id: str = "S014", ingest_ts: Column | None = None
) -> DataFrame:
    """Archive rows in the bar schema, prices adjusted ones, raw prices NULL; ``arrival`` is kept."""
    def number(name: str) -> Column:
        return nan_to_null(F.col(name).cast("double"))

    none = F.lit(None).cast("double")
    return bars.select(
        F.col("date").cast("date").alias("trade_date"),
        pad_code(F.col("code")).alias("code"),
        *[none.alias(c) for c in ("open_raw", "high_raw", "low_raw", "close_raw", "prev_close_raw")],
        number("pctChg").alias("pct_chg_pct"),
        number("volume").alias("volume_shares"),
        number("amount").alias("amount_cny"),
        number("turn").alias("turnover_pct"),
        none.alias("adj_factor"),
        number("close").alias("close_qfq"),
        number("close").isNotNull().cast("int").alias("is_trade"),
        F.lit(None).cast("int").alias("is_st"),
        F.lit(None).cast("string").alias("limit_status"),
        F.lit(source_id).alias("source_id"),
        (F.current_timestamp() if ingest_ts is None else ingest_ts).alias("ingest_ts"),
        number("open").alias("open_qfq"),
        number("high").alias("high_qfq"),
        number("low").alias("low_qfq"),
        none.alias("amplitude_pct"),
        none.alias("change_amt"),
        *[F.col(c) for c in ("arrival",) if c in bars.columns],
    )


def parse_kline_lines(lines: DataFrame, line: str = "line", keep_short: bool = False) -> DataFrame:
    """Comma-joined k-line text to typed columns; lines under eleven fields are skipped.

    ``malformed`` marks a line whose date or whose numbers do not parse; ``nan`` is a
    number that is missing. With ``keep_short`` the lines under eleven fields stay, marked
    ``short`` (a null line too) and not malformed.
    """
    parts = F.split(F.col(line), ",")
    keep = [c for c in lines.columns if c != line]
    cut = lines.select(*keep, parts.alias("_p"))
    if not keep_short:
        cut = cut.where(F.size("_p") >= 11)
    # One function over the fields, not an expression for each: ten of them make a method too long to be compiled.
    texts = F.slice("_p", 2, len(KLINE_FIELDS))
    read = cut.select(
        *keep, "_p", date_prefix(F.get(F.col("_p"), F.lit(0))).alias("date"), F.transform(texts, to_number).alias("_v"))
    odd = F.zip_with("_v", texts, lambda value, text: value.isNull() & ~F.lower(F.trim(text)).isin("nan", "+nan", "-nan"))
    bad = F.col("date").isNull() | F.exists(odd, lambda b: b)
    values = [F.get(F.col("_v"), F.lit(i)).alias(n) for i, n in enumerate(KLINE_FIELDS)]
    if not keep_short:
        return read.select(*keep, "date", *values, bad.alias("malformed"))
    short = F.coalesce(F.size("_p"), F.lit(0)) < 11
    return read.select(*keep, "date", *values, short.alias("short"), (~short & bad).alias("malformed"))


def quarantine_payloads(parsed: DataFrame, payload: list[str]) -> DataFrame:
    """Drop every row of a payload that holds a malformed line.

    One bad number fails the whole fetch of its payload, not just its line. The
    rows are written first: both sides read them, and a filter on ``malformed`` would
    otherwise parse every field of a line again. The bad payload keys are few, so the
    anti join is normally a broadcast and the bars are not shuffled.
    """
    parsed = materialize(parsed, "parsed-lines")
    bad = parsed.where("malformed").select(*payload).distinct()
    return parsed.join(bad, payload, "left_anti").drop("malformed")


def tradable_bars(bars: DataFrame) -> DataFrame:
    """Projected bars with an adjusted close that were not suspended.

    Applied before any window, so row frames count tradable rows. Both the
    predicate and the column list reach the Parquet scan.
    """
    return bars.where("close_qfq is not null and (is_trade is null or is_trade = 1)").select(
        *FEATURE_BAR_COLUMNS
    )
