"""Landed input accounted for: every line and page ends as accepted, superseded or rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.bars import parse_kline_lines
from .aliases import ranked_aliases

NUMBERS = ["open", "close", "high", "low", "volume", "amount", "amplitude", "pct", "change", "turnover"]
# Reasons of a rejected line, in the order they are looked for.
SHORT, MALFORMED, PAYLOAD, UNIVERSE, VALIDITY = "short", "malformed", "payload", "universe", "validity"


class AccountError(RuntimeError):
    """Lines that were read are in no account."""


# --- price lines ----------------------------------------------------------------

def routes(alias: DataFrame, universe: DataFrame) -> DataFrame:
    """(code, routes): the companies of the universe a listing's bars belong to, and when.

    A code that heads alias entries takes its bars from these alone; any other is its own listing. One row per
    listing, so a join with it repeats no line.
    """
    targets = universe.select("code").distinct()
    listed = ranked_aliases(alias).select(
        F.col("canonical_code").alias("code"), F.col("historical_code").alias("listing"),
        "valid_from", "valid_to", F.col("alias_rank").cast("int").alias("rank"),
    )
    day = F.lit(None).cast("date")
    own = targets.join(listed.select("code").distinct(), "code", "left_anti").select(
        "code", F.col("code").alias("listing"), day.alias("valid_from"), day.alias("valid_to"), F.lit(0).alias("rank"))
    entries = own.unionByName(listed.join(targets, "code", "left_semi"))
    return entries.groupBy("listing").agg(
        F.collect_list(F.struct("code", "valid_from", "valid_to", "rank")).alias("routes")
    ).withColumnRenamed("listing", "code")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Every landed line with its fields; ``short`` and ``malformed`` mark those without. No line is dropped.

    ``arrival`` orders the lines; where there is none, the text does.
    """
    arrival = F.col("arrival") if "arrival" in lines.columns else F.col("line")
    return parse_kline_lines(lines.select("code", "line", arrival.alias("arrival")), keep_short=True)


def routed_lines(parsed: DataFrame, alias: DataFrame, universe: DataFrame) -> DataFrame:
    """A row per line and company it serves: (code, company, date, numbers, arrival, rank, reason, shared).

    ``reason`` says why a line serves none: it is short, malformed, part of a payload (the lines of
    its listing) that holds a malformed one, of a listing outside the universe, or outside the validity of
    its listing. ``shared`` marks the further companies of a line.
    """
    bad = parsed.where("malformed").select("code", F.lit(True).alias("bad")).distinct()
    met = parsed.join(bad, "code", "left").join(routes(alias, universe), "code", "left")
    day = F.col("date")
    valid = F.filter("routes", lambda r: (
        (r["valid_from"].isNull() | (day >= r["valid_from"])) & (r["valid_to"].isNull() | (day <= r["valid_to"]))))
    reason = (
        F.when(F.col("short"), SHORT).when(F.col("malformed"), MALFORMED).when(F.col("bad"), PAYLOAD)
        .when(F.col("routes").isNull(), UNIVERSE).when(F.size(valid) == 0, VALIDITY)
    )
    used = F.when(F.col("reason").isNull(), valid)
    spread = met.withColumn("reason", reason).select(
        "code", "date", *NUMBERS, "arrival", "reason", F.posexplode_outer(used).alias("at", "route"))
    return spread.select(
        "code", F.col("route.code").alias("company"), "date", *NUMBERS, "arrival",
        F.col("route.rank").alias("rank"), "reason", (F.coalesce("at", F.lit(0)) > 0).alias("shared"),
    )


def accepted_bars(routed: DataFrame) -> DataFrame:
    """One bar per company and day, with the number of lines it stands for in ``landed``.

    On a day landed twice the later alias wins, then the line that arrived last.
    """
    payload = F.struct(*NUMBERS)
    return routed.where("reason is null").groupBy("company", "date").agg(
        F.max_by(payload, F.struct("rank", "arrival")).alias("bar"), F.count("*").alias("landed"),
    ).select(F.col("company").alias("code"), F.col("date").alias("trade_date"), "bar.*", "landed")


def rejected_lines(routed: DataFrame) -> DataFrame:
    return routed.where("reason is not null").select("code", "date", "arrival", "reason")


def line_accounts(routed: DataFrame, landed: int, accepted: DataFrame | None = None) -> DataFrame:
    """(outcome, reason, lines): landed and shared lines on one side, accepted, superseded and rejected on the other.

    ``landed`` is the number counted where the lines were read, ``accepted`` the bars if they are written already.
    Raises unless both sides agree.
    """
    rows = routed.groupBy("reason").agg(
        F.count("*").alias("lines"), F.sum(F.col("shared").cast("long")).alias("shared"),
    ).collect()
    bars = (accepted_bars(routed) if accepted is None else accepted).agg(F.count("*"), F.coalesce(F.sum("landed"), F.lit(0))).first()
    rejected = sorted((r.reason, r.lines) for r in rows if r.reason is not None)
    table = [("landed", None, landed), ("shared", None, sum(r.shared for r in rows)),
             ("accepted", None, bars[0]), ("superseded", None, bars[1] - bars[0]),
             *[("rejected", reason, n) for reason, n in rejected]]
    if table[0][2] + table[1][2] != sum(n for outcome, _, n in table[2:]):
        raise AccountError(f"lines are missing from the accounts: {table}")
    return routed.sparkSession.createDataFrame(table, "outcome string, reason string, lines long")


# --- response pages -------------------------------------------------------------

def page_facts(pages: DataFrame, body: str = "body") -> DataFrame:
    """(code, fetch, page, arrival, told, records, body): what each landed page says about the whole.

    ``told`` is the number of pages the response names (1 if it names none), ``records`` its rows.
    """
    parsed = F.from_json(body, "result struct<pages: int, data: array<string>>")
    told = F.greatest(F.coalesce(F.col("_j.result.pages"), F.lit(1)), F.lit(1))
    records = F.coalesce(F.size("_j.result.data"), F.lit(0))
    return pages.withColumn("_j", parsed).select(
        "code", "fetch", "page", "arrival", told.alias("told"), F.greatest(records, F.lit(0)).alias("records"), body)


def page_ledger(facts: DataFrame) -> DataFrame:
    """(code, fetch, pages, last_page, told, repeats, missing, mixed, whole) of every fetch.

    A fetch asks for page 1, 2, ... until a page is the last it names or holds no record. It is whole if these
    pages all landed. ``mixed`` marks a fetch whose pages name different totals, so that the table changed while it
    was read; it is not whole, for a record may have moved between two pages. A page that landed twice counts once,
    as it arrived last.
    """
    once = facts.groupBy("code", "fetch", "page").agg(
        F.max_by(F.struct("told", "records"), "arrival").alias("p"), F.count("*").alias("copies"))
    per = once.groupBy("code", "fetch").agg(
        F.count("*").alias("pages"), F.max("page").alias("last_page"), F.min("page").alias("first_page"),
        F.max_by("p", "page").alias("last"), F.min("p.told").alias("least"), F.max("p.told").alias("told"),
        F.sum(F.col("copies") - 1).alias("repeats"),
    )
    ended = (F.col("last_page") >= F.col("last.told")) | (F.col("last.records") == 0)
    wanted = F.when(ended, F.col("last_page")).otherwise(F.col("last.told"))
    mixed = F.col("least") < F.col("told")
    gone = wanted - F.col("pages")
    whole = ended & (F.col("first_page") == 1) & (gone == 0) & ~mixed
    return per.select(
        "code", "fetch", "pages", "last_page", "told", "repeats", gone.cast("long").alias("missing"),
        mixed.alias("mixed"), whole.alias("whole"))


def last_whole_pages(facts: DataFrame, ledger: DataFrame) -> DataFrame:
    """The pages of each code's last whole fetch, each once; a code without one has none."""
    best = ledger.where("whole").groupBy("code").agg(F.max("fetch").alias("fetch"))
    kept = facts.join(best, ["code", "fetch"], "left_semi")
    rest = [c for c in kept.columns if c not in ("code", "fetch", "page")]
    return kept.groupBy("code", "fetch", "page").agg(F.max_by(F.struct(*rest), "arrival").alias("p")).select(
        "code", "fetch", "page", "p.*")


def incomplete_codes(ledger: DataFrame) -> DataFrame:
    """(code, fetch, missing, mixed): codes whose last fetch is not whole, so that an older one or none is used."""
    last = ledger.groupBy("code").agg(F.max_by(F.struct(*[c for c in ledger.columns if c != "code"]), "fetch").alias("l"))
    return last.where("not l.whole").select("code", "l.fetch", "l.missing", "l.mixed")

