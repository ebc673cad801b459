"""Scalar rules as Column expressions; everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Listing-code prefixes per exchange.
SH_PREFIXES = ["60", "68"]
BJ_PREFIXES = ["92", "43", "83", "87"]
CODE_WIDTH = 6


def pad_code(code: Column, width: int = CODE_WIDTH) -> Column:
    """Left-pad with zeros; a longer code is left alone (``lpad`` would cut it)."""
    text = code.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def exchange_of(code: Column) -> Column:
    """Exchange from the first two characters of a code."""
    prefix = F.substring(code, 1, 2)
    return (
        F.when(prefix.isin(SH_PREFIXES), "SH").when(prefix.isin(BJ_PREFIXES), "BJ").otherwise("SZ")
    )


def exchange_or_derived(given: Column, code: Column) -> Column:
    """The given exchange in upper case, else derived from the code."""
    return F.coalesce(F.nullif(F.upper(given), F.lit("")), exchange_of(code))


def date_prefix(text: Column) -> Column:
    """Date in the first ten characters; anything else is NULL."""
    return F.try_to_date(F.substring(text.cast("string"), 1, 10), "yyyy-M-d")


def availability_date(announced: Column, updated: Column) -> Column:
    """Day a fact became known: the later of the dates that are present."""
    return F.greatest(announced, updated)


def revision_id(announced: Column, updated: Column) -> Column:
    """Revision key: update date, else announcement date, else ``'0'``."""
    return F.coalesce(updated.cast("string"), announced.cast("string"), F.lit("0"))


def nan_to_null(value: Column) -> Column:
    """NaN sorts above every number in Spark and poisons aggregates; NULL does not."""
    return F.nanvl(value, F.lit(None).cast("double"))


def to_number(text: Column) -> Column:
    """Parsed number, NULL if it is none.

    The JVM parser also takes a type suffix (``1.5d``), which is not a number
    in the source files, hence the guard.
    """
    text = text.cast("string")
    parsed = nan_to_null(text.try_cast("double"))
    last = F.right(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(1))
    return F.when(~last.isin("d", "D", "f", "F"), parsed)


def first_number(*candidates: Column) -> Column:
    """First candidate that parses; NULL, ``''`` and ``'-'`` are skipped."""
    return F.coalesce(*[to_number(c) for c in candidates])


def first_text(*candidates: Column) -> Column:
    """First non-empty text, else ``''``."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in candidates], F.lit(""))


def inclusive_end(end_exclusive: Column) -> Column:
    """Last day inside a half-open interval; an open end stays NULL."""
    return F.date_sub(end_exclusive, 1)


def classification_version(industry_code: Column) -> Column:
    """Revision of the classification an (arrow-joined) category path belongs to."""
    return F.when(industry_code.contains("220803"), "SW2021").otherwise("SW_LEGACY")


def decide(prob: Column, threshold: float = 0.5) -> Column:
    """Class decision, inclusive at the threshold."""
    return (prob >= F.lit(threshold)).cast("int")


def run_status(formal_ok: Column) -> Column:
    return F.when(formal_ok, "FORMAL").otherwise("PARTIAL")


def slot_of(ts: Column) -> Column:
    """Half-hour slot of a timestamp, 0 to 47."""
    return (F.hour(ts) * 2 + F.floor(F.minute(ts) / 30)).cast("int")


def slot_label(slot: Column) -> Column:
    """Start of a slot as ``H:MM``."""
    return F.concat(
        F.floor(slot / 2).cast("string"), F.when(slot % 2 == 0, ":00").otherwise(":30")
    )
