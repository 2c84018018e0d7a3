"""Numbers as people write them in sheets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _number(text: Column, digits: Column) -> Column:
    comma, stop = F.contains(digits, F.lit(",")), F.contains(digits, F.lit("."))
    plain = (
        F.when(comma & stop & (F.locate(",", F.reverse(digits)) < F.locate(".", F.reverse(digits))), F.translate(digits, ",.", "."))
        .when(comma & stop, F.translate(digits, ",", ""))
        .when(comma & digits.rlike("^[^,]+,[^,]{3}$"), F.translate(digits, ",", ""))
        .when(comma, F.translate(digits, ",", "."))
        .when(stop & digits.rlike(r"^[^.]*(?:[.][^.]{3})+$"), F.translate(digits, ".", ""))
        .otherwise(digits)
    )
    sign = F.when((F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")"))) | F.startswith(text, F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))
    refused = (
        ~digits.rlike("[0-9]")
        | text.rlike(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}")
        | F.regexp_replace(text, r"(?i)\b(rp|idr|usd)\b", "").rlike("[A-Za-z]")
    )
    return F.when(~refused, plain.try_cast("double") * sign)


def parse_number(value: Column) -> Column:
    """The number that a cell holds, or null: dates, codes and prose are not numbers.

    The last of ``,`` and ``.`` is the decimal sign if both occur. One comma
    before three digits, or full stops before groups of three, group thousands.
    """
    return let(F.trim(F.coalesce(value, F.lit(""))), lambda text: let(F.regexp_replace(text, "[^0-9.,]", ""), lambda digits: _number(text, digits)))


def is_numeric_cell(value: Column, number: Column | None = None) -> Column:
    """Whether a cell holds a number, its unit aside. ``number`` is what :func:`parse_number` gives for the cell, where that is at hand: only cells that may have a unit are read again."""
    if number is not None:
        return F.when(~value.rlike("[A-Za-z$%]"), number.isNotNull()).otherwise(is_numeric_cell(value))
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?i)\b(rp|idr|usd|rp\.|ribu|juta|kg|pcs|unit|%)\b", "")
    return let(F.trim(F.translate(bare, "$%", "")), lambda b: (b != "") & ~b.rlike("[A-Za-z]") & parse_number(b).isNotNull())


def numeric_ratio(value: Column) -> Column:
    """Aggregate: the share of numbers among cells that are not blank; 0 if all are."""
    filled = F.trim(F.coalesce(value, F.lit(""))) != ""
    return F.coalesce(F.avg(F.when(filled, is_numeric_cell(value).cast("double"))), F.lit(0.0))


def format_number(value: Column) -> Column:
    """``14830000`` as ``14.830.000``, ``1234.5`` as ``1.234,5``; empty for null."""
    whole = F.translate(F.format_number(value, 0), ",", ".")
    broken = F.regexp_replace(F.regexp_replace(F.translate(F.format_number(value, 2), ",.", ".,"), "0+$", ""), ",$", "")
    return F.when(value.isNull(), "").when(value == F.floor(value), whole).otherwise(broken)


def excel_serial(serial: Column, epoch_1904: bool = False) -> Column:
    """The day of a spreadsheet date as ``yyyy-mm-dd``, with its time if there is one; null where it can't be a date."""
    base = 24107 if epoch_1904 else 25569
    seconds = F.round((serial - F.lit(base)) * 86400).cast("long")
    at = F.timestamp_seconds(seconds)
    text = F.when(serial == F.floor(serial), F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    return F.when((serial >= 0) & (serial < 2958466), text)
