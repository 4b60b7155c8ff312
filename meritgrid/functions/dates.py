"""Dates in mixed layouts, certificate status and validity rules.

``as_of`` is always a parameter, written as a timestamp text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritgrid.functions.exprs import first_rule, has, lookup
from meritgrid.functions.text import filled

# Date layouts tried in this order.
PORTAL_FORMATS = ["d MMM yyyy", "d MMMM yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d.M.yyyy"]
LIST_FORMATS = [
    "d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
]
DENTAL_FORMATS = ["d MMM yyyy", "d-M-yyyy", "yyyy-M-d"]
ABSENT_DATES = ["na", "n/a", "", "unknown"]
MONTHS = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}

# Application words -> status.
APPLICATION_RULES = [
    (["closed"], "Application Closed"),
    (["pending"], "Application Pending"),
    (["approved"], "Approved"),
    (["rejected"], "Rejected"),
    (["withdrawn"], "Withdrawn"),
]


def parse_date(text: Column | str, formats: Sequence[str] = tuple(PORTAL_FORMATS)) -> Column:
    """First layout that fits, as a date; null for absent or unreadable texts."""
    raw = F.trim(filled(text))
    tries = [F.try_to_timestamp(raw, F.lit(f)).cast("date") for f in formats]
    return F.when(~F.lower(raw).isin(ABSENT_DATES), F.coalesce(*tries))


def iso_or_same(text: Column | str) -> Column:
    """``30 Oct 2021`` as an ISO timestamp text, other texts unchanged."""
    parsed = F.try_to_timestamp(F.trim(filled(text)), F.lit("d MMM yyyy"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), filled(text))


def find_date(text: Column | str) -> Column:
    """Date text found by pattern: ``d Mon yyyy``, ``d/m/yyyy`` or ISO, written as ISO.

    Texts without a date stay as they are, blanks become null. ISO input stays ISO.
    """
    raw = filled(text)
    worded, slashed, iso = r"(\d{1,2})\s+(\w+)\s+(\d{4})", r"(\d{1,2})/(\d{1,2})/(\d{4})", r"(\d{4})-(\d{1,2})-(\d{1,2})"
    g = lambda p, i: F.regexp_extract(raw, p, i)
    two = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    month = g(worded, 2)
    named = F.coalesce(lookup(F.left(F.lower(month), F.lit(3)), MONTHS), F.lit("01"))
    month_no = F.when(month.rlike(r"^\p{L}+$"), named).otherwise(two(month))
    return (
        F.when(F.trim(raw) == "", F.lit(None).cast("string"))
        .when(g(worded, 0) != "", F.concat_ws("-", g(worded, 3), month_no, two(g(worded, 1))))
        .when(g(slashed, 0) != "", F.concat_ws("-", g(slashed, 3), two(g(slashed, 2)), two(g(slashed, 1))))
        .when(g(iso, 0) != "", F.concat_ws("-", g(iso, 1), two(g(iso, 2)), two(g(iso, 3))))
        .otherwise(raw)
    )


def _day(day: Column) -> Column:
    return day.cast("date").cast("timestamp")


def certificate_status(remarks: Column | str, valid_upto: Column, as_of: str, variant: str = "remarks_first") -> Column:
    """Status from remark words and the expiry date.

    Variants: ``remarks_first`` (words decide before the date), ``date_between`` (suspension and
    expiry words, then the date, then active words), ``portal`` (expiry word, then the date),
    ``dental`` (as portal with withdrawals, active without a date).
    """
    words = F.lower(filled(remarks))
    now, end = F.lit(as_of).cast("timestamp"), _day(valid_upto)
    by_day = F.when(end > now, "Active").when(end <= now, "Expired")
    if variant == "remarks_first":
        return (
            F.when(has(words, "expired"), "Expired")
            .when(has(words, "suspended"), "Suspended")
            .when(has(words, "revoked", "cancelled"), "Revoked")
            .when(has(words, "active", "valid"), "Active")
            .otherwise(F.coalesce(by_day, F.lit("Unknown")))
        )
    if variant == "date_between":
        not_before = F.when(end < now, "Expired").when(end >= now, "Active")
        worded = F.when(has(words, "active", "valid", "current"), "Active").otherwise("Unknown")
        return (
            F.when(has(words, "suspended", "revoked", "cancelled", "withdrawn"), "Suspended")
            .when(has(words, "expired", "lapsed"), "Expired")
            .otherwise(F.coalesce(not_before, worded))
        )
    if variant == "portal":
        return F.when(has(words, "expired"), "Expired").otherwise(F.coalesce(by_day, F.lit("Unknown")))
    if variant == "dental":
        return (
            F.when(has(words, "withdrawn", "suspended"), "Suspended")
            .when(has(words, "expired", "not renewed"), "Expired")
            .otherwise(F.coalesce(by_day, F.lit("Active")))
        )
    raise ValueError(f"unknown variant {variant}")


def refreshed_status(status: Column | str, valid_upto: Column, as_of: str) -> Column:
    """Status by the expiry date where there is one, else the given status."""
    now, end = F.lit(as_of).cast("timestamp"), _day(valid_upto)
    return F.coalesce(F.when(end >= now, "Active").when(end < now, "Expired"), filled(status))


def application_status(text: Column | str) -> Column:
    return first_rule(F.lower(filled(text)), APPLICATION_RULES, "Under Review")


def year_of(day: Column) -> Column:
    return F.year(day).cast("long")
