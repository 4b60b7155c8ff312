"""Row validation with issue lists, completeness scores and record enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions import cleaning, dates
from meritgrid.functions.exprs import has, hits
from meritgrid.functions.text import filled, lower_name
from meritgrid.operators import filters, merge
from meritgrid.rules.filters import HEALTHCARE_WORDS


def _issues(*checks: tuple[Column, str]) -> Column:
    """Texts of the checks that hold, in order."""
    found = [F.when(F.coalesce(test, F.lit(False)), F.lit(issue)) for test, issue in checks]
    return F.array_compact(F.array(*found))


def name_issues(name: Column | str) -> Column:
    text = F.trim(filled(name))
    return _issues(
        (text == "", "Missing hospital name"),
        ((text != "") & (F.length(text) < 3), "Hospital name too short"),
        (F.length(text) > 200, "Hospital name too long"),
        (~text.rlike("[a-zA-Z]"), "Suspicious hospital name pattern"),
    )


def location_issues(city: Column | str, state: Column | str, country: Column | str) -> Column:
    c, s, n = F.trim(filled(city)), F.trim(filled(state)), F.trim(filled(country))
    return _issues(
        (c == "", "Missing city"),
        (s == "", "Missing state"),
        (n == "", "Missing country"),
        ((n != "") & (F.lower(n) != "india"), "Non-India country"),
    )


def number_issues(number: Column | str, reference: Column | str) -> Column:
    a, r = F.trim(filled(number)), F.trim(filled(reference))
    return _issues(
        (a == "", "Missing accreditation number"),
        ((a != "") & ~a.rlike(r"^PEH-\d{4}-\d{4}$"), "Invalid accreditation number format"),
        (r == "", "Missing reference number"),
    )


def _strict_iso(text: Column | str) -> Column:
    return F.try_to_timestamp(filled(text), F.lit("yyyy-M-d")).cast("date")


def date_issues(valid_from: Column | str, valid_upto: Column | str) -> Column:
    """Missing, unreadable, reversed, very short and very long validity periods."""
    a, b = filled(valid_from), filled(valid_upto)
    start, end = _strict_iso(a), _strict_iso(b)
    days = F.datediff(end, start)
    both = (a != "") & (b != "")
    return _issues(
        (a == "", "Missing valid from date"),
        (b == "", "Missing valid upto date"),
        (both & (start >= end), "Invalid date range (from >= upto)"),
        (both & (days < 30), "Suspiciously short certification period"),
        (both & (days > 3650), "Suspiciously long certification period"),
        (both & (start.isNull() | end.isNull()), "Invalid date format"),
    )


def status_issues(status: Column | str, valid_upto: Column | str, as_of: str) -> Column:
    text = F.trim(filled(status))
    end, now = _strict_iso(valid_upto).cast("timestamp"), F.lit(as_of).cast("timestamp")
    return _issues(
        (text == "", "Missing certification status"),
        ((text != "") & ~text.isin("Active", "Expired"), "Invalid certification status"),
        ((text == "Active") & (end < now), "Status shows Active but certification expired"),
        ((text == "Expired") & (end >= now), "Status shows Expired but certification still valid"),
    )


def validated(rows: DataFrame, as_of: str) -> DataFrame:
    """Portal rows with cleaned name and places, refreshed status, ``issues`` and ``is_valid``.

    Expects ``name, city, state, country, accreditation_number, reference_number, valid_from,
    valid_upto, status`` with ISO date texts.
    """
    issues = F.concat(
        name_issues("name"),
        location_issues("city", "state", "country"),
        number_issues("accreditation_number", "reference_number"),
        date_issues("valid_from", "valid_upto"),
        status_issues("status", "valid_upto", as_of),
    )
    return (
        rows.withColumn("issues", issues)
        .withColumn("is_valid", F.size("issues") == 0)
        .withColumn("name", cleaning.tidy_hospital_name("name"))
        .withColumn("city", cleaning.plain_state("city"))
        .withColumn("state", cleaning.plain_state("state"))
        .withColumn("status", dates.refreshed_status("status", _strict_iso("valid_upto"), as_of))
    )


def issue_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def portal_quality(name: Column, reference: Column, state: Column, city: Column, day: Column, application: Column,
                   address: Column, status: Column, level: Column) -> Column:
    """0-100 completeness points of a portal row."""
    given = lambda c: filled(c) != ""
    points = [
        F.when(F.length(name) > 10, 20).when(given(name), 10).otherwise(0),
        F.when(given(reference), 15).otherwise(0),
        F.when(given(state) & (state != "Unknown"), 15).otherwise(0),
        F.when(given(city) & (city != "Unknown"), 10).otherwise(0),
        F.when(day.isNotNull(), 10).otherwise(0),
        F.when(given(application), 10).otherwise(0),
        F.when(given(address), 5).otherwise(0),
        F.when(filled(status) != "Unknown", 10).otherwise(0),
        F.when(given(level), 5).otherwise(0),
    ]
    return F.least(sum(points, F.lit(0)), F.lit(100))


def portal_rows(rows: DataFrame) -> DataFrame:
    """Portal rows with a name and reference, cleaned, dated, scored; one per name and reference.

    The portal keeps the application date in ``accreditation_number`` and the application status
    in ``valid_from``.
    """
    usable = rows.filter((F.length(F.trim(filled("name"))) >= 3) & (filled("reference_number") != ""))
    day_text = filled("accreditation_number")
    cleaned = usable.select(
        "*",
        dates.parse_date(F.when(~day_text.isin("", "N/A", "Unknown"), day_text)).alias("application_date"),
        F.trim(filled("valid_from")).alias("application_status"),
    )
    city = F.when(filled("city") != "", cleaning.tidy_place(filled("city"))).otherwise(F.col("city"))
    cleaned = (
        cleaned.withColumn("name", cleaning.portal_name("name"))
        .withColumn("reference_number", F.trim("reference_number"))
        .withColumn("certification_status", dates.application_status("application_status"))
        .withColumn("city", city)
        .withColumn("state", cleaning.known_state("state"))
        .withColumn("country", F.lit("India"))
    )
    quality = portal_quality(*[F.col(c) for c in (
        "name", "reference_number", "state", "city", "application_date", "application_status", "address",
        "certification_status", "accreditation_level",
    )])
    scored = cleaned.withColumn("data_quality_score", quality)
    return merge.dedupe_on(scored, [lower_name("name"), F.trim("reference_number")])


# --- completeness of other feeds -----------------------------------------------------------


def dental_quality(fields: dict[str, Column]) -> Column:
    """Percentage points of a dental row: name 2, number 2, reference 1, dates 2, others 1 each."""
    given = {k: filled(c).rlike(r"\S") for k, c in fields.items()}
    points = [
        (given["name"], 2), (given["accreditation_no"], 2), (given["reference_no"], 1),
        (given["valid_from"] & given["valid_upto"], 2), (given["status"], 1), (given["country"], 1), (given["remarks"], 1),
    ]
    return sum((F.when(test, p).otherwise(0) for test, p in points), F.lit(0)) * 10.0


def dental_completeness(fields: dict[str, Column]) -> Column:
    required = ["name", "accreditation_no", "reference_no", "valid_from", "valid_upto", "status", "country"]
    done = sum((F.when(filled(fields[f]).rlike(r"\S"), 1).otherwise(0) for f in required), F.lit(0))
    return done * 100.0 / len(required)


def lab_confidence(name: Column | str, has_location: Column, has_number: Column, has_scope: Column) -> Column:
    """0-100 confidence of a laboratory row."""
    words = F.least(hits(F.lower(filled(name)), [w.lower() for w in HEALTHCARE_WORDS]) * 10, F.lit(30))
    return F.least(
        F.when(filters.valid_name(name), 40.0).otherwise(0.0)
        + words
        + F.when(has_location, 15.0).otherwise(0.0)
        + F.when(has_number, 10.0).otherwise(0.0)
        + F.when(has_scope, 5.0).otherwise(0.0),
        F.lit(100.0),
    )


def enriched_labs(rows: DataFrame) -> DataFrame:
    """Laboratory rows with a clean name, places, type, distinct services and quality columns.

    Expects ``seq, name, locations array, services array, accreditation_number, scope``. Rows
    without a valid name drop; one row per cleaned lower-case name stays.
    """
    valid = rows.filter(filters.valid_name("name")).withColumn("name", cleaning.registry_name("name"))
    found = F.when(F.size(F.coalesce("locations", F.array().cast("array<string>"))) > 0, F.col("locations"))
    services = F.coalesce("services", F.array().cast("array<string>"))
    by_service = F.exists(services, lambda s: F.contains(F.lower(s), F.lit("laboratory")))
    kind = cleaning.facility_type("name", "laboratory")
    out = (
        valid.withColumn("locations", F.coalesce(found, cleaning.cities_in("name")))
        .withColumn("organization_type", F.when((kind == "Healthcare Organization") & by_service, "Laboratory").otherwise(kind))
        .withColumn("services", F.array_distinct(services))
        .withColumn("has_location", F.size("locations") > 0)
        .withColumn("has_number", filled("accreditation_number") != "")
        .withColumn("has_scope", filled("scope") != "")
        .withColumn("name_length", F.length("name"))
    )
    out = out.withColumn(
        "confidence_score", lab_confidence("name", F.col("has_location"), F.col("has_number"), F.col("has_scope"))
    )
    return merge.dedupe_on(out, [lower_name("name")])


def registry_flag(certs: DataFrame) -> DataFrame:
    """Per organisation the first registry certification by name, type or issuer, with its dates."""
    texts = [F.lower(filled(c)) if c in certs.columns else F.lit("") for c in ("name", "type", "issuer")]
    test = F.lit(False)
    for t in texts:
        test = test | has(t, "jci", "joint commission international")

    def pick(names: Sequence[str]) -> Column:
        held = [F.col(n) for n in names if n in certs.columns]
        return F.coalesce(*held, F.lit(""))

    row = F.struct(
        pick(["accreditation_date", "valid_from", "date"]).alias("accreditation_date"),
        pick(["expiry_date", "valid_until"]).alias("expiry_date"),
    )
    return certs.groupBy("seq").agg(
        F.max(test.cast("int")).alias("has_jci"),
        F.min_by(F.when(test, row), F.when(test, F.col("pos"))).alias("_f"),
    ).select(
        "seq",
        "has_jci",
        F.coalesce("_f.accreditation_date", F.lit("")).alias("jci_accreditation_date"),
        F.coalesce("_f.expiry_date", F.lit("")).alias("jci_expiry_date"),
    )


def indicator_initiatives(flags: DataFrame) -> DataFrame:
    """Initiative rows implied by registry flags. ``flags(seq, jci_accredited, nabh_accredited)``."""
    rows = [
        F.when(F.col("jci_accredited"), F.struct(F.lit("JCI Quality Standards").alias("name"), F.lit(5).alias("score_impact"))),
        F.when(F.col("nabh_accredited"), F.struct(F.lit("NABH Quality Standards").alias("name"), F.lit(3).alias("score_impact"))),
    ]
    return flags.select("seq", F.inline(F.array_compact(F.array(*rows))))
