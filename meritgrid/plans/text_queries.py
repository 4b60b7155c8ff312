"""Queries over text clean-up, places, keywords, dates and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions import cleaning, dates, text
from meritgrid.functions.exprs import computed_once, num
from meritgrid.operators import match, validate
from meritgrid.plans.registry import Views, query

AS_OF = "1999-06-01 12:00:00"


def pick(options: list[str], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (by % len(options) + 1).cast("int"))


def raw_name() -> Column:
    """Names with stray spaces, abbreviations, capitals and titles."""
    tail = pick([" Hosp. Pvt Ltd", " AND CHILD", "CareUnit", " Ltd.", " of the lab.", ".,"], F.col("seq"))
    head = pick(["", "Dr. ", "  ", "(", "ms "], F.col("seq"))
    return F.concat(head, F.col("name"), tail)


STATE_TEXTS = ["Tamilnadu", "orissa", "Chattisgarh", "GOA", "jammu and  kashmir", "n/a", "Bangalore", "Sindh"]


def located_name() -> Column:
    state = pick(["Goa", "Tamil Nadu", "Kerala"], F.col("seq"))
    ending = pick([", India", ", Nepal", "", ", india"], F.col("seq"))
    return F.concat(
        F.split("name", ",")[0], F.when(F.col("city") != "", F.concat(F.lit(", "), "city")).otherwise(""), F.lit(", "), state, ending,
        F.when(F.col("seq") % 9 == 0, " (Punjab)").otherwise(""),
    )


def us_address() -> Column:
    state = pick(["MN", "OH", "CA"], F.col("seq"))
    city = pick(["Rochester", "Eau Claire", "Fresno", "Lima"], F.col("seq"))
    number = (F.col("seq") % 900 + 100).cast("string")
    code = F.concat(F.lit("55"), F.lpad((F.col("seq") % 1000).cast("string"), 3, "0"))
    us = F.concat(number, F.lit(" Main Street, "), city, F.lit(", "), state, F.lit(" "), code)
    abroad = F.concat(F.lit("Ring 7, "), city, F.lit(", Germany"))
    phone = F.when(F.col("phone") != "", F.concat(F.lit(" "), F.col("phone"))).otherwise("")
    return F.concat(F.when(F.col("seq") % 5 == 0, abroad).otherwise(us), phone)


@query("clean_names")
def _clean_names(v: Views) -> DataFrame:
    raw = raw_name()
    return v.orgs.select(
        "seq",
        cleaning.tidy_hospital_name(raw).alias("tidy_name"),
        cleaning.registry_name(raw).alias("registry_name"),
        cleaning.document_name(raw).alias("document_name"),
        cleaning.portal_name(raw).alias("portal_name"),
        cleaning.without_location_suffix(located_name()).alias("short_name"),
        cleaning.clean_text(F.concat(raw, F.lit(" #1 & <b>!"))).alias("clean_text"),
    )


@query("place_parts")
def _place_parts(v: Views) -> DataFrame:
    name = located_name()
    parts, inside = cleaning.place_parts(name), cleaning.place_in_name(name)
    listed, bracketed = cleaning.listed_place(name), cleaning.listed_place(name, True)
    return v.orgs.select(
        "seq",
        F.concat_ws("|", parts["city"], parts["state"], parts["country"]).alias("parts"),
        F.concat_ws("|", inside["city"], inside["state"], inside["country"]).alias("inside"),
        F.concat_ws("|", listed["city"], listed["state"], listed["address"]).alias("listed"),
        bracketed["state"].alias("bracketed_state"),
    )


@query("tidy_locations")
def _tidy_locations(v: Views) -> DataFrame:
    address = F.concat_ws(" / ", "country", "region", F.lit("India"), "country", F.lit("x u003cbr"))
    where = cleaning.location_of(F.col("city"), F.col("state"), address)
    placed = computed_once(v.orgs, location=where, located=located_name())
    return placed.select(
        "seq",
        "location",
        cleaning.name_without_place("located", "location").alias("bare_name"),
        cleaning.display_line("located", "location").alias("display_line"),
        cleaning.suggestion_key("located", "location").alias("suggestion_key"),
    )


@query("states_and_countries")
def _states(v: Views) -> DataFrame:
    state = pick(STATE_TEXTS, F.col("seq"))
    spot = pick(["Dhaka clinic", "London", "Pune 7", "Fortis Riyadh", "Quito"], F.col("seq"))
    return v.orgs.select(
        "seq",
        cleaning.known_state(state).alias("known_state"),
        cleaning.plain_state(state).alias("plain_state"),
        cleaning.state_in_address(F.concat_ws(" ", "name", state)).alias("address_state"),
        cleaning.state_in_name(F.concat_ws(" ", "name", state)).alias("name_state"),
        cleaning.country_of_name(spot).alias("name_country"),
        cleaning.country_of_place(spot).alias("place_country"),
        cleaning.region_of(spot, F.col("city"), {"united states": ["city 1"]}).alias("region_key"),
        F.array_join(cleaning.cities_in(spot), "|").alias("cities"),
    )


@query("address_parts")
def _addresses(v: Views) -> DataFrame:
    address = us_address()
    place, triple = cleaning.us_place(address), cleaning.city_state_zip(address)
    return v.orgs.select(
        "seq",
        cleaning.us_city(address, place["state"]).alias("city_found"),
        cleaning.zip_code(address).alias("zip_found"),
        F.concat_ws("|", place["state"], place["zip_code"], place["country"]).alias("us_place"),
        F.concat_ws("|", triple["city"], triple["state"], triple["zip_code"]).alias("triple"),
        cleaning.has_phone(address).cast("int").alias("has_phone"),
        cleaning.phone_of(address).alias("phone_found"),
    )


@query("facility_types")
def _facility_types(v: Views) -> DataFrame:
    lists = ["registry", "portal", "web", "collector", "laboratory", "upload"]
    sized = cleaning.facility_type_by_size("name", F.col("seq") % 8)
    return v.orgs.select(
        "seq", *[cleaning.facility_type("name", k).alias(f"{k}_type") for k in lists], sized.alias("sized_type")
    )


@query("search_keywords")
def _keywords(v: Views) -> DataFrame:
    join = lambda c: F.array_join(c, "|")
    return v.orgs.select(
        "seq",
        join(F.array_sort(cleaning.specialties("name"))).alias("specialties"),
        join(cleaning.search_keywords("name", "country")).alias("keywords"),
        join(cleaning.pathology_keywords("name", "country")).alias("lab_keywords"),
        join(cleaning.lab_feed_keywords("name", F.array("city"))).alias("feed_keywords"),
    )


@query("upload_certs")
def _upload_certs(v: Views) -> DataFrame:
    joined = F.concat(F.lower("name"), F.lit("; "), F.upper("status"), F.lit(" |,"), F.col("pos").cast("string"))
    rows = v.certs.select("seq", "pos", F.explode(cleaning.upload_cert_names(joined)).alias("raw"))
    name = cleaning.upload_cert_name(F.col("raw"))
    return rows.withColumn("cert_name", name).groupBy("cert_name", F.when(F.col("raw").rlike(r"^\d+$"), "").otherwise(F.col("raw")).alias("raw")).agg(
        F.count("*").alias("n"),
        F.min(cleaning.upload_cert_type(F.col("cert_name"))).alias("cert_type"),
        F.min(cleaning.upload_cert_impact(F.col("cert_name"))).alias("impact"),
    ).filter("raw <> ''")


@query("feed_cert_kinds")
def _feed_kinds(v: Views) -> DataFrame:
    return v.certs.groupBy("name", cleaning.feed_cert_kind("name").alias("kind")).agg(F.count("*").alias("n"))


@query("urls")
def _urls(v: Views) -> DataFrame:
    return v.pages.select(
        "page_id",
        cleaning.full_url(F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))).alias("full_url"),
        cleaning.name_from_url("url").alias("url_name"),
        cleaning.name_from_url("url", True).alias("url_name_plain"),
    )


@query("display_details")
def _display_details(v: Views) -> DataFrame:
    address = F.when(F.col("seq") % 4 == 0, "Location to be verified").otherwise(us_address())
    return v.orgs.select("seq", cleaning.display_details("name", address, "data_source", F.col("seq") % 6).alias("line"))


@query("text_similarity")
def _similarity(v: Views) -> DataFrame:
    """Edit similarity and word overlap of every name with its two-word head."""
    head = F.concat_ws(" ", F.slice(F.split("name", " "), 1, 2))
    edit = 1 - F.levenshtein(F.lower("name"), F.lower(head)) / F.greatest(F.length("name"), F.length(head))
    return v.orgs.select(
        "seq",
        num(edit).alias("edit_similarity"),
        num(text.word_overlap(text.words(F.lower("name")), text.words(F.lower(head)))).alias("word_overlap"),
        num(text.word_similarity(text.words(F.lower("name")), text.words(F.lower(head)))).alias("word_jaccard"),
    )


@query("char_similarity")
def _char_similarity(v: Views) -> DataFrame:
    head = F.concat_ws(" ", F.slice(F.split("name", " "), 1, 2))
    return v.orgs.select("seq", num(match.char_similarity(F.lower("name"), F.lower(head))).alias("char_similarity"))


def date_text() -> Column:
    day, month = (F.col("pos") % 28 + 1).cast("string"), F.col("pos") % 12 + 1
    year = (F.col("pos") % 20 + 1995).cast("string")
    return (
        F.when(F.col("pos") % 6 == 0, F.concat_ws("/", day, month.cast("string"), year))
        .when(F.col("pos") % 6 == 1, F.concat_ws("-", day, month.cast("string"), year))
        .when(F.col("pos") % 6 == 2, F.concat_ws(".", F.lpad(day, 2, "0"), F.lpad(month.cast("string"), 2, "0"), year))
        .when(F.col("pos") % 6 == 3, F.concat(F.lit("Mar "), day, F.lit(", "), year))
        .otherwise(F.col("accreditation_date"))
    )


@query("date_parse")
def _date_parse(v: Views) -> DataFrame:
    raw = date_text()
    return v.certs.select(
        raw.alias("raw"),
        dates.parse_date(raw).cast("string").alias("portal_date"),
        dates.parse_date(raw, dates.LIST_FORMATS).cast("string").alias("list_date"),
        dates.find_date(raw).alias("found_date"),
        dates.iso_or_same(raw).alias("iso_or_same"),
    ).distinct()


def remark_text() -> Column:
    return pick(["", "Suspended by board", "renewal valid", "Expired in 2020", "cancelled", "not renewed", "current file"], F.col("pos"))


@query("certificate_status")
def _certificate_status(v: Views) -> DataFrame:
    end = F.when(F.col("pos") % 4 != 0, F.col("expiry_ts").cast("date"))
    variants = ["remarks_first", "date_between", "portal", "dental"]
    rows = v.certs.select(
        *[dates.certificate_status(remark_text(), end, AS_OF, k).alias(k) for k in variants],
        dates.refreshed_status("status", end, AS_OF).alias("refreshed"),
        dates.application_status(remark_text()).alias("application"),
    )
    return rows.groupBy(*variants, "refreshed", "application").agg(F.count("*").alias("n"))


def registry_rows(v: Views) -> DataFrame:
    """One portal row per order with dates, numbers and places of its organisation."""
    start = F.col("ts").cast("date")
    end = F.date_add(start, (F.col("entry_id") % 40 * 110).cast("int"))
    places = v.orgs.select("seq", "name", "city", "state")
    rows = v.history.join(places, "seq")
    return rows.select(
        F.col("entry_id").alias("seq"),
        F.when(F.col("entry_id") % 41 == 0, "42").otherwise(F.col("name")).alias("name"),
        "city",
        "state",
        F.when(F.col("entry_id") % 10 == 0, "Nepal").when(F.col("entry_id") % 11 == 0, "").otherwise("India").alias("country"),
        F.when(F.col("entry_id") % 13 == 0, "X-1").otherwise(F.concat(F.lit("PEH-2015-"), F.lpad((F.col("entry_id") % 10000).cast("string"), 4, "0"))).alias("accreditation_number"),
        F.when(F.col("entry_id") % 17 != 0, F.concat(F.lit("R"), (F.col("entry_id") % 50).cast("string"))).alias("reference_number"),
        F.when(F.col("entry_id") % 19 != 0, start.cast("string")).otherwise("").alias("valid_from"),
        F.when(F.col("entry_id") % 23 != 0, end.cast("string")).otherwise("soon").alias("valid_upto"),
        F.when(F.col("entry_id") % 3 == 0, "Active").when(F.col("entry_id") % 3 == 1, "Expired").otherwise("Lapsed").alias("status"),
    )


@query("validation_issues")
def _validation(v: Views) -> DataFrame:
    out = validate.validated(registry_rows(v), AS_OF)
    return out.select("seq", F.array_join("issues", "|").alias("issues"), F.col("is_valid").cast("int").alias("is_valid"), "status")


@query("issue_histogram")
def _issue_histogram(v: Views) -> DataFrame:
    return validate.issue_counts(validate.validated(registry_rows(v), AS_OF))


@query("portal_rows")
def _portal_rows(v: Views) -> DataFrame:
    """Portal rows as published: application date in the number column, status in valid_from."""
    rows = registry_rows(v).select(
        "seq", "name", F.when(F.col("city") != "", F.col("city")).alias("city"), "state", "reference_number",
        F.when(F.col("seq") % 4 == 0, "N/A").otherwise(F.date_format(F.col("valid_from").try_cast("date"), "dd MMM yyyy")).alias("accreditation_number"),
        pick(["Closed", "pending review", "Approved ", ""], F.col("seq")).alias("valid_from"),
        F.when(F.col("seq") % 2 == 0, F.col("city")).alias("address"),
        F.lit("Entry Level").alias("accreditation_level"),
    )
    return validate.portal_rows(rows).select(
        "seq", "name", "city", "state", F.col("application_date").cast("string").alias("application_date"),
        "certification_status", F.col("data_quality_score").cast("long").alias("data_quality_score"),
    )


@query("dental_scores")
def _dental(v: Views) -> DataFrame:
    fields = {
        "name": F.col("name"), "accreditation_no": F.col("phone"), "reference_no": F.col("city"), "valid_from": F.col("website"),
        "valid_upto": F.col("state"), "status": F.nullif(F.col("state"), F.lit("Unknown")), "country": F.col("country"),
        "remarks": F.when(F.col("seq") % 2 == 0, " "),
    }
    return v.orgs.select(
        "seq", num(validate.dental_quality(fields)).alias("quality"), num(validate.dental_completeness(fields)).alias("completeness")
    )


def lab_rows(v: Views) -> DataFrame:
    return v.orgs.select(
        "seq",
        F.concat_ws(" ", "name", pick(["Pune", "", "Noida Agra"], F.col("seq"))).alias("name"),
        F.when(F.col("seq") % 4 == 0, F.array("city")).alias("locations"),
        F.array(F.lit("Blood laboratory"), F.lit("Blood laboratory")).alias("services"),
        F.when(F.col("phone") != "", F.col("phone")).alias("accreditation_number"),
        F.when(F.col("seq") % 3 == 0, "testing").otherwise("").alias("scope"),
    )


@query("enriched_labs")
def _enriched(v: Views) -> DataFrame:
    return validate.enriched_labs(lab_rows(v)).select(
        "seq", "name", F.array_join("locations", "|").alias("locations"), "organization_type",
        F.size("services").cast("long").alias("n_services"), num("confidence_score").alias("confidence_score"),
    )


@query("registry_flag")
def _registry_flag(v: Views) -> DataFrame:
    certs = v.certs.groupBy("seq", "pos").agg(
        F.min("name").alias("name"), F.min("accreditation_date").alias("accreditation_date"), F.min(F.col("expiry_ts").cast("date").cast("string")).alias("expiry_date")
    )
    return validate.registry_flag(certs)


@query("indicator_initiatives")
def _indicators(v: Views) -> DataFrame:
    flags = v.orgs.select("seq", (F.col("seq") % 3 == 0).alias("jci_accredited"), (F.col("seq") % 4 == 0).alias("nabh_accredited"))
    return validate.indicator_initiatives(flags)
