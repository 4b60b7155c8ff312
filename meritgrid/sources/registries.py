"""Registry feeds -> unified organisation rows with a nested certification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions import cleaning, dates
from meritgrid.functions.exprs import first_filled, lookup
from meritgrid.functions.text import filled
from meritgrid.operators import score_more, validate

# Names and impacts of the registry certifications.
JCI_NAME = "Joint Commission International (JCI)"
NABH_NAME = "National Accreditation Board for Hospitals & Healthcare Providers (NABH)"
NABL_NAME = "National Accreditation Board for Testing and Calibration Laboratories (NABL)"
CAP_BODY = "College of American Pathologists"
JCI_IMPACT, LAB_IMPACT, PATHOLOGY_IMPACT = 20.0, 15.0, 18.0

# Country -> region of the registry feeds.
REGISTRY_REGIONS = {
    "India": "Asia-Pacific", "Singapore": "Asia-Pacific", "Malaysia": "Asia-Pacific",
    "Thailand": "Asia-Pacific", "South Korea": "Asia-Pacific", "UAE": "Middle East",
    "Saudi Arabia": "Middle East", "Qatar": "Middle East", "Jordan": "Middle East",
    "Lebanon": "Middle East", "Turkey": "Europe", "Switzerland": "Europe", "Brazil": "Americas",
    "Colombia": "Americas", "Argentina": "Americas",
}
PATHOLOGY_REGIONS = {
    "United States": "Americas", "Canada": "Americas", "Brazil": "Americas",
    "United Kingdom": "Europe", "Germany": "Europe", "Switzerland": "Europe", "Ireland": "Europe",
    "Japan": "Asia-Pacific", "Singapore": "Asia-Pacific", "China": "Asia-Pacific",
    "South Korea": "Asia-Pacific", "Saudi Arabia": "Middle East", "UAE": "Middle East",
    "South Africa": "Africa",
}

# Alternative keys of external records and of search payloads.
EXTERNAL_KEYS = {
    "name": ["name", "organization_name", "hospital_name"],
    "city": ["city", "town"],
    "state": ["state", "region"],
    "country": ["country", "nation"],
    "hospital_type": ["hospital_type", "type"],
}
PAYLOAD_KEYS = {
    "name": ["name", "organization_name", "hospital_name", "title"],
    "state": ["state", "state_name", "location_state"],
    "city": ["city", "city_name", "location_city"],
    "address": ["address", "full_address", "location"],
    "phone": ["phone", "contact_number", "mobile"],
    "email": ["email", "email_address", "contact_email"],
    "website": ["website", "url", "web_url"],
    "accreditation_level": ["level", "accreditation_level", "grade"],
    "accreditation_category": ["category", "type", "organization_type"],
    "certificate_number": ["certificate_no", "cert_number", "registration_no"],
    "valid_from": ["valid_from", "start_date", "issue_date"],
    "valid_until": ["valid_until", "end_date", "expiry_date"],
}
PAYLOAD_DEFAULTS = {"state": "Unknown", "city": "Unknown", "accreditation_level": "Unknown", "accreditation_category": "Unknown"}


def certification(name: Column, kind: Column, status: Column, source: str, **more: Column) -> Column:
    """Certification struct with every field of the unified schema."""
    blank = F.lit("")
    return F.struct(
        name.alias("name"),
        kind.alias("type"),
        status.alias("status"),
        more.get("accreditation_date", blank).alias("accreditation_date"),
        more.get("expiry_date", blank).alias("expiry_date"),
        more.get("accreditation_no", blank).alias("accreditation_no"),
        more.get("reference_no", blank).alias("reference_no"),
        more.get("remarks", blank).alias("remarks"),
        more.get("score_impact", F.lit(0.0)).alias("score_impact"),
        F.lit(source).alias("source"),
    )


def flags(**values: bool | Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return F.create_map(*pairs)


def _kept(df: DataFrame) -> list[str]:
    return [c for c in ("seq",) if c in df.columns]


def first_key(record: Column, names: Sequence[str]) -> Column:
    """First non-blank value under alternative keys of a map."""
    return first_filled(*[F.try_element_at(record, F.lit(n)) for n in names])


def external_rows(records: DataFrame, record: str = "record", keys: Mapping[str, Sequence[str]] = EXTERNAL_KEYS) -> DataFrame:
    """Loose records (maps) -> standard columns by the first non-empty alternative key."""
    keep = [c for c in records.columns if c != record]
    return records.select(*keep, *[first_key(F.col(record), names).alias(f) for f, names in keys.items()])


def payload_rows(payloads: DataFrame, column: str) -> DataFrame:
    """Search payloads -> organisation rows that have a name."""
    from meritgrid.sources.readers import payload_items

    keep = [c for c in payloads.columns if c != column]
    items = payloads.select(*keep, F.explode(payload_items(column)).alias("record"))
    rows = external_rows(items, "record", PAYLOAD_KEYS).filter(filled("name") != "")
    return rows.fillna(PAYLOAD_DEFAULTS)


def jci_rows(rows: DataFrame) -> DataFrame:
    """International registry ``name, country, type, accreditation_date, region``."""
    cert = certification(
        F.lit(JCI_NAME), F.lit("JCI Accreditation"), F.lit("Active"), "JCI Database",
        accreditation_date=filled("accreditation_date"), remarks=F.lit("JCI Accredited"), score_impact=F.lit(JCI_IMPACT),
    )
    return rows.select(
        *_kept(rows),
        "name",
        F.col("name").alias("original_name"),
        F.lit("").alias("city"),
        F.lit("").alias("state"),
        filled("country").alias("country"),
        F.coalesce("type", F.lit("General Hospital")).alias("hospital_type"),
        F.array(cert).alias("certifications"),
        F.lit("JCI").alias("data_source"),
        flags(jci_accredited=True, nabh_accredited=False, international_accreditation=True, accreditation_valid=True).alias("quality_indicators"),
        filled("region").alias("region"),
        cleaning.search_keywords("name", "country").alias("search_keywords"),
    )


def entry_level_rows(rows: DataFrame) -> DataFrame:
    """Entry-level portal rows: name before the first ``, ``, type from the name, flags."""
    name = F.trim(F.split(filled("name"), ", ")[0])
    cert = certification(
        F.lit(NABH_NAME + " - Entry Level"), F.lit("NABH Entry Level"), F.coalesce("status", F.lit("Unknown")), "NABH Entry Level Portal",
        accreditation_no=filled("accreditation_number"), reference_no=filled("reference_number"),
        accreditation_date=filled("valid_from"), expiry_date=filled("valid_upto"),
        score_impact=F.when(F.col("status") == "Active", 15.0).otherwise(0.0),
    )
    return rows.select(
        *_kept(rows),
        name.alias("name"),
        F.col("name").alias("full_name"),
        F.coalesce("country", F.lit("India")).alias("country"),
        filled("state").alias("state"),
        filled("city").alias("city"),
        cleaning.facility_type(name, "registry").alias("hospital_type"),
        F.lit("NABH Entry Level Portal").alias("data_source"),
        F.array(cert).alias("certifications"),
        flags(nabh_accredited=True, nabh_entry_level=True, accreditation_current=F.coalesce(F.col("status") == "Active", F.lit(False))).alias("quality_indicators"),
    )


def updated_portal_rows(rows: DataFrame, data_source: str = "Updated_NABH_Portal") -> DataFrame:
    """Validated portal rows -> unified rows; the source name differs between two loaders."""
    cert = certification(
        F.lit("NABH"), F.lit("NABH"), F.coalesce("certification_status", F.lit("Unknown")), "NABH Updated Portal",
        accreditation_no=filled("accreditation_number"), reference_no=filled("reference_number"),
        accreditation_date=F.coalesce(F.col("application_date").cast("string"), F.lit("")),
    )
    return rows.select(
        *_kept(rows),
        F.trim("name").alias("name"),
        F.trim("name").alias("original_name"),
        F.trim(filled("city")).alias("city"),
        F.trim(filled("state")).alias("state"),
        F.coalesce("country", F.lit("India")).alias("country"),
        F.lit("Hospital").alias("hospital_type"),
        F.lit(data_source).alias("data_source"),
        F.array(cert).alias("certifications"),
        F.coalesce(F.col("data_quality_score").cast("double"), F.lit(0.0)).alias("quality_score"),
    )


def lab_feed_rows(rows: DataFrame) -> DataFrame:
    """Laboratory feed ``name, locations, accreditation_number, status, services``."""
    status = F.coalesce("status", F.lit("Active"))
    cert = certification(
        F.lit(NABL_NAME), F.lit("NABL Accreditation"), status, "NABL Database",
        accreditation_no=filled("accreditation_number"), remarks=F.lit("NABL Accredited - Testing"), score_impact=F.lit(LAB_IMPACT),
    )
    return rows.select(
        *_kept(rows),
        "name",
        F.coalesce(F.try_element_at("locations", F.lit(1)), F.lit("")).alias("city"),
        cleaning.state_in_name("name").alias("state"),
        F.lit("India").alias("country"),
        F.lit("Healthcare Organization").alias("hospital_type"),
        F.array(cert).alias("certifications"),
        F.lit("NABL").alias("data_source"),
        F.lit("Asia-Pacific").alias("region"),
        flags(
            jci_accredited=False, nabh_accredited=False, nabl_accredited=True, international_accreditation=False,
            accreditation_valid=F.lower(status) == "active",
        ).alias("quality_indicators"),
        cleaning.lab_feed_keywords("name", F.col("locations")).alias("search_keywords"),
    )


def pathology_rows(rows: DataFrame) -> DataFrame:
    """Pathology-body laboratories ``name, address, state, country, zip_code, certifications``."""
    cert = lambda c: certification(
        F.coalesce(c["name"], F.lit("ISO 15189 Medical Laboratory Accreditation")), F.lit("CAP 15189"),
        F.coalesce(c["status"], F.lit("Active")), CAP_BODY, accreditation_date=F.coalesce(c["issue_date"], F.lit("")),
        remarks=F.lit("CAP 15189 Accredited Laboratory"), score_impact=F.lit(PATHOLOGY_IMPACT),
    )
    country = F.coalesce("country", F.lit("United States"))
    return rows.select(
        *_kept(rows),
        "name",
        cleaning.us_city("address", "state").alias("city"),
        filled("state").alias("state"),
        country.alias("country"),
        filled("zip_code").alias("zip_code"),
        F.lit("Medical Laboratory").alias("hospital_type"),
        F.transform("certifications", cert).alias("certifications"),
        F.lit("CAP 15189").alias("data_source"),
        flags(
            cap_accredited=True, iso_15189_accredited=True, jci_accredited=False, nabh_accredited=False,
            international_accreditation=True, accreditation_valid=True, laboratory_accreditation=True,
        ).alias("quality_indicators"),
        lookup(country, PATHOLOGY_REGIONS, "Unknown").alias("region"),
        cleaning.pathology_keywords("name", country).alias("search_keywords"),
    )


def dental_rows(rows: DataFrame) -> DataFrame:
    """Dental facilities: city and state are the third and second comma parts from the end."""
    parts = F.split(filled("name"), ", ")
    n = F.size(parts)
    fields = {c: F.col(c) for c in (
        "name", "accreditation_no", "reference_no", "valid_from", "valid_upto", "status", "country", "remarks"
    )}
    return rows.select(
        *_kept(rows),
        "name",
        F.when(n >= 3, F.trim(F.try_element_at(parts, F.lit(-3)))).otherwise("Unknown").alias("city"),
        F.when(n >= 2, F.trim(F.try_element_at(parts, F.lit(-2)))).otherwise("Unknown").alias("state"),
        F.coalesce("country", F.lit("India")).alias("country"),
        F.lit("Dental Facility").alias("hospital_type"),
        F.lit("NABH_Dental").alias("data_source"),
        filled("status").alias("nabh_status"),
        F.round(validate.dental_quality(fields), 2).alias("quality_score"),
        F.round(validate.dental_completeness(fields), 2).alias("data_completeness"),
    )


def map_export_rows(documents: DataFrame, column: str, country: str) -> DataFrame:
    """Map export elements (tags, coordinates or a centre) -> rows with a name."""
    schema = "struct<elements:array<struct<tags:map<string,string>,lat:double,lon:double,center:struct<lat:double,lon:double>>>>"
    keep = [c for c in documents.columns if c != column]
    rows = documents.select(*keep, F.inline(F.from_json(F.col(column), schema)["elements"]))
    tag = lambda *names: first_key(F.col("tags"), names)
    return rows.select(
        *keep,
        tag("name").alias("name"),
        tag("addr:city", "is_in:city").alias("city"),
        tag("addr:state", "is_in:state").alias("state"),
        F.coalesce(tag("addr:country"), F.lit(country)).alias("country"),
        F.coalesce("lat", "center.lat").alias("lat"),
        F.coalesce("lon", "center.lon").alias("lon"),
    ).filter("name is not null")


def point_rows(documents: DataFrame, column: str) -> DataFrame:
    """Knowledge-base bindings -> rows; ``Point(lon lat)`` gives the coordinates."""
    value = "struct<value:string>"
    schema = (
        f"struct<results:struct<bindings:array<struct<itemLabel:{value},countryLabel:{value},coord:{value},website:{value}>>>>"
    )
    keep = [c for c in documents.columns if c != column]
    rows = documents.select(*keep, F.inline(F.from_json(F.col(column), schema)["results"]["bindings"]))
    point = F.col("coord.value")
    number = lambda i: F.nullif(F.regexp_extract(filled(point), r"^Point\(([^ ]+) ([^ )]+)\)", i), F.lit("")).try_cast("double")
    return rows.select(
        *keep,
        F.col("itemLabel.value").alias("name"),
        F.col("countryLabel.value").alias("country"),
        number(2).alias("lat"),
        number(1).alias("lon"),
        F.col("website.value").alias("website"),
    )


def registry_defaults(rows: DataFrame) -> DataFrame:
    """Registry rows with reset international flags, keywords and, where missing, a region.

    Expects ``name, country, region, quality_indicators map<string,boolean>``.
    """
    country = F.coalesce("country", F.lit("India"))
    reset = F.map_filter("quality_indicators", lambda k, _: ~k.isin("jci_accredited", "international_accreditation"))
    fixed = flags(jci_accredited=False, international_accreditation=False)
    return (
        rows.withColumn("quality_indicators", F.map_concat(reset, fixed))
        .withColumn("search_keywords", cleaning.search_keywords("name", country))
        .withColumn("region", F.coalesce("region", lookup(country, REGISTRY_REGIONS, "Unknown")))
    )


def portal_to_unified(rows: DataFrame) -> DataFrame:
    """Portal rows ``name, status, valid_from, valid_upto, accreditation_no, reference_no, remarks``
    with cleaned name, location, type and an edition-aware impact."""
    place = cleaning.place_in_name("name")
    status = F.coalesce("status", F.lit("Unknown"))
    cert = certification(
        F.lit(NABH_NAME), F.lit("NABH Accreditation"), status, "NABH Portal",
        accreditation_date=dates.iso_or_same("valid_from"), expiry_date=dates.iso_or_same("valid_upto"),
        accreditation_no=filled("accreditation_no"), reference_no=filled("reference_no"), remarks=filled("remarks"),
        score_impact=score_more.edition_impact(status, "remarks"),
    )
    return rows.select(
        *_kept(rows),
        cleaning.without_location_suffix("name").alias("name"),
        F.col("name").alias("original_name"),
        place["city"].alias("city"),
        place["state"].alias("state"),
        place["country"].alias("country"),
        cleaning.facility_type("name", "portal").alias("hospital_type"),
        F.array(cert).alias("certifications"),
        F.lit("NABH").alias("data_source"),
        flags(nabh_accredited=status == "Active", accreditation_valid=status == "Active").alias("quality_indicators"),
        score_more.edition("remarks").alias("accreditation_level"),
    )


def flatten_regions(rows: DataFrame, column: str = "regions") -> DataFrame:
    """Map region -> list of organisation structs as rows with the region as a column."""
    keep = [c for c in rows.columns if c != column]
    listed = rows.select(*keep, F.explode(column).alias("region", "_orgs"))
    return listed.select(*keep, "region", F.inline("_orgs"), F.lit("Known registry").alias("source"))
