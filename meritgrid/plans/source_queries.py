"""Queries over readers' parsing, registry conversions, uploads and output shapes.

Raw documents and feed rows are derived from the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.exprs import num
from meritgrid.operators import validate
from meritgrid.plans.merging_queries import unique_certs
from meritgrid.plans.ranking_queries import ranked_table
from meritgrid.plans.registry import Views, query
from meritgrid.plans.text_queries import located_name, pick, us_address
from meritgrid.sources import readers, registries, sinks, uploads


def org_object() -> Column:
    return F.to_json(F.struct("name", "city", "country", "website"))


def document_text() -> Column:
    """List, wrapped, single and broken documents by turns."""
    one = org_object()
    listed = F.concat(F.lit("["), one, F.lit(","), one, F.lit("]"))
    return (
        F.when(F.col("seq") % 4 == 0, listed)
        .when(F.col("seq") % 4 == 1, F.concat(F.lit('{"metadata":{},"organizations":'), listed, F.lit("}")))
        .when(F.col("seq") % 4 == 2, one)
        .otherwise(F.concat(F.lit('{"name": "'), F.col("name"), F.lit('", "address" : "'), F.col("city"), F.lit('", ')))
    )


@query("parsed_documents")
def _parsed(v: Views) -> DataFrame:
    docs = v.orgs.select("seq", document_text().alias("document"))
    return readers.parse_documents(docs, "document").select("seq", "name", "city", "country", "website")


@query("recovered_documents")
def _recovered(v: Views) -> DataFrame:
    return readers.recover_documents(v.orgs.select("seq", document_text().alias("document")), "document")


@query("source_fallback")
def _fallback(v: Views) -> DataFrame:
    empty = v.orgs.filter("country = 'nowhere'").select("seq", "name")
    legacy = v.orgs.filter("data_source = 'supplier'").select("seq", "name", "city")
    spare = v.orgs.filter("data_source = 'customer'").select("seq", "name")
    return readers.first_available(empty, legacy, spare).select("seq", "name", "city")


@query("source_union")
def _union(v: Views) -> DataFrame:
    first = v.orgs.filter("data_source = 'customer'").select("seq", "city")
    second = v.orgs.filter("data_source = 'supplier'").select("seq", "state")
    both = readers.union_sources([("main", first), ("extra", second)])
    return both.groupBy("source_name", "source_priority").agg(
        F.count("*").alias("n"), F.count("city").alias("n_city"), F.count("state").alias("n_state")
    )


@query("payload_rows")
def _payload(v: Views) -> DataFrame:
    keyed = F.when(F.col("seq") % 2 == 0, F.to_json(F.struct(F.col("name").alias("hospital_name"), F.lit("").alias("state"), F.col("state").alias("state_name")))).otherwise(
        F.to_json(F.struct(F.lit(" ").alias("name"), F.col("name").alias("title"), F.col("city").alias("location"), F.col("phone").alias("mobile")))
    )
    text = (
        F.when(F.col("seq") % 3 == 0, F.concat(F.lit("["), keyed, F.lit("]")))
        .when(F.col("seq") % 3 == 1, F.concat(F.lit('{"data":['), keyed, F.lit(',{"name":""}]}')))
        .otherwise(keyed)
    )
    rows = registries.payload_rows(v.orgs.select("seq", text.alias("payload")), "payload")
    return rows.select("seq", "name", "state", "address", "phone")


@query("external_rows")
def _external(v: Views) -> DataFrame:
    record = F.create_map(
        F.when(F.col("seq") % 2 == 0, "organization_name").otherwise("name"), F.col("name"),
        F.lit("city"), F.col("city"), F.lit("town"), F.lit("Town"), F.lit("nation"), F.col("country"), F.lit("type"), F.col("hospital_type"),
    )
    return registries.external_rows(v.orgs.select("seq", record.alias("record"))).select("seq", "name", "city", "country", "hospital_type")


@query("hospital_csv_rows")
def _hospital_csv(v: Views) -> DataFrame:
    rows = v.orgs.select(
        "seq", F.when(F.col("seq") % 6 != 0, F.concat(F.lit(" "), F.col("name"))).otherwise(" ").alias("Hospital"), F.col("state").alias("State"),
        F.col("city").alias("City"), F.nullif(F.col("phone"), F.lit("")).alias("LocalAddress"), F.when(F.col("seq") % 4 != 0, (F.col("seq") % 900000 + 0.0)).alias("Pincode"),
    )
    out = uploads.hospital_csv_rows(rows)
    flag = lambda k: F.col("quality_indicators")[k].cast("int")
    return out.select("seq", "name", "city", "address", "pincode", flag("has_address").alias("has_address"), flag("has_pincode").alias("has_pincode"))


@query("rural_rows")
def _rural(v: Views) -> DataFrame:
    rows = v.orgs.select("seq", F.concat(F.col("name"), F.lit("  ")).alias("Hospital Name"), F.col("state").alias("State"), F.col("city").alias("District"))
    return uploads.rural_rows(rows).select("seq", "name", "city", F.col("location.state").alias("state"), "hospital_type")


@query("upload_rows")
def _upload_rows(v: Views) -> DataFrame:
    rows = v.orgs.select(
        "seq", F.when(F.col("seq") % 7 == 0, "nan").otherwise(F.col("name")).alias(" Hospital_Name "), F.col("country").alias("Nation"), F.col("city").alias("location"),
        F.col("state").alias("region"), F.col("name").alias("category"), (F.col("seq") % 50 + 0.5).cast("string").alias("BEDS"),
        pick(["iso 9001; cap", "JCI |,", "", "Green"], F.col("seq")).alias("accreditations"), F.lit("Eye, , Heart ").alias("departments"),
    )
    out = uploads.upload_rows(rows)
    return out.select(
        "seq", "name", "country", "city", "state", "hospital_type", "bed_count", F.array_join("specialties", "|").alias("specialties"),
        F.array_join(F.transform("certifications", lambda c: c["name"]), "|").alias("certs"), num(F.aggregate("certifications", F.lit(0.0), lambda a, c: a + c["score_impact"])).alias("impact"),
    )


def first_cert(*fields: str) -> list[Column]:
    return [F.col("certifications")[0][f].alias(f"cert_{f}") for f in fields]


@query("jci_rows")
def _jci(v: Views) -> DataFrame:
    rows = v.orgs.select("seq", "name", "country", F.when(F.col("seq") % 3 == 0, F.col("hospital_type")).alias("type"), F.lit("2020-01-01").alias("accreditation_date"), "region")
    out = registries.jci_rows(rows)
    return out.select("seq", "name", "hospital_type", "region", *first_cert("type", "accreditation_date"), num(F.col("certifications")[0]["score_impact"]).alias("impact"), F.size("search_keywords").cast("long").alias("n_keywords"))


@query("entry_level_rows")
def _entry(v: Views) -> DataFrame:
    rows = v.orgs.select(
        "seq", "name", "city", "state", pick(["Active", "Expired"], F.col("seq")).alias("status"), F.lit("India").alias("country"),
        F.lit("PEH-1").alias("accreditation_number"), F.lit("R1").alias("reference_number"), F.lit("").alias("valid_from"), F.lit("").alias("valid_upto"),
    )
    out = registries.entry_level_rows(rows)
    return out.select("seq", "name", "full_name", "hospital_type", num(F.col("certifications")[0]["score_impact"]).alias("impact"), F.col("quality_indicators")["accreditation_current"].cast("int").alias("current_flag"))


@query("updated_portal_rows")
def _updated(v: Views) -> DataFrame:
    rows = v.orgs.select(
        "seq", F.concat(F.lit(" "), F.col("name")).alias("name"), F.nullif(F.col("city"), F.lit("")).alias("city"), "state", F.lit("India").alias("country"), F.lit("Approved").alias("certification_status"),
        F.lit("N1").alias("accreditation_number"), F.lit("R").alias("reference_number"), F.lit(None).cast("date").alias("application_date"), (F.col("seq") % 100).alias("data_quality_score"),
    )
    return registries.updated_portal_rows(rows).select("seq", "name", "city", "data_source", num("quality_score").alias("quality_score"), *first_cert("status", "accreditation_no"))


@query("lab_feed_rows")
def _lab_feed(v: Views) -> DataFrame:
    rows = v.orgs.select(
        "seq", F.concat_ws(" ", "name", pick(["Kerala", "", "New Delhi"], F.col("seq"))).alias("name"), F.filter(F.array("city"), lambda c: c != "").alias("locations"),
        F.col("phone").alias("accreditation_number"), F.when(F.col("seq") % 2 == 0, "Inactive").alias("status"),
    )
    out = registries.lab_feed_rows(rows)
    return out.select("seq", "city", "state", *first_cert("status", "accreditation_no"), F.col("quality_indicators")["accreditation_valid"].cast("int").alias("valid_flag"), F.size("search_keywords").cast("long").alias("n_keywords"))


@query("pathology_rows")
def _pathology(v: Views) -> DataFrame:
    cert = F.struct(F.when(F.col("seq") % 2 == 0, "ISO 15189").alias("name"), F.lit(None).cast("string").alias("status"), F.lit("2025-01-01").alias("issue_date"))
    rows = v.orgs.select(
        "seq", "name", us_address().alias("address"), pick(["MN", "OH", "CA"], F.col("seq")).alias("state"), pick(["United States", "Germany", "Peru"], F.col("seq")).alias("country"), F.lit("55901").alias("zip_code"), F.array(cert).alias("certifications"),
    )
    return registries.pathology_rows(rows).select("seq", "city", "country", "region", *first_cert("name", "status", "accreditation_date"))


@query("dental_rows")
def _dental(v: Views) -> DataFrame:
    rows = v.orgs.select(
        "seq", F.concat_ws(", ", "name", F.nullif(F.col("city"), F.lit("")), F.when(F.col("seq") % 2 == 0, F.col("state")), F.lit("India")).alias("name"), F.lit("India").alias("country"),
        F.col("phone").alias("accreditation_no"), F.lit("R").alias("reference_no"), F.lit("01 Jan 2020").alias("valid_from"), F.col("city").alias("valid_upto"), F.lit("Active").alias("status"), F.lit("").alias("remarks"),
    )
    return registries.dental_rows(rows).select("seq", "city", "state", num("quality_score", 2).alias("quality_score"), num("data_completeness", 2).alias("data_completeness"))


@query("map_export_rows")
def _map_export(v: Views) -> DataFrame:
    tags = F.when(F.col("seq") % 5 != 0, F.create_map(F.lit("name"), F.col("name"), F.lit("is_in:city"), F.col("city"), F.lit("addr:city"), F.lit(""))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    lat = (F.col("seq") % 90).cast("double")
    element = F.when(F.col("seq") % 2 == 0, F.to_json(F.struct(tags.alias("tags"), lat.alias("lat"), lat.alias("lon")))).otherwise(
        F.to_json(F.struct(tags.alias("tags"), F.struct(lat.alias("lat"), (lat + 1).alias("lon")).alias("center")))
    )
    docs = v.orgs.select("seq", F.concat(F.lit('{"elements":['), element, F.lit("]}")).alias("document"))
    return registries.map_export_rows(docs, "document", "India").select("seq", "name", "city", "country", num("lat").alias("lat"), num("lon").alias("lon"))


@query("point_rows")
def _points(v: Views) -> DataFrame:
    point = F.when(F.col("seq") % 3 != 0, F.concat(F.lit("Point("), (F.col("seq") % 180).cast("string"), F.lit(".5 "), (F.col("seq") % 90).cast("string"), F.lit(".25)"))).otherwise("elsewhere")
    value = lambda c: F.struct(c.alias("value"))
    binding = F.to_json(F.struct(value(F.col("name")).alias("itemLabel"), value(F.col("country")).alias("countryLabel"), value(point).alias("coord")))
    docs = v.orgs.select("seq", F.concat(F.lit('{"results":{"bindings":['), binding, F.lit("]}}")).alias("document"))
    return registries.point_rows(docs, "document").select("seq", "name", "country", num("lat").alias("lat"), num("lon").alias("lon"))


@query("registry_defaults")
def _defaults(v: Views) -> DataFrame:
    rows = v.orgs.select(
        "seq", "name", pick(["India", "Brazil", "Peru"], F.col("seq")).alias("country"), F.when(F.col("seq") % 2 == 0, F.col("region")).alias("region"),
        F.create_map(F.lit("jci_accredited"), F.lit(True), F.lit("nabh_accredited"), F.lit(True)).alias("quality_indicators"),
    )
    out = registries.registry_defaults(rows)
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("quality_indicators")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return out.select("seq", "region", listed.alias("flags"))


@query("portal_to_unified")
def _portal(v: Views) -> DataFrame:
    rows = v.orgs.select(
        "seq", located_name().alias("name"), pick(["Active", "Expired", "Odd"], F.col("seq")).alias("status"), pick(["04 May 2015", "2016-01-01"], F.col("seq")).alias("valid_from"),
        F.lit("30 Oct 2021").alias("valid_upto"), F.lit("A").alias("accreditation_no"), F.lit("R").alias("reference_no"), pick(["6th Edition", "", "5th Edition", "4th Edition"], F.col("seq")).alias("remarks"),
    )
    out = registries.portal_to_unified(rows)
    return out.select("seq", "name", "city", "state", "country", "hospital_type", "accreditation_level", *first_cert("accreditation_date", "expiry_date"), num(F.col("certifications")[0]["score_impact"]).alias("impact"))


@query("flattened_regions")
def _regions(v: Views) -> DataFrame:
    regions = F.create_map(F.col("region"), F.array(F.struct("name", "country")), F.lit("Second"), F.array(F.struct(F.upper("name").alias("name"), "country"), F.struct("name", F.lit("X").alias("country"))))
    return registries.flatten_regions(v.orgs.select("seq", regions.alias("regions"))).groupBy("region", "source").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


@query("ranking_rows")
def _ranking_rows(v: Views) -> DataFrame:
    out = sinks.ranking_rows(ranked_table(v).withColumn("certification_count", F.col("active_certs")))
    return out.select("rank", "name", "country", num("total_score").alias("total_score"), "certification_count")


@query("audit_rows")
def _audit(v: Views) -> DataFrame:
    certs = unique_certs(v)
    sources = v.orgs.select("seq", F.posexplode(F.array("data_source", "region", "data_source")).alias("pos", "source"))
    flags = validate.registry_flag(certs.select("seq", "pos", "name"))
    return sinks.audit_rows(v.orgs, certs, sources, flags).select("id", "name", "sources", "source_count", "certifications_count", "certification_names", "has_jci")


@query("status_columns")
def _status_columns(v: Views) -> DataFrame:
    by_body = F.map_filter(
        F.create_map(F.lit("nabh"), F.struct(pick(["Accredited", "Applied"], F.col("seq")).alias("status")), F.lit("jci"), F.struct(F.lit("Unknown").alias("status"))),
        lambda k, _: (k == "nabh") | (F.col("seq") % 3 == 0),
    )
    return sinks.status_columns(v.orgs.select("seq", by_body.alias("certifications")))
