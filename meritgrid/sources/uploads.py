"""Uploads and file lists: header synonyms, row casts and conversion to unified rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions import cleaning
from meritgrid.functions.text import filled
from meritgrid.rules.cleaning import HEADER_SYNONYMS


def map_headers(columns: Sequence[str], synonyms: Mapping[str, Sequence[str]] = HEADER_SYNONYMS) -> dict[str, str]:
    """Canonical field -> header, first synonym wins, without regard to case and outer spaces."""
    known = {c.strip().lower(): c for c in reversed(list(columns))}
    found = {}
    for field, names in synonyms.items():
        header = next((known[n] for n in names if n in known), None)
        if header is not None:
            found[field] = header
    return found


def whole_number(value: Column) -> Column:
    return value.try_cast("double").cast("long")


def upload_rows(df: DataFrame) -> DataFrame:
    """Upload with unknown headers -> unified rows; rows without a name drop."""
    mapped = map_headers(df.columns)
    if "name" not in mapped:
        raise ValueError("no column stands for the organisation name")
    source = lambda f: F.col(f"`{mapped[f]}`").cast("string") if f in mapped else F.lit(None).cast("string")
    name = F.trim(source("name"))
    kind = F.when(source("hospital_type").isNotNull(), cleaning.facility_type(source("hospital_type"), "upload"))
    skills = F.filter(F.transform(F.split(source("specialties"), ","), lambda s: F.trim(s)), lambda s: s != "")
    certs = F.transform(
        cleaning.upload_cert_names(source("certifications")),
        lambda raw: F.struct(
            cleaning.upload_cert_name(raw).alias("name"),
            cleaning.upload_cert_type(cleaning.upload_cert_name(raw)).alias("type"),
            F.lit("Active").alias("status"),
            F.lit("Upload").alias("source"),
            F.concat(F.lit("Imported from upload: "), raw).alias("remarks"),
            cleaning.upload_cert_impact(cleaning.upload_cert_name(raw)).alias("score_impact"),
        ),
    )
    kept = [c for c in ("seq",) if c in df.columns]
    rows = df.select(
        *kept,
        name.alias("name"),
        name.alias("original_name"),
        *[F.coalesce(F.trim(source(f)), F.lit("")).alias(f) for f in ("country", "city", "state")],
        F.coalesce(kind, F.lit("")).alias("hospital_type"),
        *[F.trim(source(f)).alias(f) for f in ("website", "phone", "email")],
        whole_number(source("established_year")).alias("established_year"),
        whole_number(source("bed_count")).alias("bed_count"),
        skills.alias("specialties"),
        certs.alias("certifications"),
        F.lit("Upload").alias("data_source"),
    )
    return rows.filter(F.col("name").isNotNull() & (F.col("name") != "") & (F.lower("name") != "nan"))


def hospital_csv_rows(df: DataFrame) -> DataFrame:
    """Hospital list ``Hospital, State, City, LocalAddress, Pincode`` -> unified rows."""
    address = F.trim(filled("LocalAddress"))
    kept = [c for c in ("seq",) if c in df.columns]
    return df.filter(F.trim(filled("Hospital")) != "").select(
        *kept,
        F.trim("Hospital").alias("name"),
        F.lit("India").alias("country"),
        F.trim(filled("State")).alias("state"),
        F.trim(filled("City")).alias("city"),
        address.alias("address"),
        F.coalesce(F.col("Pincode").cast("double").cast("long").cast("string"), F.lit("")).alias("pincode"),
        F.lit("General Hospital").alias("hospital_type"),
        F.lit("Hospital CSV").alias("data_source"),
        F.create_map(
            F.lit("csv_hospital"), F.lit(True),
            F.lit("has_address"), address != "",
            F.lit("has_pincode"), F.col("Pincode").isNotNull(),
            F.lit("location_verified"), F.lit(True),
        ).alias("quality_indicators"),
    )


def rural_rows(df: DataFrame) -> DataFrame:
    """Rural list ``Hospital Name, State, District`` -> unified rows with a nested location."""
    name, state, district = F.trim(F.col("`Hospital Name`")), F.trim("State"), F.trim("District")
    kept = [c for c in ("seq",) if c in df.columns]
    return df.select(
        *kept,
        name.alias("name"),
        name.alias("original_name"),
        district.alias("city"),
        state.alias("state"),
        F.lit("India").alias("country"),
        F.lit("Rural Hospital").alias("hospital_type"),
        F.lit("Rural list").alias("data_source"),
        F.create_map(
            F.lit("jci_accredited"), F.lit(False),
            F.lit("nabh_accredited"), F.lit(False),
            F.lit("nabl_accredited"), F.lit(False),
            F.lit("rural_hospital"), F.lit(True),
        ).alias("quality_indicators"),
        F.struct(district.alias("district"), state.alias("state"), F.lit("India").alias("country")).alias("location"),
    )
