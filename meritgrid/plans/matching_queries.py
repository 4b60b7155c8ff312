"""Queries over name normalisers and matching operators.

The supplier feed plays the incoming registry, the customer feed the base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgrid.functions import text
from meritgrid.functions.exprs import num
from meritgrid.operators import match, score
from meritgrid.plans.registry import Views, query


def incoming(v: Views) -> DataFrame:
    return v.orgs.filter("data_source = 'supplier'")


def base(v: Views) -> DataFrame:
    return v.orgs.filter("data_source = 'customer'")


@query("name_keys")
def _name_keys(v: Views) -> DataFrame:
    return v.orgs.select(
        "seq",
        text.alnum_key("name").alias("alnum_key"),
        text.score_key("name").alias("score_key"),
        text.company_key("name").alias("company_key"),
        text.lab_match_key("name").alias("lab_match_key"),
        text.registry_key("name").alias("registry_key"),
        text.hospital_key("name").alias("hospital_key"),
        text.lab_key("name").alias("lab_key"),
        text.search_key("name").alias("search_key"),
    )


@query("canonical_names")
def _canonical(v: Views) -> DataFrame:
    place = ("city", "state", "country")
    return v.orgs.select(
        "seq",
        text.canonical_name("name", *place).alias("canonical_name"),
        text.loader_name("name", *place).alias("loader_name"),
    )


@query("cert_keys")
def _cert_keys(v: Views) -> DataFrame:
    return v.certs.groupBy("name", text.cert_key("name").alias("cert_key")).agg(F.count("*").alias("n"))


@query("match_same_name")
def _same_name(v: Views) -> DataFrame:
    return match.same_name(incoming(v), base(v))


@query("match_verified_registry")
def _verified(v: Views) -> DataFrame:
    return match.verified_registry_match(v.orgs, v.registry)


@query("match_located_name")
def _located(v: Views) -> DataFrame:
    registry = incoming(v).select("seq", "name", "city", "state")
    return match.located_name_match(v.orgs, registry)


@query("registry_valid")
def _registry_valid(v: Views) -> DataFrame:
    return match.registry_valid(v.orgs, v.registry).select("seq", "registry_valid")


@query("insert_by_place")
def _insert_by_place(v: Views) -> DataFrame:
    keys = [F.concat_ws("_", F.lower("name"), F.lower("city"), F.lower("state"))]
    return match.insert_new(base(v), incoming(v), keys).select("seq", "name")


@query("insert_by_name")
def _insert_by_name(v: Views) -> DataFrame:
    return match.insert_new(base(v), incoming(v), [F.lower("name")], keep_repeats=True).select("seq", "name")


@query("insert_by_name_once")
def _insert_once(v: Views) -> DataFrame:
    fresh = incoming(v).filter(F.trim("name") != "")
    return match.insert_new(base(v), fresh, [F.lower("name")]).select("seq", "name")


@query("enrich_last")
def _enrich(v: Views) -> DataFrame:
    return match.enrich_last(incoming(v), base(v), ["phone", "website"]).select(
        "seq", "enriched", "extra_phone", "extra_website"
    )


@query("fill_from_existing")
def _fill(v: Views) -> DataFrame:
    return match.fill_from(incoming(v), base(v), ["city", "phone"]).select("seq", "city", "phone")


@query("match_tiered")
def _tiered(v: Views) -> DataFrame:
    return match.tiered_match(incoming(v), base(v))


@query("match_same_place")
def _same_place(v: Views) -> DataFrame:
    return match.same_place_match(incoming(v), base(v))


@query("match_three_keys")
def _three_keys(v: Views) -> DataFrame:
    number = F.concat(F.lit("PEH-"), (F.col("seq") % 97).cast("string"))
    numbered = incoming(v).withColumn("accreditation_no", F.when(F.col("seq") % 5 == 0, number).otherwise(""))
    held = v.certs.filter(F.col("name").startswith("NABH")).select(
        "seq", F.concat(F.lit("PEH-"), (F.col("pos") % 400).cast("string")).alias("accreditation_no")
    )
    return match.three_key_match(numbered, base(v), held)


@query("match_lab_name")
def _lab_name(v: Views) -> DataFrame:
    return match.lab_name_match(incoming(v), base(v))


@query("match_similar_name")
def _similar_name(v: Views) -> DataFrame:
    return match.similar_name_match(incoming(v), base(v))


@query("match_sub_brand")
def _sub_brand(v: Views) -> DataFrame:
    return match.sub_brand_match(incoming(v), base(v), "apex", ["hospital", "clinic", "institute"])


@query("match_fuzzy_registry")
def _fuzzy(v: Views) -> DataFrame:
    return match.fuzzy_registry_match(v.orgs, incoming(v)).select(
        "seq", "match_seq", num("similarity").alias("similarity"), "confidence"
    )


@query("match_cascade")
def _cascade(v: Views) -> DataFrame:
    registry = incoming(v).select(
        "seq", F.concat_ws(" ", "name", "city").alias("name"), F.concat_ws(" ", "country", "name").alias("organization_name")
    )
    return match.match_cascade(v.orgs, registry)


@query("lookup_names")
def _lookup(v: Views) -> DataFrame:
    orgs = v.orgs.withColumn("original_name", F.concat_ws(" ", "country", "name"))
    return match.lookup_names(orgs, v.asked).select("query_no", "method", "match_seq", num("score").alias("score"))


@query("ranked_search")
def _ranked_search(v: Views) -> DataFrame:
    orgs = v.orgs.withColumn("original_name", F.concat_ws(" ", "country", "name"))
    return match.ranked_search(orgs, v.asked).select("query_no", "seq", num("score").alias("score"))


@query("scored_lookup")
def _scored_lookup(v: Views) -> DataFrame:
    scored = base(v).select("seq", "name", F.col("prior_score_src").alias("total_score"))
    return match.scored_lookup(incoming(v), scored)


@query("match_loose_registry")
def _loose(v: Views) -> DataFrame:
    return match.loose_registry_match(v.orgs, v.registry)


@query("country_regions")
def _regions(v: Views) -> DataFrame:
    named = F.element_at(
        F.array(*[F.lit(c) for c in ("India", "Usa", "germany", "UAE", "Peru")]), (F.col("seq") % 5 + 1).cast("int")
    )
    country = F.when(F.col("seq") % 2 == 0, F.col("country")).otherwise(named)
    return v.orgs.select(
        "seq", score.broad_region(country).alias("broad_region"), score.region_type(country).alias("region_type")
    )


@query("region_peers")
def _region_peers(v: Views) -> DataFrame:
    subjects = v.orgs.select("seq", "name", F.lower("country").alias("region_key"))
    scored = v.orgs.select("seq", F.col("prior_score_src").alias("total_score"))
    out = match.peers_by_score(match.region_peers(v.orgs, subjects), scored)
    return out.select("subject", "peer", F.col("place").cast("long").alias("place"))


@query("branch_groups")
def _branch_groups(v: Views) -> DataFrame:
    brand = F.element_at(
        F.array(*[F.lit(b) for b in ("Narayana", "Max Super", "Noida Plain", "Quiet")]), (F.col("seq") % 4 + 1).cast("int")
    )
    found = match.branch_group(F.concat_ws(" ", brand, F.split("name", " ")[0]))
    return v.orgs.select(
        "seq", found["group"].alias("group_name"), found["branches"].cast("long").alias("branches"), found["search_type"].alias("search_type")
    )


