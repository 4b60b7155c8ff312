"""Queries over duplicate removal, merges, upserts, nested values and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions import nested, text
from meritgrid.functions.exprs import num
from meritgrid.operators import batches, filters, match, merge, near_names
from meritgrid.plans.matching_queries import base, incoming
from meritgrid.plans.registry import Views, query
from meritgrid.session import cut_lineage, small_table, spread

FIELDS = ["name", "city", "state", "country", "hospital_type", "website", "phone"]


def canonical() -> Column:
    return text.canonical_name("name", "city", "state", "country")


def jci_flags(v: Views) -> DataFrame:
    """Two indicator flags per organisation."""
    flags = F.array(
        F.struct(F.lit("jci_accredited").alias("flag"), (F.col("seq") % 3 == 0).alias("value")),
        F.struct(F.lit("verified").alias("flag"), F.when(F.col("seq") % 4 != 0, F.col("seq") % 4 == 1).alias("value")),
    )
    return v.orgs.select("seq", F.inline(flags))


def of_base(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The rows whose organisation is held, dealt by organisation: certifications are many."""
    return spread(rows, "seq").join(held.select("seq"), "seq")


@query("cert_items_cleaned")
def _cert_items(v: Views) -> DataFrame:
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    as_object = F.concat(F.lit('{"name":'), quoted(F.col("name")), F.lit(',"status":'), quoted(F.col("status")), F.lit("}"))
    item = (
        F.when(F.col("pos") % 4 == 0, quoted(F.concat(F.lit(" "), F.col("name"))))
        .when(F.col("pos") % 4 == 1, as_object)
        .when(F.col("pos") % 4 == 2, F.lit('"  "'))
        .otherwise(F.lit("42"))
    )
    cleaned = v.certs.select("seq", "pos", nested.clean_cert_items(F.array(item)).alias("items"))
    return cleaned.select("seq", "pos", F.inline("items")).select("seq", "pos", "name", "status")


@query("accredited_bodies")
def _accredited(v: Views) -> DataFrame:
    status = F.when(F.col("seq") % 2 == 0, "Accredited").otherwise("Applied")
    other = F.when(F.col("seq") % 3 == 0, "Accredited").otherwise("Unknown")
    by_body = F.create_map(F.lit("nabh"), F.struct(status.alias("status")), F.lit("jci"), F.struct(other.alias("status")))
    return v.orgs.select("seq", F.inline(nested.accredited_bodies(by_body)))


@query("row_richness")
def _richness(v: Views) -> DataFrame:
    orgs = v.orgs
    return orgs.select("seq", nested.richness(orgs, FIELDS).cast("long").alias("richness"))


@query("collected_sources")
def _sources(v: Views) -> DataFrame:
    found = nested.collect_sources(
        nested.as_list("data_source"),
        F.array(F.concat(F.lit(" "), F.col("region")), F.lit("")),
        nested.as_list("website"),
        nested.as_list(F.upper("data_source")),
        nested.as_list("data_source"),
    )
    return v.orgs.select("seq", F.array_join(found, "|").alias("sources"))


@query("group_level_filter")
def _group_level(v: Views) -> DataFrame:
    return filters.group_level_names(v.orgs).select("seq", "is_group")


@query("row_filters")
def _row_filters(v: Views) -> DataFrame:
    word = F.element_at(
        F.array(*[F.lit(w) for w in ("Home", "Search NABH", "Government", "12345", "Pune Labs", "Pune")]), (F.col("seq") % 6 + 1).cast("int")
    )
    name = F.when(F.col("seq") % 2 == 0, F.col("name")).otherwise(F.concat_ws(" ", word, F.when(F.col("seq") % 5 == 0, F.col("city"))))
    checks = {
        "not_junk": filters.not_junk(name),
        "hospital_block": filters.hospital_block(F.concat_ws(", ", name, F.col("phone"))),
        "real_facility": filters.real_facility(
            F.concat(F.when(F.col("seq") % 3 == 0, "fallback_").otherwise("place-id-"), F.col("seq").cast("string")),
            F.when(F.col("city") == "", "Unknown location").otherwise(F.col("city")),
            F.array(F.lower("hospital_type")),
            name,
        ),
        "is_private": filters.is_private(name),
        "valid_name": filters.valid_name(name),
    }
    return v.orgs.select("seq", *[c.cast("int").alias(n) for n, c in checks.items()])


@query("structure_split")
def _structure(v: Views) -> DataFrame:
    raw = (
        F.when(F.col("seq") % 50 == 0, F.concat(F.lit('"'), F.col("name"), F.lit('"')))
        .when(F.col("seq") % 50 == 1, F.lit("[1]"))
        .when(F.col("seq") % 50 == 2, F.lit('{"name": '))
        .otherwise(F.concat(F.lit('{"name":"'), F.col("name"), F.lit('"}')))
    )
    return filters.structure_split(v.orgs.select("seq", raw.alias("raw")), "raw")


@query("keep_richest")
def _keep_richest(v: Views) -> DataFrame:
    return merge.keep_richest(v.orgs, canonical(), FIELDS).select("seq", "name")


@query("group_members")
def _group_members(v: Views) -> DataFrame:
    return merge.group_targets(v.orgs, canonical(), FIELDS)


@query("merged_certs")
def _merged_certs(v: Views) -> DataFrame:
    """Certifications of the merged groups; pos ties of one organisation are settled by name."""
    targets = merge.group_targets(v.orgs, canonical(), FIELDS)
    rows = merge.merged_certs(targets, v.certs.select("seq", "pos", "name"))
    return rows.select("group_seq", "seq", "pos", "name")


@query("first_filled_fields")
def _first_filled(v: Views) -> DataFrame:
    rows = merge.first_filled_by_group(v.orgs, text.alnum_key("name"), ["city", "state", "phone", "website"])
    return rows.drop("group_key")


@query("valid_certs")
def _valid_certs(v: Views) -> DataFrame:
    validity = match.registry_valid(v.orgs, v.registry)
    return merge.valid_certs(v.certs.select("seq", "pos", "name"), validity).select("seq", "pos", "name")


@query("merged_flags")
def _merged_flags(v: Views) -> DataFrame:
    targets = merge.group_targets(v.orgs, text.alnum_key("name"), FIELDS)
    flags = merge.merged_flags(targets, jci_flags(v))
    checked = match.registry_valid(v.orgs, v.registry).join(targets, "seq").groupBy("group_seq").agg(
        (F.max("registry_valid") == 1).alias("value")
    )
    return merge.force_flag(flags, checked, "jci_accredited").select("group_seq", "flag", F.col("value").cast("int").alias("value"))


@query("best_certs")
def _best_certs(v: Views) -> DataFrame:
    rows = merge.best_certs(unique_certs(v))
    return rows.select("seq", "cert_key", "pos", "name", F.col("score_impact").cast("long").alias("score_impact"))


@query("distinct_certs")
def _distinct_certs(v: Views) -> DataFrame:
    return merge.distinct_certs(unique_certs(v)).select("seq", "pos", "name")


@query("distinct_certs_edit")
def _distinct_certs_edit(v: Views) -> DataFrame:
    """As ``distinct_certs``, by edit distance."""
    return merge.distinct_certs(unique_certs(v), measure="edits").select("seq", "pos", "name")


@query("near_equal_names")
def _near_equal_names(v: Views) -> DataFrame:
    """Organisations of one city whose name is near to a better rated or earlier one's."""
    items = v.orgs.select(
        F.concat_ws("|", "state", "city").alias("group"), F.col("seq").alias("pos"), F.lower("name").alias("name"), (-F.col("prior_score_src")).alias("rank")
    )
    return near_names.greedy_removed(items, measure="edits").rows.withColumnsRenamed({"group": "place", "pos": "seq"})


def unique_certs(v: Views) -> DataFrame:
    """Certifications with a position that is unique inside the organisation."""
    return v.certs.groupBy("seq", "pos").agg(
        F.min("name").alias("name"), F.min("status").alias("status"), F.max("score_impact").alias("score_impact")
    )


@query("one_jci")
def _one_jci(v: Views) -> DataFrame:
    return merge.one_jci(unique_certs(v)).groupBy("seq").agg(
        F.count("*").alias("n"), F.max("moved_last").alias("moved_last")
    )


@query("dedupe_keys")
def _dedupe_keys(v: Views) -> DataFrame:
    """Rows kept by each composite key."""
    orgs = v.orgs
    name = text.lower_name("name")
    variants = {
        "name_address": [name, text.lower_name("city")],
        "name_number": [name, F.col("seq") % 7, F.col("seq") % 5],
        "name_reference": [name, F.col("seq") % 5],
        "name": [name],
    }
    out = None
    for what, keys in variants.items():
        rows = merge.dedupe_on(orgs, keys).select(F.lit(what).alias("what"), "seq")
        out = rows if out is None else out.union(rows)
    return out


@query("dedupe_iso")
def _dedupe_iso(v: Views) -> DataFrame:
    iso = v.certs.filter(F.col("name").startswith("ISO")).select(
        "seq", "pos", "name", (F.col("pos") % 50).alias("number")
    )
    order = F.struct("seq", "pos")
    return merge.dedupe_on(iso, ["name", "number"], order).select("name", "number", "seq", "pos")


@query("upload_upsert")
def _upload(v: Views) -> DataFrame:
    b, i = base(v), incoming(v)
    targets = merge.upload_targets(b, i)
    held = v.certs.select("seq", "pos", "name")
    fresh = i.select("seq", F.inline(F.array(
        F.struct(F.lit(1).cast("long").alias("pos"), F.lit("iso 9001:2015").alias("name")),
        F.struct(F.lit(2).cast("long").alias("pos"), F.lit("Green Seal").alias("name")),
    )))
    rows = merge.upload_certs(held, fresh, targets)
    return rows.groupBy("seq", "name").agg(F.count("*").alias("n"), F.max("added").alias("added"))


def portal_rows(v: Views) -> DataFrame:
    """Incoming registry rows with certificate fields."""
    return incoming(v).withColumns(
        {
            "status": F.when(F.col("seq") % 3 == 0, "Expired").otherwise("Active"),
            "accreditation_no": F.concat(F.lit("PEH-"), (F.col("seq") % 1000).cast("string")),
            "valid_upto": F.lit("2027-01-01"),
            "address": F.concat_ws(" ", "city", "state", "country", F.when(F.col("seq") % 2 == 0, "Main Road 12")),
            "scraped_date": F.lit("2025-09-27"),
            "quality_score": F.col("prior_score_src") / 100,
        }
    )


def registry_tables(v: Views) -> dict[str, DataFrame]:
    """The whole base after the entry-level registry; every seventh certification is of its kind."""
    rows, held = portal_rows(v), base(v)
    kind = F.when(F.col("pos") % 7 == 0, merge.REGISTRY_CERT).otherwise("Other")
    certs = v.certs.select("seq", "pos", "name", kind.alias("cert_type"), "status", F.col("score_impact").cast("double").alias("score_impact"))
    flags = jci_flags(v).join(held.select("seq"), "seq")
    return merge.registry_upsert(held, rows, match.same_place_match(rows, held), of_base(certs, held), flags)


@query("registry_upsert")
def _registry_upsert(v: Views) -> DataFrame:
    out = registry_tables(v)["orgs"].filter("action <> 'kept'")
    return out.select("target_seq", "action", "n_incoming", "status", num("score_impact").alias("score_impact"), "accreditation_current")


@query("registry_upsert_table")
def _registry_table(v: Views) -> DataFrame:
    return registry_tables(v)["orgs"].drop("prior_score_src")


@query("registry_upsert_certs")
def _registry_certs(v: Views) -> DataFrame:
    return registry_tables(v)["certs"]


@query("registry_upsert_flags")
def _registry_flags(v: Views) -> DataFrame:
    return registry_tables(v)["flags"]


@query("portal_upsert")
def _portal_upsert(v: Views) -> DataFrame:
    rows = portal_rows(v)
    held = base(v).withColumns(
        {
            "address": F.concat_ws(" ", "city", "state"),
            "accreditation_no": F.lit("PEH-1"),
            "scraped_date": F.when(F.col("seq") % 2 == 0, "2025-09-27").otherwise("2025-10-01"),
            "quality_score": F.col("prior_score_src") / 100,
        }
    )
    out = merge.portal_upsert(held, rows, match.same_place_match(rows, held))
    return out.filter("n_incoming > 0").select(
        "target_seq", "address", "accreditation_no", num("quality_score").alias("quality_score"), "n_incoming"
    )


def keyworded(orgs: DataFrame) -> DataFrame:
    return orgs.withColumn("search_keywords", F.array_distinct(F.split(F.lower("name"), " ")))


def lab_tables(v: Views) -> dict[str, DataFrame]:
    """The laboratory feed and the base; their names are made and written once, as every step reads them."""
    orgs = cut_lineage(keyworded(v.orgs.select("seq", "name", "data_source")))
    labs, held = orgs.filter("data_source = 'supplier'"), orgs.filter("data_source = 'customer'")
    return merge.lab_upsert(held, labs, match.lab_name_match(labs, held))


@query("lab_upsert")
def _lab_upsert(v: Views) -> DataFrame:
    parts = lab_tables(v)
    words = parts["keywords"].groupBy("seq").agg(F.count("*").alias("n_keywords"))
    return parts["sources"].join(words, "seq").select("seq", "data_source", "action", "n_keywords")


@query("lab_upsert_stats")
def _lab_stats(v: Views) -> DataFrame:
    return lab_tables(v)["stats"]


def pathology_tables(v: Views) -> dict[str, DataFrame]:
    labs, held = incoming(v), base(v)
    certs = v.certs.select("seq", "pos", "name", "status", F.col("score_impact").cast("double").alias("score_impact"))
    flags = jci_flags(v).join(held.select("seq"), "seq")
    return merge.pathology_upsert(held, labs, match.similar_name_match(labs, held), of_base(certs, held), flags)


@query("batch_matches")
def _batch_matches(v: Views) -> DataFrame:
    """All organisations as one batch that meets an empty table."""
    return batches.in_batch(v.orgs.select("seq", "name"), "apex hospital").routes


@query("pathology_upsert")
def _pathology(v: Views) -> DataFrame:
    return pathology_tables(v)["orgs"].filter("action <> 'kept'")


@query("pathology_upsert_table")
def _pathology_table(v: Views) -> DataFrame:
    return pathology_tables(v)["orgs"]


@query("pathology_upsert_certs")
def _pathology_certs(v: Views) -> DataFrame:
    return pathology_tables(v)["certs"]


@query("pathology_upsert_flags")
def _pathology_flags(v: Views) -> DataFrame:
    return pathology_tables(v)["flags"]


def branded_tables(v: Views) -> dict[str, DataFrame]:
    """The whole base after the branded laboratories, with their certification and two initiatives."""
    labs = incoming(v).select(
        "seq", "name", F.lit(18.0).alias("impact"), F.array(F.lit("Pathology"), F.col("hospital_type")).alias("specialties"), F.lit(95.0).alias("quality_score")
    )
    held = base(v).select(
        "seq", "name", (F.col("prior_score_src") / 100).alias("quality_score"), F.array(F.lit("Clinic")).alias("specialties")
    )
    one = F.struct(F.lit(1).cast("long").alias("pos"), F.lit("CAP 15189").alias("name"))
    both = [F.struct(F.lit(i).cast("long").alias("pos"), F.lit(c).alias("category")) for i, c in enumerate(["Laboratory Quality", "Research"], 1)]
    return merge.branded_lab_upsert(
        held, labs, match.sub_brand_match(labs, held, "apex", ["hospital", "clinic", "institute"]),
        of_base(v.certs.select("seq", "pos", "name"), held), labs.select("seq", F.inline(F.array(one))),
        of_base(v.initiatives.select("seq", "pos", "category"), held), labs.select("seq", F.inline(F.array(*both))),
        jci_flags(v).join(held.select("seq"), "seq"),
    )


def branded_rows(out: DataFrame) -> DataFrame:
    return out.withColumns({"quality_score": num("quality_score"), "specialties": F.array_join("specialties", "|")})


@query("branded_lab_upsert")
def _branded(v: Views) -> DataFrame:
    return branded_rows(branded_tables(v)["orgs"].filter("action = 'updated'")).drop("action")


@query("branded_lab_upsert_table")
def _branded_table(v: Views) -> DataFrame:
    return branded_rows(branded_tables(v)["orgs"])


@query("branded_lab_upsert_certs")
def _branded_certs(v: Views) -> DataFrame:
    return branded_tables(v)["certs"]


@query("branded_lab_upsert_initiatives")
def _branded_initiatives(v: Views) -> DataFrame:
    return branded_tables(v)["initiatives"]


@query("branded_lab_upsert_flags")
def _branded_flags(v: Views) -> DataFrame:
    return branded_tables(v)["flags"]


@query("global_upsert")
def _global(v: Views) -> DataFrame:
    feed = incoming(v).withColumn("source_name", F.concat(F.lit("feed"), (F.col("seq") % 2).cast("string")))
    targets = merge.global_targets(base(v), feed)
    return merge.global_fill(base(v), feed, targets.filter("not is_new"), ["city", "state"]).select(
        "seq", "city", "state", "data_source"
    )


@query("global_certs")
def _global_certs(v: Views) -> DataFrame:
    feed = incoming(v)
    targets = merge.global_targets(base(v), feed)
    fresh = feed.select(
        "seq",
        text.company_key("name").alias("company_key"),
        F.inline(F.array(
            F.struct(F.lit(1).cast("long").alias("pos"), F.lit("JCI").alias("name"), F.lit("JCI").alias("kind")),
            F.struct(F.lit(2).cast("long").alias("pos"), F.lit("iso 15189").alias("name"), F.lit("ISO_15189").alias("kind")),
        )),
    )
    official = v.registry.filter("not verification_required").select(text.company_key("name").alias("company_key"))
    out = merge.validated_certs(v.certs.filter("seq < 1000000000").select("seq", "pos", "name"), fresh, targets, official)
    return out.groupBy("seq").agg(F.count("*").alias("n"), F.sum("validated").alias("n_validated"))


@query("two_registry_merge")
def _two_registries(v: Views) -> DataFrame:
    parts = merge.two_registry_merge(v.orgs, v.certs.select("seq", "pos", "name"))
    n = parts["certs"].groupBy("group_seq").agg(F.count("*").alias("n_certs"))
    return parts["sources"].join(n, "group_seq", "left").fillna(0, subset=["n_certs"])


@query("submission_upsert")
def _submissions(v: Views) -> DataFrame:
    located = v.orgs.withColumn("location", F.concat_ws(", ", "city", "country")).withColumn("last_updated", F.lit("2025-01-01"))
    held = located.filter("data_source = 'customer'")
    asked = located.filter("data_source = 'supplier'").withColumn("phone", F.when(F.col("phone") != "", F.col("phone")))
    return merge.submission_upsert(held, asked, ["name", "location", "phone", "hospital_type"], "2025-10-01")


@query("family_certs_dropped")
def _family_dropped(v: Views) -> DataFrame:
    out = merge.drop_certs_of(v.orgs, v.certs, ["apex", "royal"])
    return out.groupBy("seq").agg(F.count("*").alias("n_certs"))


@query("flags_unset")
def _flags_unset(v: Views) -> DataFrame:
    out = merge.unset_flags(v.orgs, jci_flags(v), ["apex"], ["jci_accredited"])
    return out.select("seq", "flag", F.col("value").cast("int").alias("value"))


@query("superseded_dropped")
def _superseded(v: Views) -> DataFrame:
    certs = v.certs.select("seq", F.concat(F.lit("MC-"), (F.col("pos") % 500).cast("string")).alias("certificate_number"))
    return merge.drop_superseded(v.orgs, certs, "apex", "MC-338").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))


@query("insert_absent")
def _insert_absent(v: Views) -> DataFrame:
    orgs = v.orgs.select("seq", "name", "country")
    curated = small_table(
        v.spark,
        [(-1, "Apex Hospital", "INDIA", "apex hospital"), (-2, "Quiet Harbour Home", "USA", "quiet harbour")],
        seq="bigint", name="string", country="string", phrase="string",
    )
    return merge.insert_absent(orgs, curated)


@query("run_statistics")
def _run_statistics(v: Views) -> DataFrame:
    b, i = base(v), incoming(v)
    matches = match.same_name(i, b)
    matched, fresh = merge.split_matched(i, matches)
    actions = matched.select(F.lit("updated").alias("action")).union(fresh.select(F.lit("added")))
    return merge.run_statistics(b, i, actions, b.select("seq").union(fresh.select("seq")))


@query("append_feed")
def _append_feed(v: Views) -> DataFrame:
    out = merge.append_feed(base(v), incoming(v), "NABH_Dental")
    return out.groupBy("data_source").agg(F.count("*").alias("n"))
