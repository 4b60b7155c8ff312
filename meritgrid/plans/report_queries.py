"""Queries over reports, trends, evidence, advice and further scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from meritgrid.functions.exprs import num
from meritgrid.operators import filters, match, report, score, score_more, validate
from meritgrid.plans.matching_queries import base, incoming
from meritgrid.plans.merging_queries import unique_certs
from meritgrid.plans.ranking_queries import ranked_table, score_table
from meritgrid.plans.registry import Views, query
from meritgrid.plans.scoring_queries import scored_orgs
from meritgrid.plans.text_queries import lab_rows, pick, registry_rows
from meritgrid.operators.ordering import first_rows
from meritgrid.session import small_table


def typed_certs(v: Views) -> DataFrame:
    """Certifications with a type text that is sometimes missing."""
    kind = F.when(F.col("pos") % 9 != 0, F.concat(score.cert_type("name"), F.lit(" Accreditation")))
    return v.certs.select(
        "seq", "pos", "name", "status", kind.alias("type"), "accreditation_date",
        F.when(F.col("pos") % 2 == 0, F.col("expiry_ts").cast("date").cast("string")).alias("expiry_date"),
    )


def org_dims(v: Views) -> DataFrame:
    return report.counts_by(v.orgs, {"state": "state", "type": "hospital_type", "source": "data_source", "country": "country"})


@query("count_by_dimension")
def _counts(v: Views) -> DataFrame:
    return org_dims(v)


@query("top_counts")
def _top_counts(v: Views) -> DataFrame:
    return report.counts_by(v.orgs, {"city": "city", "country": "country"}, 5)


@query("feed_coverage")
def _feed_coverage(v: Views) -> DataFrame:
    checks = {
        "with_city": F.col("city") != "",
        "with_state": F.col("state") != "Unknown",
        "with_phone": F.col("phone") != "",
        "with_website": F.col("website").isNotNull(),
    }
    return report.coverage(v.orgs, checks)


@query("country_summary")
def _country_summary(v: Views) -> DataFrame:
    out = report.place_summary(ranked_table(v), "country")
    return out.select("country", "n_orgs", "best_rank", *[num(c).alias(c) for c in out.columns if c[:4] in ("avg_", "max_", "min_")])


@query("region_summary")
def _region_summary(v: Views) -> DataFrame:
    out = report.place_summary(ranked_table(v), "region")
    return out.select("region", "n_orgs", "best_rank", num("avg_rank").alias("avg_rank"), num("avg_total_score").alias("avg_total_score"))


@query("country_top")
def _country_top(v: Views) -> DataFrame:
    return report.country_top(score_table(v)).select("country", "n_orgs", num("avg_score").alias("avg_score"), "top_organization")


@query("score_bands")
def _score_bands(v: Views) -> DataFrame:
    return report.score_bands(score_table(v))


@query("gapped_bands")
def _gapped(v: Views) -> DataFrame:
    return report.gapped_bands(score_table(v)).select("band", "n", num("share").alias("share"))


@query("cert_quality")
def _cert_quality(v: Views) -> DataFrame:
    return report.cert_quality(typed_certs(v))


@query("cert_issues")
def _cert_issues(v: Views) -> DataFrame:
    return report.cert_issues(typed_certs(v)).groupBy("issue").agg(F.count("*").alias("n"))


@query("country_types")
def _country_types(v: Views) -> DataFrame:
    return report.country_types(v.orgs, typed_certs(v))


@query("body_coverage")
def _body_coverage(v: Views) -> DataFrame:
    return report.body_coverage(v.orgs, typed_certs(v))


@query("iso_standards")
def _iso_standards(v: Views) -> DataFrame:
    return report.iso_standards(v.certs)


@query("coverage_kpis")
def _kpis(v: Views) -> DataFrame:
    out = report.coverage_kpis(v.orgs, typed_certs(v))
    return out.select("n_orgs", "n_certified", "n_certs", "n_complete", *[num(c).alias(c) for c in ("coverage_pct", "certs_per_org", "complete_pct")])


@query("family_counts")
def _families(v: Views) -> DataFrame:
    return report.family_counts(typed_certs(v))


@query("portal_body_counts")
def _portal_bodies(v: Views) -> DataFrame:
    orgs = v.orgs.select("seq", F.when(F.col("seq") % 3 == 0, "Updated_NABH_Portal").otherwise(F.col("data_source")).alias("data_source"))
    return report.portal_body_counts(orgs, typed_certs(v))


@query("table_integrity")
def _integrity(v: Views) -> DataFrame:
    raw = F.when(F.col("seq") % 50 == 0, F.lit('"text"')).otherwise(F.concat(F.lit('{"seq":'), F.col("seq").cast("string"), F.lit("}")))
    rows = v.orgs.select(filters.structure_of(raw).alias("kind"))
    return report.integrity(rows).select("n_rows", "n_valid", num("integrity_pct").alias("integrity_pct"), "label")


@query("field_completeness")
def _completeness(v: Views) -> DataFrame:
    return report.completeness(v.orgs, ["name", "city", "state", "phone", "website"]).select("field", num("pct").alias("pct"))


@query("portal_years")
def _portal_years(v: Views) -> DataFrame:
    rows = registry_rows(v)
    return report.counts_by(rows, {"year": F.left("valid_from", F.lit(4)), "status": "status"})


@query("column_profile")
def _column_profile(v: Views) -> DataFrame:
    return report.column_profile(v.orgs, ["city", "website", "hospital_type"], 3)


@query("duplicate_names")
def _duplicates(v: Views) -> DataFrame:
    return report.duplicate_names(v.orgs)


@query("upload_profile")
def _upload_profile(v: Views) -> DataFrame:
    rows = v.orgs.select(F.when(F.col("seq") % 20 != 0, F.col("name")).alias("name"), "country")
    out = report.upload_profile(rows, "name", "country", F.col("name").isNotNull())
    return out.select("n_rows", "n_empty_names", "n_duplicate_names", "n_accepted", num("success_pct").alias("success_pct"), "n_countries")


@query("portal_quality_bands")
def _portal_bands(v: Views) -> DataFrame:
    scored = v.history.select((F.col("total_score")).alias("data_quality_score"))
    return report.quality_bands(scored).select("band", "n", num("avg_score").alias("avg_score"))


@query("lab_cleaning_report")
def _lab_report(v: Views) -> DataFrame:
    return report.lab_cleaning_report(validate.enriched_labs(lab_rows(v)))


@query("match_report")
def _match_report(v: Views) -> DataFrame:
    registry = incoming(v).select("seq", "name", F.concat_ws(" ", "country", "name").alias("organization_name"))
    out = report.match_report(match.match_cascade(v.orgs, registry))
    return out.select("n_orgs", "n_matched", num("match_pct").alias("match_pct"), "n_high", "n_medium", "n_low")


@query("source_audit")
def _source_audit(v: Views) -> DataFrame:
    sources = v.orgs.select("seq", F.explode(F.array("data_source", "region")).alias("source"))
    return report.source_audit(sources, validate.registry_flag(unique_certs(v)))


@query("dual_accreditation")
def _dual(v: Views) -> DataFrame:
    flags = v.orgs.select((F.col("seq") % 3 == 0).alias("jci_accredited"), F.when(F.col("seq") % 5 != 0, F.col("seq") % 4 == 0).alias("nabh_accredited"))
    return report.dual_accreditation(flags)


@query("specialty_counts")
def _specialties(v: Views) -> DataFrame:
    from meritgrid.functions.cleaning import specialties

    return report.specialty_counts(v.orgs.select(specialties("name").alias("specialties")))


@query("lab_summary")
def _lab_summary(v: Views) -> DataFrame:
    labs = v.orgs.select("phone", "website", F.concat_ws(", ", "city", "state", "country").alias("address"), (F.col("prior_score_src") / 100).alias("quality_score"))
    out = report.lab_summary(labs)
    return out.select("n_labs", num("avg_score").alias("avg_score"), "with_phone", "with_website", "with_address")


@query("top_hundred")
def _top_hundred(v: Views) -> DataFrame:
    return report.top_ranked(ranked_table(v), 100).select("overall_rank", "seq", num("total_score").alias("total_score"))


def country_table(v: Views) -> DataFrame:
    """Country indicators out of the organisation rows."""
    rows = v.orgs.groupBy("country", "region").agg(
        F.round(F.avg("prior_score_src") / 60, 6).alias("score"), F.count("*").alias("hospitals"), F.round(F.sum("prior_score_src"), 6).alias("gdp")
    )
    return rows.withColumn("code", F.right("country", F.lit(2))).withColumn("tie", F.col("country"))


@query("country_filter")
def _country_filter(v: Views) -> DataFrame:
    rows = filters.country_filter(country_table(v), 60, 90, 50, ["_1", "10", "12", "_5", "_7", "20"])
    return rows.select("country", num("score").alias("score"), "hospitals")


@query("country_statistics")
def _country_statistics(v: Views) -> DataFrame:
    out = report.country_statistics(country_table(v))
    return out.select(num("avg_score").alias("avg_score"), "top_country", "n_high", num("high_pct").alias("high_pct"), "hospitals")


@query("region_statistics")
def _region_statistics(v: Views) -> DataFrame:
    table = country_table(v)
    out = report.region_statistics(table.drop("region"), table.select("country", "region"))
    return out.select("region", "n_countries", num("avg_score").alias("avg_score"), "hospitals", num("avg_gdp", 4).alias("avg_gdp"))


@query("largest_countries")
def _largest(v: Views) -> DataFrame:
    return report.largest(country_table(v), "score", 5, "country").select("country", num("score").alias("score"))


def monthly(v: Views) -> DataFrame:
    """Monthly counts with wide year and month numbers."""
    return v.monthly.withColumns({"y": F.col("y").cast("long"), "m": F.col("m").cast("long")})


@query("running_by_type")
def _running(v: Views) -> DataFrame:
    return report.running_by_type(monthly(v)).select("y", "m", "cert_type", "running")


@query("monthly_growth")
def _monthly_growth(v: Views) -> DataFrame:
    return report.growth_by_month(monthly(v)).select("y", "m", "running", num("growth").alias("growth"))


@query("type_totals")
def _type_totals(v: Views) -> DataFrame:
    return report.type_totals(v.monthly).select("cert_type", "total", num("share").alias("share"), num("monthly_avg").alias("monthly_avg"))


@query("year_totals")
def _year_totals(v: Views) -> DataFrame:
    return report.year_totals(monthly(v)).select("y", "total", num("monthly_avg").alias("monthly_avg"), num("growth").alias("growth"))


@query("growth_metrics")
def _growth_metrics(v: Views) -> DataFrame:
    out = report.growth_metrics(v.monthly, 1996, 2000)
    return out.select(num("growth_pct").alias("growth_pct"), num("cagr_pct").alias("cagr_pct"), "total", "peak_month", "lowest_month")


@query("year_month_matrix")
def _matrix(v: Views) -> DataFrame:
    return report.year_month_matrix(monthly(v))


@query("source_reconciliation")
def _reconcile(v: Views) -> DataFrame:
    loaded = v.orgs.filter("city <> ''")
    return report.reconcile(v.orgs, loaded, ["state", "city"]).select("what", "n_source", "n_loaded", num("share").alias("share"))


@query("missing_states")
def _missing(v: Views) -> DataFrame:
    return report.missing_values(v.orgs, v.orgs.filter("city not like 'City 3%'"), "city")


def registry_hits(v: Views) -> DataFrame:
    """Registry lookups united: verified names, laboratory names and ISO certificates."""
    verified = match.same_name(v.orgs, v.registry.filter("not verification_required")).select(
        "seq", F.lit("JCI Database").alias("source"), F.lit(2).alias("priority"), F.lit("JCI").alias("cert_name")
    )
    labs = match.same_name(v.orgs, incoming(v)).select("seq", F.lit("NABL Database"), F.lit(1), F.lit("NABL"))
    iso = v.certs.filter(F.col("name").startswith("ISO")).select("seq", F.lit("ISO Database"), F.lit(3), "name")
    return verified.union(labs).union(iso)


@query("evidence")
def _evidence(v: Views) -> DataFrame:
    return report.evidence(v.orgs, registry_hits(v)).select("seq", F.col("n_certs").cast("long").alias("n_certs"), "sources", "status")


@query("validated_reviews")
def _validated_reviews(v: Views) -> DataFrame:
    kept = report.reviews_of_validated(v.reviews, report.evidence(v.orgs, registry_hits(v)), completed=False)
    return kept.groupBy("seq").agg(F.count("*").alias("n_reviews"))


@query("org_initiatives")
def _org_initiatives(v: Views) -> DataFrame:
    found = v.initiatives.select("seq", "pos", F.col("category").alias("initiative"))
    rows = [(1, "apex hospital", 1, "Hand Hygiene"), (1, "apex hospital", 2, "Research"), (2, "royal", 1, "Green Campus"), (3, "no such", 1, "Nothing")]
    known = small_table(v.spark, rows, known_no="int", key="string", pos="bigint", initiative="string")
    return report.initiatives_of(v.orgs, found, known).select("seq", "initiative", "prio")


@query("suggestions")
def _suggestions(v: Views) -> DataFrame:
    orgs = v.orgs.select("seq", "name", F.concat_ws(" ", "name", "region").alias("original_name"), F.concat_ws(", ", "city", "state").alias("location"))
    return report.suggestions(orgs, v.typed, 10).select("query_no", F.col("place").cast("long").alias("place"), "seq", "match_type")


@query("merged_suggestions")
def _merged_suggestions(v: Views) -> DataFrame:
    def provider(rows: DataFrame, key: str) -> DataFrame:
        from pyspark.sql.window import Window

        few = first_rows(rows.select(F.col(key).alias("query_no"), "seq", "name"), ["query_no"], ["seq"], 8)
        return few.withColumn("place", F.row_number().over(Window.partitionBy("query_no").orderBy("seq")))

    first, second = provider(incoming(v), "country"), provider(base(v), "country")
    return report.merged_suggestions(first, second).select("query_no", F.col("place").cast("long").alias("place"), "name")


# --- further scores ------------------------------------------------------------------------


@query("public_text_score")
def _public(v: Views) -> DataFrame:
    body = pick(["JCI", "CAP", "NABH", "ISO", "MAGNET", "X"], F.col("pos"))
    found = v.certs.select("seq", body.alias("body"), F.col("name").alias("standard"), "name")
    public = v.orgs.filter("seq % 4 <> 0").select(
        "seq", ((F.col("seq") % 10) / 10).alias("confidence"), (F.col("seq") % 2 == 0).alias("has_awards"),
        (F.col("seq") % 3 == 0).alias("has_specialties"), F.lit(True).alias("has_website"),
    )
    out = score_more.public_text_score(v.orgs.select("seq"), found, public)
    return out.select("seq", *[num(c).alias(c) for c in ("certification_score", "quality_score", "mandatory_penalty", "total_score")], "confidence_level")


@query("lab_points")
def _lab_points(v: Views) -> DataFrame:
    points = score_more.lab_points(F.col("seq") % 5 != 0, pick(["high", "medium", "low", "none"], F.col("seq")), pick(["ISO 15189", "ISO 17025"], F.col("seq")))
    return v.orgs.select("seq", points.cast("long").alias("lab_points"))


@query("iso_summary")
def _iso_summary(v: Views) -> DataFrame:
    rows = v.certs.filter(F.col("name").startswith("ISO")).select(
        "seq", F.col("name").alias("standard"), pick(["TUV", "BSI", "SGS"], F.col("pos")).alias("body"),
        F.when(F.col("pos") % 4 == 0, "Expired").otherwise("Valid").alias("status"),
        F.date_sub(F.col("expiry_ts").cast("date"), 1095).alias("issue_date"), F.col("expiry_ts").cast("date").alias("expiry_date"),
        ((F.col("pos") % 5 + 5) / 10).alias("confidence"),
    )
    out = score_more.iso_summary(v.orgs, rows)
    return out.select(
        "seq", "total_certs", "active_certs", "standards", "bodies", F.col("earliest_issue").cast("string").alias("earliest_issue"),
        F.col("latest_expiry").cast("string").alias("latest_expiry"), num("score_impact").alias("score_impact"),
    )


@query("iso_lookup")
def _iso_lookup(v: Views) -> DataFrame:
    rows = v.certs.filter(F.col("name").startswith("ISO")).groupBy("name").agg(F.count("*").alias("n"))
    return rows.select(
        "name", "n", score_more.iso_impact("name").cast("long").alias("impact"),
        F.split(score_more.iso_text("name", "relevance"), " - ")[0].alias("relevance"),
        F.split(score_more.iso_text("name", "description"), " - ")[0].alias("description"),
    )


@query("directory_scores")
def _directory_scores(v: Views) -> DataFrame:
    rows = v.orgs.select(
        "seq", (F.col("seq") % 2 == 0).alias("has_nabh"), (F.col("seq") % 4 == 0).alias("nabh_full"), (F.col("seq") % 3 == 0).alias("has_jci"),
        (F.col("seq") % 5 == 0).alias("has_nabl"), (F.col("seq") % 6).alias("n_iso"), (F.col("seq") % 7).alias("n_empanelments"),
        (F.col("seq") % 8 == 2).alias("nabh_entry"), (F.col("seq") % 3 == 1).alias("jci"), (F.col("seq") % 2 == 1).alias("iso_9001"),
        (F.col("seq") % 5 == 1).alias("iso_14001"), (F.col("seq") % 5 == 2).alias("iso_45001"), (F.col("seq") % 9 == 0).alias("empanelled"),
        "phone", "website", F.concat_ws(", ", "city", "state", "country").alias("address"), F.when(F.col("seq") % 6 == 0, "United States").otherwise(F.col("country")).alias("country"), "state",
    )
    out = score_more.lab_directory_scores(score_more.strategy_score(score_more.directory_score(rows)))
    return out.select("seq", *[num(c).alias(c) for c in ("directory_score", "strategy_score", "basic_score", "improved_score", "final_score")])


@query("edition_impact")
def _edition(v: Views) -> DataFrame:
    remarks = pick(["6th Edition", "5th Edition ok", "4th Edition", ""], F.col("pos"))
    return v.certs.groupBy("status", remarks.alias("remarks")).agg(F.count("*").alias("n")).select(
        "status", "remarks", "n", score_more.edition("remarks").alias("edition"), num(score_more.edition_impact("status", "remarks")).alias("impact")
    )


@query("improvement_advice")
def _advice(v: Views) -> DataFrame:
    scored = scored_orgs(v).withColumn("has_branches", F.col("seq") % 5 == 0)
    return score_more.advice(scored).groupBy("kind", "advice").agg(F.count("*").alias("n_orgs"))


@query("certification_gaps")
def _gaps(v: Views) -> DataFrame:
    return score_more.certification_gaps(v.orgs, v.certs.withColumn("status", score.clean_status("status"))).select("seq", "standard")


@query("score_potential")
def _potential(v: Views) -> DataFrame:
    return score_more.score_potential(scored_orgs(v)).select("seq", *[num(c).alias(c) for c in ("potential", "cert_potential", "initiative_potential")])


@query("international_advice")
def _intl_advice(v: Views) -> DataFrame:
    tiers = v.certs.select("seq", score.tier_and_type("name")["tier"].alias("tier"))
    return score_more.international_advice(scored_orgs(v), tiers).groupBy("kind", "advice").agg(F.count("*").alias("n_orgs"))


@query("certification_advice")
def _cert_advice(v: Views) -> DataFrame:
    scored = score.intl_score_of_orgs(v.orgs.select("seq", "country"), v.certs)
    out = score_more.certification_advice(scored.select("seq", "global_standards", "broad_region"), v.certs)
    return out.groupBy("advice").agg(F.count("*").alias("n_orgs"))


@query("batch_scores")
def _batch(v: Views) -> DataFrame:
    """Whole-table scoring on merged duplicates, duplicates removed by normalised name."""
    orgs = v.orgs.select("seq", "name", "country", "region", "hospital_type")
    out = score_more.batch_scores(orgs, unique_certs(v), fuzzy=False)
    return out.select("seq", F.col("certification_count").cast("long").alias("certification_count"), num("certification_score").alias("certification_score"), num("total_score").alias("total_score"))


@query("batch_scores_fuzzy")
def _batch_fuzzy(v: Views) -> DataFrame:
    """As ``batch_scores`` with near-equal certification names removed as well."""
    orgs = v.orgs.select("seq", "name", "country", "region", "hospital_type")
    out = score_more.batch_scores(orgs, unique_certs(v))
    return out.select("seq", num("certification_score").alias("certification_score"), num("total_score").alias("total_score"))
