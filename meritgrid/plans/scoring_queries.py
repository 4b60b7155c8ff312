"""Queries over the scoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.exprs import num
from meritgrid.operators import rank, reviews, score
from meritgrid.plans.registry import Views, query


def latest_history_score(v: Views) -> DataFrame:
    """Previous total score per organisation: its latest history entry."""
    return v.history.groupBy("seq").agg(
        F.max_by(F.col("total_score"), F.struct("ts", "entry_id")).alias("prior_score")
    )


def scored_orgs(v: Views) -> DataFrame:
    orgs = v.orgs.select("seq", "name", "country", "region", "hospital_type")
    return score.total_score(orgs, v.certs, v.initiatives, latest_history_score(v))


def org_keys(v: Views) -> DataFrame:
    return v.orgs.select("seq")


@query("status_words")
def _status_words(v: Views) -> DataFrame:
    return v.certs.select("seq", "pos", score.clean_status("status").alias("clean_status"))


@query("cert_type")
def _cert_type(v: Views) -> DataFrame:
    return (
        v.certs.groupBy("name", score.cert_type("name").alias("cert_type")).agg(F.count("*").alias("n"))
    )


@query("cert_tier_type")
def _cert_tier_type(v: Views) -> DataFrame:
    both = score.tier_and_type("name")
    return v.certs.groupBy("name", both["tier"].alias("tier"), both["type"].alias("cert_type")).agg(
        F.count("*").alias("n")
    )


@query("cert_intl_type")
def _cert_intl_type(v: Views) -> DataFrame:
    return v.certs.groupBy("name", score.intl_cert_type("name").alias("cert_type")).agg(
        F.count("*").alias("n")
    )


@query("implied_lab_cert")
def _implied_lab(v: Views) -> DataFrame:
    facts = score.with_implied_lab(score.fold_certs(v.certs))
    return facts.select("seq", "implied_lab", F.col("scored_certs").alias("certs_with_implied"))


@query("cert_score")
def _cert_score(v: Views) -> DataFrame:
    out = score.cert_score(score.facts_of(org_keys(v), v.certs))
    return out.select(
        "seq",
        F.col("scored_certs").cast("long"),
        num("diversity_bonus").alias("diversity_bonus"),
        num("international_bonus").alias("international_bonus"),
        num("certification_score").alias("certification_score"),
    )


@query("cert_breakdown")
def _cert_breakdown(v: Views) -> DataFrame:
    facts = score.with_implied_lab(score.fold_certs(v.certs))
    return score.cert_breakdown(v.certs, facts).select(
        "seq", "cert_type", "n", num("total_points").alias("total_points"), num("weight").alias("weight")
    )


@query("compliance")
def _compliance(v: Views) -> DataFrame:
    out = score.compliance(score.facts_of(org_keys(v), v.certs))
    return out.select(
        "seq",
        F.col("compliant_count").cast("long"),
        num("compliance_pct").alias("compliance_pct"),
        F.col("total_penalty").cast("long"),
        score.compliant("CAP").cast("int").alias("cap_compliant"),
    )


@query("penalty_by_category")
def _penalty_by_category(v: Views) -> DataFrame:
    return score.penalty_by_category(score.facts_of(org_keys(v), v.certs))


@query("missing_standards")
def _missing_standards(v: Views) -> DataFrame:
    rows = score.missing_standards(score.facts_of(org_keys(v), v.certs))
    return rows.groupBy("standard").agg(
        F.count("*").alias("n_orgs"), F.sum("penalty").alias("penalty_points")
    )


@query("older_penalty_score")
def _older(v: Views) -> DataFrame:
    return score.older_penalty_score(org_keys(v), v.certs).select(
        "seq", num("noncompliance_penalty").alias("noncompliance_penalty"), num("older_score").alias("older_score")
    )


@query("initiative_score")
def _initiative_score(v: Views) -> DataFrame:
    return score.initiative_score(v.initiatives).select(
        "seq", "initiative_count", num("initiative_score").alias("initiative_score")
    )


@query("initiative_score_intl")
def _initiative_score_intl(v: Views) -> DataFrame:
    reach = F.element_at(
        F.array(*[F.lit(x) for x in ("International", "National", "Regional", "Local")]),
        (F.col("pos") % 4 + 1).cast("int"),
    )
    return score.intl_initiative_score(v.initiatives.withColumn("impact", reach)).select(
        "seq", num("initiative_score").alias("initiative_score")
    )


@query("total_score")
def _total_score(v: Views) -> DataFrame:
    return scored_orgs(v).select(
        "seq",
        num("certification_score").alias("certification_score"),
        num("initiative_score").alias("initiative_score"),
        num("applied_penalty").alias("applied_penalty"),
        num("baseline_adjustment").alias("baseline_adjustment"),
        num("total_score").alias("total_score"),
    )


@query("score_top_ten")
def _score_top_ten(v: Views) -> DataFrame:
    ranked = rank.unique_rank(scored_orgs(v))
    return ranked.filter("overall_rank <= 10").select(
        "overall_rank", "name", "country", num("total_score").alias("total_score"),
        num("percentile").alias("percentile"),
    )


@query("intl_cert_score")
def _intl_cert_score(v: Views) -> DataFrame:
    cleaned = v.certs.withColumn("status", score.clean_status("status"))
    return score.intl_cert_score(org_keys(v), cleaned).select(
        "seq",
        F.col("counted").cast("long"),
        F.col("global_standards").cast("long"),
        F.col("regional_excellence").cast("long"),
        F.col("specialty_certs").cast("long"),
        num("intl_penalty").alias("intl_penalty"),
        num("intl_cert_score").alias("intl_cert_score"),
    )


def metrics_table(v: Views) -> DataFrame:
    """Quality dimensions per organisation out of its score history; some stay unknown."""
    s = F.col("total_score")
    return v.history.groupBy("seq").agg(
        F.max(s).alias("clinical_outcomes"),
        F.min(s).alias("patient_experience"),
        F.when(F.count("*") % 2 == 0, F.max(s) - F.min(s)).alias("operational_excellence"),
        F.when(F.count("*") % 3 == 0, F.sum(s)).alias("innovation_technology"),
        F.lit(None).cast("double").alias("sustainability_social"),
    )


@query("metric_score")
def _metric_score(v: Views) -> DataFrame:
    return score.quality_metric_score(metrics_table(v)).select(
        "seq", num("innovation_part").alias("innovation_part"), num("metric_score").alias("metric_score")
    )


@query("intl_total_score")
def _intl_total(v: Views) -> DataFrame:
    out = score.intl_score_of_orgs(v.orgs.select("seq", "country"), v.certs, metrics_table(v))
    return out.select(
        "seq", "region_type", num("intl_total").alias("intl_total"), num("adjusted_total").alias("adjusted_total")
    )


@query("intl_org_context")
def _intl_context(v: Views) -> DataFrame:
    out = score.intl_score_of_orgs(v.orgs.select("seq", "country"), v.certs)
    return out.groupBy("region_type", "broad_region").agg(
        F.count("*").alias("n"), num(F.avg("adjusted_total")).alias("mean_total")
    )


def branch_orgs(v: Views) -> DataFrame:
    """Organisations with branch details taken from their own columns."""
    place = F.struct(
        F.coalesce("city", F.lit("")).alias("name"),
        F.when(F.col("seq") % 3 == 0, "Flagship").when(F.col("seq") % 3 == 1, "Specialty Branch").otherwise("Clinic").alias("type"),
        F.when(F.col("seq") % 2 == 0, F.array(F.lit("Transplant"))).otherwise(
            F.array(F.lit("Cardiac"), F.lit("Oncology"))
        ).alias("specialties"),
    )
    cities = F.element_at(F.array(*[F.lit(c) for c in ("Chennai", "Delhi", "Rochester", "Nowhere")]), (F.col("seq") % 4 + 1).cast("int"))
    named = F.concat(F.col("name"), F.lit(" "), cities, F.lit(" "), F.coalesce("city", F.lit("")))
    return v.orgs.select(
        "seq",
        named.alias("name"),
        (F.col("seq") % 7 != 0).alias("has_branches"),
        F.when(F.col("seq") % 5 == 0, "specific_location").otherwise("multi_location").alias("search_type"),
        F.array(place).alias("locations"),
        F.array(F.when(F.col("seq") % 3 == 0, "South India").when(F.col("seq") % 3 == 1, "North India").otherwise("Midwest USA")).alias("regions_served"),
    )


@query("location_adjustment")
def _location_adjustment(v: Views) -> DataFrame:
    return score.location_adjustment(branch_orgs(v)).select("seq", F.col("location_adjustment").cast("long"))


@query("reputation_bonus")
def _reputation(v: Views) -> DataFrame:
    brands = ("Mayo Clinic", "Cedars-Sinai", "Singapore General Hospital", "Apollo Hospitals", "AIIMS Delhi", "Plain")
    brand = F.element_at(F.array(*[F.lit(b) for b in brands]), (F.col("seq") % 6 + 1).cast("int"))
    named = v.orgs.select("seq", F.concat_ws(" ", brand, "name").alias("name"))
    return score.reputation(named).select(
        "seq", num("reputation_bonus").alias("reputation_bonus"), num("reputation_multiplier").alias("reputation_multiplier")
    )


@query("missing_cert_penalty")
def _missing_cert_penalty(v: Views) -> DataFrame:
    short = F.split(F.col("name"), " ")[0]
    certs = v.certs.select("seq", short.alias("name"), score.clean_status("status").alias("status"))
    return score.missing_cert_penalty(org_keys(v), certs).select("seq", F.col("missing_cert_penalty").cast("long"))


@query("regional_adaptation")
def _regional_adaptation(v: Views) -> DataFrame:
    return score.regional_adaptation(v.orgs.select("seq", "name"), v.certs).select(
        "seq", F.col("adaptation_bonus").cast("long"), F.col("world_score").cast("long")
    )


@query("grade_bands")
def _grades(v: Views) -> DataFrame:
    s = F.col("prior_score_src") / 100.0
    return v.orgs.groupBy(score.grade(s).alias("grade"), score.quality_level(s).alias("level")).agg(
        F.count("*").alias("n")
    )


@query("review_trend")
def _review_trend(v: Views) -> DataFrame:
    return reviews.half_split_trend(v.reviews).select(
        "seq",
        "n_reviews",
        num("recent_sentiment").alias("recent_sentiment"),
        num("older_sentiment").alias("older_sentiment"),
        "trend",
    )


REVIEW_AS_OF = "2024-03-31 00:00:00"


@query("review_summary")
def _review_summary(v: Views) -> DataFrame:
    return reviews.review_summary(org_keys(v), v.reviews, REVIEW_AS_OF).select(
        "seq",
        F.col("n_reviews").cast("long"),
        num("avg_rating").alias("avg_rating"),
        num("sentiment").alias("sentiment"),
        "platforms",
        "trend",
        num("trend_shift").alias("trend_shift"),
    )


@query("review_confidence")
def _review_confidence(v: Views) -> DataFrame:
    return reviews.review_summary(org_keys(v), v.reviews, REVIEW_AS_OF).select(
        "seq", F.col("n_recent").cast("long"), num("confidence").alias("confidence")
    )


@query("review_score")
def _review_score(v: Views) -> DataFrame:
    summary = reviews.review_summary(org_keys(v), v.reviews, REVIEW_AS_OF)
    return reviews.review_score(summary).select("seq", num("review_score").alias("review_score"))
