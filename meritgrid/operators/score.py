"""Scoring of organisations from certifications, initiatives and penalties.

Inputs are long tables: ``certs(seq, pos, name, status, score_impact)`` and
``initiatives(seq, pos, category, impact_score, status)``. Everything an organisation needs from
its certifications is folded in one aggregation by ``seq``, so a hot organisation is reduced on
the map side before the shuffle and no certification list is ever gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.exprs import any_of, band, col, computed_once, first_rule, has, hits, lookup
from meritgrid.rules import certification as rules
from meritgrid.rules import places


def clean_status(status: Column | str) -> Column:
    """Status synonyms become Active or In Progress; other words stay as they are."""
    word = F.upper(F.trim(col(status)))
    return (
        F.when(word.isin(rules.ACTIVE_WORDS), F.lit("Active"))
        .when(word.isin(rules.PROGRESS_WORDS), F.lit("In Progress"))
        .otherwise(col(status))
    )


def cert_type(name: Column | str) -> Column:
    return first_rule(F.upper(col(name)), rules.TYPE_RULES, "LOCAL")


def tier_and_type(name: Column | str) -> Column:
    """struct(tier, type) by the ordered international tier rules."""
    upper = F.upper(col(name))
    us_body = has(upper, "JOINT COMMISSION") & ~has(upper, "INTERNATIONAL")
    early = first_rule(upper, rules.TIER_RULES, None)
    late = first_rule(upper, rules.TIER_RULES_AFTER_US_COMMISSION, "SPECIALTY|LOCAL")
    joined = F.coalesce(early, F.when(us_body, F.lit("REGIONAL_EXCELLENCE|JOINT_COMMISSION")), late)
    parts = F.split(joined, r"\|")
    return F.struct(parts[0].alias("tier"), parts[1].alias("type"))


def intl_cert_type(text: Column | str) -> Column:
    """International certification type of name, type and standard text; null when unknown."""
    return _intl_type(F.upper(col(text)))


def _intl_type(upper: Column) -> Column:
    world = has(upper, "WHO") & has(upper, "CERTIFICATION", "STANDARD")
    lab = has(upper, "EA") & has(upper, "LABORATORY")
    return F.coalesce(
        F.when(has(upper, "JCI", "JOINT COMMISSION INTERNATIONAL"), F.lit("JCI")),
        F.when(world, F.lit("WHO_CERTIFICATION")),
        first_rule(upper, rules.INTL_TYPE_RULES, None),
        F.when(lab, F.lit("EA_LABORATORY")),
    )


def is_international(name: Column | str) -> Column:
    return has(F.upper(col(name)), "JCI", "ISO", "JOINT COMMISSION", "MAGNET")


def is_recognised(name: Column | str) -> Column:
    return has(F.upper(col(name)), "NABH", "JCI", "CAP", "ISO", "NABL")


def standard_key(name: Column | str) -> dict[str, Column]:
    """Which mandatory standard a certification name speaks for, one flag per standard."""
    upper = F.upper(col(name))
    iso = first_rule(
        upper, [([f"ISO {n}", f"ISO{n}"], f"ISO {n}") for n in rules.ISO_TEST_ORDER], None
    )
    flags = {key: F.coalesce(iso == key, F.lit(False)) for key in rules.STANDARDS if key[:3] == "ISO"}
    flags["CAP"] = has(upper, "CAP", "COLLEGE OF AMERICAN PATHOLOGISTS")
    flags["JCI"] = has(upper, "JCI", "JOINT COMMISSION INTERNATIONAL") | us_commission(name)
    return flags


def us_commission(name: Column | str) -> Column:
    upper = F.upper(col(name))
    return has(upper, "JOINT COMMISSION") & ~has(upper, "INTERNATIONAL")


def _slug(standard: str) -> str:
    return standard.lower().replace(" ", "")


def count_when(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def weighted_points(name: Column, status: Column, impact: Column) -> Column:
    """Impact times weight times status factor; null unless active or in progress."""
    kind = cert_type(name)
    weight = lookup(kind, {k: w for k, (w, _) in rules.TYPE_WEIGHTS.items()})
    base = lookup(kind, {k: b for k, (_, b) in rules.TYPE_WEIGHTS.items()})
    factor = F.when(status == "Active", 1.0).when(status == "In Progress", 0.5)
    return F.coalesce(impact.cast("double"), base) * weight * factor


def fold_certs(certs: DataFrame) -> DataFrame:
    """One row of certification facts per organisation; one aggregation by ``seq``."""
    status = F.trim(F.coalesce(clean_status("status"), F.lit("")))
    name = F.coalesce(F.col("name"), F.lit(""))
    upper = F.upper(name)
    flags = standard_key(name)
    # position and compliance packed in one long: the last matching certification decides
    packed = F.col("pos") * 2 + F.when(F.col("_st").isin(rules.CURRENT_STATUSES), 1).otherwise(0)
    facts = certs.select(
        "seq",
        "pos",
        status.alias("_st"),
        weighted_points(name, status, F.col("score_impact")).alias("_pts"),
        is_international(name).alias("_intl"),
        is_recognised(name).alias("_rec"),
        upper.contains("NABL").alias("_nabl"),
        has(upper, "ISO 15189", "ISO15189").alias("_lab"),
        us_commission(name).alias("_usjc"),
        *[flag.alias(f"_is_{_slug(key)}") for key, flag in flags.items()],
    )
    last = [
        F.max(F.when(F.col(f"_is_{_slug(k)}"), packed)).alias(f"last_{_slug(k)}") for k in flags
    ]
    return facts.groupBy("seq").agg(
        F.count("*").alias("cert_rows"),
        F.count("_pts").alias("scored_certs"),
        F.coalesce(F.sum("_pts"), F.lit(0.0)).alias("points"),
        count_when(F.col("_intl") & (F.col("_st") == "Active")).alias("intl_active"),
        count_when(F.col("_rec")).alias("recognised"),
        count_when(F.col("_st") == "Active").alias("active_certs"),
        count_when(F.col("_nabl") & (F.col("_st") == "Active")).alias("nabl_active"),
        count_when(F.col("_lab")).alias("lab_certs"),
        count_when(F.col("_usjc")).alias("us_commission"),
        count_when(F.col("_is_cap")).alias("cap_certs"),
        *last,
    )


def with_implied_lab(folded: DataFrame) -> DataFrame:
    """Active NABL without ISO 15189 earns an implied, active ISO 15189 certification."""
    implied = F.when((F.col("nabl_active") > 0) & (F.col("lab_certs") == 0), 1).otherwise(0)
    gain = rules.IMPLIED_LAB_IMPACT * rules.TYPE_WEIGHTS["ISO_15189"][0]
    return (
        folded.withColumn("implied_lab", implied)
        .withColumn("points", F.col("points") + F.col("implied_lab") * F.lit(gain))
        .withColumn("scored_certs", F.col("scored_certs") + F.col("implied_lab"))
        .withColumn("intl_active", F.col("intl_active") + F.col("implied_lab"))
        .withColumn("recognised", F.col("recognised") + F.col("implied_lab"))
    )


def cert_score(folded: DataFrame) -> DataFrame:
    """Weighted certification score with diversity and international bonus, capped at 75."""
    n, k = F.col("scored_certs"), F.col("intl_active")
    diversity = F.when(n > 1, F.least(n * 2, F.lit(10))).otherwise(0)
    international = F.least(k * 3, F.lit(12))
    raw = F.col("points") + diversity + international
    return (
        folded.withColumn("diversity_bonus", diversity.cast("double"))
        .withColumn("international_bonus", international.cast("double"))
        .withColumn("certification_score", F.greatest(F.lit(0.0), F.least(raw, F.lit(75.0))))
    )


def standard_penalty(standard: str) -> Column:
    """Penalty of one missing standard, softened where a US body is present."""
    full = rules.STANDARDS[standard][0]
    us, cap = F.col("us_commission") > 0, F.col("cap_certs") > 0
    half = max(1, full // 2)
    if standard == "ISO 15189":
        return F.when(cap, 0).when(us, half).otherwise(full)
    if standard in rules.HALVED_WITH_US_BODIES:
        return F.when(us | cap, half).otherwise(full)
    return F.lit(full)


def compliant(standard: str) -> Column:
    return F.coalesce(F.col(f"last_{_slug(standard)}") % 2 == 1, F.lit(False))


def compliance(folded: DataFrame) -> DataFrame:
    """Compliant count, percentage and total penalty over the nine standards."""
    ok = sum((F.when(compliant(s), 1).otherwise(0) for s in rules.STANDARDS), F.lit(0))
    penalty = sum(
        (F.when(compliant(s), 0).otherwise(standard_penalty(s)) for s in rules.STANDARDS), F.lit(0)
    )
    return (
        folded.withColumn("compliant_count", ok)
        .withColumn("compliance_pct", ok * 100.0 / len(rules.STANDARDS))
        .withColumn("total_penalty", penalty)
    )


def missing_standards(folded: DataFrame) -> DataFrame:
    """One row per organisation and mandatory standard that is missing or not current."""
    entries = [
        F.when(
            ~compliant(s) & (standard_penalty(s) > 0),
            F.struct(
                F.lit(s).alias("standard"),
                F.lit(category).alias("category"),
                standard_penalty(s).cast("long").alias("penalty"),
            ),
        )
        for s, (_, category) in rules.STANDARDS.items()
    ]
    return folded.select("seq", F.inline(F.array_compact(F.array(*entries))))


def penalty_by_category(folded: DataFrame) -> DataFrame:
    return missing_standards(folded).groupBy("seq", "category").agg(F.sum("penalty").alias("penalty"))


def cert_breakdown(certs: DataFrame, folded: DataFrame) -> DataFrame:
    """Count, total points and weight per organisation and certification type."""
    status = F.trim(F.coalesce(clean_status("status"), F.lit("")))
    name = F.coalesce(F.col("name"), F.lit(""))
    own = certs.select(
        "seq",
        cert_type(name).alias("cert_type"),
        weighted_points(name, status, F.col("score_impact")).alias("points"),
    ).filter(F.col("points").isNotNull())
    weight = rules.TYPE_WEIGHTS["ISO_15189"][0]
    implied = folded.filter("implied_lab = 1").select(
        "seq", F.lit("ISO_15189").alias("cert_type"), F.lit(rules.IMPLIED_LAB_IMPACT * weight).alias("points")
    )
    weights = {k: w for k, (w, _) in rules.TYPE_WEIGHTS.items()}
    return (
        own.union(implied)
        .groupBy("seq", "cert_type")
        .agg(F.count("*").alias("n"), F.sum("points").alias("total_points"))
        .withColumn("weight", lookup("cert_type", weights))
    )


def initiative_score(initiatives: DataFrame) -> DataFrame:
    """Weighted initiative score with a diversity bonus, capped at 35."""
    weight = lookup(F.coalesce("category", F.lit("Other")), rules.INITIATIVE_WEIGHTS, 0.5)
    state = F.coalesce("status", F.lit("Active"))
    factor = F.when(state == "Active", 1.0).when(state == "In Progress", 0.8).otherwise(0.5)
    points = F.coalesce(F.col("impact_score").cast("double"), F.lit(6.0)) * weight * factor
    n = F.col("initiative_count")
    bonus = F.when(n > 1, F.least(n * 0.8, F.lit(8.0))).otherwise(0.0)
    return (
        initiatives.select("seq", points.alias("_pts"))
        .groupBy("seq")
        .agg(F.count("*").alias("initiative_count"), F.sum("_pts").alias("_sum"))
        .select("seq", "initiative_count", F.least(F.col("_sum") + bonus, F.lit(35.0)).alias("initiative_score"))
    )


def intl_initiative_score(initiatives: DataFrame) -> DataFrame:
    """International variant: base 3 per initiative, reach factor, bonus above three, cap 25."""
    weight = lookup(F.coalesce("category", F.lit("Quality Improvement")), rules.INTL_INITIATIVE_WEIGHTS, 0.5)
    reach = lookup(F.coalesce("impact", F.lit("National")), rules.REACH_FACTORS, 1.0)
    factor = F.when(F.coalesce("status", F.lit("Active")) == "Active", 1.0).otherwise(0.7)
    n = F.col("n")
    bonus = F.when(n > 3, F.least((n - 3) * 1.5, F.lit(8.0))).otherwise(0.0)
    return (
        initiatives.select("seq", (F.lit(3.0) * weight * reach * factor).alias("_pts"))
        .groupBy("seq")
        .agg(F.count("*").alias("n"), F.sum("_pts").alias("_sum"))
        .select("seq", F.least(F.col("_sum") + bonus, F.lit(25.0)).alias("initiative_score"))
    )


def facts_of(orgs: DataFrame, certs: DataFrame) -> DataFrame:
    """Certification facts for every organisation, zeros where it has none."""
    folded = with_implied_lab(fold_certs(certs))
    packed = {c for c in folded.columns if c.startswith("last_")}
    counts = [c for c in folded.columns if c != "seq" and c not in packed]
    return orgs.join(folded, "seq", "left").fillna(0, subset=counts)


def total_score(
    orgs: DataFrame, certs: DataFrame, initiatives: DataFrame, prior: DataFrame | None = None
) -> DataFrame:
    """Certification plus initiative score minus penalties, with the baseline floor.

    ``prior(seq, prior_score)`` softens the penalty of organisations that scored 70 or more.
    """
    scored = compliance(cert_score(facts_of(orgs, certs)))
    scored = scored.join(initiative_score(initiatives), "seq", "left").fillna(
        0, subset=["initiative_count", "initiative_score"]
    )
    if prior is not None:
        strong = F.coalesce(F.col("prior_score"), F.lit(0.0)) >= 70
        scored = scored.join(prior.select("seq", "prior_score"), "seq", "left")
        applied = F.when(strong, F.floor(F.col("total_penalty") * 0.4)).otherwise(F.col("total_penalty"))
    else:
        applied = F.col("total_penalty")
    raw = F.greatest(
        F.lit(0.0), F.col("certification_score") + F.col("initiative_score") - F.col("applied_penalty")
    )
    floor = 12.0
    lifted = (F.col("recognised") > 0) & (F.col("_raw") < floor)
    return (
        scored.withColumn("applied_penalty", applied.cast("double"))
        .withColumn("_raw", raw)
        .withColumn("baseline_adjustment", F.when(lifted, floor - F.col("_raw")).otherwise(0.0))
        .withColumn("total_score", F.when(lifted, floor).otherwise(F.col("_raw")))
        .drop("_raw")
    )


def older_penalty_score(orgs: DataFrame, certs: DataFrame) -> DataFrame:
    """Earlier rule: the share of missing standards costs points before and after a cap of 70."""
    scored = compliance(cert_score(facts_of(orgs, certs)))
    gap = (len(rules.STANDARDS) - F.col("compliant_count")) / len(rules.STANDARDS)
    raw = F.col("points") + F.col("diversity_bonus") + F.col("international_bonus")
    before = F.greatest(F.lit(0.0), raw - gap * 30)
    ceiling = 70.0 - F.col("noncompliance_penalty") * 0.5
    return scored.withColumn("noncompliance_penalty", gap * 30).withColumn(
        "older_score", F.greatest(F.lit(0.0), F.least(before, ceiling))
    )


# --- international score -------------------------------------------------------------------


def intl_cert_score(orgs: DataFrame, certs: DataFrame) -> DataFrame:
    """Weighted current certifications, tier bonuses and mandatory-group penalties, cap 60."""
    texts = [F.coalesce(F.col(c), F.lit("")) if c in certs.columns else F.lit("") for c in ("name", "type", "standard")]
    current = F.col("status").isin(rules.CURRENT_STATUSES)
    pick = lambda i: {k: float(v[i]) for k, v in rules.INTL_WEIGHTS.items()}
    read = computed_once(certs, _text=F.when(current, F.upper(F.concat_ws(" ", *texts))))
    tagged = computed_once(read.select("seq", "score_impact", "_text"), _kind=F.when(F.col("_text").isNotNull(), _intl_type(F.col("_text"))))
    points = F.coalesce(F.col("score_impact").cast("double"), lookup("_kind", pick(1))) * lookup("_kind", pick(0))
    tier = lookup("_kind", pick(2))
    meets = {g: F.coalesce(F.col("_kind").isin(kinds), F.lit(False)) for g, (_, kinds) in rules.INTL_MANDATORY.items()}
    folded = tagged.groupBy("seq").agg(
        F.count("*").alias("cert_rows"),
        F.count("_kind").alias("counted"),
        F.coalesce(F.sum(points), F.lit(0.0)).alias("points"),
        count_when(tier == 1).alias("global_standards"),
        count_when(tier.isin(2.0, 3.0)).alias("regional_excellence"),
        count_when(tier.isin(4.0, 5.0)).alias("specialty_certs"),
        count_when(F.col("_kind") == "JOINT_COMMISSION_US").alias("us_commission"),
        *[count_when(test).alias(f"meets_{g}") for g, test in meets.items()],
    )
    counts = [c for c in folded.columns if c not in ("seq", "points")]
    joined = orgs.join(folded, "seq", "left").fillna(0, subset=counts).fillna(0.0, subset=["points"])
    costs = []
    for group, (cost, _) in rules.INTL_MANDATORY.items():
        due = F.lit(cost)
        if group == "quality":
            due = F.when(F.col("us_commission") > 0, cost * 0.5).otherwise(cost)
        costs.append(F.when(F.col(f"meets_{group}") > 0, 0.0).otherwise(due))
    n, g = F.col("counted"), F.col("global_standards")
    final = (
        F.col("points")
        + F.when(n > 1, F.least(n * 2, F.lit(15))).otherwise(0)
        + F.least(g * 5, F.lit(20))
        - F.col("intl_penalty")
    )
    capped = F.when(F.col("cert_rows") == 0, 0.0).otherwise(F.least(final, F.lit(60.0)))
    return joined.withColumn("intl_penalty", sum(costs, F.lit(0.0))).withColumn("intl_cert_score", capped)


def quality_metric_score(metrics: DataFrame) -> DataFrame:
    """Weighted sum of dimension scores (each at most 100, defaults without data), cap 40."""
    parts = {
        dim: F.least(F.coalesce(F.col(dim).cast("double"), F.lit(default)), F.lit(100.0)) * weight
        for dim, (weight, default) in rules.METRIC_DIMENSIONS.items()
    }
    return metrics.withColumn("innovation_part", parts["innovation_technology"]).withColumn(
        "metric_score", F.least(sum(parts.values(), F.lit(0.0)), F.lit(40.0))
    )


def region_type(country: Column | str) -> Column:
    filled = F.upper(F.trim(col(country)))
    known = F.coalesce(filled, F.lit("")) == ""
    return F.when(known | filled.isin(places.DEVELOPED_COUNTRIES), "developed").otherwise("developing")


def broad_region(country: Column | str) -> Column:
    return lookup(F.coalesce(F.upper(F.trim(col(country))), F.lit("")), places.COUNTRY_REGIONS, "Global")


def intl_total(scored: DataFrame) -> DataFrame:
    """0.6 certification + 0.4 metrics, plus the regional-context bonus."""
    base = F.col("intl_cert_score") * 0.6 + F.coalesce("metric_score", F.lit(0.0)) * 0.4
    innovation = F.coalesce("innovation_part", F.lit(0.0)) * 0.2
    bonus = F.when(F.col("region_type") == "developed", innovation).when(
        F.col("region_type") == "developing", 2.0
    )
    return scored.withColumn("intl_total", base).withColumn(
        "adjusted_total", base + F.coalesce(bonus, F.lit(0.0))
    )


def intl_score_of_orgs(orgs: DataFrame, certs: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """International score with the region context taken from the organisation row."""
    scored = intl_cert_score(orgs, certs.withColumn("status", clean_status("status")))
    scored = scored.withColumn("region_type", region_type("country")).withColumn(
        "broad_region", broad_region("country")
    )
    if metrics is None:
        scored = scored.withColumn("metric_score", F.lit(0.0)).withColumn("innovation_part", F.lit(0.0))
    else:
        measured = quality_metric_score(metrics).select("seq", "metric_score", "innovation_part")
        scored = scored.join(measured, "seq", "left")
    return intl_total(scored)


# --- adjustments ---------------------------------------------------------------------------


def location_adjustment(orgs: DataFrame) -> DataFrame:
    """City, branch, specialty and served-region points, at most 8, 0 without branches.

    Expects ``has_branches, search_type, locations array<struct<name,type,specialties>>,
    regions_served array<string>``; the first location sharing a word with the name counts.
    """
    name = F.lower(F.trim("name"))
    city = first_rule(name, [([c], p) for c, p in places.CITY_POINTS.items()], 0)
    words = lambda loc: F.filter(F.split(F.lower(loc["name"]), r"\s+"), lambda w: w != "")
    sharing = F.filter("locations", lambda loc: F.exists(words(loc), lambda w: F.contains(name, w)))
    hit = F.try_element_at(sharing, F.lit(1))
    skills = F.coalesce(F.col("_hit.specialties"), F.array().cast("array<string>"))
    branch = (
        lookup(F.coalesce("_hit.type", F.lit("")), places.BRANCH_TYPE_POINTS, 0)
        + F.when(F.array_contains(skills, "Transplant"), 2).otherwise(0)
        + F.when(F.array_contains(skills, "Cardiac") & F.array_contains(skills, "Oncology"), 1).otherwise(0)
    )
    branch = F.when(F.col("search_type") == "multi_location", branch).when(
        F.col("search_type") == "specific_location", 1
    )
    served = F.coalesce("regions_served", F.array().cast("array<string>"))
    regional = (
        F.when(F.array_contains(served, "South India") & has(name, *places.SOUTH_CITIES), 1)
        .when(F.array_contains(served, "North India") & has(name, *places.NORTH_CITIES), 1)
        .when(any_of(F.array_contains(served, r) for r in places.US_EXCELLENCE_REGIONS), 2)
        .otherwise(0)
    )
    points = city + F.coalesce(branch, F.lit(0)) + regional
    return (
        orgs.withColumn("_hit", hit)
        .withColumn("location_adjustment", F.when(F.col("has_branches"), F.least(points, F.lit(8))).otherwise(0))
        .drop("_hit")
    )


def reputation(orgs: DataFrame) -> DataFrame:
    """Reputation bonus (at most 5) and multiplier of the first phrase found in the name."""
    bonus, multiplier = {}, {}
    for phrase, (national, world, teaching, research, leader) in places.REPUTATION.items():
        points = 0.0
        if national:
            points += 3 if national <= 5 else 2 if national <= 10 else 1 if national <= 20 else 0
        if world:
            points += 2 if world <= 10 else 1 if world <= 25 else 0
        points += teaching + research + (0.5 if leader and not national else 0)
        bonus[phrase] = float(min(points, 5))
        if national and national <= 20:
            multiplier[phrase] = 1.10 if national <= 5 else 1.08 if national <= 10 else 1.05
        elif world and world <= 25:
            multiplier[phrase] = 1.08
        else:
            multiplier[phrase] = 1.03 if teaching else 1.0
    name = F.lower(F.trim("name"))
    return orgs.withColumn(
        "reputation_bonus", first_rule(name, [([p], v) for p, v in bonus.items()], 0.0)
    ).withColumn("reputation_multiplier", first_rule(name, [([p], v) for p, v in multiplier.items()], 1.0))


def missing_cert_penalty(orgs: DataFrame, certs: DataFrame) -> DataFrame:
    """3/2/1 points for no active NABH/JCI/NABL (exact names) and 2 for fewer than three active."""
    active = certs.filter(F.col("status") == "Active")
    folded = active.groupBy("seq").agg(
        F.count("*").alias("_n"),
        *[count_when(F.col("name") == body).alias(f"_{body}") for body in ("NABH", "JCI", "NABL")],
    )
    joined = orgs.join(folded, "seq", "left").fillna(0, subset=["_n", "_NABH", "_JCI", "_NABL"])
    cost = sum(
        (F.when(F.col(f"_{body}") == 0, points).otherwise(0) for body, points in (("NABH", 3), ("JCI", 2), ("NABL", 1))),
        F.lit(0),
    )
    cost = cost + F.when(F.col("_n") < 3, 2).otherwise(0)
    return joined.withColumn("missing_cert_penalty", cost).drop("_n", "_NABH", "_JCI", "_NABL")


def regional_adaptation(orgs: DataFrame, certs: DataFrame) -> DataFrame:
    """Underserved-care bonus (at most 5) and world-reach score (at most 10) from names."""
    regional = certs.groupBy("seq").agg(
        count_when(has(F.lower("name"), *places.REGIONAL_CERT_WORDS)).alias("_regional")
    )
    name = F.lower(F.col("name"))
    joined = orgs.join(regional, "seq", "left").fillna(0, subset=["_regional"])
    bonus = hits(name, places.UNDERSERVED_WORDS) + F.least(F.col("_regional"), F.lit(3))
    return (
        joined.withColumn("adaptation_bonus", F.least(bonus, F.lit(5)))
        .withColumn("world_score", F.least(hits(name, places.WORLD_PHRASES) * 2, F.lit(10)))
        .drop("_regional")
    )


def grade(score: Column | str) -> Column:
    return band(F.coalesce(col(score), F.lit(0.0)), rules.GRADE_BANDS, "C")


def quality_level(score: Column | str) -> Column:
    return band(F.coalesce(col(score), F.lit(0.0)), rules.LEVEL_BANDS, rules.LEVEL_DEFAULT)
