"""Scores of single feeds, public text and ISO certificates, and rule-driven advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.exprs import col, first_rule, has, lookup
from meritgrid.functions.text import filled
from meritgrid.operators import merge, score
from meritgrid.rules import scoring as rules
from meritgrid.session import cut_lineage

# --- public text ---------------------------------------------------------------------------


def public_text_score(orgs: DataFrame, accreditations: DataFrame, public: DataFrame) -> DataFrame:
    """Weighted public accreditations, awards, specialties and website, times confidence, minus penalties.

    ``accreditations(seq, body, standard[, name])`` is long; ``public(seq, confidence, has_awards,
    has_specialties, has_website)`` has a row per organisation found in public text. Others are
    scored from the default row: nothing found, confidence 0.2.
    """
    body, standard = F.upper(filled("body")), F.lower(filled("standard"))
    name = F.lower(filled("name")) if "name" in accreditations.columns else F.lit("")
    iso_met = (body == "ISO") & (standard.contains("iso 9001") | standard.contains("iso 15189"))
    met = {
        "CAP": body == "CAP",
        "JCI": body == "JCI",
        "ISO 9001": (body == "ISO") & standard.contains("iso 9001"),
        "ISO 15189": (body == "ISO") & ~standard.contains("iso 9001") & standard.contains("iso 15189"),
        "MAGNET": (body == "MAGNET") | (name.contains("magnet") & ~body.isin("CAP", "JCI") & ~iso_met),
    }
    slug = lambda k: k.lower().replace(" ", "")
    folded = accreditations.groupBy("seq").agg(
        F.sum(lookup(body, rules.PUBLIC_WEIGHTS, 0.0)).alias("_acc"),
        *[F.max(test.cast("int")).alias(f"_{slug(k)}") for k, test in met.items()],
    )
    joined = orgs.join(public, "seq", "left").join(folded, "seq", "left")
    found = F.col("confidence").isNotNull()
    accreditation = F.when(found, F.coalesce("_acc", F.lit(0.0))).otherwise(0.0)
    quality = F.when(F.col("has_awards"), rules.PUBLIC_AWARDS).otherwise(0.0) + F.when(
        F.col("has_specialties"), rules.PUBLIC_SPECIALTIES
    ).otherwise(0.0)
    web = F.when(F.col("has_website"), rules.PUBLIC_WEBSITE).otherwise(0.0)
    confidence = F.coalesce("confidence", F.lit(rules.PUBLIC_DEFAULT_CONFIDENCE))
    penalty = sum(
        (
            F.when(found & (F.coalesce(f"_{slug(k)}", F.lit(0)) == 1), 0.0).otherwise(cost)
            for k, cost in rules.PUBLIC_PENALTIES.items()
        ),
        F.lit(0.0),
    )
    total = F.greatest(F.lit(0.0), (accreditation + quality + web) * confidence - penalty)
    level = F.when(confidence > 0.7, "High").when(confidence > 0.4, "Medium").otherwise("Low")
    return joined.select(
        *orgs.columns,
        (accreditation * confidence).alias("certification_score"),
        (quality * confidence).alias("quality_score"),
        penalty.alias("mandatory_penalty"),
        total.alias("total_score"),
        level.alias("confidence_level"),
    )


def lab_points(accredited: Column, confidence: Column, iso_standard: Column) -> Column:
    """15 points for an accredited laboratory, confidence and ISO 15189 bonus, at most 25."""
    bonus = lookup(confidence, rules.LAB_CONFIDENCE_POINTS, 0)
    total = F.least(F.lit(15) + bonus + F.when(iso_standard == "ISO 15189", 5).otherwise(0), F.lit(25))
    return F.when(accredited, total).otherwise(0)


# --- ISO certificates ----------------------------------------------------------------------


def base_standard(standard: Column | str) -> Column:
    return F.split(filled(standard), ":")[0]


def iso_impact(standard: Column | str) -> Column:
    exact = lookup(filled(standard), rules.ISO_IMPACTS)
    return F.coalesce(exact, lookup(base_standard(standard), rules.ISO_IMPACTS), F.lit(rules.ISO_DEFAULT_IMPACT))


def iso_text(standard: Column | str, kind: str) -> Column:
    """Description or relevance text of a standard."""
    table, default = {
        "description": (rules.ISO_DESCRIPTIONS, rules.ISO_DEFAULT_DESCRIPTION),
        "relevance": (rules.ISO_RELEVANCE, rules.ISO_DEFAULT_RELEVANCE),
    }[kind]
    return lookup(base_standard(standard), table, default)


def iso_summary(orgs: DataFrame, certificates: DataFrame) -> DataFrame:
    """Totals, active count, distinct standards and bodies, dates and capped score impact.

    ``certificates(seq, standard, body, status, issue_date, expiry_date, confidence)``. Distinct
    lists come from distinct (organisation, value) pairs. Organisations without any get zeros.
    """
    valid = F.col("status") == "Valid"
    weight = lookup(base_standard("standard"), rules.ISO_WEIGHTS, rules.ISO_DEFAULT_WEIGHT)
    totals = certificates.groupBy("seq").agg(
        F.count("*").alias("total_certs"),
        F.sum(F.when(valid, 1).otherwise(0)).alias("active_certs"),
        F.min("issue_date").alias("earliest_issue"),
        F.max(F.when(valid, F.col("expiry_date"))).alias("latest_expiry"),
        F.least(F.sum(F.when(valid, weight * F.col("confidence")).otherwise(0.0)), F.lit(25.0)).alias("score_impact"),
    )

    def listed(column: str, name: str) -> DataFrame:
        pairs = certificates.groupBy("seq", column).agg(F.lit(1)).select("seq", column)
        return pairs.groupBy("seq").agg(F.array_join(F.array_sort(F.collect_list(column)), "|").alias(name))

    joined = orgs.select("seq").join(totals, "seq", "left")
    joined = joined.join(listed("standard", "standards"), "seq", "left").join(listed("body", "bodies"), "seq", "left")
    return joined.fillna(0, subset=["total_certs", "active_certs"]).fillna(0.0, subset=["score_impact"]).fillna(
        "", subset=["standards", "bodies"]
    )


# --- simple additive scores ----------------------------------------------------------------


def directory_score(bodies: DataFrame) -> DataFrame:
    """0-10: base 1, NABH 2 (+0.5 full), JCI 3, NABL 1, 0.5 per ISO and 0.3 per empanelment.

    ``bodies(seq, has_nabh, nabh_full, has_jci, has_nabl, n_iso, n_empanelments)``.
    """
    points = (
        F.lit(1.0)
        + F.when(F.col("has_nabh"), F.when(F.col("nabh_full"), 2.5).otherwise(2.0)).otherwise(0.0)
        + F.when(F.col("has_jci"), 3.0).otherwise(0.0)
        + F.when(F.col("has_nabl"), 1.0).otherwise(0.0)
        + F.col("n_iso") * 0.5
        + F.col("n_empanelments") * 0.3
    )
    return bodies.withColumn("directory_score", F.least(points, F.lit(10.0)))


def strategy_score(flags: DataFrame) -> DataFrame:
    """0-100 from accreditation flags: NABH 30/20, JCI 25, ISO 15/10/10, empanelment 10."""
    on = lambda c, p: F.when(F.col(c), p).otherwise(0)
    nabh = F.when(F.col("nabh_full"), 30).when(F.col("nabh_entry"), 20).otherwise(0)
    points = nabh + on("jci", 25) + on("iso_9001", 15) + on("iso_14001", 10) + on("iso_45001", 10) + on("empanelled", 10)
    return flags.withColumn("strategy_score", F.least(points, F.lit(100)))


def lab_directory_scores(labs: DataFrame) -> DataFrame:
    """Three completeness scores of laboratory rows (from 75, 85 and 90 upwards, capped)."""
    given = lambda c: filled(c) != ""
    plus = lambda test, p: F.when(F.coalesce(test, F.lit(False)), p).otherwise(0.0)
    long_address = F.length(filled("address")) > 20
    first = 75.0 + plus(given("address"), 5.0) + plus(given("phone"), 3.0) + plus(given("website"), 7.0) + plus(given("country"), 5.0)
    second = 85.0 + plus(given("phone"), 5.0) + plus(long_address, 5.0) + plus(given("country"), 3.0) + plus(given("state"), 2.0)
    third = (
        90.0 + plus(given("phone"), 3.0) + plus(long_address, 2.0) + plus(given("country"), 2.0) + plus(given("state"), 1.0)
        + plus(filled("country") != "United States", 1.0)
    )
    return (
        labs.withColumn("basic_score", F.least(first, F.lit(95.0)))
        .withColumn("improved_score", F.least(second, F.lit(95.0)))
        .withColumn("final_score", F.least(third, F.lit(98.0)))
    )


def edition(remarks: Column | str) -> Column:
    return first_rule(filled(remarks), [([f"{n} Edition"], f"{n} Edition") for n in ("6th", "5th", "4th")], "Standard")


def edition_impact(status: Column | str, remarks: Column | str) -> Column:
    """Registry impact 15 with edition bonus when active, reduced when expired or unknown."""
    bonus = first_rule(filled(remarks), [(["6th Edition"], 20.0), (["5th Edition"], 18.0)], 15.0)
    return F.when(col(status) == "Active", bonus).when(col(status) == "Expired", 4.5).otherwise(7.5)


def page_confidence(name: Column, description: Column, contact: Column, address: Column, n_certs: Column, n_initiatives: Column) -> Column:
    """0-1 confidence of a page record."""
    on = lambda test, p: F.when(test, p).otherwise(0.0)
    total = (
        on(name, 0.2) + on(description, 0.1) + on(contact, 0.1) + on(address, 0.1)
        + F.least(F.lit(0.3), n_certs * 0.1) + F.least(F.lit(0.2), n_initiatives * 0.05)
    )
    return F.least(F.lit(1.0), total)


# --- advice --------------------------------------------------------------------------------


def advice(scored: DataFrame) -> DataFrame:
    """One row per organisation and advice: threshold rules on the scores, branches, big cities.

    Expects ``name, total_score, certification_score, initiative_score, active_certs`` and,
    optionally, ``has_branches``.
    """
    entry = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("advice"))
    rows = []
    for kind, text, column, op, limit in rules.ADVICE_RULES:
        test = F.col(column) < limit if op == "<" else F.col(column) >= limit
        rows.append(F.when(test, entry(kind, text)))
    if "has_branches" in scored.columns:
        rows.append(F.when(F.col("has_branches"), entry(*rules.BRANCH_ADVICE)))
    big_city = has(F.lower(filled("name")), *rules.EXPANSION_CITIES)
    rows.append(F.when(big_city, entry(*rules.EXPANSION_ADVICE)))
    return scored.select("seq", F.inline(F.array_compact(F.array(*rows))))


def certification_gaps(orgs: DataFrame, certs: DataFrame) -> DataFrame:
    """Catalogue certifications whose word occurs in no active certification of the organisation."""
    active = certs.filter(F.trim(filled("status")) == "Active")
    name = F.upper(filled("name"))
    flag = lambda key: f"_{key.lower().replace(' ', '')}"
    held = active.groupBy("seq").agg(
        *[F.max(name.contains(key).cast("int")).alias(flag(key)) for key in rules.GAP_CATALOGUE]
    )
    joined = orgs.select("seq").join(held, "seq", "left")
    gaps = [
        F.when(F.coalesce(F.col(flag(key)), F.lit(0)) == 0, F.struct(F.lit(key).alias("standard"), F.lit(text).alias("gap")))
        for key, text in rules.GAP_CATALOGUE.items()
    ]
    return joined.select("seq", F.inline(F.array_compact(F.array(*gaps))))


def score_potential(scored: DataFrame) -> DataFrame:
    """What is left to the maximum, in total and per part."""
    return scored.select(
        "seq",
        (F.lit(rules.MAX_TOTAL) - F.col("total_score")).alias("potential"),
        F.greatest(F.lit(0.0), rules.MAX_CERT - F.col("certification_score")).alias("cert_potential"),
        F.greatest(F.lit(0.0), rules.MAX_INITIATIVE - F.col("initiative_score")).alias("initiative_potential"),
    )


def international_advice(scored: DataFrame, breakdown: DataFrame) -> DataFrame:
    """Advice by total-score band and certification tiers not yet reached.

    ``breakdown(seq, tier)`` lists the certification tiers of each organisation.
    """
    texts = lambda lines: F.array(*[F.lit(x) for x in lines])
    by_band = (
        F.when(F.col("total_score") < 30, texts(rules.INTL_ADVICE_LOW))
        .when(F.col("total_score") < 60, texts(rules.INTL_ADVICE_MIDDLE))
        .otherwise(texts(rules.INTL_ADVICE_HIGH))
    )
    actions = scored.select("seq", F.lit("priority").alias("kind"), F.explode(by_band).alias("advice"))
    tiers = breakdown.groupBy("seq").agg(
        *[F.max((F.col("tier") == t).cast("int")).alias(f"_{t}") for t in rules.INTL_OPPORTUNITIES]
    )
    joined = scored.select("seq").join(tiers, "seq", "left")
    none = F.array().cast("array<string>")
    missing = F.concat(
        *[F.when(F.coalesce(F.col(f"_{t}"), F.lit(0)) == 0, texts(lines)).otherwise(none) for t, lines in rules.INTL_OPPORTUNITIES.items()]
    )
    return actions.union(joined.select("seq", F.lit("opportunity"), F.explode(missing)))


def certification_advice(scored: DataFrame, certs: DataFrame) -> DataFrame:
    """Advice from global standards, ISO count and region, for the international score.

    ``scored(seq, global_standards, broad_region)``.
    """
    upper = F.upper(filled("name"))
    counts = certs.groupBy("seq").agg(
        F.sum(upper.contains("ISO").cast("int")).alias("_iso"),
        F.max(upper.contains("JOINT_COMMISSION").cast("int")).alias("_us"),
    )
    joined = scored.join(counts, "seq", "left").fillna(0, subset=["_iso", "_us"])
    rows = [
        F.when(F.col("global_standards") == 0, F.lit(rules.CERT_ADVICE["global"])),
        F.when(F.col("_iso") < 3, F.lit(rules.CERT_ADVICE["iso"])),
        F.when((F.col("broad_region") == "North America") & (F.col("_us") == 0), F.lit(rules.CERT_ADVICE["regional"])),
    ]
    return joined.select("seq", F.explode(F.array_compact(F.array(*rows))).alias("advice"))


# --- whole-table scoring -------------------------------------------------------------------


def batch_scores(orgs: DataFrame, certs: DataFrame, prior: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """Score every organisation of a merged table: duplicates out, status cleaned, no initiatives.

    A missing impact counts as 0. The certification count is that of active certifications
    before duplicates are removed.
    """
    filled_certs = certs.withColumn("score_impact", F.coalesce(F.col("score_impact").cast("double"), F.lit(0.0)))
    active = F.when(score.clean_status("status") == "Active", 1).otherwise(0)
    named = cut_lineage(merge.certs_by_name(filled_certs, active=F.sum(active)))
    best = merge.best_of_names(named)
    deduped = merge.without_near_names(best) if fuzzy else best.drop("_q")
    nothing = filled_certs.limit(0).select("seq", "pos", F.lit("").alias("category"), F.lit(0).alias("impact_score"), "status")
    counted = named.groupBy("seq").agg(F.sum("active").alias("certification_count"))
    scored = score.total_score(orgs, deduped.select("seq", "pos", "name", "status", "score_impact"), nothing, prior)
    return scored.join(counted, "seq", "left").fillna(0, subset=["certification_count"])


