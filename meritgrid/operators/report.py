"""Grouped counts, summaries, quality reports, trends, reconciliations and suggestions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritgrid.functions import cleaning
from meritgrid.functions.exprs import band, first_rule, has
from meritgrid.functions.text import filled, lower_name
from meritgrid.operators import blocking
from meritgrid.operators.containment import contained_pairs
from meritgrid.operators.ordering import first_rows
from meritgrid.operators.search import Texts, asked_texts
from meritgrid.session import cut_lineage

# --- counts --------------------------------------------------------------------------------


def counts_by(df: DataFrame, dims: Mapping[str, Column | str], k: int | None = None) -> DataFrame:
    """Counts per value of every dimension in one pass; the k largest per dimension when asked."""
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("dimension"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("value"))
            for n, c in dims.items()
        ]
    )
    counts = (
        df.select(F.inline(entries))
        .groupBy("dimension", F.coalesce("value", F.lit("Unknown")).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return counts if k is None else first_rows(counts, ["dimension"], [F.desc("n"), "value"], k)


def coverage(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Row count and the number of rows each check holds for, as one row."""
    return df.agg(
        F.count("*").alias("n_rows"),
        *[F.sum(F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0)).alias(n) for n, test in checks.items()],
    )


def place_summary(ranked: DataFrame, dim: str) -> DataFrame:
    """Per country or region: size, ranks, scores and percentiles, to be read by best rank."""
    return ranked.groupBy(dim).agg(
        F.count("*").alias("n_orgs"),
        F.min("overall_rank").alias("best_rank"),
        F.avg("overall_rank").alias("avg_rank"),
        *[fn(c).alias(f"{p}_{c}") for c in ("total_score", "percentile") for p, fn in (("avg", F.avg), ("max", F.max), ("min", F.min))],
    )


def country_top(scored: DataFrame) -> DataFrame:
    """Per country: count, mean score and best organisation, the first one among equals."""
    best = F.max_by("name", F.struct("total_score", (-F.col("seq")).alias("s")))
    return scored.groupBy("country").agg(
        F.count("*").alias("n_orgs"), F.avg("total_score").alias("avg_score"), best.alias("top_organization")
    )


GRADES = [(75, "A+ (75-100)"), (65, "A (65-74)"), (55, "B+ (55-64)"), (45, "B (45-54)")]  # fixed values
GAPPED_BANDS = [  # fixed values: closed ranges that leave gaps between them
    (70.0, 100.0, "A+ (70-100)"),
    (60.0, 69.99, "A (60-69)"),
    (50.0, 59.99, "B+ (50-59)"),
    (40.0, 49.99, "B (40-49)"),
    (30.0, 39.99, "C+ (30-39)"),
    (0.0, 29.99, "C (0-29)"),
]


def score_bands(scored: DataFrame) -> DataFrame:
    return scored.groupBy(band(F.col("total_score"), GRADES, "C (0-44)").alias("band")).agg(F.count("*").alias("n"))


def gapped_bands(scored: DataFrame) -> DataFrame:
    """Counts and shares over closed ranges; scores between two ranges are in none."""
    s = F.col("total_score")
    totals = scored.agg(
        F.count("*").alias("_n"),
        *[F.sum(F.when(s.between(lo, hi), 1).otherwise(0)).alias(f"_{i}") for i, (lo, hi, _) in enumerate(GAPPED_BANDS)],
    )
    rows = [F.struct(F.lit(g).alias("band"), F.col(f"_{i}").alias("n")) for i, (_, _, g) in enumerate(GAPPED_BANDS)]
    return totals.select(F.inline(F.array(*rows)), "_n").withColumn("share", F.col("n") * 100.0 / F.col("_n")).drop("_n")


# --- certification quality -----------------------------------------------------------------


def cert_quality(certs: DataFrame) -> DataFrame:
    """Complete, missing and badly dated certifications, one row."""
    name, kind, status = filled("name"), filled("type"), filled("status")
    bad = lambda c: (filled(c) != "") & F.try_to_timestamp(filled(c), F.lit("yyyy-M-d")).isNull()
    add = lambda test: F.sum(F.when(test, 1).otherwise(0))
    return certs.agg(
        F.count("*").alias("n_certs"),
        add((name != "") & (kind != "") & (status != "")).alias("complete"),
        add(name == "").alias("missing_name"),
        add(status == "").alias("missing_status"),
        add(kind == "").alias("missing_type"),
        (add(bad("accreditation_date")) + add(bad("expiry_date"))).alias("invalid_dates"),
    )


def cert_issues(certs: DataFrame) -> DataFrame:
    """One row per certification and issue."""
    bad = lambda c: (filled(c) != "") & F.try_to_timestamp(filled(c), F.lit("yyyy-M-d")).isNull()
    checks = [
        (filled("name") == "", "Missing certification name"),
        (filled("status") == "", "Missing certification status"),
        (filled("type") == "", "Missing certification type"),
        (bad("accreditation_date"), "Invalid date format in accreditation_date"),
        (bad("expiry_date"), "Invalid date format in expiry_date"),
    ]
    issues = F.array_compact(F.array(*[F.when(t, F.lit(i)) for t, i in checks]))
    return certs.select("seq", "pos", F.explode(issues).alias("issue"))


def country_types(orgs: DataFrame, certs: DataFrame) -> DataFrame:
    """Certification counts per country and type."""
    joined = certs.filter(filled("type") != "").select("seq", "type").join(orgs.select("seq", "country"), "seq")
    return joined.groupBy("country", "type").agg(F.count("*").alias("n"))


def bodies_of(name: Column | str, kind: Column | str) -> Column:
    """All accreditation bodies a certification speaks for; one may count for several."""
    n, t = F.upper(filled(name)), F.upper(filled(kind))
    tests = {
        "jci": has(n, "JCI", "JOINT COMMISSION") | has(t, "JCI ACCREDITATION"),
        "nabh": has(n, "NABH", "NATIONAL ACCREDITATION BOARD"),
        "nabl": has(n, "NABL", "NATIONAL ACCREDITATION BOARD FOR TESTING AND CALIBRATION LABORATORIES"),
        "cap": has(n, "CAP", "COLLEGE OF AMERICAN PATHOLOGISTS"),
        "iso": has(n, "ISO"),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(body)) for body, test in tests.items()]))


def body_coverage(orgs: DataFrame, certs: DataFrame) -> DataFrame:
    """Per body: certifications, organisations and countries.

    Distinct counts come from (body, organisation) rows first, so a frequent body is not
    gathered in one task.
    """
    kind = F.col("type") if "type" in certs.columns else F.lit("")
    rows = certs.select("seq", F.explode(bodies_of("name", kind)).alias("body"))
    per_org = rows.groupBy("body", "seq").agg(F.count("*").alias("_n"))
    per_country = per_org.join(orgs.select("seq", "country"), "seq").groupBy("body", "country").agg(
        F.sum("_n").alias("_n"), F.count("*").alias("_o")
    )
    return per_country.groupBy("body").agg(
        F.sum("_n").alias("n_certs"), F.sum("_o").alias("n_orgs"), F.count("*").alias("n_countries")
    )


def iso_standards(certs: DataFrame) -> DataFrame:
    number = F.regexp_extract(F.upper(filled("name")), r"ISO\s*(\d+)", 1)
    return (
        certs.select(F.when(number != "", F.concat(F.lit("ISO "), number)).alias("standard"))
        .filter("standard is not null")
        .groupBy("standard")
        .agg(F.count("*").alias("n"))
    )


def coverage_kpis(orgs: DataFrame, certs: DataFrame) -> DataFrame:
    """Coverage and completeness percentages, certifications per certified organisation, texts."""
    per_org = certs.withColumn(
        "_ok", ((filled("name") != "") & (filled("type") != "") & (filled("status") != "")).cast("int")
    ).groupBy("seq").agg(F.count("*").alias("_n"), F.sum("_ok").alias("_ok"))
    joined = orgs.select("seq").join(per_org, "seq", "left")
    totals = joined.agg(
        F.count("*").alias("n_orgs"),
        F.count("_n").alias("n_certified"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_certs"),
        F.coalesce(F.sum("_ok"), F.lit(0)).alias("n_complete"),
    )
    share = F.col("n_certified") / F.nullif(F.col("n_orgs"), F.lit(0)) * 100
    complete = F.col("n_complete") / F.nullif(F.col("n_certs"), F.lit(0)) * 100
    return totals.select(
        "*",
        share.alias("coverage_pct"),
        (F.col("n_certs") / F.nullif(F.col("n_certified"), F.lit(0))).alias("certs_per_org"),
        complete.alias("complete_pct"),
        F.format_string("Certification Coverage: %.1f%% of organizations have accreditation data", share).alias("finding"),
    )


FAMILIES = [(["nabh"], "nabh"), (["jci"], "jci"), (["nabl"], "nabl"), (["cap"], "cap")]  # fixed values


def family_counts(certs: DataFrame) -> DataFrame:
    """Certifications per family; a type counts for the first family it names."""
    family = first_rule(F.lower(filled("type")), FAMILIES, "other")
    return certs.groupBy(family.alias("family")).agg(F.count("*").alias("n"))


def integrity(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """Share of object rows and the label of the whole table."""
    totals = rows.agg(F.count("*").alias("n_rows"), F.sum(F.when(F.col(kind) == "dict", 1).otherwise(0)).alias("n_valid"))
    share = F.col("n_valid") / F.nullif(F.col("n_rows"), F.lit(0))
    return totals.withColumn("integrity_pct", share * 100).withColumn(
        "label", F.when(share > 0.95, "Good").otherwise("Needs Attention")
    )


def portal_body_counts(orgs: DataFrame, certs: DataFrame) -> DataFrame:
    """Certifications per body with the part that comes from the entry-level or updated portal."""
    joined = certs.join(orgs.select("seq", "data_source"), "seq")
    fresh = has(F.lower(filled("data_source")), "updated_nabh", "nabh_entry_level")
    family = first_rule(F.lower(filled("type")), FAMILIES, "other")
    return joined.groupBy(family.alias("family")).agg(
        F.count("*").alias("n"), F.sum(F.when(fresh, 1).otherwise(0)).alias("n_portal")
    )


# --- feed profiles -------------------------------------------------------------------------


def completeness(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Percentage of filled values per field."""
    parts = [
        F.struct(F.lit(f).alias("field"), F.avg(F.when(F.trim(filled(F.col(f).cast("string"))) != "", 100.0).otherwise(0.0)).alias("pct"))
        for f in fields
    ]
    return rows.agg(F.array(*parts).alias("_a")).select(F.inline("_a"))


def column_profile(rows: DataFrame, fields: Sequence[str], k: int = 10) -> DataFrame:
    """Per column: distinct values, nulls, and the k most frequent values."""
    counts = counts_by(rows, {f: f for f in fields})
    given = rows.agg(*[F.sum(F.when(F.col(f).isNull(), 1).otherwise(0)).alias(f) for f in fields])
    nulls = given.select(F.inline(F.array(*[F.struct(F.lit(f).alias("dimension"), F.col(f).alias("n_null")) for f in fields])))
    distinct = counts.groupBy("dimension").agg(F.count("*").alias("_values"))
    top = first_rows(counts, ["dimension"], [F.desc("n"), "value"], k).groupBy("dimension").agg(
        F.max("n").alias("top_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))), lambda s: s["value"]), "|").alias("top_values")
    )
    return (
        distinct.join(nulls, "dimension")
        .join(top, "dimension")
        .select("dimension", (F.col("_values") - F.when(F.col("n_null") > 0, 1).otherwise(0)).alias("n_distinct"), "n_null", "top_n", "top_values")
    )


def duplicate_names(rows: DataFrame, name: str = "name") -> DataFrame:
    """Given, distinct and repeated names."""
    per_name = rows.filter(filled(name) != "").groupBy(name).agg(F.count("*").alias("_n"))
    return per_name.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_names"),
        F.count("*").alias("n_distinct"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("n_duplicates"),
    )


def upload_profile(rows: DataFrame, name: str, country: str, accepted: Column) -> DataFrame:
    """Rows, empty and repeated names, success rate and distinct countries of an upload.

    Grouped by (name, country) first; repeated names count like rows after the first one, empty
    names included.
    """
    empty = filled(name) == ""
    first = rows.groupBy(F.coalesce(F.col(name), F.lit("")).alias("_name"), F.col(country).alias("_country")).agg(
        F.count("*").alias("_n"),
        F.sum(F.when(empty, 1).otherwise(0)).alias("_empty"),
        F.sum(F.when(F.coalesce(accepted, F.lit(False)), 1).otherwise(0)).alias("_ok"),
    )
    per_name = first.groupBy("_name").agg(F.sum("_n").alias("_n"), F.sum("_empty").alias("_empty"), F.sum("_ok").alias("_ok"))
    n_countries = first.filter("_ok > 0").select("_country").distinct().agg(F.count("_country")).scalar()
    totals = per_name.agg(
        F.sum("_n").alias("n_rows"),
        F.sum("_empty").alias("n_empty_names"),
        (F.sum("_n") - F.count("*")).alias("n_duplicate_names"),
        F.sum("_ok").alias("n_accepted"),
    )
    return totals.withColumn("success_pct", F.col("n_accepted") * 100.0 / F.col("n_rows")).withColumn("n_countries", n_countries)


def missing_headers(columns: Sequence[str], required: Sequence[str]) -> list[str]:
    """Required fields no header stands for."""
    from meritgrid.sources.uploads import map_headers

    mapped = map_headers(columns)
    return [r for r in required if r not in mapped]


QUALITY_BANDS = [(90, "excellent"), (70, "good"), (50, "fair")]  # fixed values
CONFIDENCE_BANDS = [(80, "high"), (60, "medium")]  # fixed values


def quality_bands(rows: DataFrame, score: str = "data_quality_score") -> DataFrame:
    return rows.groupBy(band(F.col(score), QUALITY_BANDS, "poor").alias("band")).agg(
        F.count("*").alias("n"), F.avg(score).alias("avg_score")
    )


def lab_cleaning_report(rows: DataFrame, k: int = 20) -> DataFrame:
    """Type and location counts and confidence bands of cleaned laboratory rows."""
    bands = rows.groupBy(band(F.col("confidence_score"), CONFIDENCE_BANDS, "low").alias("value")).agg(F.count("*").alias("n"))
    types = rows.groupBy(F.col("organization_type").alias("value")).agg(F.count("*").alias("n"))
    places = rows.select(F.explode("locations").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    top = places.orderBy(F.desc("n"), "value").limit(k)
    tag = lambda df, name: df.select(F.lit(name).alias("what"), "value", "n")
    return tag(bands, "confidence").union(tag(types, "type")).union(tag(top, "location"))


def lab_samples(rows: DataFrame, k: int = 10) -> DataFrame:
    return rows.filter("confidence_score >= 80").orderBy("seq").limit(k)


def match_report(matches: DataFrame) -> DataFrame:
    """Match rate and counts per confidence word."""
    found = F.col("method") != "not_found"
    add = lambda test: F.sum(F.when(test, 1).otherwise(0))
    return matches.agg(
        F.count("*").alias("n_orgs"),
        add(found).alias("n_matched"),
        (add(found) * 100.0 / F.count("*")).alias("match_pct"),
        *[add(F.col("confidence") == c).alias(f"n_{c}") for c in ("high", "medium", "low")],
    )


def source_audit(sources: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows per source and the registry-flag count. ``sources(seq, source)``, ``flags(seq, has_jci)``."""
    per_source = sources.groupBy("source").agg(F.count("*").alias("n")).select(F.concat(F.lit("source::"), F.col("source")).alias("metric"), "n")
    totals = flags.agg(F.count("*").alias("total"), F.sum("has_jci").alias("jci"))
    rows = F.array(F.struct(F.lit("total").alias("metric"), F.col("total").alias("n")), F.struct(F.lit("jci").alias("metric"), F.col("jci").alias("n")))
    return totals.select(F.inline(rows)).union(per_source)


def dual_accreditation(flags: DataFrame) -> DataFrame:
    """Counts of two registry flags and of both. ``flags(seq, jci_accredited, nabh_accredited)``."""
    add = lambda test: F.sum(F.when(F.coalesce(test, F.lit(False)), 1).otherwise(0))
    a, b = F.col("jci_accredited"), F.col("nabh_accredited")
    return flags.agg(F.count("*").alias("n_orgs"), add(a).alias("n_jci"), add(b).alias("n_nabh"), add(a & b).alias("n_both"))


def specialty_counts(labs: DataFrame) -> DataFrame:
    return labs.select(F.explode("specialties").alias("specialty")).groupBy("specialty").agg(F.count("*").alias("n"))


def lab_summary(labs: DataFrame) -> DataFrame:
    """Laboratory count, mean score, and how many have a phone, website and long address."""
    return labs.agg(
        F.count("*").alias("n_labs"),
        F.avg("quality_score").alias("avg_score"),
        F.sum((filled("phone") != "").cast("int")).alias("with_phone"),
        F.sum((filled("website") != "").cast("int")).alias("with_website"),
        F.sum((F.length(filled("address")) > 20).cast("int")).alias("with_address"),
    )


# --- countries and trends ------------------------------------------------------------------


def country_statistics(countries: DataFrame) -> DataFrame:
    """Mean score, best country, share of countries at 85 or more, hospitals in total."""
    high = F.sum(F.when(F.col("score") >= 85, 1).otherwise(0))
    return countries.agg(
        F.avg("score").alias("avg_score"),
        F.max_by("country", F.struct("score", F.col("tie"))).alias("top_country"),
        high.alias("n_high"),
        (high * 100.0 / F.count("*")).alias("high_pct"),
        F.sum("hospitals").alias("hospitals"),
    )


def region_statistics(countries: DataFrame, regions: DataFrame) -> DataFrame:
    """Countries, mean score, hospitals and mean GDP per region. ``regions(country, region)``."""
    return countries.join(regions, "country").groupBy("region").agg(
        F.count("*").alias("n_countries"),
        F.avg("score").alias("avg_score"),
        F.sum("hospitals").alias("hospitals"),
        F.avg("gdp").alias("avg_gdp"),
    )


def monthly_totals(monthly: DataFrame) -> DataFrame:
    """Totals per month; a calendar of months stays small whatever the data size."""
    return monthly.groupBy("y", "m").agg(F.sum("cnt").alias("total"))


def running_by_type(monthly: DataFrame) -> DataFrame:
    """Running count per type, month by month."""
    w = Window.partitionBy("cert_type").orderBy("y", "m").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.withColumn("running", F.sum("cnt").over(w))


def growth_by_month(monthly: DataFrame) -> DataFrame:
    """Running total and its growth over the month before, 0 without a base, first month left out."""
    order = Window.orderBy("y", "m")
    running = monthly_totals(monthly).withColumn("running", F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("running").over(order)
    growth = F.when(before > 0, (F.col("running") - before) / before * 100).otherwise(0.0)
    return running.withColumn("_b", before).withColumn("growth", growth).filter("_b is not null").drop("_b")


def type_totals(monthly: DataFrame) -> DataFrame:
    """Total, share and mean over the months in the data, per type."""
    totals = monthly.groupBy("cert_type").agg(F.sum("cnt").alias("total"))
    share = F.col("total") * 100.0 / F.sum("total").over(Window.partitionBy())
    months = monthly.agg(F.count_distinct("y", "m").alias("months"))  # one row
    averaged = totals.join(F.broadcast(months), F.lit(True))
    average = F.col("total") / F.col("months")
    return averaged.withColumn("share", share).withColumn("monthly_avg", average).drop("months")


def year_totals(monthly: DataFrame) -> DataFrame:
    """Total, monthly mean and growth over the year before; 0 in the first year."""
    totals = monthly.groupBy("y").agg(F.sum("cnt").alias("total"))
    before = F.lag("total").over(Window.orderBy("y"))
    growth = F.coalesce((F.col("total") - before) / before * 100, F.lit(0.0))
    return totals.withColumn("monthly_avg", F.col("total") / 12).withColumn("growth", growth)


def growth_metrics(monthly: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Overall growth, compound annual growth, total, peak and lowest month of the years."""
    scope = monthly_totals(monthly).filter(F.col("y").between(first_year, last_year))
    at = lambda y: F.sum(F.when(F.col("y") == y, F.col("total")))
    label = F.concat_ws("-", F.col("y").cast("string"), F.lpad(F.col("m").cast("string"), 2, "0"))
    early = -(F.col("y") * 12 + F.col("m"))
    totals = scope.agg(
        at(first_year).alias("_a"),
        at(last_year).alias("_b"),
        F.sum("total").alias("total"),
        F.max_by(label, F.struct("total", early.alias("e"))).alias("peak_month"),
        F.min_by(label, F.struct("total", (-early).alias("e"))).alias("lowest_month"),
    )
    ratio = F.col("_b") / F.col("_a")
    return totals.select(
        ((ratio - 1) * 100).alias("growth_pct"),
        ((F.pow(ratio, F.lit(1.0 / (last_year - first_year))) - 1) * 100).alias("cagr_pct"),
        "total", "peak_month", "lowest_month",
    )


def year_month_matrix(monthly: DataFrame) -> DataFrame:
    """One row per year, one column per month."""
    return monthly.groupBy("y").pivot("m", list(range(1, 13))).agg(F.sum("cnt")).select(
        "y", *[F.coalesce(F.col(str(m)), F.lit(0)).alias(f"m{m:02d}") for m in range(1, 13)]
    )


# --- reconciliation and evidence -----------------------------------------------------------


def reconcile(source: DataFrame, loaded: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Loaded share of the rows, and per dimension how many source values arrived."""
    n_loaded = loaded.agg(F.count("*")).scalar()
    out = source.agg(F.count("*").alias("n_source")).select(F.lit("rows").alias("what"), "n_source", n_loaded.alias("n_loaded"))
    for d in dims:
        there = loaded.select(d).distinct().withColumn("_hit", F.lit(1))
        values = source.select(d).distinct().join(there, d, "left")
        out = out.union(values.agg(F.count("*"), F.count("_hit")).select(F.lit(d), "count(1)", "count(_hit)"))
    return out.withColumn("share", F.col("n_loaded") * 100.0 / F.col("n_source"))


def missing_values(source: DataFrame, loaded: DataFrame, dim: str) -> DataFrame:
    """Values of the source that did not arrive."""
    return source.select(dim).distinct().join(loaded.select(dim).distinct(), dim, "left_anti")


def evidence(orgs: DataFrame, hits: DataFrame) -> DataFrame:
    """Per organisation: certifications found, contributing sources in order, and a status.

    ``hits(seq, source, priority, cert_name)`` unites the registry lookups. Sources are folded to
    one row per (organisation, source) before they are listed.
    """
    per_source = hits.groupBy("seq", "source", "priority").agg(F.count("*").alias("_n"))
    folded = per_source.groupBy("seq").agg(
        F.sum("_n").alias("n_certs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "source"))), lambda s: s["source"]), "; ").alias("sources"),
    )
    return orgs.select("seq").join(folded, "seq", "left").fillna(0, subset=["n_certs"]).fillna("", subset=["sources"]).withColumn(
        "status", F.when(F.col("n_certs") > 0, "validated").otherwise("none")
    )


def initiatives_of(orgs: DataFrame, extracted: DataFrame, known: DataFrame) -> DataFrame:
    """Initiatives per organisation, page-extracted first, distinct by name.

    ``extracted(seq, pos, initiative)``; ``known(key, pos, initiative)`` applies by equal name,
    else by the first key contained either way.
    """
    keyed = orgs.select(F.col("seq").alias("lid"), lower_name("name").alias("key"))
    order = known.groupBy("key").agg(F.min("known_no").alias("ord"))
    exact = blocking.equal_key(keyed, order)
    rest = keyed.join(exact.select("lid"), "lid", "left_anti")
    partial = blocking.best_of(blocking.either_contains(rest, order))
    routed = exact.union(partial).join(order, "ord").select(F.col("lid").alias("seq"), F.col("key"))
    from_list = routed.join(known, "key").select("seq", F.lit(1).alias("prio"), "pos", "initiative")
    both = extracted.select("seq", F.lit(0).alias("prio"), "pos", "initiative").union(from_list)
    return first_rows(both, ["seq", "initiative"], ["prio", "pos"])


def reviews_of_validated(reviews: DataFrame, evidence_rows: DataFrame, completed: bool = True) -> DataFrame:
    """Reviews of organisations that passed validation: evidence found, or the check completed."""
    passed = evidence_rows if completed else evidence_rows.filter("status = 'validated'")
    return reviews.join(passed.select("seq"), "seq", "left_semi")


# --- top lists and suggestions -------------------------------------------------------------


def top_ranked(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.orderBy("overall_rank").limit(k)


def largest(df: DataFrame, column: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(column), *ties).limit(k)


def suggestions(orgs: DataFrame, typed: Texts, k: int = 10) -> DataFrame:
    """Suggestions for typed texts: name start, then name part, then original name.

    ``typed``: a table ``query_no, query`` or a list of texts. One per name and location key (better
    class, then shorter name, then file order), ordered by class and name. Texts under two letters are
    left out. Typed texts find the names that hold them through the containment automaton.
    """
    name, original = lower_name("name"), lower_name("original_name")
    held = orgs.filter(name != "").select(
        "seq", "name", name.alias("_n"), original.alias("_o"), cleaning.suggestion_key("name", "location").alias("_key")
    )
    held = cut_lineage(held)
    asked = cut_lineage(asked_texts(orgs.sparkSession, typed).filter(F.length("query") >= 2))
    # a row for the name and one for the original name, so that the pairs are found and joined once
    both = F.array(*[F.struct(F.col(c).alias("_whole"), F.lit(c == "_o").alias("_orig")) for c in ("_n", "_o")])
    sides = held.select("*", F.inline(both)).drop("_o")
    pairs = contained_pairs(sides.select("_whole").distinct(), asked.select(F.col("query").alias("key")).distinct())
    n, q = F.col("_n"), F.col("key")
    hits = pairs.join(sides, "_whole").filter(~F.col("_orig") | ~F.contains(n, q))
    hits = hits.withColumn("_kind", F.when(F.col("_orig"), 2).when(F.startswith(n, q), 0).otherwise(1))
    best = first_rows(hits, ["key", "_key"], ["_kind", F.length("name"), "seq"])
    w = Window.partitionBy("key").orderBy("_kind", cleaning.unify_company(F.trim("name")), "seq")
    names = F.element_at(F.array(F.lit("name_start"), F.lit("name_contains"), F.lit("original_name")), F.col("_kind") + 1)
    placed = best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return placed.join(asked.withColumnRenamed("query", "key"), "key").select(
        "query_no", "place", "seq", names.alias("match_type")
    )


def merged_suggestions(first: DataFrame, second: DataFrame, k: int = 8) -> DataFrame:
    """Two providers in order, distinct by lower-case name, k per query.

    Both carry ``query_no, place, name``; half of k comes from the first provider at most.
    """
    head = first.filter(F.col("place") <= k // 2).select("query_no", F.lit(0).alias("_p"), "place", "name")
    taken = head.groupBy("query_no").agg(F.count("*").alias("_t"))
    rest = second.join(taken, "query_no", "left").filter(F.col("place") <= k - F.coalesce("_t", F.lit(0))).select(
        "query_no", F.lit(1), "place", "name"
    )
    both = head.union(rest).withColumn("_n", lower_name("name"))
    distinct = first_rows(both, ["query_no", "_n"], ["_p", "place"])
    w = Window.partitionBy("query_no").orderBy("_p", "place")
    return distinct.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("query_no", F.col("_r").alias("place"), "name")
