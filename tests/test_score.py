"""Scores against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from meritgrid.operators import merge, reviews, score, score_more

CERTS = "seq long, pos long, name string, status string, score_impact double"
INITIATIVES = "seq long, pos long, category string, impact_score double, status string"


def orgs(spark, *seqs):
    return spark.createDataFrame([(s, f"Org {s}") for s in seqs], "seq long, name string")


def one(df):
    return df.collect()[0].asDict()


def total(spark, certs, initiatives=(), prior=None):
    rows = spark.createDataFrame([(1, i, *c) for i, c in enumerate(certs)], CERTS)
    inits = spark.createDataFrame([(1, i, *x) for i, x in enumerate(initiatives)], INITIATIVES)
    held = None if prior is None else spark.createDataFrame([(1, float(prior))], "seq long, prior_score double")
    return one(score.total_score(orgs(spark, 1), rows, inits, held))


def test_nothing_costs_every_mandatory_standard(spark):
    r = total(spark, [])
    assert (r["total_penalty"], r["compliant_count"], r["total_score"]) == (45, 0, 0.0)


def test_single_certifications(spark):
    r = total(spark, [("ISO 9001:2015", "Accredited", None)])
    # 28 * 3.5 = 98 and one international bonus of 3, capped at 75; penalty 45 - 4
    assert (r["certification_score"], r["total_penalty"], r["total_score"]) == (75.0, 41, 34.0)
    zero = total(spark, [("ISO 9001:2015", "Active", 0.0)])
    assert zero["certification_score"] == 3.0
    assert zero["total_score"] == 12.0 and zero["baseline_adjustment"] == 12.0
    half = total(spark, [("State License", "Pending", 10.0)])
    assert half["certification_score"] == pytest.approx(11.0)
    assert half["total_score"] == 0.0


def test_us_bodies_soften_iso_penalties(spark):
    r = total(spark, [("CAP Accreditation", "Expired", None)])
    # CAP 8 and JCI 10 in full, ISO 15189 free, 9001 2, 27001 3, 45001 2, 13485 2, 14001 1
    assert r["total_penalty"] == 28
    us = total(spark, [("Joint Commission", "Active", None)])
    # JCI met; CAP 8, 15189 2, 9001 2, 27001 3, 45001 2, 13485 2, 14001 1
    assert us["total_penalty"] == 20


def test_active_nabl_implies_iso_15189_for_points_only(spark):
    r = total(spark, [("NABL Testing", "Active", 0.0)])
    assert r["implied_lab"] == 1
    # 22 * 3.8 + diversity 4 + international 3
    assert r["certification_score"] == 75.0
    assert r["total_penalty"] == 45


def test_the_last_matching_certification_decides(spark):
    r = total(spark, [("ISO 9001", "Active", None), ("ISO9001 renewal", "Expired", None)])
    assert r["compliant_count"] == 0
    r = total(spark, [("ISO 9001", "Expired", None), ("ISO9001 renewal", "Valid", None)])
    assert r["compliant_count"] == 1


def test_prior_score_softens_the_penalty(spark):
    certs = [("ISO 9001", "Active", None)]
    assert total(spark, certs, prior=70)["applied_penalty"] == 16.0
    assert total(spark, certs, prior=69)["applied_penalty"] == 41.0


def test_initiatives(spark):
    r = total(spark, [], [("Patient Safety", 10.0, "Active"), ("Odd", None, "Closed")])
    # 12 + 6 * 0.5 * 0.5 + min(1.6, 8)
    assert r["initiative_score"] == pytest.approx(12 + 1.5 + 1.6)
    capped = total(spark, [], [("Patient Safety", 10.0, "Active")] * 9)
    assert capped["initiative_score"] == 35.0


def test_international_score_accepts_equivalents_and_may_be_negative(spark):
    def intl(*certs):
        rows = spark.createDataFrame([(1, i, *c) for i, c in enumerate(certs)], CERTS)
        return one(score.intl_cert_score(orgs(spark, 1), rows))

    base = ["JCI", "ISO 9001"]
    for lab in ("ISO 15189", "CAP", "NABL"):
        r = intl(*[(n, "Active", 1.0) for n in [*base, lab]])
        assert r["intl_penalty"] == 0.0
    r = intl(("Unknown permit", "Active", 1.0))
    assert (r["intl_penalty"], r["intl_cert_score"]) == (40.0, -40.0)
    r = intl(("Joint Commission", "Active", 0.0))
    assert r["intl_penalty"] == 6.0 + 8.0
    none = one(score.intl_cert_score(orgs(spark, 1), spark.createDataFrame([], CERTS)))
    assert none["intl_cert_score"] == 0.0


def test_greedy_certification_removal_equals_plain_loop(spark):
    import difflib

    names = ["Green Seal Award", "Green Seal Awards", "Hand Care Badge", "Hand Care Badges 2", "Blue Door", "ISO 9001", "ISO-9001:2015"]
    impacts = [1.0, 5.0, None, None, 2.0, 3.0, 9.0]
    rows = spark.createDataFrame([(1, i, n, "Active", s) for i, (n, s) in enumerate(zip(names, impacts))], CERTS)
    kept = {r["name"] for r in merge.distinct_certs(rows).collect()}
    assert difflib.SequenceMatcher(None, names[0].upper(), names[1].upper()).ratio() > 0.8
    assert kept == {"Green Seal Awards", "Hand Care Badges 2", "Blue Door", "ISO-9001:2015"} or kept == {
        "Green Seal Awards", "Hand Care Badge", "Blue Door", "ISO-9001:2015"
    }
    order = {r["name"]: r["pos"] for r in merge.distinct_certs(rows).collect()}
    assert order["ISO-9001:2015"] == 5  # the better item takes the place of the first one


def test_batch_scoring_counts_missing_impact_as_zero(spark):
    rows = spark.createDataFrame([(1, 1, "ISO 9001", "Active", None)], CERTS)
    r = one(score_more.batch_scores(orgs(spark, 1), rows))
    assert (r["certification_score"], r["total_score"], r["certification_count"]) == (3.0, 12.0, 1)


def test_review_confidence_and_score(spark):
    rows = [(1, i, "web" if i % 2 else "app", None if i == 0 else 4.0, 0.5 if i > 1 else -0.5, f"2024-01-0{i + 1} 00:00:00") for i in range(4)]
    revs = spark.createDataFrame(rows, "seq long, event_id long, platform string, rating double, sentiment double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    r = one(reviews.review_score(reviews.review_summary(orgs(spark, 1), revs, "2024-02-01 00:00:00")))
    assert r["trend"] == "improving" and r["platforms"] == "app=2;web=2"
    confidence = 0.4 * 4 / 50 + 0.4 + 0.2 * 2 / 3
    assert r["confidence"] == pytest.approx(confidence)
    assert r["review_score"] == pytest.approx((0.5 + 2.5 + 3.2 + 2.0) * confidence)
    empty = one(reviews.review_score(reviews.review_summary(orgs(spark, 2), revs, "2024-02-01 00:00:00")))
    assert (empty["review_score"], empty["trend"], empty["n_reviews"]) == (0.0, "stable", 0)


def test_one_jci_prefers_the_larger_certificate_number(spark):
    from meritgrid.operators import merge

    rows = [
        (1, 1, "JCI", "Active and long", 20, "A1"),
        (1, 2, "JCI", "Active", 20, "Z9"),
        (1, 3, "ISO 9001", "Active", 5, ""),
    ]
    certs = spark.createDataFrame(
        rows, "seq long, pos long, name string, status string, score_impact int, certificate_number string"
    )
    kept = {r.pos: r.moved_last for r in merge.one_jci(certs).collect()}
    assert kept == {2: 1, 3: 0}


def test_certification_keys_are_computed_once_a_row(spark):
    rows = spark.createDataFrame(
        [(1, 0, "ISO-9001", "Active", 1), (1, 1, "iso 9001 ", "Active", 5), (1, 2, " ", "Active", 1)],
        "seq long, pos long, name string, status string, score_impact int",
    )
    best = merge.best_certs(rows)
    assert [(r.cert_key, r.pos, r.name) for r in best.collect()] == [("ISO9001", 0, "iso 9001 ")]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"ISO\s*-\s*(\d+)") == 1


def test_international_type_is_computed_once_a_row(spark):
    certs = spark.createDataFrame([(1, "JCI", "Active", 3), (1, "ISO 9001", None, None)], "seq long, name string, status string, score_impact int")
    orgs = spark.createDataFrame([(1,), (2,)], "seq long")
    found = score.intl_cert_score(orgs, certs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    assert [(r.seq, r.cert_rows, r.counted) for r in found.orderBy("seq").collect()] == [(1, 2, 1), (2, 0, 0)]


def test_batch_scores_reads_certifications_once(spark):
    rows = [(1, 1, "ISO 9001", "Active", None), (1, 2, "iso 9001", "accredited", 4), (1, 3, "", "Active", 1), (2, 1, None, None, None)]
    certs = spark.createDataFrame(rows, "seq long, pos long, name string, status string, score_impact int")
    orgs = spark.createDataFrame([(i, "n", "India", "Asia", "Clinic") for i in (1, 2, 3)], "seq long, name string, country string, region string, hospital_type string")
    found = score_more.batch_scores(orgs, certs, fuzzy=False)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # the organisations
    assert {r.seq: r.certification_count for r in found.collect()} == {1: 3, 2: 0, 3: 0}
