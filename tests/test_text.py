"""Text, place and date expressions on single values."""

import pytest
from pyspark.sql import functions as F

from meritgrid.functions import cleaning, dates, nested, text
from meritgrid.operators import filters, merge, validate


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(
    "name,want",
    [
        ("Joint Commission International (JCI)", "JCI"),
        ("iso-14001 Environmental", "ISO14001"),
        ("ISO 9001:2015", "ISO9001"),
        ("College of American Pathologists", "CAP"),
        ("  ", ""),
        ("Green Seal", "GREEN SEAL"),
    ],
)
def test_cert_key(spark, name, want):
    assert value(spark, text.cert_key(F.lit(name))) == want


@pytest.mark.parametrize(
    "name,city,state,country,want",
    [
        ("Apollo Hospitals (Unit 2), Chennai, Tamil Nadu, India", "Chennai", "Tamil Nadu", "India", "apollo hospitals"),
        ("Care Private Limited", "", "", "", "care pvt. ltd.."),
        ("Care Pvt Ltd, Goa", None, "Goa", None, "care pvt. ltd."),
        ("Lakeside  Clinic USA", "", "", "", "lakeside clinic"),
        (None, None, None, None, ""),
    ],
)
def test_canonical_name(spark, name, city, state, country, want):
    cells = [F.lit(x).cast("string") for x in (name, city, state, country)]
    assert value(spark, text.canonical_name(*cells)) == want


def test_title_case_after_every_non_letter(spark):
    assert value(spark, cleaning.title_case(F.lit("o'neil ST.mary 3rd"))) == "O'Neil St.Mary 3Rd"


def test_names_from_urls(spark):
    assert value(spark, cleaning.name_from_url(F.lit("https://mayo-clinic.org/about"))) == "Mayo Clinic"
    assert value(spark, cleaning.name_from_url(F.lit("https://ab.org/good-care/x"))) == "Good Care"
    assert value(spark, cleaning.name_from_url(F.lit("https://www.care.org"), True)) == "Care"
    assert value(spark, cleaning.name_from_url(F.lit("nothing"))) == "New Organization"
    assert value(spark, cleaning.full_url(F.lit("a.org/x"))) == "https://a.org/x"
    assert value(spark, cleaning.full_url(F.lit("https:///x"))) is None


def test_locations(spark):
    where = cleaning.location_of(F.lit("Pune"), F.lit("MH"), F.lit("ignored"))
    assert value(spark, where) == "Pune, MH"
    messy = cleaning.location_of(F.lit(""), F.lit(None).cast("string"), F.lit("A - a | B/ India, C\\u003cbr"))
    assert value(spark, messy) == "A, B"
    assert value(spark, cleaning.location_of(F.lit(""), F.lit(""), F.lit(""))) == "Unknown Location"
    bare = cleaning.name_without_place(F.lit("City Care, Pune - India"), F.lit("Pune"))
    assert value(spark, bare) == "city care"


@pytest.mark.parametrize(
    "raw,want",
    [("04 May 2015", "2015-05-04"), ("4/5/2015", "2015-05-04"), ("2015-05-04", "2015-05-04"), ("soon", "soon"), (" ", None), ("1 Foo 2020", "2020-01-01")],
)
def test_find_date(spark, raw, want):
    assert value(spark, dates.find_date(F.lit(raw))) == want


@pytest.mark.parametrize(
    "raw,want",
    [("08 Dec 2014", "2014-12-08"), ("8 December 2014", "2014-12-08"), ("08.12.2014", "2014-12-08"), ("30/02/2014", None), ("N/A", None), ("", None)],
)
def test_parse_date(spark, raw, want):
    got = value(spark, dates.parse_date(F.lit(raw)))
    assert (str(got) if got else None) == want


def test_status_on_the_expiry_day(spark):
    day = F.to_date(F.lit("2025-06-01"))
    at = "2025-06-01 00:00:00"
    assert value(spark, dates.certificate_status(F.lit(""), day, at)) == "Expired"
    assert value(spark, dates.certificate_status(F.lit(""), day, at, "date_between")) == "Active"
    assert value(spark, dates.certificate_status(F.lit("now active"), day, at, "date_between")) == "Active"
    assert value(spark, dates.certificate_status(F.lit("Not renewed"), day, at, "dental")) == "Expired"
    assert value(spark, dates.certificate_status(F.lit(""), F.lit(None).cast("date"), at, "dental")) == "Active"


def test_issue_lists(spark):
    got = value(spark, validate.number_issues(F.lit("PEH-12"), F.lit("")))
    assert got == ["Invalid accreditation number format", "Missing reference number"]
    got = value(spark, validate.date_issues(F.lit("2020-01-10"), F.lit("2020-01-01")))
    assert got == ["Invalid date range (from >= upto)", "Suspiciously short certification period"]
    assert value(spark, validate.name_issues(F.lit("  "))) == ["Missing hospital name", "Suspicious hospital name pattern"]


def test_mixed_certification_items(spark):
    items = F.array(*[F.lit(x) for x in ('"ISO 9001"', '{"name":"JCI","status":"Expired"}', '" "', "7", "null", "[1]")])
    got = value(spark, nested.clean_cert_items(items))
    assert [(c["name"], c["status"]) for c in got] == [("ISO 9001", "Active"), ("JCI", "Expired")]


def test_valid_names(spark):
    for name, want in [("Pune", False), ("Pune Labs", True), ("12345", False), ("Serial no", False), ("Good Care", True), ("a@b.com x", False)]:
        assert value(spark, filters.valid_name(F.lit(name))) is want


def test_similar_texts(spark):
    texts = F.array(*[F.lit(t) for t in ("a b c d", "a b c d e", "x y", "x y z w", "q", "r", "s", "t")])
    assert value(spark, merge.drop_similar_texts(texts)) == ["a b c d", "x y", "x y z w", "q", "r"]


def test_group_level_equals_pairwise(spark):
    names = ["Apollo", "Apollo Delhi", "Apollo, Goa", "Care Group", "Eye (Unit) A", "Eye", "Eye (Unit)", "Lab", "Labs", ""]
    df = spark.createDataFrame(list(enumerate(names)), "seq long, name string")
    got = {r["name"]: r["is_group"] for r in filters.group_level_names(df).collect()}

    def plain(name):
        if not name:
            return 0
        if any(w in name.lower() for w in ("group", "network", "health system")):
            return 1
        if "," in name or ("(" in name and ")" in name):
            return 0
        return int(any(o != name and (o.startswith(name + " ") or o.startswith(name + ",")) for o in names))

    assert got == {n: plain(n) for n in names}
