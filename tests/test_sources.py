"""Readers, uploads and sinks on files."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from meritgrid.operators import extract, rank, report
from meritgrid.sources import readers, sinks, uploads


def write(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


def test_documents_of_every_shape(spark, tmp_path):
    folder = tmp_path / "docs"
    cert = {"name": "ISO 9001", "status": "Active", "score_impact": 3}
    write(folder, "a.json", [{"name": "A", "certifications": [cert]}, {"name": "B"}])
    write(folder, "b.json", {"metadata": {}, "organizations": [{"name": "C", "quality_indicators": {"x": True}}]})
    write(folder, "c.json", {"name": "D", "city": "Pune"})
    write(folder, "d.json", '{"name": "E", "website" : "http://e.org", oops')
    write(folder, "e.json", "not json at all")
    rows = readers.read_organisations(spark, str(folder)).select("source_name", "name", "website", "city", "certifications").collect()
    assert sorted((r["source_name"], r["name"]) for r in rows) == [
        ("a.json", "A"), ("a.json", "B"), ("b.json", "C"), ("c.json", "D"), ("d.json", "E"),
    ]
    by_name = {r["name"]: r for r in rows}
    assert by_name["A"]["certifications"][0]["score_impact"] == 3.0
    assert by_name["E"]["website"] == "http://e.org"


def test_folder_scan_tags_rows_with_their_file(spark, tmp_path):
    folder = tmp_path / "mixed"
    write(folder, "x.json", {"data": [{"organization_name": "A", "town": "T"}]})
    write(folder, "y.csv", "hospital_name,city\nB,Goa\n")
    rows = readers.scan_folder(spark, str(folder)).collect()
    assert sorted((r["source_name"], r["record"].get("organization_name") or r["record"].get("hospital_name")) for r in rows) == [
        ("x.json", "A"), ("y.csv", "B"),
    ]


def test_csv_files_keep_their_own_headers(spark, tmp_path):
    folder = tmp_path / "tables"
    write(folder, "a.csv", 'name,city\n"Alpha, Inc",Goa\n\nBeta\n')
    write(folder, "b.csv", "\ufeffcity,name,phone,name\nPune,old,1,Gamma\ncity,name,phone,name\n,Delta,,\n")
    write(folder, "c.csv", "")
    got = [(r["source_name"], sorted(r["record"].items(), key=str)) for r in readers.csv_records(spark, f"{folder}/*.csv").collect()]
    assert sorted(got, key=str) == sorted([
        ("a.csv", sorted({"name": "Alpha, Inc", "city": "Goa"}.items(), key=str)),
        ("a.csv", sorted({"name": "Beta", "city": None}.items(), key=str)),
        ("b.csv", sorted({"city": "Pune", "phone": "1", "name": "Gamma"}.items(), key=str)),
        ("b.csv", sorted({"city": None, "phone": None, "name": None}.items(), key=str)),
    ], key=str)


def test_line_documents(spark, tmp_path):
    folder = tmp_path / "lines"
    write(folder, "a.json", '{"name":"A","city":"X"}\n{"name":"B"}\n')
    assert [r["name"] for r in readers.read_lines(spark, str(folder)).orderBy("name").collect()] == ["A", "B"]


def test_header_synonyms(spark):
    assert uploads.map_headers(["Type", " Hospital_Name ", "category", "organization_name"]) == {"name": "organization_name", "hospital_type": "Type"}
    assert report.missing_headers(["name", "nation"], ["name", "country", "city"]) == ["city"]
    with pytest.raises(ValueError):
        uploads.upload_rows(spark.createDataFrame([(1,)], "x int"))


def test_first_available_source(spark):
    empty = spark.createDataFrame([], "name string")
    a = spark.createDataFrame([("a",)], "name string")
    b = spark.createDataFrame([("b",)], "name string")
    assert [r["name"] for r in readers.first_available(empty, a, b).collect()] == ["a"]
    assert [r["name"] for r in readers.first_available(empty, empty, b).collect()] == ["b"]


def ranked(spark):
    rows = [(1, "A, Ltd", "X", "R", "Clinic", 50.0, 1), (2, "B", "Y", "R", "Lab", 70.5, 2), (3, "C", "X", "R", "Lab", 50.0, 3)]
    df = spark.createDataFrame(rows, "seq long, name string, country string, region string, hospital_type string, total_score double, active_certs long")
    return rank.unique_rank(df).withColumn("certification_count", F.col("active_certs"))


def test_rankings_on_disk(spark, tmp_path):
    target = str(tmp_path / "out")
    sinks.save_rankings(ranked(spark), target)
    rows = spark.read.option("header", True).csv(target + "/summary").orderBy("rank").collect()
    assert [(r["rank"], r["name"], r["percentile"]) for r in rows] == [("1", "B", "100.00"), ("2", "C", "66.67"), ("3", "A; Ltd", "33.33")]
    assert spark.read.json(target + "/complete").count() == 3
    with pytest.raises(AnalysisException):
        sinks.save_rankings(ranked(spark), target)


def test_snapshots_are_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    path = sinks.save_snapshot(df, str(tmp_path), "2025-10-01")
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(AnalysisException):
        sinks.save_snapshot(df, str(tmp_path), "2025-10-01")


def test_page_initiatives_equal_plain_loop(spark):
    import re

    html = (
        "<p>Our patient safety program won an international award this year.</p><p>short patient safety</p>"
        "<div>Patient safety and accreditation go together. More text follows here.</div>"
        "<p>Our patient safety program won an international award this year again.</p>"
        "<p>The fourth patient safety line is never looked at because of the limit.</p>"
        "<p>Clinical excellence needs innovation and advanced methods in every ward.</p>"
    )
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(r["name"], r["category"], r["impact_score"]) for r in extract.page_initiatives(pages).orderBy("place").collect()]

    nodes = [n for n in re.split(r"<[^>]*>", html) if n]
    words = lambda t: set(t.lower().split())
    want = []
    from meritgrid.rules.extraction import BOOST_WORDS, INITIATIVE_KEYWORDS

    for keyword, (impact, category) in INITIATIVE_KEYWORDS.items():
        for node in [n for n in nodes if keyword in n.lower()][:3]:
            if not 20 < len(node) < 500:
                continue
            sentence = next(s for s in node.split(".") if keyword in s.lower())
            name = sentence.strip()[:80]
            if any(len(words(name) & words(w[0])) / len(words(name) | words(w[0])) > 0.7 for w in want):
                continue
            want.append((name, category, min(20, impact + 2 * sum(b in node.lower() for b in BOOST_WORDS))))
    assert got == want[:5]


def test_contact_address_is_cut_at_a_comma(spark):
    long = "Block A, " * 30
    html = f'<span class="address">{long}</span><p>+1-555-010-0199 x@y.org</p>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    r = extract.contact_details(pages).collect()[0]
    assert len(r["address"]) <= 180 and r["address"].endswith("Block A")
    assert (r["phone"], r["email"]) == ("+1-555-010-0199", "x@y.org")
