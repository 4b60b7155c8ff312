"""Upserts over the whole base, against the pairwise SQL and hand-made cases."""

import re
import sys
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from meritgrid.operators import match, merge  # noqa: E402
from meritgrid.plans import merging_queries  # noqa: E402
from meritgrid.plans.registry import TABLES  # noqa: E402
from tools.check import rows_of  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_registry_upsert_matches_in_every_region(spark):
    """The registered SQL compares every pair of the whole base."""
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(contract.oracle_sql()["registry_upsert"])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    df = contract.queries()["registry_upsert"](spark, SF)
    assert rows_of(df.columns, df.collect()) == want


def rows_by(df, *keys):
    return sorted(tuple(r[k] for k in keys) for r in df.collect())


def test_branded_labs_keep_the_base_and_insert_the_unmatched(spark):
    held = spark.createDataFrame([(1, 90.0, ["Clinic"]), (2, None, ["Eye"])], "seq long, quality_score double, specialties array<string>")
    labs = spark.createDataFrame(
        [(11, 6.0, ["Lab"], 95.0), (12, 6.0, ["Lab", "Eye"], 95.0), (13, 6.0, ["New"], 95.0)],
        "seq long, impact double, specialties array<string>, quality_score double",
    )
    matches = spark.createDataFrame([(11, 1), (12, 1)], "seq long, match_seq long")
    certs = spark.createDataFrame([(1, 4, "JCI"), (2, 1, "ISO")], "seq long, pos long, name string")
    brought = spark.createDataFrame([(11, 1, "CAP"), (11, 2, "more"), (12, 1, "CAP"), (13, 1, "CAP"), (13, 2, "own")], "seq long, pos long, name string")
    flags = spark.createDataFrame([(1, "cap_accredited", False), (2, "verified", True)], "seq long, flag string, value boolean")
    out = merge.branded_lab_upsert(held, labs, matches, certs, brought, certs, brought, flags)
    orgs = {r.seq: (r.quality_score, sorted(r.specialties), r.n_labs, r.action) for r in out["orgs"].collect()}
    assert orgs == {1: (100.0, ["Clinic", "Eye", "Lab"], 2, "updated"), 2: (None, ["Eye"], 0, "kept"), 13: (95.0, ["New"], 0, "inserted")}
    assert rows_by(out["certs"], "seq", "name") == [(1, "CAP"), (1, "CAP"), (1, "JCI"), (2, "ISO"), (13, "CAP"), (13, "own")]
    assert [r[0] for r in rows_by(out["initiatives"], "seq")] == [1] * 4 + [2] + [13] * 2
    placed = rows_by(out["initiatives"].filter("seq = 1"), "pos", "name")
    assert [n for _, n in placed] == ["JCI", "CAP", "more", "CAP"] and len({p for p, _ in placed}) == 4
    found = {(r.seq, r.flag): r.value for r in out["flags"].collect()}
    assert len(found) == 11 and found[1, "cap_accredited"] and found[13, "accreditation_valid"] and found[2, "verified"]


def test_pathology_returns_the_whole_table(spark):
    held = spark.createDataFrame([(1, "A", "customer"), (2, "B", "customer")], "seq long, name string, data_source string")
    labs = spark.createDataFrame([(11, "A x"), (12, "A y"), (13, "Quiet Lab"), (14, "quiet lab")], "seq long, name string")
    matches = spark.createDataFrame([(11, 1), (12, 1)], "seq long, match_seq long")
    certs = spark.createDataFrame([(2, 1, "ISO")], "seq long, pos long, name string")
    flags = spark.createDataFrame([(2, "verified", True)], "seq long, flag string, value boolean")
    out = merge.pathology_upsert(held, labs, matches, certs, flags)
    assert rows_by(out["orgs"], "seq", "data_source", "added_certs", "action") == [
        (1, "customer, CAP", 2, "updated"), (2, "customer", 0, "kept"), (13, "CAP 15189", 1, "inserted")
    ]  # 14 finds 13, which was inserted before it
    assert rows_by(out["orgs"].filter("seq = 13"), "lab_name") == [("quiet lab",)]
    assert [r[0] for r in rows_by(out["certs"], "seq")] == [1, 1, 2, 13, 13]
    assert out["flags"].count() == 11


def test_registry_replaces_or_appends_one_certification(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "seq long, name string")
    rows = spark.createDataFrame(
        [(11, "a", "Active"), (12, "a", "Expired"), (13, "b", "Active"), (14, "new", "Active"), (15, "c", "Active")],
        "seq long, name string, status string",
    ).selectExpr("*", "'N' AS accreditation_no", "'2027' AS valid_upto")
    matches = spark.createDataFrame([(11, 1), (12, 1), (13, 2)], "seq long, match_seq long")
    kind = merge.REGISTRY_CERT
    certs = spark.createDataFrame(
        [(1, 3, "old", kind, "Active", 15.0), (1, 5, "late", kind, "Active", 1.0), (2, 9, "ISO", "x", "Active", 2.0), (3, 1, "JCI", "x", "Active", 3.0)],
        "seq long, pos long, name string, cert_type string, status string, score_impact double",
    )
    flags = spark.createDataFrame([(1, "accreditation_current", True), (3, "verified", True)], "seq long, flag string, value boolean")
    out = merge.registry_upsert(held, rows, matches, certs, flags)
    assert rows_by(out["orgs"], "target_seq", "name", "action", "n_incoming") == [
        (1, "a", "updated", 2), (2, "b", "updated", 1), (3, "c", "kept", 0), (14, "new", "inserted", 1)
    ]
    assert rows_by(out["certs"], "seq", "pos", "status", "score_impact") == [
        (1, 3, "Expired", 0.0), (1, 5, "Active", 1.0), (2, 9, "Active", 2.0), (2, 10, "Active", 15.0), (3, 1, "Active", 3.0), (14, 1, "Active", 15.0)
    ]
    found = {(r.seq, r.flag): r.value for r in out["flags"].collect()}
    assert len(found) == 10 and found[1, "accreditation_current"] is False and found[3, "verified"]


def tasks_of(df):
    """How many tasks hold the rows of ``df``."""
    return df.select(F.spark_partition_id()).distinct().count()


def test_valid_certs_keep_the_first_backed_one_and_stay_in_many_tasks(spark):
    """Equal keys with and without the family phrase, null and repeated organisations, names without a key."""
    names = ["JCI", "jci!", "Joint Commission", "Joint-Commission", "ISO 9001", "iso-9001", "--", None]
    rows = [(s, p, names[(p * 5 + (s or 0)) % 8], f"x{p}") for s in [None, *range(40)] for p in range(12)]
    backing = [(s, v) for s in range(0, 40, 2) for v in ([1, 0] if s % 4 else [None])]
    key = lambda n: re.sub("[^a-z0-9]+", " ", (n or "").lower()).strip()
    jci = lambda n: "JCI" in n.upper() or "JOINT COMMISSION" in n.upper()
    valid, want = {s for s, v in backing if v}, {}
    for s, p, n, x in rows:
        if key(n) and (s in valid or not jci(n)):
            want.setdefault((s, key(n)), (s, p, n, x))
    certs = spark.createDataFrame(rows, "seq long, pos long, name string, extra string")
    out = merge.valid_certs(certs, spark.createDataFrame(backing, "seq long, registry_valid int"))
    assert out.columns == certs.columns
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want.values()))
    assert tasks_of(out) == 4  # the shuffle partitions of the session, not one for so few rows


def test_rows_of_the_base_stay_in_many_tasks(spark):
    """Null and repeated organisations join as before."""
    rows = [(s, p) for s in [None, *range(30), 7] for p in range(5)]
    held = [None, *range(0, 30, 2), 4]
    out = merging_queries.of_base(
        spark.createDataFrame(rows, "seq long, pos long"), spark.createDataFrame([(s,) for s in held], "seq long")
    )
    want = [r for r in rows for s in held if s is not None and r[0] == s]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert tasks_of(out) == 4


def plan_of(df, capsys):
    df.explain("extended")
    return capsys.readouterr().out


def test_laboratory_feed_makes_its_keys_once(spark, capsys):
    """Equal, contained and foreign names, null and repeated ones; later steps read the written keys."""
    words = lambda n: sorted(set((n or "").lower().split()))
    held = [(1, "Apex Care", "JCI"), (2, "River", "customer"), (3, "apex care", "NABH"), (4, None, "customer")]
    labs = [(11, "Apex  Care"), (12, "River"), (13, "apex care north"), (14, "Nothing alike"), (15, None), (16, "apex care")]
    base = spark.createDataFrame([(*r, words(r[1])) for r in held], "seq long, name string, data_source string, search_keywords array<string>")
    feed = spark.createDataFrame([(*r, words(r[1])) for r in labs], "seq long, name string, search_keywords array<string>")
    matches = match.lab_name_match(feed, base)
    assert rows_by(matches, "seq", "match_seq") == [(11, 1), (12, 2), (13, 1), (15, 4), (16, 1)]
    out = merge.lab_upsert(base, feed, matches)
    assert rows_by(out["sources"], "seq", "data_source", "action") == [
        (1, "JCI+NABL", "updated"), (2, "NABL", "updated"), (3, "NABH", "kept"), (4, "NABL", "updated"), (14, "NABL", "added")
    ]
    assert rows_by(out["keywords"].filter("seq in (1, 14)"), "seq", "keyword") == [(1, "apex"), (1, "care"), (14, "alike"), (14, "nothing")]
    assert tuple(out["stats"].first()) == (3, 2, 1)
    assert "regexp_replace" not in plan_of(matches, capsys)
    assert "MapCoGroups" not in plan_of(out["sources"], capsys)
