"""Work on single rows: dealt over tasks, and no expression computed again by filters or lambdas."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meritgrid.functions import cleaning
from meritgrid.functions.exprs import computed_once, once
from meritgrid.operators import extract, rank
from meritgrid.plans.registry import Views


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = str(tmp_path_factory.mktemp("rowwise"))
    n = 40
    tables = {
        "customer": {"c_custkey": list(range(n)), "c_nationkey": [0] * n, "c_mktsegment": ["BUILDING"] * n, "c_acctbal": [1.0] * n},
        "supplier": {"s_suppkey": [1, None], "s_nationkey": [0, 0], "s_acctbal": [2.0, None]},
        "nation": {"n_nationkey": [0], "n_name": ["PERU"], "n_regionkey": [0]},
        "region": {"r_regionkey": [0], "r_name": ["AMERICA"]},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), f"{top}/{name}.parquet")
    return top


def test_organisations_of_a_small_file_reach_all_tasks(spark, folder):
    orgs = Views(spark, folder).orgs
    assert orgs.count() == 42
    assert orgs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_once_keeps_values_and_nulls(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    out = df.select(once(F.upper("t"), lambda x: F.concat(x, x)).alias("v")).collect()
    assert [r.v for r in out] == ["ABAB", None]


def test_filter_does_not_repeat_a_column(spark):
    df = spark.createDataFrame([("a1",), ("b",)], "t string")
    out = computed_once(df, x=F.regexp_replace("t", "[0-9]", "")).filter("length(x) > 0").select("x", F.upper("x"))
    assert plan_of(out).count("regexp_replace") == 1
    assert sorted(r.x for r in out.collect()) == ["a", "b"]


def test_location_is_computed_once_for_its_last_tokens(spark):
    df = spark.createDataFrame([("Pune, pune, MH, India",), ("",), (None,)], "t string")
    out = df.select(cleaning.tidy_location(F.col("t")).alias("v"))
    assert plan_of(out).count("u003c|u003e") == 1
    assert [r.v for r in out.collect()] == ["Pune, MH", "Unknown Location", "Unknown Location"]


def test_places_are_not_split_again_for_every_name_token(spark):
    df = spark.createDataFrame([("Apex Clinic, Pune", "Pune, MH"), (None, None)], "n string, l string")
    out = df.select(cleaning.name_without_place("n", "l").alias("v"))
    assert plan_of(out).count("split(") == 2
    assert [r.v for r in out.collect()] == ["apex clinic", ""]


def test_pages_are_cut_once_for_their_tables_and_blocks(spark):
    html = '<table id=x><tr><th>a</th></tr><tr><td>1</td></tr></table><div class="card"><h3>Apex House</h3></div>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    rows, profile, blocks = extract.table_rows(pages, ["a"]), extract.table_profile(pages), extract.directory_blocks(pages)
    for out in (rows, profile, blocks):
        assert plan_of(out).count("(?=<)") == 1
    assert [(r.page_id, r.a) for r in rows.collect()] == [(1, "1")]
    assert [r.n_rows for r in profile.collect()] == [2]
    assert [r.name for r in blocks.collect()] == ["Apex House"]


def test_document_names_are_written_out_once(spark):
    text = "Organization | No\n1 | Apex Hosp. | MC-1234\nApex Care Pvt Ltd"
    docs = spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")
    out = extract.document_rows(docs)
    assert plan_of(out).count("^(Dr") == 2  # pipe rows, other lines
    assert sorted({r.method for r in out.collect()})


def test_neighbours_meet_in_blocks_and_are_never_broadcast(spark):
    ranks = [1, 2, 3, 9, 10, 11, 11, 20, 21, 31, None]
    ranked = spark.createDataFrame(list(enumerate(ranks)), "seq long, overall_rank long")
    out = rank.rank_neighbours(ranked, reach=10)
    want = sorted(
        (i, a, j, b) for i, a in enumerate(ranks) for j, b in enumerate(ranks) if a and b and 1 <= abs(a - b) <= 10
    )
    got = out.select("subject", "subject_rank", "neighbour", "neighbour_rank").collect()
    assert sorted(map(tuple, got)) == want
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
