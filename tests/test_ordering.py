"""Scale forms of ranks and running sums against plain windows."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritgrid.operators import ordering, rank


def scored(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [
        (i, f"Org {rng.randint(0, 9)} {i}", rng.choice([0.0, 0.0, 12.0, 12.5, 40.0, 77.25]) + rng.randint(0, 2), rng.randint(0, 3), "hot" if i % 3 else f"g{i % 5}")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "seq long, name string, total_score double, active_certs long, region string").repartition(7)


def test_global_rank_is_row_number(spark):
    df = scored(spark)
    placed = ordering.place(df, F.desc("total_score"), "seq")
    got = {r["seq"]: r["rank"] for r in ordering.global_rank(placed).collect()}
    w = Window.orderBy(F.desc("total_score"), "seq")
    want = {r["seq"]: r["rank"] for r in df.withColumn("rank", F.row_number().over(w)).collect()}
    assert got == want


def test_group_rank_with_a_hot_group(spark):
    df = scored(spark)
    placed = ordering.place(df, F.desc("total_score"), "seq")
    got = {r["seq"]: (r["r"], r["n"]) for r in ordering.group_rank(placed, ["region"], "r", "n").collect()}
    w = Window.partitionBy("region")
    want = {
        r["seq"]: (r["r"], r["n"])
        for r in df.withColumn("r", F.row_number().over(w.orderBy(F.desc("total_score"), "seq"))).withColumn("n", F.count("*").over(w)).collect()
    }
    assert got == want


def test_running_sum(spark):
    df = scored(spark)
    placed = ordering.place(df, "seq")
    got = {r["seq"]: r["s"] for r in ordering.running_sum(placed, "active_certs", "s").collect()}
    total = 0
    for r in df.orderBy("seq").collect():
        total += r["active_certs"]
        assert got[r["seq"]] == total


def test_unique_rank_is_a_permutation_and_ignores_partitioning(spark):
    df = scored(spark)
    rows = rank.unique_rank(df).select("seq", "overall_rank", "percentile").collect()
    assert sorted(r["overall_rank"] for r in rows) == list(range(1, 401))
    assert {r["percentile"] for r in rows if r["overall_rank"] == 1} == {100.0}
    again = rank.unique_rank(df.coalesce(1)).select("seq", "overall_rank", "percentile").collect()
    assert sorted(rows) == sorted(again)


def test_rank_of_a_single_row(spark):
    df = scored(spark, 1)
    assert [r["overall_rank"] for r in rank.unique_rank(df).collect()] == [1]
    assert rank.similar_performers(df).count() == 0
    assert rank.benchmark_window(df).count() == 0


def test_benchmark_window_by_hand(spark):
    rows = [(1, "a", 90.0), (2, "b", 80.0), (3, "c", 80.0), (4, "d", 70.0)]
    df = spark.createDataFrame(rows, "seq long, name string, total_score double")
    got = {(r["subject"], r["peer"]): (r["side"], r["rank_position"]) for r in rank.benchmark_window(df, 2).collect()}
    # the insertion point of an 80 is before the other 80: only the 90 is above
    assert got[(3, 1)] == ("above", 1)
    assert got[(3, 2)] == ("below", 2)
    assert got[(3, 4)] == ("below", 3)
    assert got[(4, 3)] == ("above", 3)
    assert got[(1, 2)] == ("below", 1)


def test_history_keeps_the_latest(spark):
    rows = [(1, f"2024-01-{d:02d}", d, d) for d in range(1, 20)]
    df = spark.createDataFrame(rows, "seq long, ts string, entry_id long, total_score long")
    old, new = df.filter("entry_id < 10"), df.filter("entry_id >= 10")
    kept = [r["entry_id"] for r in rank.append_history(old, new).collect()]
    assert sorted(kept) == list(range(8, 20))
    trend = rank.score_trend(df).collect()[0]
    assert (trend["direction"], trend["change"]) == ("up", 1)
