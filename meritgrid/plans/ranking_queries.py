"""Queries over ranks, windows and score history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.exprs import num
from meritgrid.operators import rank
from meritgrid.plans.registry import Views, query
from meritgrid.plans.scoring_queries import scored_orgs


def score_table(v: Views) -> DataFrame:
    """One scored row per organisation, scores rounded once so that both engines see equal ties."""
    return scored_orgs(v).select(
        "seq", "name", "country", "region", "hospital_type",
        num("total_score").alias("total_score"),
        num("certification_score").alias("certification_score"),
        "active_certs",
    )


def ranked_table(v: Views) -> DataFrame:
    return rank.unique_rank(score_table(v))


@query("unique_rank")
def _unique_rank(v: Views) -> DataFrame:
    return ranked_table(v).select("seq", "overall_rank", num("percentile").alias("percentile"))


@query("live_rank")
def _live_rank(v: Views) -> DataFrame:
    return rank.live_rank(score_table(v)).select("seq", "live_rank", num("pct_live").alias("pct_live"))


@query("category_rank")
def _category_rank(v: Views) -> DataFrame:
    return rank.category_rank(score_table(v)).select("seq", "category_rank", num("pct_category").alias("pct_category"))


@query("regional_rank")
def _regional_rank(v: Views) -> DataFrame:
    return rank.regional_rank(score_table(v)).select(
        "seq", "region", "region_rank", "n_region", num("pct_region").alias("pct_region")
    )


@query("similar_performers")
def _similar(v: Views) -> DataFrame:
    return rank.similar_performers(score_table(v)).select(
        "subject", "peer", F.col("peer_no").cast("long"), num("peer_score").alias("peer_score")
    )


@query("benchmark_window")
def _benchmark(v: Views) -> DataFrame:
    return rank.benchmark_window(score_table(v)).select(
        "subject", "peer", "side", "rank_position", num("score_difference").alias("score_difference")
    )


@query("peer_averages")
def _peer_averages(v: Views) -> DataFrame:
    return rank.peer_averages(rank.benchmark_window(score_table(v))).select(
        "subject", num("gap_above").alias("gap_above"), num("gap_below").alias("gap_below")
    )


@query("rank_neighbours")
def _neighbours(v: Views) -> DataFrame:
    return rank.rank_neighbours(ranked_table(v)).select("subject", "neighbour", "neighbour_rank")


@query("detailed_percentiles")
def _detailed(v: Views) -> DataFrame:
    table = score_table(v).withColumn("accredited", F.col("active_certs") > 1)
    out = rank.detailed_percentiles(table)
    return out.select(
        "seq", "overall_rank", "country_rank", "type_rank", "accredited_rank", "tier", "tier_rank",
        *[num(f"{s}_pct").alias(f"{s}_pct") for s in ("overall", "country", "type", "accredited", "tier")],
    )


@query("performance_level")
def _performance_level(v: Views) -> DataFrame:
    table = score_table(v).withColumn("accredited", F.col("active_certs") > 1)
    out = rank.detailed_percentiles(table)
    return out.select("seq", "performance_level")


@query("top_per_scope")
def _top_per_scope(v: Views) -> DataFrame:
    return rank.top_per_scope(ranked_table(v)).select("scope", "scope_value", "seq", "overall_rank")


@query("percentile_peers")
def _percentile_peers(v: Views) -> DataFrame:
    return rank.percentile_peers(ranked_table(v)).select(
        "subject", "peer", F.col("peer_no").cast("long"), num("peer_pct").alias("peer_pct")
    )


@query("gap_to_best")
def _gap(v: Views) -> DataFrame:
    return rank.gap_to_best(score_table(v)).select("seq", num("gap").alias("gap"))


@query("history_latest")
def _history_latest(v: Views) -> DataFrame:
    past, fresh = v.history.filter("ts < '1997-01-01'"), v.history.filter("ts >= '1997-01-01'")
    return rank.append_history(past, fresh).select("seq", "entry_id", "total_score")


@query("score_trend")
def _score_trend(v: Views) -> DataFrame:
    return rank.score_trend(v.history).select("seq", "direction", "status", "change")


@query("rank_trend")
def _rank_trend(v: Views) -> DataFrame:
    return rank.rank_trend(v.history, "total_score").select("seq", "direction", "rank_change", "description")


@query("score_statistics")
def _score_statistics(v: Views) -> DataFrame:
    out = rank.score_statistics(score_table(v))
    return out.select("n", *[num(c).alias(c) for c in ("mean", "median", "std_dev", "lowest", "highest")])


@query("rank_check")
def _rank_check(v: Views) -> DataFrame:
    """Checks a damaged rank column: every seventh rank is shifted by one, the first one falls out."""
    damaged = ranked_table(v).withColumn(
        "overall_rank",
        F.when(F.col("overall_rank") % 7 == 1, F.col("overall_rank") - 1).otherwise(F.col("overall_rank")),
    )
    return rank.rank_check(damaged)


@query("rank_level_check")
def _level_check(v: Views) -> DataFrame:
    out = rank.level_check(ranked_table(v))
    return out.select(
        num("total_score").alias("total_score"), "n", "first_rank", "last_rank", num("low_pct").alias("low_pct"),
        num("high_pct").alias("high_pct"), "off_rows", "several_ranks",
    )
