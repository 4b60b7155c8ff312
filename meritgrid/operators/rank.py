"""Rankings, percentiles, neighbours, peers and score history.

A scored table holds one row per organisation: ``seq, name, total_score`` and, where an operator
says so, ``active_certs, certification_score, country, region, hospital_type``. Neighbour and
peer lists are looked up by position in the sorted table, never by pairing all organisations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritgrid.functions.exprs import band
from meritgrid.operators.ordering import (
    first_rows,
    global_rank,
    group_rank,
    place,
    running_sum,
    unplaced,
)


BLOCK = 1_000_000


def unique_rank(scored: DataFrame) -> DataFrame:
    """Ranks 1..N by score, active certifications and lower-case name; seq settles full ties."""
    placed = place(scored, F.desc("total_score"), F.desc("active_certs"), F.lower("name"), "seq")
    ranked = unplaced(global_rank(placed, "overall_rank", "n_orgs"))
    return ranked.withColumn(
        "percentile", (F.col("n_orgs") - F.col("overall_rank") + 1) / F.col("n_orgs") * 100
    )


def by_score(scored: DataFrame) -> DataFrame:
    """Placed by score, best first, file order among equals."""
    return place(scored, F.desc("total_score"), "seq")


def live_rank(scored: DataFrame) -> DataFrame:
    """Rank of each organisation when it queues behind all others with its score or more."""
    ranked = unplaced(global_rank(by_score(scored), "_pos_rank", "n_orgs"))
    level = ranked.groupBy("total_score").agg(F.max("_pos_rank").alias("live_rank"))
    return (
        ranked.join(level, "total_score")
        .withColumn("pct_live", (F.col("n_orgs") - F.col("live_rank")) / F.col("n_orgs") * 100)
        .drop("_pos_rank")
    )


def category_rank(scored: DataFrame, score: str = "certification_score") -> DataFrame:
    """Rank as others minus lower-scoring others; percentile as their share."""
    placed = place(scored, F.col(score).desc(), "seq")
    ranked = unplaced(global_rank(placed, "_pos_rank", "n_orgs"))
    level = ranked.groupBy(score).agg(F.max("_pos_rank").alias("_last"))
    others = F.col("n_orgs") - 1
    lower = F.col("n_orgs") - F.col("_last")
    return (
        ranked.join(level, score)
        .withColumn("category_rank", others - lower)
        .withColumn("pct_category", F.when(others > 0, lower / others * 100))
        .drop("_pos_rank", "_last")
    )


def regional_rank(scored: DataFrame) -> DataFrame:
    """Higher scorers in the region plus one; organisations alone in their region are left out."""
    ranked = unplaced(group_rank(by_score(scored), ["region"], "_pos_rank", "n_region"))
    level = ranked.groupBy("region", "total_score").agg(F.min("_pos_rank").alias("region_rank"))
    share = (F.col("n_region") - F.col("region_rank") + 1) / F.col("n_region") * 100
    return (
        ranked.join(level, ["region", "total_score"])
        .filter("n_region > 1")
        .withColumn("pct_region", share)
        .drop("_pos_rank")
    )


def similar_performers(scored: DataFrame, width: float = 5.0, k: int = 10) -> DataFrame:
    """First k others, best first, whose score is within the width of the subject's score.

    Scores and differences are compared at nine decimals.
    """
    scored = scored.withColumn("total_score", F.round("total_score", 9))
    indexed = unplaced(global_rank(by_score(scored), "_idx"))
    levels = indexed.groupBy("total_score").agg(F.count("*").alias("_n"))
    points = levels.select(F.col("total_score").alias("_at"), F.lit(1).alias("_kind"), "_n", F.lit(None).cast("double").alias("_score"))
    probes = levels.select(
        F.round(F.col("total_score") + width, 9).alias("_at"), F.lit(0), F.lit(0).cast("long"), F.col("total_score")
    )
    # rows scoring above score + width come before the probe in the descending order
    ahead = running_sum(place(points.union(probes), F.desc("_at"), "_kind"), "_n", "_ahead")
    starts = ahead.filter("_kind = 0").select(F.col("_score").alias("total_score"), "_ahead")
    subject = indexed.join(starts, "total_score").select(
        F.col("seq").alias("subject"),
        F.col("total_score").alias("subject_score"),
        F.explode(F.sequence(F.col("_ahead") + 1, F.col("_ahead") + k + 1)).alias("_idx"),
    )
    peers = indexed.select("_idx", F.col("seq").alias("peer"), F.col("total_score").alias("peer_score"))
    near = subject.join(peers.hint("merge"), "_idx").filter(
        (F.col("peer") != F.col("subject")) & (F.round(F.abs(F.col("peer_score") - F.col("subject_score")), 9) <= width)
    )
    w = Window.partitionBy("subject").orderBy("_idx")
    return (
        near.withColumn("peer_no", F.row_number().over(w))
        .filter(F.col("peer_no") <= k)
        .drop("_idx")
    )


def benchmark_window(scored: DataFrame, reach: int = 20) -> DataFrame:
    """Others just above and below the subject's insertion point, with the score difference."""
    indexed = unplaced(global_rank(by_score(scored), "_idx"))
    level = indexed.groupBy("total_score").agg((F.min("_idx") - 1).alias("_p"))
    subject = indexed.join(level, "total_score").select(
        F.col("seq").alias("subject"),
        F.col("total_score").alias("subject_score"),
        F.col("_idx").alias("_self"),
        "_p",
        F.explode(F.sequence(F.col("_p") - reach, F.col("_p") + reach - 1)).alias("_i"),
    )
    # positions among the others: the subject itself is skipped
    subject = subject.withColumn("_idx", F.when(F.col("_i") + 1 < F.col("_self"), F.col("_i") + 1).otherwise(F.col("_i") + 2))
    peers = indexed.select("_idx", F.col("seq").alias("peer"), F.col("total_score").alias("peer_score"))
    return subject.filter("_i >= 0").join(peers.hint("merge"), "_idx").select(
        "subject",
        "peer",
        F.when(F.col("_i") < F.col("_p"), "above").otherwise("below").alias("side"),
        (F.col("_i") + 1).alias("rank_position"),
        (F.col("peer_score") - F.col("subject_score")).alias("score_difference"),
    )


def rank_neighbours(ranked: DataFrame, reach: int = 10) -> DataFrame:
    """Organisations up to ``reach`` places above and below by stored unique rank.

    Ranks meet in blocks of ``reach``: a subject in its own block, a peer in its own and the two beside it.
    """
    block = F.floor(F.col("overall_rank") / reach)
    subject = ranked.select(F.col("seq").alias("subject"), F.col("overall_rank").alias("subject_rank"), block.alias("_block"))
    peers = ranked.select(
        F.col("overall_rank").alias("neighbour_rank"),
        F.col("seq").alias("neighbour"),
        F.explode(F.array(block - 1, block, block + 1)).alias("_block"),
    )
    apart = F.abs(F.col("neighbour_rank") - F.col("subject_rank"))
    return subject.join(peers.hint("merge"), "_block").filter(apart.between(1, reach)).drop("_block")


TIERS = [(80, "Excellent (80-100)"), (60, "Good (60-79)"), (40, "Average (40-59)")]


def detailed_percentiles(scored: DataFrame) -> DataFrame:
    """Rank, size and percentile overall and inside country, type, accredited subset and tier.

    Expects ``country, hospital_type, accredited`` besides the score; one sort serves all scopes.
    """
    scoped = scored.withColumn("tier", band(F.col("total_score"), TIERS, "Below Average (<40)"))
    placed = global_rank(by_score(scoped), "overall_rank", "n_orgs")
    scopes = {"country": "country", "type": "hospital_type", "accredited": "accredited", "tier": "tier"}
    for scope, key in scopes.items():
        placed = group_rank(placed, [key], f"{scope}_rank", f"n_{scope}")
    out = unplaced(placed)
    for scope in ["overall", *scopes]:
        rank, n = F.col(f"{scope}_rank"), F.col("n_orgs" if scope == "overall" else f"n_{scope}")
        out = out.withColumn(f"{scope}_pct", (n - rank + 1) / n * 100)
    for column in ("accredited_rank", "n_accredited", "accredited_pct"):
        out = out.withColumn(column, F.when(F.col("accredited"), F.col(column)))
    return out.withColumn("performance_level", performance_level())


def performance_level() -> Column:
    rank, n = F.col("overall_rank"), F.col("n_orgs")
    return (
        F.when(rank <= F.floor(n * 0.1), "Top 10%")
        .when(rank <= F.floor(n * 0.25), "Top 25%")
        .when(F.col("overall_pct") >= 50, "Above Average")
        .otherwise("Below Average")
    )


def top_per_scope(ranked: DataFrame, overall: int = 5, country: int = 3, hospital_type: int = 3) -> DataFrame:
    """Best organisations overall, per country and per type; expects ``overall_rank``."""
    cols = ["seq", "total_score", "overall_rank"]
    best = ranked.filter(F.col("overall_rank") <= overall).select(
        F.lit("overall").alias("scope"), F.lit("all").alias("scope_value"), *cols
    )
    for key, k in (("country", country), ("hospital_type", hospital_type)):
        top = first_rows(ranked, [key], ["overall_rank"], k)
        best = best.union(top.select(F.lit(key), F.col(key), *cols))
    return best


def percentile_peers(ranked: DataFrame, width: float = 5.0, k: int = 10) -> DataFrame:
    """First k others, best first, within ``width`` percentile points of the subject."""
    pct = (F.col("n_orgs") - F.col("overall_rank") + 1) / F.col("n_orgs") * 100
    base = ranked.withColumn("_pct", pct)
    start = F.greatest(F.lit(1), F.ceil(F.col("overall_rank") - F.col("n_orgs") * (width / 100)) - 1)
    subject = base.select(
        F.col("seq").alias("subject"),
        F.col("_pct").alias("subject_pct"),
        F.explode(F.sequence(start, start + k + 2)).alias("_idx"),
    )
    peers = base.select(F.col("overall_rank").alias("_idx"), F.col("seq").alias("peer"), F.col("_pct").alias("peer_pct"))
    near = subject.join(peers.hint("merge"), "_idx").filter(
        (F.col("peer") != F.col("subject"))
        & F.col("peer_pct").between(F.col("subject_pct") - width, F.col("subject_pct") + width)
    )
    w = Window.partitionBy("subject").orderBy("_idx")
    return near.withColumn("peer_no", F.row_number().over(w)).filter(F.col("peer_no") <= k).drop("_idx")


def gap_to_best(scored: DataFrame) -> DataFrame:
    best = scored.agg(F.max("total_score")).scalar()
    return scored.withColumn("gap", best - F.col("total_score"))


def peer_averages(window: DataFrame) -> DataFrame:
    """Mean score of the peers above and below and the gaps to them, from ``benchmark_window``."""
    diff = F.col("score_difference")
    return window.groupBy("subject").agg(
        F.avg(F.when(F.col("side") == "above", diff)).alias("gap_above"),
        F.avg(F.when(F.col("side") == "below", diff)).alias("gap_below"),
    )


# --- history -------------------------------------------------------------------------------


def append_history(history: DataFrame, new_entries: DataFrame, keep: int = 12) -> DataFrame:
    """History plus new entries, the latest ``keep`` per organisation."""
    return latest_entries(history.unionByName(new_entries), keep)


def latest_entries(history: DataFrame, keep: int = 12) -> DataFrame:
    return first_rows(history, ["seq"], [F.desc("ts"), F.desc("entry_id")], keep)


def last_two(history: DataFrame, value: str) -> DataFrame:
    """Latest and previous value per organisation that has at least two entries."""
    w = Window.partitionBy("seq").orderBy(F.desc("ts"), F.desc("entry_id"))
    pair = history.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
    return (
        pair.groupBy("seq")
        .agg(
            F.max(F.when(F.col("_rn") == 1, F.col(value))).alias("latest"),
            F.max(F.when(F.col("_rn") == 2, F.col(value))).alias("previous"),
            F.count("*").alias("_n"),
        )
        .filter("_n = 2")
        .drop("_n")
    )


def _direction(change: Column) -> list[Column]:
    direction = F.when(change > 0, "up").when(change < 0, "down").otherwise("stable")
    status = F.when(change > 0, "improving").when(change < 0, "declining").otherwise("stable")
    return [direction.alias("direction"), status.alias("status")]


def score_trend(history: DataFrame, value: str = "total_score") -> DataFrame:
    change = F.col("latest") - F.col("previous")
    return last_two(history, value).select("seq", *_direction(change), F.abs(change).alias("change"))


def rank_trend(history: DataFrame, rank: str = "overall_rank") -> DataFrame:
    """Rank trend: a smaller rank number is an improvement."""
    change = F.col("previous") - F.col("latest")
    text = (
        F.when(change > 0, F.format_string("Moved up %d positions", change.cast("long")))
        .when(change < 0, F.format_string("Dropped %d positions", F.abs(change).cast("long")))
        .otherwise("Maintained position")
    )
    return last_two(history, rank).select(
        "seq", *_direction(change), F.abs(change).alias("rank_change"), text.alias("description")
    )


# --- statistics over scored tables ---------------------------------------------------------


def score_statistics(scored: DataFrame) -> DataFrame:
    """Mean, upper median, population deviation, minimum and maximum of the score."""
    ranked = unplaced(global_rank(place(scored.select("total_score", "seq"), "total_score", "seq"), "_idx", "_n"))
    middle = F.floor(F.col("_n") / 2) + 1
    return ranked.agg(
        F.count("*").alias("n"),
        F.avg("total_score").alias("mean"),
        F.max(F.when(F.col("_idx") == middle, F.col("total_score"))).alias("median"),
        F.stddev_pop("total_score").alias("std_dev"),
        F.min("total_score").alias("lowest"),
        F.max("total_score").alias("highest"),
    )


def rank_check(ranked: DataFrame, rank: str = "overall_rank") -> DataFrame:
    """One row per finding: a duplicate, missing or extra rank, and one summary row."""
    per_rank = ranked.groupBy(F.col(rank).alias("rank_value")).agg(F.count("*").alias("n"))
    n_orgs = ranked.agg(F.count("*")).scalar()
    # expected ranks in blocks of a million per row, so no single row holds all of them
    blocks = ranked.agg(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.count("*") / BLOCK))).alias("_b"))
    expected = blocks.select(
        F.explode(F.sequence(F.col("_b") * BLOCK + 1, (F.col("_b") + 1) * BLOCK)).alias("rank_value")
    ).filter(F.col("rank_value") <= n_orgs)
    duplicates = per_rank.filter("n > 1").select(F.lit("duplicate").alias("finding"), "rank_value", "n")
    missing = expected.join(per_rank, "rank_value", "left_anti").select(F.lit("missing"), "rank_value", F.lit(0).cast("long"))
    extra = (
        per_rank.filter((F.col("rank_value") < 1) | (F.col("rank_value") > n_orgs))
        .select(F.lit("extra"), "rank_value", "n")
    )
    summary = per_rank.agg(F.sum("n").alias("rank_value"), F.count("*").alias("n")).select(
        F.lit("summary"), "rank_value", "n"
    )
    return duplicates.union(missing).union(extra).union(summary)


def level_check(ranked: DataFrame) -> DataFrame:
    """Per score level: size, rank span, percentile span and rows whose percentile is off."""
    expected = (F.col("n_orgs") - F.col("overall_rank") + 1) / F.col("n_orgs") * 100
    off = F.abs(F.col("percentile") - expected) >= 0.01
    return ranked.groupBy("total_score").agg(
        F.count("*").alias("n"),
        F.min("overall_rank").alias("first_rank"),
        F.max("overall_rank").alias("last_rank"),
        F.min("percentile").alias("low_pct"),
        F.max("percentile").alias("high_pct"),
        F.sum(F.when(off, 1).otherwise(0)).alias("off_rows"),
    ).withColumn("several_ranks", (F.col("last_rank") > F.col("first_rank")).cast("int"))
