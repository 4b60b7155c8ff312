"""Review summaries: ratings, sentiment, half-split trend, confidence and score.

Reviews are long rows ``seq, event_id, platform, rating, sentiment, ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.exprs import band, lookup
from meritgrid.operators.ordering import group_rank, place, unplaced

# Points per review-volume band and per trend.
VOLUME_BANDS = [(100, 4.0), (50, 3.0), (20, 2.0), (10, 1.0)]
TREND_POINTS = {"improving": 2.0, "stable": 1.0, "declining": 0.0}
TREND_SHIFT = {"improving": 0.1, "stable": 0.0, "declining": -0.1}


EXACT = "decimal(28,12)"  # sums that feed bands and roundings must not depend on their order


def exact_sum(value: Column) -> Column:
    return F.sum(value.cast(EXACT)).cast("double")


def _exact_mean(value: Column) -> Column:
    return exact_sum(value) / F.nullif(F.count(value), F.lit(0))


def half_split_trend(reviews: DataFrame) -> DataFrame:
    """Later half minus earlier half of the mean sentiment, by time; under four rows is stable."""
    placed = place(reviews.select("seq", "ts", "event_id", "sentiment"), "ts", "event_id")
    ordered = unplaced(group_rank(placed, ["seq"], "_i", "_n"))
    later = F.col("_i") > F.floor(F.col("_n") / 2)
    halves = ordered.groupBy("seq").agg(
        F.count("*").alias("n_reviews"),
        _exact_mean(F.when(later, F.col("sentiment"))).alias("recent_sentiment"),
        _exact_mean(F.when(~later, F.col("sentiment"))).alias("older_sentiment"),
    )
    shift = F.col("recent_sentiment") - F.col("older_sentiment")
    return halves.withColumn(
        "trend",
        F.when(F.col("n_reviews") < 4, "stable")
        .when(shift > 0.1, "improving")
        .when(shift < -0.1, "declining")
        .otherwise("stable"),
    )


def age_in_days(ts: Column, as_of: str) -> Column:
    """Whole days from the time to ``as_of``."""
    now = F.lit(as_of).cast("timestamp")
    return F.floor((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000))


def platform_counts(reviews: DataFrame, as_of: str) -> DataFrame:
    """Per organisation and platform; the shared first level of every review figure."""
    recent = age_in_days(F.col("ts").cast("timestamp"), as_of) <= 90
    return reviews.groupBy("seq", "platform").agg(
        F.count("*").alias("n"),
        F.count("rating").alias("n_rated"),
        F.sum(F.col("rating").cast(EXACT)).alias("sum_rating"),
        F.sum(F.col("sentiment").cast(EXACT)).alias("sum_sentiment"),
        F.sum(F.when(recent, 1).otherwise(0)).alias("n_recent"),
    )


def review_summary(orgs: DataFrame, reviews: DataFrame, as_of: str) -> DataFrame:
    """Counts, means, platform breakdown, trend and confidence; zeros and stable without reviews."""
    by_platform = platform_counts(reviews, as_of)
    entry = F.concat(F.col("platform"), F.lit("="), F.col("n").cast("string"))
    totals = by_platform.groupBy("seq").agg(
        F.sum("n").alias("n_reviews"),
        F.count("*").alias("n_platforms"),
        F.sum("n_recent").alias("n_recent"),
        (F.sum("sum_rating").cast("double") / F.nullif(F.sum("n_rated"), F.lit(0))).alias("avg_rating"),
        (F.sum("sum_sentiment").cast("double") / F.sum("n")).alias("sentiment"),
        F.array_join(F.array_sort(F.collect_list(entry)), ";").alias("platforms"),
    )
    trend = half_split_trend(reviews).select("seq", "trend")
    joined = orgs.select("seq").join(totals, "seq", "left").join(trend, "seq", "left")
    filled = joined.fillna(0, subset=["n_reviews", "n_platforms", "n_recent"]).fillna(
        0.0, subset=["avg_rating", "sentiment"]
    ).fillna({"platforms": "", "trend": "stable"})
    return filled.withColumn("confidence", review_confidence()).withColumn(
        "trend_shift", lookup("trend", TREND_SHIFT, 0.0)
    )


def review_confidence() -> Column:
    """0.4 volume + 0.4 recent share + 0.2 platform variety."""
    n = F.col("n_reviews")
    value = (
        F.least(n / 50.0, F.lit(1.0)) * 0.4
        + F.col("n_recent") / F.nullif(n, F.lit(0)) * 0.4
        + F.least(F.col("n_platforms") / 3.0, F.lit(1.0)) * 0.2
    )
    return F.when(n > 0, F.least(value, F.lit(1.0))).otherwise(0.0)


def review_score(summary: DataFrame) -> DataFrame:
    """0-15 points: volume, sentiment, rating and trend, times confidence."""
    volume = band(F.col("n_reviews"), VOLUME_BANDS, 0.5)
    sentiment = F.greatest(F.lit(0.0), (F.col("sentiment") + 1) * 2.5)
    rating = F.when(F.col("avg_rating") > 0, F.col("avg_rating") / 5.0 * 4.0).otherwise(sentiment * 0.8)
    trend = lookup("trend", TREND_POINTS, 1.0)
    some = F.col("n_reviews") > 0
    points = {
        "volume_points": volume,
        "sentiment_points": sentiment,
        "rating_points": rating,
        "trend_points": trend,
    }
    out = summary
    for name, value in points.items():
        out = out.withColumn(name, F.when(some, value).otherwise(0.0))
    base = sum((F.col(p) for p in points), F.lit(0.0))
    return out.withColumn("review_score", F.least(base * F.col("confidence"), F.lit(15.0)))
