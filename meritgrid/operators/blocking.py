"""Exact name-matching joins without pairing names.

Every helper turns a fuzzy condition into equi-joins on derived keys and reduces the right side
to its best order value per key (with map-side combine) before joining. A key shared by a third
of all rows therefore reaches the join as one row.

``left(lid, key)`` and ``right(key, ord)``; extra equality columns go in ``on``. ``ord`` is any
orderable column, smaller is better: ``seq`` for first-in-file, ``struct(-score, seq)`` for best
score. Results are ``(lid, ord)`` with the smallest ``ord`` that satisfies the condition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.text import words
from meritgrid.operators.containment import contained_pairs

SHORT_SET = 12  # word sets up to this size use the subset join, longer ones the prefix join
Pairwise = Callable[[Column, Column], Column]


def best_of(*candidates: DataFrame) -> DataFrame:
    """Smallest order value per left row over several candidate sets."""
    union = candidates[0].select("lid", "ord")
    for more in candidates[1:]:
        union = union.unionByName(more.select("lid", "ord"))
    return union.groupBy("lid").agg(F.min("ord").alias("ord"))


def equal_key(left: DataFrame, right: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    keys = ["key", *on]
    first = right.groupBy(*keys).agg(F.min("ord").alias("ord"))
    return left.join(first, keys).select("lid", "ord")


def right_in_left(
    left: DataFrame, right: DataFrame, on: Sequence[str] = (), allowed: Pairwise | None = None
) -> DataFrame:
    """Right keys that occur inside the left key; ``allowed(part, whole)`` may restrict the pair."""
    subjects = left.select(F.col("key").alias("_whole"), *on).distinct()
    first = right.groupBy("key", *on).agg(F.min("ord").alias("ord"))
    pairs = contained_pairs(subjects, first.select("key", *on), on)
    if allowed is not None:
        pairs = pairs.filter(allowed(F.col("key"), F.col("_whole")))
    found = pairs.join(first, ["key", *on]).groupBy("_whole", *on).agg(F.min("ord").alias("ord"))
    return left.join(found.withColumnRenamed("_whole", "key"), ["key", *on]).select("lid", "ord")


def left_in_right(
    left: DataFrame, right: DataFrame, on: Sequence[str] = (), allowed: Pairwise | None = None
) -> DataFrame:
    """Right keys that contain the left key."""
    wholes = right.groupBy(F.col("key").alias("_whole"), *on).agg(F.min("ord").alias("ord"))
    pairs = contained_pairs(wholes.select("_whole", *on), left.select("key", *on).distinct(), on)
    if allowed is not None:
        pairs = pairs.filter(allowed(F.col("key"), F.col("_whole")))
    first = pairs.join(wholes, ["_whole", *on]).groupBy("key", *on).agg(F.min("ord").alias("ord"))
    return left.join(first, ["key", *on]).select("lid", "ord")


def either_contains(
    left: DataFrame, right: DataFrame, on: Sequence[str] = (), allowed: Pairwise | None = None
) -> DataFrame:
    return right_in_left(left, right, on, allowed).union(left_in_right(left, right, on, allowed))


def _with_words(df: DataFrame) -> DataFrame:
    return df.withColumn("_words", words("key")).withColumn("_n", F.size("_words"))


def _subsets(items: Column, n: Column, drop: Column) -> Column:
    """All sub-lists of the sorted words with at most ``drop`` words left out, as texts."""
    empty = F.array(F.array().cast("array<string>"))
    grow = lambda acc, i: F.filter(
        F.concat(acc, F.transform(acc, lambda s: F.array_append(s, F.element_at(items, i)))),
        lambda s: F.size(s) >= i - drop,
    )
    lists = F.aggregate(F.sequence(F.lit(1), n), empty, grow)
    return F.transform(lists, lambda s: F.struct(F.array_join(s, " ").alias("part"), F.size(s).alias("size")))


def _passes(score: Column, threshold: float, strict: bool) -> Column:
    return score > threshold if strict else score >= threshold


def word_jaccard(left: DataFrame, right: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """Candidates ``(lid, score, ord)`` whose best word-set Jaccard reaches the threshold.

    Two sets that similar share a subset of at least threshold times the larger size, so both
    sides are keyed by their large subsets. The right side keeps one row per (subset, set size);
    the score of a pair is then size / (n + m - size), largest for the full intersection.
    """
    subjects = _with_words(left.select("key").distinct()).filter("_n > 0")
    targets = _with_words(right.groupBy("key").agg(F.min("ord").alias("ord"))).filter("_n > 0")
    drop = F.floor(F.col("_n") * (1 - threshold) + 1e-9).cast("int")

    def keyed(df: DataFrame, *carry: str) -> DataFrame:
        part = F.explode(_subsets(F.col("_words"), F.col("_n"), drop)).alias("_s")
        rows = df.filter(F.col("_n") <= SHORT_SET).select(*carry, "_n", part)
        return rows.select(*carry, "_n", "_s.part", "_s.size").hint("merge")

    best = keyed(targets, "ord").groupBy("part", "size", F.col("_n").alias("_m")).agg(F.min("ord").alias("ord"))
    score = F.col("size") / (F.col("_n") + F.col("_m") - F.col("size"))
    short = keyed(subjects, "key").join(best, ["part", "size"]).withColumn("score", score).select("key", "score", "ord")
    both = short.union(_long_jaccard(subjects, targets, threshold))
    return (
        left.join(both.filter(_passes(F.col("score"), threshold, strict)), "key").select("lid", "score", "ord")
    )


def _long_jaccard(subjects: DataFrame, targets: DataFrame, threshold: float) -> DataFrame:
    """Pairs with a set longer than SHORT_SET: prefix filter on the rarest words, then check."""
    floor_size = int(SHORT_SET * threshold)
    subjects, targets = subjects.filter(F.col("_n") >= floor_size), targets.filter(F.col("_n") >= floor_size)
    counts = (
        subjects.select(F.explode("_words").alias("w"))
        .union(targets.select(F.explode("_words").alias("w")))
        .groupBy("w")
        .agg(F.count("*").alias("df"))
    )

    def prefixes(df: DataFrame, *carry: str) -> DataFrame:
        rows = df.select("key", "_words", "_n", *carry, F.explode("_words").alias("w")).join(counts, "w")
        ordered = rows.groupBy("key", "_words", "_n", *carry).agg(
            F.array_sort(F.collect_list(F.struct("df", "w"))).alias("_o")
        )
        keep = F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9).cast("int") + 1
        return ordered.select("key", "_words", "_n", *carry, F.explode(F.slice("_o", F.lit(1), keep)).alias("_p")).select(
            "key", "_words", "_n", *carry, F.col("_p.w").alias("w")
        )

    a = prefixes(subjects)
    b = prefixes(targets, "ord").select(F.col("_words").alias("_other"), F.col("_n").alias("_m"), "ord", "w").hint("merge")
    shared = F.size(F.array_intersect("_words", "_other"))
    long_pair = (F.col("_n") > SHORT_SET) | (F.col("_m") > SHORT_SET)
    sized = F.least("_n", "_m") >= F.greatest("_n", "_m") * threshold - 1e-9
    return (
        a.join(b, "w")
        .filter(long_pair & sized)
        .withColumn("score", shared / (F.col("_n") + F.col("_m") - shared))
        .select("key", "score", "ord")
    )


def two_shared_words(left: DataFrame, right: DataFrame, min_length: int = 4) -> DataFrame:
    """Right keys sharing at least two words of ``min_length`` letters, joined on word pairs."""
    long_words = F.filter(words("key"), lambda w: F.length(w) >= min_length)

    def pairs(df: DataFrame, *carry: str) -> DataFrame:
        rows = df.withColumn("_w", long_words)
        first = rows.select("key", *carry, "_w", F.posexplode("_w").alias("_i", "a"))
        rest = F.slice("_w", F.col("_i") + 2, F.size("_w"))
        return first.select("key", *carry, "a", F.explode(rest).alias("b")).hint("merge")

    first = pairs(right, "ord").groupBy("a", "b").agg(F.min("ord").alias("ord"))
    found = pairs(left.select("key").distinct()).join(first, ["a", "b"]).groupBy("key").agg(F.min("ord").alias("ord"))
    return left.join(found, "key").select("lid", "ord")
