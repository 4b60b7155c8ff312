"""Matches between the rows of one arriving batch, as if the rows came one after another.

A row that is similar to an earlier inserted row joins the first such row; any other row is inserted. Which
rows are inserted depends on the order, so they settle in rounds: a row is inserted once no earlier
similar row is open, and the open rows similar to it join. A round needs only the smallest order
among a row's open neighbours, which is an aggregation over what similar open rows share; neither all pairs
nor a list per key is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions import text
from meritgrid.functions.text import lower_name, words
from meritgrid.operators.containment import contained_pairs
from meritgrid.session import cut_lineage

FEWER = 4  # the edges are narrowed to the open rows whenever these are that many times fewer


def word_pairs(rows: DataFrame, min_length: int, *carry: str) -> DataFrame:
    """``pair, key, *carry``: every two words of ``min_length`` letters of a key."""
    long_words = F.filter(words("key"), lambda w: F.length(w) >= min_length)
    listed = rows.select("key", *carry, long_words.alias("_w")).select("*", F.posexplode("_w").alias("_i", "_a"))
    rest = F.slice("_w", F.col("_i") + 2, F.size("_w"))
    pairs = listed.select("key", *carry, "_a", F.explode(rest).alias("_b"))
    return pairs.select(F.concat_ws(" ", "_a", "_b").alias("pair"), "key", *carry)


@dataclass
class SimilarNames:
    """What ties the different keys of a batch: shared word pairs, and keys inside other keys.

    ``edges(a, b)``, both directions; the word pairs follow from a key alone. Keys of ``branded`` rows are
    tied to each other only, whatever their words are.
    """

    min_length: int
    edges: DataFrame

    def least(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        """``key, low``: smallest ``ord`` among those of ``others(key, ord)`` tied to a key of ``rows(key)``."""
        best = word_pairs(others, self.min_length, "ord").groupBy("pair").agg(F.min("ord").alias("ord"))
        by_pair = word_pairs(rows, self.min_length).join(best.hint("merge"), "pair").select("key", "ord")
        ends = others.select(F.col("key").alias("b"), "ord")
        by_part = self.edges.join(ends, "b").select(F.col("a").alias("key"), "ord")
        return by_pair.unionByName(by_part).groupBy("key").agg(F.min("ord").alias("low"))

    def among(self, rows: DataFrame) -> SimilarNames:
        """The ties between the keys of ``rows(key)`` only."""
        keys = rows.select("key").distinct()
        a, b = keys.withColumnRenamed("key", "a"), keys.withColumnRenamed("key", "b")
        edges = self.edges.join(a, "a", "left_semi").join(b, "b", "left_semi")
        return SimilarNames(self.min_length, cut_lineage(edges.select("a", "b")))


def similar_names(keys: DataFrame, min_length: int = 4) -> SimilarNames:
    """Ties of ``keys(key)``: two shared words of ``min_length`` letters, or one key inside the other."""
    found = contained_pairs(keys.select(F.col("key").alias("_whole")), keys).filter("_whole != key")
    found = cut_lineage(found.select(F.col("_whole").alias("a"), F.col("key").alias("b")))
    return SimilarNames(min_length, found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))))


@dataclass
class Settled:
    """``routes(seq, target_seq)``, equal for inserted rows, and the rounds it took."""

    routes: DataFrame
    rounds: int


def _before(rows: DataFrame, ties: SimilarNames, others: DataFrame) -> DataFrame:
    """``rows`` with ``low``: smallest order of a row of ``others`` they would join, null if none.

    A branded row joins branded rows only, any other row whatever is similar to its key.
    """
    first = others.filter("branded").agg(F.min("ord")).scalar()
    same = others.groupBy("key").agg(F.min("ord").alias("_same"))
    out = rows.join(ties.least(rows, others), "key", "left").join(same, "key", "left")
    low = F.when(F.col("branded"), first).otherwise(F.least("low", "_same"))
    return out.withColumn("low", low).drop("_same")


def in_batch(batch: DataFrame, brand: str | None = None, key: Column | None = None) -> Settled:
    """Where every row of ``batch(seq, name)`` goes when the rows arrive in the order of ``seq``.

    Names are similar when their laboratory keys are equal, one contains the other, or they share two
    words of four letters or more. With ``brand``, a row whose name holds it joins the first row that
    holds it too and nothing else; other rows may still join such a row by similarity.
    """
    named = lower_name("name")
    branded = F.contains(named, F.lit(brand)) if brand else F.lit(False)
    rows = batch.select("seq", (text.lab_key("name") if key is None else key).alias("key"), branded.alias("branded"))
    rows = cut_lineage(rows)
    nodes = rows.groupBy("key", "branded").agg(F.min("seq").alias("ord"))
    ties = similar_names(rows.select("key").distinct())
    open_, inserted, rounds = cut_lineage(nodes), None, 0
    near, narrowed = ties, open_.count()
    while n_open := open_.count():
        rounds += 1
        if n_open * FEWER <= narrowed:
            near, narrowed = near.among(open_), n_open
        seen = cut_lineage(_before(open_, near, open_))
        waits = F.coalesce(F.col("low") < F.col("ord"), F.lit(False))
        fresh = seen.filter(~waits).drop("low")
        inserted = fresh if inserted is None else inserted.unionByName(fresh)
        left = _before(seen.filter(waits).drop("low"), near, fresh)
        open_ = cut_lineage(left.filter(F.col("low").isNull() | (F.col("low") > F.col("ord"))).drop("low"))
    if inserted is None:
        return Settled(rows.select("seq", F.col("seq").alias("target_seq")), 0)
    placed = _before(nodes, ties, inserted)
    # a row that is inserted itself may have a later inserted neighbour, which it came before
    target = F.least("low", "ord")
    found = placed.select("key", "branded", target.alias("target_seq"))
    return Settled(rows.join(found, ["key", "branded"]).select("seq", "target_seq"), rounds)
