"""Which texts occur inside which other texts, with one automaton for many searched texts.

A searched text (part) is dealt by its rarest gram, three letters that few of the texts to be read
(wholes) have; a whole goes to the buckets of the chosen grams that it holds. So the rows that cross the
network are linear in the length of the wholes. In a bucket the parts form an automaton that every whole
passes once. Buckets are divided into tiles of bounded size, on both sides. Parts shorter than a gram
are looked up among the one- and two-letter pieces of the wholes instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.session import cut_lineage

GRAM = 3
TOKENS = 1 << 31  # numbers of grams; a count times this stays a long
TILE = 20_000  # rows of one side that meet in a task


def _grams(text: str) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    cut = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(GRAM))))
    return F.when(F.length(text) >= GRAM, cut).otherwise(F.array().cast("array<string>"))


def _pieces(wholes: DataFrame, parts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Pairs of wholes and parts shorter than a gram; nothing is cut where there are none."""
    short = parts.filter(F.length("key") < GRAM)
    lengths = short.agg(F.array_sort(F.collect_set(F.length("key")))).scalar()  # at most 0, 1 and 2
    sized = wholes.withColumn("_len", F.explode(lengths)).filter(F.col("_len") <= F.length("_whole"))
    last = F.when(F.col("_len") == 0, 1).otherwise(F.length("_whole") - F.col("_len") + 1)
    starts = F.sequence(F.lit(1), last)
    cut = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("_whole"), i, F.col("_len"))))
    return sized.withColumn("key", F.explode(cut)).join(short, ["key", *on]).select("_whole", "key", *on)


def _search(on: Sequence[str]):
    names = ["_whole", "key", *on]

    def run(wholes: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        if wholes.empty or parts.empty:
            return pd.DataFrame(columns=names)
        rows = zip(*[wholes[c] for c in ["_whole", *on]])
        places: dict[str, set] = {}
        for key, *place in zip(*[parts[c] for c in ["key", *on]]):
            places.setdefault(key, set()).add(tuple(place))
        automaton = ahocorasick.Automaton()
        for key in places:
            automaton.add_word(key, key)
        automaton.make_automaton()
        found = []
        for whole, *place in rows:
            inside = {key for _, key in automaton.iter(whole)}
            found += [(whole, key, *place) for key in inside if tuple(place) in places[key]]
        return pd.DataFrame(found, columns=names)

    return run


def contained_pairs(wholes: DataFrame, parts: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """``_whole, key, *on``: every part ``key`` that occurs in a whole of the same ``on`` values.

    ``wholes(_whole, *on)`` and ``parts(key, *on)`` hold strings, each row once; the empty part occurs
    in every whole. Null texts and null ``on`` values pair with nothing.
    """
    spark = wholes.sparkSession
    on = list(on)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = wholes.select("_whole", *on, F.explode(_grams("_whole")).alias("gram"))
    # few rows, written so that Spark sees how small they are and need not shuffle the grams of the parts
    common = cut_lineage(read.groupBy("gram", *on).agg(F.count("*").alias("n")))
    asked = parts.select("key", *on, F.explode(_grams("key")).alias("gram"))
    rated = asked.join(common, ["gram", *on], "left")  # a gram that no whole has rules its part out
    # a number for each gram of a place: grams that share one only meet in vain
    token = F.pmod(F.xxhash64("gram", *on), F.lit(TOKENS))
    # count and token are one number, whose least value is found without sorting the rows of all grams
    rarest = rated.groupBy("key", *on).agg(F.min(F.coalesce("n", F.lit(0)) * TOKENS + token).alias("_r"))
    dealt = rarest.filter(F.col("_r") >= TOKENS).select("key", *on, F.pmod("_r", F.lit(TOKENS)).alias("token"))
    dealt = cut_lineage(dealt.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")))
    wanted = dealt.select("token", F.col("bucket").alias("bucket")).distinct()  # a column of its own
    read = read.select("_whole", *on, token.alias("token"))
    held = cut_lineage(read.join(wanted, "token").select("_whole", *on, "bucket").distinct())
    tiles = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    # one row for each bucket: bounded by the number of partitions
    sizes = F.broadcast(tiles(held, "_m").join(tiles(dealt, "_n"), "bucket"))
    own = lambda name, count: F.pmod(F.xxhash64(name), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = held.join(sizes, "bucket").select("_whole", *on, "bucket", own("_whole", "_m").alias("i"), every("_n").alias("j"))
    right = dealt.join(sizes, "bucket").select("key", *on, "bucket", every("_m").alias("i"), own("key", "_n").alias("j"))
    tile = ["bucket", "i", "j"]
    kind = ", ".join(f"{c} string" for c in ["_whole", "key", *on])
    pairs = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(_search(on), kind)
    return pairs.unionByName(_pieces(wholes, parts, on))
