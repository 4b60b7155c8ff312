"""Near-equal names of one group, removed greedily, the worse one of every pair.

The rule is sequential: in the order of ``pos`` every row still there meets all later ones still there,
and of a near-equal pair the worse one goes (the earlier one if they are equally good stays); a row that
goes during its own turn finishes it. The first rows of every group settle in rounds of joins; those that
still act then meet the later rows, which leaves few for the next, longer part. Near pairs come from an
index of rare grams that rows of one group share, or, where few texts occur in many groups, that texts
share. No list of a group is built, and no table of all near pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritgrid.operators.match import char_similarity
from meritgrid.operators.search import SLACK, gram_tokens
from meritgrid.session import cut_lineage

LEAST = 0.8  # similarity from which unequal texts surely share a gram of two letters
FIRST_PART = 256  # rows of a group that settle first; every further part is twice as long
HALVINGS = 20  # a part is about 2 ** -k of a group's rows, for a k up to this



def _near(measure: str, threshold: float) -> Column:
    """Whether the texts ``a`` and ``b`` are more similar than ``threshold``."""
    a, b = F.col("a"), F.col("b")
    if measure == "blocks":
        return char_similarity(a, b) > threshold
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor(longest * (1 - threshold) + SLACK).cast("int")
    distance = F.call_function("levenshtein", a, b, most)  # -1 for more than that, without counting on
    return (distance >= 0) & (1 - distance / longest > threshold)


def _rare_grams(texts: DataFrame, threshold: float, measure: str) -> DataFrame:
    """``text, rare``: hashes of the rarest grams of every text, rarest first; two near texts share one."""
    size = F.length("text")
    if measure == "edits":
        shared = F.floor((2 * threshold - 1) * size - 1 - SLACK) + 1
    else:
        shared = F.floor((1.5 * threshold - 1) * size * (1 + threshold / (2 - threshold)) - 1 - SLACK) + 1
    keep = size - F.greatest(F.lit(1), shared)
    tokens = cut_lineage(gram_tokens(texts).select("text", "gram", "k"))
    often = tokens.groupBy("gram", "k").agg(F.count("*").alias("df"))
    order = Window.partitionBy("text").orderBy("df", "gram", "k")
    ranked = tokens.join(often, ["gram", "k"]).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep)
    listed = ranked.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("_r", F.hash("gram", "k").alias("g"))))["g"].alias("rare"))
    return listed.select("text", F.array_distinct("rare").alias("rare"))


def _sized(threshold: float, measure: str) -> Column:
    """Lengths of ``a`` and ``b`` that a near pair can have."""
    p, q = F.length("a"), F.length("b")
    other = 1.0 if measure == "edits" else 2 - threshold
    return F.least(p, q) * other >= F.greatest(p, q) * threshold - SLACK


@dataclass
class NearTexts:
    """The index of a table of names: near pairs of some of them with others.

    ``near(a, b)`` holds all near pairs of different texts if these were compared without their groups,
    else ``rare(text, rare)`` has the grams by which texts of one group meet.
    """

    threshold: float
    measure: str
    rare: DataFrame
    near: DataFrame | None

    @classmethod
    def of(cls, names: DataFrame, threshold: float, measure: str) -> NearTexts:
        """Texts are compared without their groups where they meet no more often than there are names."""
        if threshold < LEAST:
            raise ValueError(f"the gram index needs a similarity of {LEAST} or more")
        texts = cut_lineage(names.groupBy("text").agg(F.count("*").alias("n")))
        rare = cut_lineage(_rare_grams(texts.select("text"), threshold, measure))
        often = rare.select(F.explode("rare").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
        meetings = often.agg(F.sum(F.col("df") * F.col("df"))).first()[0] or 0
        index = cls(threshold, measure, rare, None)
        if meetings <= (texts.agg(F.sum("n")).first()[0] or 0):
            index.near = cut_lineage(index._met(rare, rare, []).select("a", "b"))
        return index

    def _met(self, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """Near pairs of ``left(text, rare, *on)`` and ``right``, each where its first common gram meets."""
        side = lambda df, name: df.select(
            *[c for c in df.columns if c not in ("text", "rare")], F.col("text").alias(name), F.col("rare").alias(f"rare_{name}"), F.explode("rare").alias("g")
        )
        first = F.get(F.array_intersect("rare_a", "rare_b"), F.lit(0))
        met = side(left, "a").join(side(right, "b"), [*on, "g"])
        met = met.filter((F.col("a") != F.col("b")) & _sized(self.threshold, self.measure)).filter(first == F.col("g"))
        return met.drop("g", "rare_a", "rare_b").filter(_near(self.measure, self.threshold))

    def pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """``group, a, b``: near pairs in a group of ``left(group, text)`` and ``right``; equal texts are near."""
        left, right = left.select("group", "text").distinct(), right.select("group", "text").distinct()
        same = left.join(right, ["group", "text"]).select("group", F.col("text").alias("a"), F.col("text").alias("b"))
        if self.near is None:
            met = self._met(left.join(self.rare, "text"), right.join(self.rare, "text"), ["group"])
        else:
            other = left.withColumnRenamed("text", "a").join(self.near, "a")
            met = other.join(right.withColumnRenamed("text", "b"), ["group", "b"])
        return met.select("group", "a", "b").unionByName(same)


    def with_partner(self, items: DataFrame) -> DataFrame:
        """Rows of ``items`` (``group, name``) that some other row may be near to; all where texts were not compared."""
        if self.near is None:
            return items
        texts = self.near.select(F.col("a").alias("name")).distinct()
        others = items.join(texts, "name", "left_anti")
        twins = others.groupBy("group", "name").agg(F.count("*").alias("n")).filter("n > 1").select("group", "name")
        alike = items.join(texts, "name", "left_semi").select(*items.columns)
        return cut_lineage(alike.unionByName(others.join(twins, ["group", "name"], "left_semi").select(*items.columns)))


def near_pairs(names: DataFrame, threshold: float = LEAST, measure: str = "blocks") -> DataFrame:
    """``group, a, b``: ordered pairs of texts of one group with a similarity above ``threshold``.

    ``names(group, text)``. ``measure`` is the share of matching blocks (``blocks``, which depends on
    the order of the two) or 1 - edit distance / longer length (``edits``); a text is near to itself.
    With m matching letters of lengths p and q at most 2 (p - m) + (q - m) grams of the first are lost,
    so more than (1.5 t - 1) (p + q) - 1 are shared, and one of them is among the rarest of both texts;
    lengths must be in the proportion t : 2 - t. At an edit distance d below (1 - t) times the longer length
    all but 2 d of its grams are shared, more than (2 t - 1) of that length less one; lengths are in the
    proportion t : 1. A hot group is spread by its grams.
    """
    names = cut_lineage(names.select("group", "text").distinct())
    return NearTexts.of(names, threshold, measure).pairs(names, names)


@dataclass
class Removed:
    """``rows(group, pos)`` that go, and the rounds it took."""

    rows: DataFrame
    rounds: int


def _part(open_: DataFrame, length: int) -> tuple[DataFrame, DataFrame | None]:
    """The first rows of every group, about ``length`` of a longer one, and the later rows if there are any.

    A part ends at a value of ``pos`` near the wanted place; which one does not change the result.
    """
    long_ = cut_lineage(open_.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > length))
    if long_.isEmpty():
        return open_, None
    shares = F.percentile_approx("pos", [2.0**-k for k in range(1, HALVINGS + 1)], 1 << 14)
    ends = open_.join(long_, "group").groupBy("group", "n").agg(shares.alias("ends"))
    wanted = F.least(F.lit(HALVINGS), F.ceil(F.log2(F.col("n") / length)).cast("int"))
    flagged = cut_lineage(open_.join(ends.select("group", F.element_at("ends", wanted).alias("last")), "group", "left"))
    now = F.col("last").isNull() | (F.col("pos") <= F.col("last"))
    return flagged.filter(now).drop("last"), flagged.filter(~now).drop("last")


def _edges(index: NearTexts, first: DataFrame, second: DataFrame) -> DataFrame:
    """``group, i, j, better``: near rows with i before j; ``better`` if the later one is."""
    text = lambda rows: rows.select("group", F.col("name").alias("text"))
    a = first.withColumnsRenamed({"pos": "i", "name": "a", "rank": "rank_i"})
    b = second.withColumnsRenamed({"pos": "j", "name": "b", "rank": "rank_j"})
    met = a.join(index.pairs(text(first), text(second)), ["group", "a"]).join(b, ["group", "b"]).filter("i < j")
    return cut_lineage(met.select("group", "i", "j", F.coalesce(F.col("rank_j") < F.col("rank_i"), F.lit(False)).alias("better")))


def _settled(edges: DataFrame) -> tuple[DataFrame, int]:
    """``group, i``: rows that an earlier one removes before their own turn, and the rounds it took."""
    removers = edges.filter("NOT better").select("group", "i", "j")
    open_, gone, rounds = removers, [edges.select("group", "i").limit(0)], 0
    while not open_.isEmpty():
        rounds += 1
        waiting = open_.select("group", F.col("j").alias("i")).distinct()
        fresh = cut_lineage(open_.join(waiting, ["group", "i"], "left_anti").select("group", F.col("j").alias("i")).distinct())
        gone.append(fresh)
        open_ = open_.join(fresh.withColumnRenamed("i", "j"), ["group", "j"], "left_anti")
        open_ = cut_lineage(open_.join(fresh, ["group", "i"], "left_anti"))
    return reduce(DataFrame.unionByName, gone), rounds


def greedy_removed(items: DataFrame, threshold: float = LEAST, measure: str = "blocks") -> Removed:
    """Rows of ``items(group, pos, name, rank)`` that go; a smaller ``rank`` is better, ``pos`` is unique.

    A row removes the later near ones that are not better, whether it goes in its own turn or not, but
    only if no earlier row removed it: those rows settle in rounds, each of which takes the rows without
    an open earlier remover. A row goes in its own turn if a better later one was still there then.
    Parts of the groups settle one after the other, the rows that an earlier part removed left out; a group
    is a single part up to ``FIRST_PART`` rows.
    Null and empty names are near to no other; an empty table removes nothing.
    """
    items = items.filter("name <> '' AND group IS NOT NULL AND pos IS NOT NULL").select("group", "pos", "name", "rank")
    open_ = cut_lineage(items)
    index = NearTexts.of(open_.select("group", F.col("name").alias("text")), threshold, measure)
    open_ = index.with_partner(open_)
    gone, rounds, length = [open_.select("group", "pos").limit(0)], 0, FIRST_PART
    while open_ is not None:
        part, later = _part(open_, length)
        edges = _edges(index, part, part)
        settled, took = _settled(edges)
        acting = edges.join(settled, ["group", "i"], "left_anti")
        if later is not None:
            actors = part.join(settled.withColumnRenamed("i", "pos"), ["group", "pos"], "left_anti")
            acting = acting.unionByName(_edges(index, cut_lineage(actors), later))
        met_by = cut_lineage(acting.filter("NOT better").groupBy("group", "j").agg(F.min("i").alias("by")))
        there = acting.filter("better").join(met_by, ["group", "j"], "left").filter("by IS NULL OR by > i")
        gone.append(cut_lineage(there.select("group", F.col("i").alias("pos")).union(met_by.select("group", "j")).distinct()))
        if later is not None:
            later = cut_lineage(later.join(met_by.select("group", F.col("j").alias("pos")), ["group", "pos"], "left_anti"))
        open_, rounds, length = later, rounds + took, length * 2
    return Removed(reduce(DataFrame.unionByName, gone).distinct(), rounds)
