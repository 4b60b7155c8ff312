"""Mixing sources to target weights by a time-varying curriculum, with DataFrame operations only.

Every source has a target in words and a schedule, its weight at points of training time with straight
lines between. The integral of the schedule is the source's cumulative demand. A document's words stand
at a known point of their source's stream, so inverting the demand gives the training time at which they
are due; sorting all documents by that time by ranges gives the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.llm.common import stored
from meritgrid.llm.places import numbered, with_row

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3  # times that a source may be repeated
SEED = 12
#: Weight at points of training time, for the sources of each weight: the heavier come later.
SCHEDULES = (
    ((0.0, 3.0), (0.5, 2.0), (1.0, 1.0)),
    ((0.0, 1.0), (0.5, 2.0), (1.0, 1.0)),
    ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)),
)

Schedule = Sequence[tuple[float, float]]


def demand(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """Segments of a schedule scaled to an integral of 1: begin, weight there, slope, demand before."""
    area = sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(schedule, schedule[1:]))
    out, before = [], 0.0
    for (a, v), (b, w) in zip(schedule, schedule[1:]):
        out.append((a, v / area, (w - v) / area / (b - a), before))
        before += (b - a) * (v + w) / 2 / area
    return out


def due(share: Column, schedule: Schedule) -> Column:
    """Training time at which ``share`` of a source's demand is met: the inverse of the integral."""
    out = None
    for begin, weight, slope, before in demand(schedule):
        rest = share - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(weight * weight) + F.lit(2 * slope) * rest))
        time = F.lit(begin) + F.coalesce(F.try_divide(F.lit(2.0) * rest, F.lit(weight) + root), F.lit(0.0))
        out = time if out is None else F.when(share >= F.lit(before), time).otherwise(out)
    return out


def fill_level(sources: DataFrame, total: int, most: int) -> float:
    """Words for a unit of weight when no source gets over ``most`` times its words.

    Each round sets the sources that are above to their limit and shares the rest by weight among
    the others, until none is above. The driver sees two sums a round.
    """
    level, full = 0.0, -1
    limit = F.col("source_size") * most
    while True:
        above = limit < F.lit(level) * F.col("weight")
        sums = sources.agg(
            F.sum(F.when(above, limit).otherwise(0)).alias("held"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights"),
            F.count(F.when(above, 1)).alias("full"),
        ).first()
        if not sums.weights or sums.full == full:
            return level
        full, level = sums.full, (total - sums.held) / sums.weights


def source_targets(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """source_key, source_size, weight, target and quota (the target in whole words) of every source."""
    sums = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    listed = numbered(sums.withColumn("all", F.lit(0)), "all", ["source_key"])
    turn = (F.col("place") % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    sources = stored(listed.select("source_key", "source_size", turn.alias("turn"), weight.alias("weight")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = fill_level(sources, total, most)
    target = F.least((F.col("source_size") * most).cast("double"), F.lit(level) * F.col("weight"))
    sources = sources.withColumn("target", target)
    return stored(sources.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long")), "targets")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    schedules: Sequence[Schedule] = SCHEDULES,
    seed: int = SEED,
) -> DataFrame:
    """What the mix takes of every document, and when in training.

    Sources in the order of their bytes, null last, have ``weights`` in turn and ``schedules`` in
    turn. Targets share all words by weight; none is over ``most`` times its source's words. In a
    source documents follow the hash of seed and id, as often as the target asks; the last one is
    taken in part. Returns doc_id, size (words), source_size, target, row_id and ``uses``, an array of
    epoch, words and time, empty for documents that the mix leaves out.

    A null or empty text has no words and no use; null sources are one source, null ids are documents
    like others, rows equal in id and size may change places; an empty table gives an empty result;
    other columns play no part.
    """
    source = F.col("source").cast("string")
    sized = docs.select(
        "doc_id",
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("turn_key"),
    )
    sized = with_row(sized, "mix-sizes")
    placed = numbered(sized, "source_key", ["turn_key", "size", "row_id"], value="size")
    sources = source_targets(sized, weights, most)
    joined = placed.join(sources, "source_key")
    uses = []
    for epoch in range(most):
        start = F.col("before") + F.lit(epoch) * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("quota") - start))
        share = (start + words / F.lit(2.0)) / F.nullif("quota", F.lit(0))
        time = None
        for turn in range(len(weights)):
            at = due(share, schedules[turn % len(schedules)])
            time = at if time is None else F.when(F.col("turn") == turn, at).otherwise(time)
        uses.append(F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), time.alias("time")))
    mixed = joined.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "source_key",
        "turn_key",
        "row_id",
        F.filter(F.array(*uses), lambda u: u["words"] > 0).alias("uses"),
    )
    return stored(mixed, "mix-uses")


def training_order(mixed: DataFrame) -> DataFrame:
    """Every use of a document in the order of its training time: place and start_word from 0.

    Uses due at the same time follow source, epoch, the hash of the id, size and row.
    """
    uses = mixed.select("doc_id", "source_key", "turn_key", "size", "row_id", F.inline("uses"))
    uses = uses.withColumn("all", F.lit(0))
    order = ["time", "source_key", "epoch", "turn_key", "size", "row_id"]
    ordered = numbered(uses, "all", order, value="words")
    return ordered.select(
        "doc_id", "row_id", "epoch", "words", "time", "place", F.col("before").alias("start_word")
    )
