"""Quality rules whose thresholds come from mergeable quantile sketches.

A KLL sketch of every signal is built per language and source and merged upwards per language and
for all rows. Fences follow from the quartiles of a document's own group, or of the next larger one
where the group is small; documents are joined to their fences and filtered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.llm.common import small_batches, stored

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
LEAST_WORDS = 20

SIGNALS = (
    "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, n_lines long"
)

#: Signal: (its value, least distance of a fence from the median, fences below and above).
RULES = {
    "word_length": ("word_chars / n_words", 2.5, True),
    "symbol_share": ("n_symbols / word_chars", 0.1, False),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", 0.3, False),
    "repeat_share": ("n_repeat_words / n_words", 0.2, False),
}
REACH = 3.0
LEAST_GROUP = 100


def _exact_repeats(ids: np.ndarray) -> int:
    """Words in windows that occur twice or more, by ranks of windows of 2, 4 and 8 words."""
    ranks, width = ids, 1
    while width < WINDOW:
        pairs = ranks[:-width] * (int(ranks.max()) + 1) + ranks[width:]
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width *= 2
    twice = np.bincount(ranks)[ranks] > 1
    covered = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def repeated_words(words: list) -> int:
    """Number of words inside 8-word windows found twice or more, first ones included."""
    if len(words) < WINDOW + 1:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    n = len(ids) - WINDOW + 1
    windows = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        windows = windows * np.uint64(0xD1342543DE82EF95) + mixed[i : i + n]
    windows.sort()
    if not (windows[1:] == windows[:-1]).any():  # equal windows would have equal hashes
        return 0
    return _exact_repeats(ids)


def text_signals(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()  # bytes split at the six ASCII spaces only
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def _signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in SIGNALS.split(", ")]
    for batch in small_batches(batches):
        values = zip(*map(text_signals, batch.column("text").to_pylist()))
        counts = [pa.array(column, pa.int64()) for column in values]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names[:3]), *counts], names=names)


def signals(docs: DataFrame) -> DataFrame:
    """Signals of every document: doc_id, lang, source and six counts (see ``quality_rules``)."""
    for name in ("lang", "source"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))
    plain = docs.select(
        "doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string")
    )
    return plain.mapInArrow(_signals, SIGNALS)


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 30 * n_words")


def fences(measured: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """Low and high fence of every rule for each (lang, source) of ``measured``.

    Sketches cover all documents that pass the base rules, so that junk does not move the fences.
    """
    sound = measured.where(~base_failed())
    leaf = sound.groupBy("lang", "source").agg(
        F.count("*").alias("n"),
        *[
            F.kll_sketch_agg_double(F.expr(value).cast("double")).alias(name)
            for name, (value, _, _) in RULES.items()
        ],
    )
    leaf = stored(leaf, "quality-sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(r).alias(r) for r in RULES]]
    by_lang, overall = leaf.groupBy("lang").agg(*merged), leaf.agg(*merged)

    def bounds(sketches: DataFrame, by: list[str]) -> DataFrame:
        columns = []
        for name, (_, least, both) in RULES.items():
            low, middle, high = (
                F.kll_sketch_get_quantile_double(name, F.lit(q)) for q in (0.25, 0.5, 0.75)
            )
            spread = REACH * (high - low)
            above = F.greatest(high + spread, middle + least)
            below = F.least(low - spread, middle - least) if both else F.lit(float("-inf"))
            columns.append(F.struct(below.alias("low"), above.alias("high")).alias(name))
        return sketches.select(*by, "n", *columns)

    groups = measured.select("lang", "source").distinct().alias("g")
    b = bounds(leaf, ["lang", "source"]).alias("b")
    c = bounds(by_lang, ["lang"]).alias("c")
    whole = bounds(overall.where("n IS NOT NULL"), []).alias("d")
    own = groups.join(
        b,
        F.col("g.lang").eqNullSafe(F.col("b.lang"))
        & F.col("g.source").eqNullSafe(F.col("b.source")),
        "left",
    ).join(c, F.col("g.lang").eqNullSafe(F.col("c.lang")), "left")
    own = own.join(F.broadcast(whole), F.lit(True), "left")  # one row
    picked = []
    for name in RULES:
        value = F.when(F.col("b.n") >= least_group, F.col(f"b.{name}"))
        value = value.when(F.col("c.n") >= least_group, F.col(f"c.{name}"))
        picked.append(value.otherwise(F.col(f"d.{name}")).alias(name))
    return own.select("g.lang", "g.source", *picked)


def quality_rules(docs: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """Signals and verdict of every document: doc_id, text, lang, source (the last two optional).

    Words are runs of anything but the six ASCII spaces. A document fails the base rules with fewer
    than 20 words or over 30 % of its words in repeated 8-word windows; it is kept if it passes them
    and every rule's value lies within the fences of its language and source. Fences stand three
    quartile distances outside the quartiles, and never nearer to the median than the rule's least
    distance, so even groups lose nothing. Groups under ``least_group`` sound documents take the
    fences of their language, or of all. A null text has no words; null languages and sources form
    groups of their own; repeated rows are judged each; an empty table gives an empty result.
    """
    measured = stored(signals(docs), "quality-signals")
    s, f = measured.alias("s"), stored(fences(measured, least_group), "quality-fences").alias("f")
    joined = s.join(
        f,
        F.col("s.lang").eqNullSafe(F.col("f.lang"))
        & F.col("s.source").eqNullSafe(F.col("f.source")),
        "left",
    )
    inside = F.lit(True)
    for name, (value, _, _) in RULES.items():
        measure = F.expr(value).cast("double")
        inside &= F.coalesce(
            measure.between(F.col(f"f.{name}.low"), F.col(f"f.{name}.high")), F.lit(True)
        )
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        F.when(base_failed(), False).otherwise(inside).alias("kept"),
        "n_lines",
    )
