"""Matches inside a batch against the loop over its rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from meritgrid.operators import batches, match

WORDS = ["apollo", "care", "eye", "north", "unit", "city", "lab", "of", "mayo clinic", "river", "hospital"]


def key_of(name):
    name = re.sub(r"\s*(laboratory|laboratories|lab|labs|inc|llc|ltd|pvt|private limited|corporation|corp)\s*", " ", (name or "").lower())
    return re.sub(r"\s+", " ", name).strip()


def similar(a, b):
    long = lambda t: {w for w in t.split() if len(w) > 3}
    return a in b or b in a or len(long(a) & long(b)) >= 2


def loop(rows, brand, held=()):
    """Where each (seq, name) goes, one after another: the first similar row of the growing table."""
    table, out = list(held), {}
    for seq, name in sorted(rows):
        if brand and brand in (name or "").lower():
            hits = [s for s, n in table if brand in (n or "").lower()]
        else:
            hits = [s for s, n in table if similar(key_of(name), key_of(n))]
        out[seq] = hits[0] if hits else seq
        if not hits:
            table.append((seq, name))
    return out


def names(rng, n, longest=4):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_five_hundred_batches_at_once_equal_the_loop(spark):
    """Each batch has words of its own, so that all of them can be settled as one table."""
    rng = random.Random(8)
    rows, want = [], {}
    for batch in range(500):
        vocabulary = [f"{w}{batch}x" for w in ("apollo", "care", "eyes", "north", "unit", "city")]
        size = rng.randint(1, 12)
        own = [(batch * 100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4)))) for i in range(size)]
        want |= loop(own, None)
        rows += own
    rng.shuffle(rows)
    settled = batches.in_batch(spark.createDataFrame(rows, "seq long, name string"))
    assert {r.seq: r.target_seq for r in settled.routes.collect()} == want
    assert 2 <= settled.rounds <= 12


@pytest.mark.parametrize("seed, brand", [(1, None), (2, "mayo clinic"), (3, "mayo clinic")])
def test_batches_equal_the_loop(spark, seed, brand):
    rng = random.Random(seed)
    rows = list(enumerate(names(rng, 60) + ["", None, "lab"][: seed - 1]))
    rng.shuffle(rows)
    settled = batches.in_batch(spark.createDataFrame([(i, n) for i, (_, n) in enumerate(rows)], "seq long, name string"), brand)
    assert {r.seq: r.target_seq for r in settled.routes.collect()} == loop([(i, n) for i, (_, n) in enumerate(rows)], brand)


def test_a_chain_takes_a_round_for_every_second_row(spark):
    """Row i shares two words with rows i - 1 and i + 1 only: inserted and joined rows alternate."""
    rows = [(i, f"wordy{i} wordx{i} wordy{i + 1} wordx{i + 1}") for i in range(12)]
    settled = batches.in_batch(spark.createDataFrame(rows, "seq long, name string"))
    assert {r.seq: r.target_seq for r in settled.routes.collect()} == {i: i - i % 2 for i in range(12)}
    assert settled.rounds == 6


def test_empty_batch_and_equal_names(spark):
    empty = spark.createDataFrame([], "seq long, name string")
    settled = batches.in_batch(empty)
    assert settled.routes.count() == 0 and settled.rounds == 0
    same = spark.range(500).select(F.col("id").alias("seq"), F.lit("Same Name").alias("name"))
    settled = batches.in_batch(same)
    assert {r.target_seq for r in settled.routes.collect()} == {0} and settled.rounds == 1


def test_base_match_of_a_brand(spark):
    base = spark.createDataFrame([(1, "River Care"), (2, "Mayo Clinic North"), (3, "Mayo Clinic")], "seq long, name string")
    rows = [(11, "Mayo Clinic Labs River Care"), (12, "River Care North"), (13, "nothing alike")]
    got = match.laboratory_match(spark.createDataFrame(rows, "seq long, name string"), base, "mayo clinic")
    assert {r.seq: r.match_seq for r in got.collect()} == {11: 2, 12: 1}


def test_later_rounds_read_the_edges_of_open_rows_only(spark, monkeypatch):
    """Forty names hold the first one and settle at once, a chain without such names takes six rounds."""
    read, least = [], batches.SimilarNames.least
    monkeypatch.setattr(batches.SimilarNames, "least", lambda self, *a: (read.append(self.edges.count()), least(self, *a))[1])
    rows = [(0, "core")] + [(i, f"core {i}zz") for i in range(1, 41)]
    rows += [(50 + i, f"wordy{i} wordx{i} wordy{i + 1} wordx{i + 1}") for i in range(12)]
    settled = batches.in_batch(spark.createDataFrame(rows, "seq long, name string"))
    assert {r.seq: r.target_seq for r in settled.routes.collect()} == loop(rows, None)
    assert settled.rounds == 6
    assert read[:2] == [80, 80] and set(read[2:-1]) == {0} and read[-1] == 80  # the last step places all names


@pytest.mark.parametrize("brand", [None, "mayo clinic"])
def test_batches_equal_the_loop_when_every_round_narrows(spark, monkeypatch, brand):
    monkeypatch.setattr(batches, "FEWER", 1)
    rng = random.Random(5)
    rows = list(enumerate(names(rng, 50, 6) + ["", None, "lab"]))
    settled = batches.in_batch(spark.createDataFrame(rows, "seq long, name string"), brand)
    assert {r.seq: r.target_seq for r in settled.routes.collect()} == loop(rows, brand)
