"""Greedy removal of near-equal names against the plain loop."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from meritgrid.operators import near_names


def edit_ratio(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b), 1)


RATIOS = {"edits": edit_ratio, "blocks": lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()}


def plain_loop(rows, ratio):
    """Rows that go, for each group in the order of pos."""
    gone = set()
    for group in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == group and r[2]), key=lambda r: r[1])
        out = set()
        for i, (_, pos, name, rank) in enumerate(own):
            if pos in out:
                continue
            for _, later, other, other_rank in own[i + 1 :]:
                if later not in out and ratio(name, other) > 0.8:
                    out.add(pos if other_rank < rank else later)
        gone |= {(group, p) for p in out}
    return gone


def random_rows(seed, groups=40):
    rng = random.Random(seed)
    stems = ["iso 9001", "green seal award", "abc", "abcd", "hand care badge of honour", "x", "ab", "aaaaaaaa", "joint board é"]
    rows = []
    for g in range(groups):
        for pos in range(rng.randrange(0, 14)):
            name = rng.choice(stems)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(name) + 1)
                name = rng.choice([name[:at] + name[at + 1 :], name[:at] + rng.choice("abs 0") + name[at:]])
            rows.append((f"g{g}", pos, name, rng.randrange(3)))
    return rows


@pytest.mark.parametrize("measure", ["edits", "blocks"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removal_equals_the_plain_loop(spark, measure, seed):
    rows = random_rows(seed)
    table = spark.createDataFrame(rows, "group string, pos long, name string, rank int")
    found = near_names.greedy_removed(table, measure=measure)
    assert {(r.group, r.pos) for r in found.rows.collect()} == plain_loop(rows, RATIOS[measure])
    assert 1 <= found.rounds <= 14


@pytest.mark.parametrize("measure", ["edits", "blocks"])
def test_near_pairs_equal_all_pairs(spark, measure):
    names = sorted({r[2] for r in random_rows(9, groups=25)} - {""})
    pairs = near_names.near_pairs(spark.createDataFrame([(1, n) for n in names] + [(2, "x y z")], "group int, text string"), 0.85, measure)
    want = {(a, b) for a in names for b in names if RATIOS[measure](a, b) > 0.85}
    assert {(r.a, r.b) for r in pairs.filter("group = 1").collect()} == want and pairs.filter("group = 2").count() == 1
    with pytest.raises(ValueError):
        near_names.near_pairs(pairs.select("group", F.col("a").alias("text")), 0.5)


def test_a_row_that_goes_finishes_its_turn_and_a_chain_settles_in_rounds(spark):
    kind = "group string, pos long, name string, rank int"
    turn = [("a", 0, "seal award", 2), ("a", 1, "seal awards", 1), ("a", 2, "seal awardz", 2), ("b", 0, None, 1), (None, 0, "seal award", 1), ("c", 0, "", 1), ("c", 1, "", 1)]
    found = near_names.greedy_removed(spark.createDataFrame(turn, kind), measure="edits")
    assert {(r.group, r.pos) for r in found.rows.collect()} == {("a", 0), ("a", 2)}
    chain = [("a", i, "a" * (30 - i) + "b" * i, 0) for i in range(20)]
    found = near_names.greedy_removed(spark.createDataFrame(chain, kind), measure="edits")
    assert {r.pos for r in found.rows.collect()} == {p for _, p in plain_loop(chain, edit_ratio)} and found.rounds > 1
    empty = near_names.greedy_removed(spark.createDataFrame([], kind))
    assert empty.rows.count() == 0 and empty.rounds == 0


@pytest.mark.parametrize("measure", ["edits", "blocks"])
@pytest.mark.parametrize("first_part", [3])
def test_long_groups_settle_in_parts(spark, measure, first_part, monkeypatch):
    monkeypatch.setattr(near_names, "FIRST_PART", first_part)
    rows = random_rows(5, groups=12) + [("long", pos, name, rank) for pos, (_, _, name, rank) in enumerate(random_rows(6, groups=8))]
    table = spark.createDataFrame(rows, "group string, pos long, name string, rank int")
    found = near_names.greedy_removed(table, measure=measure)
    assert {(r.group, r.pos) for r in found.rows.collect()} == plain_loop(rows, RATIOS[measure])


def test_a_group_of_alike_names_writes_no_table_of_all_pairs(spark, monkeypatch):
    written, cut = [], near_names.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(near_names, "cut_lineage", counted)
    rng = random.Random(3)
    rows = [("g", pos, f"general hospital of the north {pos}", rng.random()) for pos in range(900)]
    table = spark.createDataFrame(rows, "group string, pos long, name string, rank double")
    near_names.greedy_removed(table, measure="edits")
    assert max(written) < 900 * 900 / 8


def test_texts_of_many_groups_meet_once(spark):
    rows = [(g, name) for g in range(300) for name in ("iso 45001 2018", "iso 9001 2015", "green seal award", "green seal awards")]
    names = spark.createDataFrame(rows, "group int, text string")
    index = near_names.NearTexts.of(names, 0.8, "blocks")
    assert index.near is not None and index.near.count() == 4
    pairs = index.pairs(names, names)
    assert pairs.count() == 300 * (4 + 4) and near_names.near_pairs(names).exceptAll(pairs).count() == 0


def test_rows_without_a_partner_leave_first(spark):
    """Where texts were compared without their groups, only rows that some row may be near to go on."""
    rows = [(g, p, n) for g in range(40) for p, n in enumerate(["ISO 9001:2015", "ISO 45001:2018", "NABL", "CAP", "Magnet"])]
    rows += [(7, 90, "CAP"), (None, 91, "NABL")]
    items = spark.createDataFrame(rows, "group long, pos long, name string")
    index = near_names.NearTexts.of(items.select("group", F.col("name").alias("text")), 0.8, "blocks")
    assert index.near is not None
    got = {tuple(r) for r in index.with_partner(items).collect()}
    assert got == {r for r in rows if r[2].startswith("ISO") or (r[0] == 7 and r[2] == "CAP")}
