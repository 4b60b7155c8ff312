"""Containment pairs against a plain double loop."""

import random

import pytest

from meritgrid.operators import containment


def pairs_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_a_double_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(containment, "TILE", 7)
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcé😀 ") for _ in range(rng.randrange(n)))
    wholes, parts = {text(30) for _ in range(150)}, {text(7) for _ in range(120)} | {"", "a", "ab", "zzz"}
    got = containment.contained_pairs(
        spark.createDataFrame([(w,) for w in wholes], "_whole string"), spark.createDataFrame([(p,) for p in parts], "key string")
    )
    assert pairs_of(got) == {(w, p) for w in wholes for p in parts if p in w}


def test_pairs_agree_on_further_columns(spark):
    rng = random.Random(3)
    rows = {("".join(rng.choice("abc") for _ in range(rng.randrange(9))), rng.choice("xy"), rng.choice("uv")) for _ in range(200)}
    wholes = spark.createDataFrame(sorted(rows), "_whole string, city string, state string")
    parts = spark.createDataFrame(sorted(rows), "key string, city string, state string")
    got = containment.contained_pairs(wholes, parts, ["city", "state"])
    assert pairs_of(got) == {(a, b, c, s) for a, c, s in rows for b, d, t in rows if b in a and (c, s) == (d, t)}


def test_empty_sides_and_nulls(spark):
    some = spark.createDataFrame([("abcd",), (None,), ("",)], "_whole string")
    keys = spark.createDataFrame([("bc",), (None,), ("bcd",), ("",)], "key string")
    assert pairs_of(containment.contained_pairs(some, keys)) == {("abcd", "bc"), ("abcd", "bcd"), ("abcd", ""), ("", "")}
    assert pairs_of(containment.contained_pairs(some.limit(0), keys)) == set()
    assert pairs_of(containment.contained_pairs(some, keys.limit(0))) == set()


def test_one_long_text_makes_rows_in_line_with_its_length(spark):
    """A text of n letters has n grams at most, however many lengths the searched texts have."""
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    parts = {long[i : i + 3 + i % 200] for i in range(0, 19_000, 37)} | {"nothere"}
    got = containment.contained_pairs(
        spark.createDataFrame([(long,)], "_whole string"), spark.createDataFrame([(p,) for p in parts], "key string")
    )
    assert {p for _, p in pairs_of(got)} == parts - {"nothere"}


def test_gram_counts_are_written_before_parts_meet_them(spark, monkeypatch):
    """So that their size is known and the grams of all parts need not be shuffled by gram."""
    written, cut = [], containment.cut_lineage
    monkeypatch.setattr(containment, "cut_lineage", lambda df: (written.append(df.columns), cut(df))[1])
    wholes = spark.createDataFrame([("abcd", "x"), ("bcde", "y")], "_whole string, city string")
    parts = spark.createDataFrame([("bcd", "x"), ("bcd", "y"), ("abc", "y")], "key string, city string")
    assert pairs_of(containment.contained_pairs(wholes, parts, ["city"])) == {("abcd", "bcd", "x"), ("bcde", "bcd", "y")}
    assert written[0] == ["gram", "city", "n"]


def test_rarest_grams_are_found_without_a_sort(spark, monkeypatch):
    """The least of a struct sorts the grams of all parts; null places still pair with nothing."""
    plans, cut = [], containment.cut_lineage
    monkeypatch.setattr(
        containment, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1]
    )
    wholes = spark.createDataFrame([("abcd", "x"), ("abcd", None), ("bcde", "y")], "_whole string, city string")
    parts = spark.createDataFrame([("bcd", "x"), ("bcd", None), ("bcde", "y"), ("zzz", "x")], "key string, city string")
    assert pairs_of(containment.contained_pairs(wholes, parts, ["city"])) == {("abcd", "bcd", "x"), ("bcde", "bcde", "y")}
    assert "SortAggregate" not in plans[1]
