"""Blocking joins against plain pairwise comparison."""

import random

import pytest

from meritgrid.operators import blocking, match

WORDS = ["apollo", "pollo", "hospital", "care", "eye", "unit", "north", "a", "of", "lab", "labs", "city", "x1"]


def names(seed: int, n: int, longest: int) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def tables(spark, left, right):
    a = spark.createDataFrame([(i, k) for i, k in enumerate(left)], "lid long, key string")
    b = spark.createDataFrame([(i, k) for i, k in enumerate(right)], "ord long, key string")
    return a, b


def first(left, right, test):
    out = {}
    for i, x in enumerate(left):
        hits = [j for j, y in enumerate(right) if test(x, y)]
        if hits:
            out[i] = min(hits)
    return out


def collected(df):
    return {r["lid"]: r["ord"] for r in blocking.best_of(df).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_containment_equals_pairwise(spark, seed):
    left, right = names(seed, 40, 3) + [""], names(seed + 100, 60, 4) + ["", "zz"]
    a, b = tables(spark, left, right)
    assert collected(blocking.either_contains(a, b)) == first(left, right, lambda x, y: x in y or y in x)
    assert collected(blocking.left_in_right(a, b)) == first(left, right, lambda x, y: x in y)
    assert collected(blocking.right_in_left(a, b)) == first(left, right, lambda x, y: y in x)


def test_containment_with_condition_and_extra_key(spark):
    left = [("north care", "p"), ("care", "q"), ("eye care unit", "p")]
    right = [("care", "p"), ("north care home", "p"), ("eye care unit two", "q"), ("unit", "p")]
    a = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(left)], "lid long, key string, city string")
    b = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(right)], "ord long, key string, city string")
    assert collected(blocking.either_contains(a, b, ["city"])) == {0: 0, 1: 2, 2: 0}
    share = match._overlap_share
    assert collected(blocking.either_contains(a, b, ["city"], share)) == {0: 1}


def jaccard(x, y):
    a, b = set(x.split()), set(y.split())
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold,strict", [(0.7, True), (0.8, False), (0.6, False)])
def test_jaccard_equals_pairwise(spark, threshold, strict):
    left, right = names(7, 60, 5), names(8, 80, 5)
    a, b = tables(spark, left, right)
    near = blocking.word_jaccard(a, b, threshold, strict)
    passes = lambda s: s > threshold if strict else s >= threshold
    assert collected(near) == first(left, right, lambda x, y: passes(jaccard(x, y)))
    best = {}
    for r in near.collect():
        key = (-r["score"], r["ord"])
        best[r["lid"]] = min(best.get(r["lid"], key), key)
    for i, x in enumerate(left):
        scores = [(-jaccard(x, y), j) for j, y in enumerate(right) if passes(jaccard(x, y))]
        assert (i in best) == bool(scores)
        if scores:
            assert best[i] == pytest.approx(min(scores))


def test_jaccard_of_long_names(spark):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(30)]
    base = [rng.sample(pool, rng.randint(9, 20)) for _ in range(25)]
    right = [" ".join(b) for b in base]
    left = []
    for b in base:
        changed = b[: len(b) - rng.randint(0, 3)] + rng.sample(pool, rng.randint(0, 2))
        left.append(" ".join(changed))
    a, b = tables(spark, left, right)
    assert collected(blocking.word_jaccard(a, b, 0.7, True)) == first(left, right, lambda x, y: jaccard(x, y) > 0.7)


def test_two_shared_words(spark):
    left, right = names(11, 50, 6), names(12, 50, 6)
    a, b = tables(spark, left, right)
    long = lambda t: {w for w in t.split() if len(w) > 3}
    assert collected(blocking.two_shared_words(a, b)) == first(left, right, lambda x, y: len(long(x) & long(y)) >= 2)


def test_hot_key_reaches_the_join_once(spark):
    a = spark.createDataFrame([(i, "hospital") for i in range(500)], "lid long, key string")
    b = spark.createDataFrame([(i, f"hospital {i % 7}") for i in range(500)], "ord long, key string")
    assert collected(blocking.left_in_right(a, b)) == {i: 0 for i in range(500)}


def similarity(a, b):
    """1 - edit distance / longer length, by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0


ORGS = [
    "Johns Hopkins Hospital", "Mayo Clinic", "Apollo Hospitals Chennai", "Apollo Hospitals Delhi", "Eye Care Unit North",
    "City Lab", "General Hospital of the North City", "Saint Anne Care",
]


def test_lookup_tiers(spark):
    rows = [(i, n, f"{n}, India" if i % 2 else "") for i, n in enumerate(ORGS)]
    orgs = spark.createDataFrame(rows, "seq long, name string, original_name string")
    texts = ["john hopkins", "MAYO CLINIC", "apollo", "Chennai, India", "City Lab, India", "Eye Care Unit South", "nothing alike"]
    got = {r["query_no"]: (r["method"], r["match_seq"]) for r in match.lookup_names(orgs, texts).collect()}
    assert got[0] == ("fuzzy", 0)
    assert got[1] == ("exact", 1)
    assert got[2] == ("contained", 2)
    assert got[4] == ("contained", 5)
    assert got[5] == ("fuzzy", 4)
    assert 6 not in got


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.6])
def test_ranked_search_equals_plain_scoring(spark, threshold):
    import re

    words = "hospital|medical|center|centre|institute|research|health|care|system|ltd|limited|pvt|private|inc|corporation|corp"

    def norm(t):
        t = re.sub(rf"\b({words})\b", "", t, flags=re.I)
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t)).strip()

    def score(q, name, original):
        q, n = q.strip(), name
        a, b = set(q.lower().split()), set(n.lower().split())
        inside = lambda t: float(q.lower() in t.lower() or t.lower() in q.lower())
        total = 0.3 * similarity(q.lower(), n.lower()) + 0.25 * similarity(norm(q).lower(), norm(n).lower())
        total += 0.2 * len(a & b) / len(a) + 0.15 * inside(n)
        if original:
            total += 0.05 * similarity(q.lower(), original.lower()) + 0.05 * inside(original)
        if n.lower() == q.lower():
            return 1.0
        return max(total, 0.9) if q.lower() in n.lower() else total

    rows = [(i, n, f"{n}, India" if i % 2 else "") for i, n in enumerate(ORGS)]
    rows += [(90, "Johns Hopkins", "Johnshopkins"), (91, "hospital", None), (92, "", "eye care"), (93, None, None)]
    orgs = spark.createDataFrame(rows, "seq long, name string, original_name string")
    texts = ["apollo hospitals", "Johns Hopkins", "north city general hospital", "mayo clinic", "eye care", "johnshopkins", "hospital"]
    want = {
        (qi, i): round(score(q, n, o), 6) for qi, q in enumerate(texts) for i, n, o in rows if n and score(q, n, o) >= threshold
    }
    got = {(r["query_no"], r["seq"]): round(r["score"], 6) for r in match.ranked_search(orgs, texts, threshold).collect()}
    assert got == want
    assert (5, 90) in got


def test_lookup_alias_needs_no_shared_word(spark):
    orgs = spark.createDataFrame([(4, "Johns Hopkins", "")], "seq long, name string, original_name string")
    got = match.lookup_names(orgs, ["john hopkinsx clinicx"]).collect()
    assert [(r["method"], r["match_seq"], r["score"]) for r in got] == [("fuzzy", 4, 0.9)]


def test_search_texts_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(match, "QUERY_BLOCK", 3)
    orgs = spark.createDataFrame([(i, f"name {i}", "") for i in range(8)], "seq long, name string, original_name string")
    texts = [f"Name {i}" for i in range(8)] + [" ", ""]
    assert {r["query_no"]: r["match_seq"] for r in match.lookup_names(orgs, texts).collect()} == {i: i for i in range(8)}
    exact = {(r["query_no"], r["seq"]) for r in match.ranked_search(orgs, texts, 0.99).collect()}
    assert exact == {(i, i) for i in range(8)}
    assert match.lookup_names(orgs, []).count() == 0
