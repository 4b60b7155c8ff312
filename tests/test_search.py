"""Search indexes: nothing similar enough is left out, and far fewer pairs than all are scored."""

import random

import pytest
from pyspark.sql import functions as F

from meritgrid.functions import text
from meritgrid.operators import match, search
from test_blocking import similarity

LETTERS = "abcdeé "


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in sorted(set(values))], "text string")


@pytest.mark.parametrize("least", [0.7, 0.75, 0.9])
def test_gram_index_keeps_every_similar_pair(spark, least):
    rng = random.Random(int(100 * least))
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 16))) for _ in range(60)] + ["", "a", "aa", "aaaa", "abab", "ababab"]

    def changed(t):
        t = list(t)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(LETTERS)]])
        return "".join(t)

    other = [changed(t) for t in base for _ in range(3)]
    got = {tuple(r) for r in search.similar_texts(texts(spark, base), texts(spark, other), least).collect()}
    want = {(a, b) for a in set(base) for b in set(other) if similarity(a, b) >= least}
    assert want <= got
    with pytest.raises(ValueError):
        search.similar_texts(texts(spark, base), texts(spark, other), 0.5)


def test_candidates_are_few(spark):
    """Names of three words with one very common word: the indexes score a small share of all pairs."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwxyz") for _ in range(8))
    names = [f"{word()} {word()} hospital" for _ in range(1500)]
    left, right = texts(spark, names[::50]), texts(spark, names)
    near = search.similar_texts(left, right, 0.75).union(search.texts_sharing_words(left, right)).distinct()
    assert near.count() < 0.2 * left.count() * right.count()


@pytest.mark.parametrize("threshold", [0.6, 0.75])
def test_searches_with_a_table_equal_plain_loops(spark, threshold):
    rng = random.Random(9)
    words = ["apollo", "care", "clinic", "eye", "hospital", "north", "river", "general", "labs"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(80)]
    asked = [(1000 + i, f" {n[: rng.randrange(3, 30)].upper()}x") for i, n in enumerate(names[::4])] + [(7, "  "), (8, None)]
    orgs = spark.createDataFrame([(i, n, f"City {n}") for i, n in enumerate(names)], "seq long, name string, original_name string")
    table = spark.createDataFrame(asked, "query_no long, query string")
    got = {r.query_no: (r.method, r.match_seq, round(r.score, 6)) for r in match.lookup_names(orgs, table, threshold).collect()}
    want = {}
    for number, query in asked:
        q = (query or "").strip().lower()
        if not q:
            continue
        hits = []
        for i, n in enumerate(names):
            overlap = len(set(q.split()) & set(n.split())) / len(set(q.split()))
            s = 0.4 * similarity(q, n) + 0.6 * overlap
            o = f"city {n}"
            tier = 0 if n == q else 1 if q in n or n in q else 2 if q in o or o in q else 3
            if tier < 3 or s >= threshold:
                hits.append((tier, 0 if tier < 3 else -round(s, 9), i))
        if hits:
            tier, s, i = min(hits)
            want[number] = (match.TIERS[tier], i, 1.0 if tier < 3 else round(-s, 6))
    assert got == want
    low = match.ranked_search(orgs, table, 0.5).filter(F.col("score") >= threshold)
    high = match.ranked_search(orgs, table, threshold)
    key = lambda df: sorted((r.query_no, r.seq, round(r.score, 9)) for r in df.collect())
    assert key(low) == key(high) and key(high)


def test_bounds_are_never_below_the_score(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice(LETTERS + "xz09") for _ in range(rng.randrange(0, 14))) for _ in range(60)] + ["", "eee eee", "é", "日本"]
    left = spark.createDataFrame([(n,) for n in names], "a string")
    a, b = F.col("a"), F.col("b")
    marks = search.letter_marks
    mine, theirs = text.words("a"), text.words("b")
    rows = left.crossJoin(left.withColumnRenamed("a", "b")).select(
        search.edit_similarity(a, b).alias("s"),
        search.edit_bound(F.length(a), F.length(b), marks(a), marks(b)).alias("most"),
        text.word_overlap(mine, theirs).alias("w"),
        search.overlap_bound(F.size(mine), search.word_marks(mine), search.word_marks(theirs)).alias("most_w"),
        F.contains(a, b).alias("holds"),
        search.may_hold(marks(a), marks(b)).alias("may"),
    ).collect()
    assert all(r.s <= r.most + 1e-12 and r.w <= r.most_w + 1e-12 and (r.may or not r.holds) for r in rows)
    assert sum(r.most < 0.7 for r in rows) > len(rows) / 2 and sum(not r.may for r in rows) > len(rows) / 2


def test_ranked_search_moves_no_pairs(spark, monkeypatch):
    """Pairs are scored where they meet: nothing above the join is shuffled; numbers repeat or are null."""
    monkeypatch.setattr(match, "SEARCH_BLOCK", 2)
    names = [(1, "Apollo Clinic", ""), (1, "Apollo Clinic", ""), (None, "Apollo Clinic", ""), (4, "Fortis Labs", "x")]
    orgs = spark.createDataFrame(names, "seq long, name string, original_name string")
    table = spark.createDataFrame([(5, "apollo clinic"), (5, "Apollo Clinic"), (None, "fortis labs"), (9, "zzz")], "query_no long, query string")
    found = match.ranked_search(orgs, table)
    above = found._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin")
    assert len(above) > 2 and "Exchange" not in above[0] and "SortMergeJoin" not in above[0]
    got = sorted((str(r.query_no), str(r.seq), r.score) for r in found.collect())
    assert got == sorted([("5", "1", 1.0)] * 4 + [("5", "None", 1.0)] * 2 + [("None", "4", 1.0)])
