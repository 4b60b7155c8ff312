"""The word index of name lookups against all pairs."""

import random

from meritgrid.operators import match, search


def texts(seed, n, longest):
    rng = random.Random(seed)
    pool = ["apex", "care", "hospital", "hospital", "clinic", "labs", "royal", "7", "unit", "branch"]
    return sorted({" ".join(rng.choice(pool) for _ in range(rng.randint(1, longest))) for _ in range(n)})


def test_pairs_by_words_lose_none_and_come_once(spark):
    left, right = texts(1, 60, 6), texts(2, 120, 7)
    as_table = lambda rows: spark.createDataFrame([(t,) for t in [*rows, None]], "text string")
    for share in (1 / 3, 0.5):
        found = search.pairs_by_words(as_table(left), as_table(right), share).select("a", "b").collect()
        got = [tuple(r) for r in found]
        assert len(got) == len(set(got))
        over = lambda a, b: len({*a.split()} & {*b.split()}) > share * len({*a.split()}) + 1e-9
        assert {(a, b) for a in left for b in right if over(a, b)} <= set(got)


def test_fuzzy_lookup_compares_no_pairs_without_a_shared_word(spark):
    names, asked = texts(3, 50, 4), [t.replace("hospital", "hospitl").replace("royal", "roya") for t in texts(4, 30, 5)]
    orgs = spark.createDataFrame([(i, n, "") for i, n in enumerate(names)], "seq long, name string, original_name string")
    out = match.lookup_names(orgs, asked)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" not in plan and "gram" not in plan  # no grams; words only
    got = {r.query_no: (r.method, r.match_seq, round(r.score, 9)) for r in out.collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for no, q in enumerate(asked):
        if any(q in n or n in q for n in names):
            assert got[no][0] in ("exact", "contained")
            continue
        score = lambda n: 0.4 * (1 - distance(q, n) / max(len(q), len(n))) + 0.6 * len({*q.split()} & {*n.split()}) / len({*q.split()})
        best, first = min((-round(score(n), 9), i) for i, n in enumerate(names))
        assert got.get(no) == (("fuzzy", first, -best) if -best >= 0.6 else None)


def test_frequent_words_meet_texts_without_a_good_name_only(spark, monkeypatch):
    """Names of a text's rarest word come first; what they score rules the names of its frequent words out."""
    names = [f"{w} hospital private limited" for w in ("apollo", "fortis", "sankara", "manipal")] + ["royal clinic", "royal labs"]
    asked = ["apllo hospital private limited", "fortis hospitals private limited", "royl clinics labs", "royal clinix"]
    orgs = spark.createDataFrame([(i, n, "") for i, n in enumerate(names)], "seq long, name string, original_name string")
    met, at = [], search.pairs_at_words
    monkeypatch.setattr(search, "pairs_at_words", lambda *a: (met.append(at(*a)), met[-1])[1])
    got = {r.query_no: (r.method, r.match_seq, round(r.score, 6)) for r in match.lookup_names(orgs, asked).collect()}
    assert got[1] == ("fuzzy", 1, round(0.4 * (1 - 1 / 32) + 0.45, 6))
    assert got[0] == ("fuzzy", 0, round(0.4 * (1 - 1 / 31) + 0.45, 6)) and got[3] == ("fuzzy", 4, round(0.4 * (1 - 1 / 12) + 0.3, 6))
    assert 2 not in got
    pairs = [{(r.a, r.b) for r in df.collect()} for df in met]
    assert len(pairs) == 2 and (asked[1], names[1]) in pairs[0]
    assert not any(a == asked[1] for a, _ in pairs[1])  # the three other names share too few words
