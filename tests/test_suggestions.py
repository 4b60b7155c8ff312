"""Suggestions against a plain loop."""

import re

from meritgrid.operators import report


def loop(rows, typed, k):
    """Best row of every name and class, then by class and name; locations are blank here."""
    lower = lambda t: (t or "").lower().strip()
    out = []
    for no, text in typed:
        q, best = lower(text), {}
        for seq, name, original in rows:
            n, o = lower(name), lower(original)
            if len(q) < 2 or not n or not (q in n or q in o):
                continue
            kind = 2 if q not in n else 0 if n.startswith(q) else 1
            plain = re.sub(r"\s+", " ", n)
            best[plain] = min(best.get(plain, (9,)), (kind, len(name), seq, plain))
        found = sorted((kind, plain, seq) for kind, _, seq, plain in best.values())
        out += [(no, i, seq, ["name_start", "name_contains", "original_name"][kind]) for i, (kind, _, seq) in enumerate(found[:k], 1)]
    return sorted(out)


def test_suggestions_equal_the_loop_and_find_the_pairs_once(spark, capsys):
    """Names equal to their original name, blank, null and repeated ones; short and repeated texts."""
    names = ["Apex Care", "apex  care", "North Apex", "River", None, "", "Eye Unit", "Apex Care", "Care"]
    originals = ["Apex Care", "Riverside", None, "River Apex", "Apex", "Apex", "", "North", "Apex Eye"]
    rows = [(i, n, o) for i, (n, o) in enumerate(zip(names, originals), 1)]
    typed = [(1, "apex"), (2, "ca"), (3, "a"), (4, "river"), (5, " APEX"), (6, "eye"), (7, None), (8, "zz")]
    orgs = spark.createDataFrame([(*r, "") for r in rows], "seq long, name string, original_name string, location string")
    out = report.suggestions(orgs, spark.createDataFrame(typed, "query_no long, query string"), 3)
    assert sorted(map(tuple, out.collect())) == loop(rows, typed, 3)
    out.explain("extended")
    optimized = capsys.readouterr().out.partition("Optimized Logical Plan")[2].partition("Physical Plan")[0]
    assert optimized.count("CoGroup") == 1
