"""The pipeline on the smallest folder: each stage's decisions against brute force."""

import corpus_pipeline
from test_dedup import LOWER, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        held.append((name, docs.collect()))
        if name != "packing":
            assert docs.columns == columns
    rows = dict(held)
    texts = [r.text.translate(LOWER) for r in rows["exact_dedup"]]
    assert len(texts) == len(set(texts)) == len({r.text.translate(LOWER) for r in rows["language_id"]})
    kept = [shingles(r.text) for r in rows["jaccard_join"]]
    for i, a in enumerate(kept):
        for b in kept[:i]:
            assert not a or not b or 5 * len(a & b) < 4 * len(a | b)
    dropped = {r.doc_id for r in rows["exact_dedup"]} - {r.doc_id for r in rows["jaccard_join"]}
    sets = [shingles(r.text) for r in rows["exact_dedup"]]
    for r in rows["exact_dedup"]:
        if r.doc_id in dropped:
            a = shingles(r.text)
            assert sum(5 * len(a & b) >= 4 * len(a | b) for b in sets) > 1
    assert len(rows["pii"]) == len(rows["jaccard_join"])
    assert not any("@mail" in r.text for r in rows["pii"])
    assert {p.doc_id for p in rows["packing"]} == {r.doc_id for r in rows["pii"]}
