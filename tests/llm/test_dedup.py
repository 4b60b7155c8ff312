"""Exact, near and passage dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meritgrid.llm import exact, near, passages
from meritgrid.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_by_force(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=str)


def exact_rows(found):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in found.select(columns).collect()), key=str)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_exact(odd_docs, no_docs):
    want = exact_by_force(pairs(odd_docs))
    assert exact_rows(exact.dedup_exact(odd_docs)) == want
    assert exact.dedup_exact(no_docs).count() == 0
    kept = exact.keep_first_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted({str(w[0]) + w[4] for w in want if w[3]} and {str(w[0]) for w in want if w[3]})


def test_exact_with_colliding_hashes(odd_docs):
    few = lambda text: F.pmod(F.xxhash64(text), F.lit(3)) * (1 << 60)
    assert exact_rows(exact.dedup_exact(odd_docs, few, 500)) == exact_by_force(pairs(odd_docs))


def test_directory_doubles_and_splits():
    directory = exact.Directory()
    directory.split(0)
    directory.split(1)
    assert (directory.depth, directory.slots, directory.local) == (2, [0, 0, 1, 2], [1, 2, 2])
    directory.split(0)
    assert (directory.depth, directory.slots) == (2, [0, 3, 1, 2])
    assert directory.ranges() == [0, 1, 2, 3]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    edges += [(i, i + 1) for i in range(200, 240)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    want = {x: top(x) for x in list(parent)}
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = (text or "").lower().encode().split()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def near_by_force(rows):
    sets = [shingles(t) for _, t in rows]
    links = [0] * len(rows)
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    return sorted(
        (str(rows[i][0]), links[i], sum(top(j) == top(i) for j in range(len(rows)))) for i in range(len(rows))
    )


def near_corpus():
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = list(base[i % 6])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    return rows


def test_near(spark, odd_docs, no_docs):
    for docs in (odd_docs, spark.createDataFrame(near_corpus(), "doc_id long, text string")):
        found = near.near_duplicates(docs, tile=4)
        got = sorted((str(r.doc_id), r.n_links, r.class_size) for r in found.collect())
        assert got == near_by_force(pairs(docs))
    assert near.near_duplicates(no_docs).count() == 0


def test_near_keeps_one_of_each_class(odd_docs):
    kept = near.keep_one_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 10 not in ids and 1 in ids and 8 not in ids and 9 not in ids
    assert ids.count(3) == 1 and 11 in ids and 12 in ids


def test_prefix_is_shortened_until_recall():
    assert near.prefix_length(24, 6, 0.8, 0.5) == 6
    length = near.prefix_length(24, 6, 0.8, 0.99999)
    assert 1 - (1 - 0.8**length) ** 24 >= 0.99999 > 1 - (1 - 0.8 ** (length + 1)) ** 24


def passages_by_force(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        covered = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                covered[i : i + length] = b"\x01" * length
        kept = bytes(b for b, c in zip(d, covered) if not c)
        runs = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        out.append((str(doc_id), len(d), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passage_rows(found):
    return sorted(
        (str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()
    )


def test_passages(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 250))) for _ in range(9)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randrange(6)):
            cut = rng.choice(base)[rng.randrange(40) :]
            parts.append(cut if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(25)))
        rows.append((i, "".join(parts)))
    rows += [(900, "a" * 400), (901, "ab" * 150), (902, "a" * 39), (903, None), (None, "a" * 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.remove_passages(docs, 40, batches=3, with_text=True)
    assert passage_rows(found) == passages_by_force(rows, 40)
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in found.collect())


def test_passages_odd(odd_docs, no_docs):
    assert passage_rows(passages.remove_passages(odd_docs)) == passages_by_force(pairs(odd_docs), 400)
    assert passages.remove_passages(no_docs).count() == 0


def test_equal_hashes_of_other_bytes_are_told_apart():
    rows = pa.table(
        {
            "core": pa.array([1, 1, 1], pa.int64()),
            "check": pa.array([2, 2, 2], pa.int64()),
            "low": pa.array([0, 0, 0], pa.int32()),
            "high": pa.array([1, 1, 1], pa.int32()),
            "margin": pa.array([b"abc", b"xbc", b"xyc"], pa.binary()),
            "new": [True, False, False],
        }
    ).combine_chunks()
    hits = passages.match_windows(rows, 2)
    plain = passages._match_plainly(
        np.array([1] * 3), np.array([2] * 3), [True, False, False], np.zeros(3, int), np.ones(3, int),
        [b"abc", b"xbc", b"xyc"], 2,
    )
    flat = lambda found: sorted((int(a), int(d)) for h in found for a, x, y in zip(*h) for d in range(x, y + 1))
    assert flat(hits) == flat(plain) == [(0, 0), (1, 0)]


def shared_by_force(rows, length):
    lists = [(t or "").lower().encode().split() for _, t in rows]
    found = [[tuple(ws[i : i + length]) for i in range(len(ws) - length + 1)] for ws in lists]
    holders = {}
    for (doc_id, text), windows in zip(rows, found):
        for w in windows:
            holders.setdefault(w, set()).add((doc_id, text))
    return sorted(sum(len(holders[w]) > 1 for w in windows) for windows in found if any(len(holders[w]) > 1 for w in windows))


def test_windows_of_words_shared_by_documents(spark, odd_docs, no_docs):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(400)}"
    passages_ = [" ".join(word() for _ in range(n)) for n in (50, 51, 52, 80)]
    texts = [" ".join([*(word() for _ in range(rng.randrange(70))), *rng.sample(passages_, rng.randrange(3)), word()]) for _ in range(60)]
    plain = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string")
    for docs, length, gram in ((plain, 51, 25), (plain, 12, 5), (odd_docs, 51, 25), (odd_docs, 8, 3)):
        rows = passages.shared_windows(docs, length, gram).collect()
        keyed = docs.select("doc_id", "text", passages.row_key("doc_id", "text").alias("key")).distinct().collect()
        windows = {r.key: max(0, len((r.text or "").encode().split()) - length + 1) for r in keyed}
        got = sorted(windows[r.key] if r.copied else r.n_shared_windows for r in rows)
        assert [n for n in got if n] == shared_by_force([(r.doc_id, r.text) for r in keyed], length)
    counts = {r.doc_id: r.n_shared_windows for r in passages.remove_passages(plain).collect()}
    assert len(counts) == 63 and sorted(c for c in counts.values() if c) == shared_by_force([(i, t) for i, t in enumerate(texts + texts[:3])], 51)
    assert passages.shared_windows(no_docs).count() == 0
