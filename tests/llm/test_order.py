"""Merkle manifest, curriculum mix and fill-in-the-middle against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meritgrid.llm import curriculum, merkle, middle, places

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(odd_docs):
    n_chars = F.when(F.col("doc_id") % 3 != 1, F.length("text").cast("long"))
    return odd_docs.withColumn("n_chars", n_chars).withColumns({"tree": F.lit("x"), "row_id": F.lit(1), "place": F.lit(None)})


def key(row):
    return tuple((v is not None, v) for v in row)


# ------------------------------------------------------------------ places


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randrange(5), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, row_id long, v long")
    got = places.numbered(df, "g", ["o", "row_id"], value="v").collect()
    for g in "ab":
        own = sorted((r for r in got if r.g == g), key=lambda r: (r.o, r.row_id))
        assert [r.place for r in own] == list(range(len(own))) and {r.in_group for r in own} == {len(own)}
        assert [r.before for r in own] == [sum(x.v for x in own[:i]) for i in range(len(own))]
        assert {r.group_sum for r in own} == {sum(x.v for x in own)}
    assert places.numbered(df.limit(0), "g", ["o"], value="v").count() == 0


# ------------------------------------------------------------------ Merkle manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_by_force(leaves):
    """Root, and of every leaf the siblings with their side, level by level."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    nodes = list(leaves)
    while len(nodes) > 1:
        for i, p in enumerate(at):
            sibling = p ^ 1
            paths[i].append((p % 2, nodes[sibling] if sibling < len(nodes) else ""))
        nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [p // 2 for p in at]
    return nodes[0], paths


def manifest_by_force(rows, claim):
    trees = {}
    for r in rows:
        leaf = leaf_of(r)
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, claim(r) or leaf, r[0]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = [tree_by_force([x[2] for x in sorted(trees[n])]) for n in names]
    root, tops = tree_by_force([b[0] for b in built])
    out = []
    for name, (subroot, paths), top in zip(names, built, tops):
        for (_, _, leaf, claimed, doc_id), path in zip(sorted(trees[name]), paths):
            now = claimed
            for left, sibling in [*path, *top]:
                now = digest(sibling + now if left else now + sibling)
            proof = digest("".join(s for _, s in [*path, *top]))
            out.append((doc_id, leaf, subroot, root, proof, now, now == root))
    return sorted(out, key=key)


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest(docs, odd, levels):
    for table in (docs, odd):
        fields = [F.col(f) for f in merkle.FIELDS]
        changed = merkle.leaf_digest([*fields[:3], fields[3] + 1, fields[4]])
        claimed = F.when(F.col("doc_id") % 5 == 0, changed)
        got = merkle.manifest(table, claimed=claimed, levels=levels)
        rows = [tuple(r) for r in table.select(*merkle.FIELDS).collect()]

        def claim(r):
            bumped = None if r[3] is None else r[3] + 1
            return leaf_of((*r[:3], bumped, r[4])) if r[0] is not None and r[0] % 5 == 0 else None

        assert sorted(map(tuple, got.collect()), key=key) == manifest_by_force(rows, claim)


def test_proofs_fold_to_the_root_and_empty_tables(docs, odd):
    for r in merkle.manifest(docs.limit(70), with_proof=True, levels=2).collect():
        steps = [s for s in r.proof.split(",") if s]
        assert merkle.fold(r.leaf, steps) == r.root and r.verified
        assert digest("".join(s[1:] for s in steps)) == r.proof_sha256
    one = merkle.manifest(docs.limit(1)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == digest("")
    assert merkle.manifest(odd.limit(0)).collect() == []


# ------------------------------------------------------------------ curriculum mix


def targets_by_force(sizes, most=3):
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {n: 1 + i % 3 for i, n in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in held]
        level = (total - sum(most * sizes[n] for n in held)) / max(1, sum(weight[n] for n in free))
        above = {n for n in free if most * sizes[n] < level * weight[n]}
        if not above:
            return {n: most * sizes[n] if n in held else level * weight[n] for n in names}
        held |= above


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(table):
    mixed = curriculum.mix_sources(table)
    rows = mixed.collect()
    order = sorted(curriculum.training_order(mixed).collect(), key=lambda r: r.place)
    own = [(r.doc_id, words_of(r.text)) for r in table.select("doc_id", "text").collect()]
    assert sorted([(r.doc_id, r.size) for r in rows], key=key) == sorted(own, key=key)
    sizes = {}
    for r in table.select("source", "text").collect():
        sizes[r.source] = sizes.get(r.source, 0) + words_of(r.text)
    want = targets_by_force(sizes)
    name = lambda r: None if r.source_key == "1" else r.source_key[1:]
    for source, target in want.items():
        mine = [r for r in rows if name(r) == source]
        assert {(r.source_size, round(r.target, 6)) for r in mine} == {(sizes[source], round(target, 6))}
        assert abs(sum(u.words for r in mine for u in r.uses) - target) <= 0.5
        for r in mine:
            taken = sum(u.words for u in r.uses)
            assert taken <= 3 * r.size and len(r.uses) <= 3
    assert [r.place for r in order] == list(range(len(order)))
    assert [r.start_word for r in order] == [sum(x.words for x in order[:i]) for i in range(len(order))]
    assert [r.time for r in order] == sorted(r.time for r in order)
    assert all(0 <= r.time <= 1 for r in order)
    return rows, order


def test_mix(docs, odd):
    check_mix(docs)
    check_mix(odd.drop("size"))
    check_mix(odd.withColumn("source", F.when(F.col("doc_id") < 2, F.lit(None)).otherwise(F.concat(F.lit("é"), F.col("doc_id") % 5))))
    empty = curriculum.mix_sources(odd.limit(0))
    assert empty.count() == 0 and curriculum.training_order(empty).count() == 0
    silent = curriculum.mix_sources(odd.withColumn("text", F.lit(" ")))
    assert all(r.uses == [] and r.target == 0 for r in silent.collect())


def test_small_sources_stop_at_their_limit_and_heavy_ones_come_late(spark):
    rows = [(i, "a", "w " * 10) for i in range(200)] + [(1000 + i, "b", "w " * 5) for i in range(4)]
    rows += [(2000 + i, "c", "w " * 10) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got, order = check_mix(table)
    assert {r.target for r in got if r.source_key == "0b"} == {60.0}
    assert all(len(r.uses) == 3 for r in got if r.source_key == "0b")
    half = len(order) // 2
    late = lambda part, low: sum(low <= r.doc_id < low + 1000 for r in part)
    assert late(order[:half], 0) > 1.3 * late(order[half:], 0)
    assert late(order[:half], 2000) < 0.8 * late(order[half:], 2000)


def test_order_does_not_depend_on_partitions(docs):
    def run(table):
        return sorted((r.doc_id, r.size, [tuple(u) for u in r.uses]) for r in curriculum.mix_sources(table).collect())

    assert run(docs) == run(docs.repartition(7, "lang"))


def test_due_inverts_the_demand(spark):
    for schedule in [*curriculum.SCHEDULES, ((0.0, 0.0), (0.2, 4.0), (1.0, 0.5))]:
        shares = np.linspace(0, 1, 41)
        df = spark.createDataFrame([(float(s),) for s in shares], "s double")
        times = [r.t for r in df.select(curriculum.due(F.col("s"), schedule).alias("t")).collect()]
        knots, weights = zip(*schedule)
        grid = np.linspace(0, 1, 200_001)
        curve = np.interp(grid, knots, weights)
        area = np.concatenate([[0], np.cumsum((curve[1:] + curve[:-1]) / 2)])
        back = np.interp(times, grid, area / area[-1])
        assert np.allclose(back, shares, atol=1e-5)


# ------------------------------------------------------------------ fill-in-the-middle


def test_wavelet_matrix():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        data = rng.integers(0, 8, n).astype(np.uint8)
        data[data == 3] = 2  # a symbol that does not occur
        matrix = middle.WaveletMatrix(data)
        spots = np.arange(n + 1)
        for symbol in range(8):
            rank = np.concatenate([[0], np.cumsum(data == symbol)])
            assert (matrix.rank(symbol, spots) == rank).all()
            where = np.flatnonzero(data == symbol)
            assert (matrix.select(symbol, np.arange(len(where))) == where).all()


PATTERNS = {
    "lines": r"[^\n]*\n|[^\n]+",
    "sentences": r"(?:[^\n.!?。]|[.!?](?![\x20\x09-\x0D]))*(?:\n|。|[.!?](?=[\x20\x09-\x0D])|(?<=.)\Z|(?<=\n)\Z)",
    "chars": r"(?s).",
}


def middle_by_force(doc_id, text, unit, rate, share):
    text = text or ""
    units = [u for u in re.findall(PATTERNS[unit], text) if u]
    assert "".join(units) == text
    hashed = digest(f"7:{'' if doc_id is None else doc_id}")
    h = [int(hashed[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in middle.MARKERS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < share:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def cuttable(spark, odd):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é😀。.!? \n\n\t<PSM>") for _ in range(rng.randrange(90))) for _ in range(150)]
    texts += ["<P>", "<S", "a<\nS>b\n", "\n", "\n\n", "x", "é\n😀", ("long é。 line. \n" * 400_000)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    return odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


@pytest.mark.parametrize("unit, rate, share", [("lines", 100, 50), ("sentences", 60, 0), ("chars", 100, 100)])
def test_fill_in_middle(docs, cuttable, unit, rate, share):
    for table in (docs, cuttable):
        made = middle.fill_in_middle(table, unit, rate, share)
        made = made.withColumn("back", middle.restored(F.col("output"), F.col("form")))
        got = [tuple(r) for r in made.collect()]
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        want = [(*middle_by_force(i, t, unit, rate, share), t or "") for i, t in rows]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert middle.fill_in_middle(cuttable.limit(0)).count() == 0
