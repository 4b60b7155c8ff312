"""N-gram Jaccard join with a MinHash index and exact verification.

Texts with equal shingle sets are one node. Each node has a label of several min-hashes in every
tree, cut to one length: the longest at which two texts at the wanted similarity share a label in some
tree with the target probability. Nodes with an equal label are candidates; candidates are united into
blocks, and inside a block every pair is compared exactly, many at a time: large blocks are divided
into tiles, pairs never leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgrid.llm.common import row_key, small_batches, stored, text_slices
from meritgrid.llm.components import components

WORDS = 5
SIMILARITY = 0.8
TREES = 24
DEPTH = 6
RECALL = 0.99999
TILE = 256
TILE_SHINGLES = 400_000
COLUMNS = 4096
SEED = 20_011

SIGNED = "doc_id long, key long, set_high long, set_low long, n_shingles int, labels array<long>"


def prefix_length(trees: int, depth: int, similarity: float, recall: float) -> int:
    """Shorten the matched prefix from the full label until the expected recall is reached."""
    for length in range(depth, 0, -1):
        if 1 - (1 - similarity**length) ** trees >= recall:
            return length
    return 1


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, all at once: a polynomial of the bytes, mixed."""
    if not words:
        return np.empty(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(len(words), np.uint64)
    live, step = np.arange(len(words)), 0
    while len(live := live[sizes[live] > step]):
        out[live] = out[live] * np.uint64(0x9E3779B97F4A7C15) + flat[begin[live] + step]
        step += 1
    return _mix(out + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_word_lists(texts: list) -> tuple[np.ndarray, list[int]]:
    """Hashes of the lower-cased words of all texts, one after another, and the words per text."""
    lists = [(t or "").lower().encode().split() for t in texts]
    number: dict[bytes, int] = {}
    order = [number.setdefault(w, len(number)) for ws in lists for w in ws]
    hashes = word_hashes(list(number))
    return hashes[np.array(order, np.int64)] if order else hashes, [len(ws) for ws in lists]


def shingle_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the n-word windows; a shorter text is one shingle as a whole."""
    if not len(words):
        return words
    n = min(n, len(words))
    count = len(words) - n + 1
    out = np.full(count, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + words[i : i + count]
    return np.unique(_mix(out))


def tree_labels(shingles: np.ndarray, trees: int, length: int, seeds: np.ndarray) -> list[int]:
    """One number for each tree: its label cut to ``length`` min-hashes."""
    smallest = np.empty(trees * length, np.uint64)
    for start in range(0, len(seeds), 8):
        part = seeds[start : start + 8, None]
        mixed = shingles[None, :] * (part | np.uint64(1))
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        smallest[start : start + 8] = (mixed ^ (part >> np.uint64(7))).min(axis=1)
    labels = smallest.reshape(trees, length)
    out = np.arange(1, trees + 1, dtype=np.uint64)
    for j in range(length):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + labels[:, j])
    return out.astype(np.int64).tolist()


def _seeds(count: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, count, np.uint64)


def _set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a shingle set."""
    import hashlib

    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    high, low = np.frombuffer(digest, np.int64).tolist()
    return high, low


def sign(docs: DataFrame, trees: int, length: int, words: int) -> DataFrame:
    """Key, shingle-set digest, number of shingles and tree labels of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(trees * length)
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            rows = []
            for start, stop in text_slices(texts):
                hashes, sizes = text_word_lists(texts[start:stop])
                at = 0
                for size in sizes:
                    found = shingle_hashes(hashes[at : at + size], words)
                    at += size
                    labels = tree_labels(found, trees, length, seeds) if len(found) else []
                    rows.append((*_set_digest(found), len(found), labels))
            high, low, counts, labels = (list(c) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()),
                    pa.array(counts, pa.int32()),
                    pa.array(labels, pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "set_high", "set_low", "n_shingles", "labels"],
            )

    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    return keyed.mapInArrow(run, SIGNED)


def candidate_blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes under a common prefix in any tree: node, component.

    ``nodes``: node, labels. Each prefix links its nodes to the smallest of them; a prefix with one
    node is dropped before.
    """
    under = stored(nodes.select("node", F.explode("labels").alias("prefix")), "near-prefixes")
    groups = under.groupBy("prefix").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    linked = under.join(groups.where("n > 1"), "prefix")
    edges = linked.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return components(edges)


def _pairs_in(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Matrix of pairs with Jaccard similarity of at least ``similarity``, by exact counts."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        shared = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2).astype(float)
        shared = np.array([[0.0, shared[0, 1]], [shared[0, 1], 0.0]])
    else:
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(m), sizes)
        often = np.bincount(column) > 1  # a shingle of one set alone joins nothing
        keep = often[column]
        row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
        shared = np.zeros((m, m), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total = int(often.sum())
        for start in range(0, total, COLUMNS):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            part = np.zeros((m, min(COLUMNS, total - start)), np.float32)
            part[row[a:b], column[a:b] - start] = 1
            shared += part @ part.T
    union = sizes[:, None] + sizes[None, :] - shared
    linked = shared >= similarity * union - 1e-6
    np.fill_diagonal(linked, False)
    return linked


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each node of a component to the one it was reached from."""
    todo, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            node = front.pop()
            near = np.flatnonzero(linked[node] & todo)
            todo[near] = False
            edges += [(node, int(other)) for other in near]
            front += near.tolist()
    return edges


def _compare(similarity: float, words: int):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        hashes, sizes = text_word_lists(tile["text"].tolist())
        ends = np.cumsum(sizes)
        sets = [shingle_hashes(hashes[e - n : e], words) for e, n in zip(ends, sizes)]
        linked = _pairs_in(sets, similarity)
        part = tile["part"].to_numpy()
        first, second = int(tile["first"].iloc[0]), int(tile["second"].iloc[0])
        if first != second:  # pairs within one part are counted in the part's own tile
            linked &= part[:, None] != part[None, :]
        node, copies = tile["node"].to_numpy(), tile["copies"].to_numpy()
        texts, links = linked.sum(axis=1), linked @ copies
        joined = _forest(linked)
        rows = [(node[i], node[i], texts[i], links[i]) for i in np.flatnonzero(texts)]
        rows += [(node[a], node[b], 0, 0) for a, b in joined]
        return pd.DataFrame(rows, columns=["a", "b", "texts", "links"]).astype("int64")

    return run


def verified_links(texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Exact comparison inside blocks: a, b, texts, links.

    ``texts``: node, copies, text, component, parts. A large component is divided into parts; every
    two parts meet in a task of their own, so no task grows with a component. Rows with a = b carry
    how many different texts and documents are linked to a node, the others a spanning forest of
    the links.
    """
    placed = texts.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = placed.select(
        "component",
        "node",
        "copies",
        "text",
        "part",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"),
    )
    met = met.withColumn("first", F.least("part", "other"))
    met = met.withColumn("second", F.greatest("part", "other"))
    return met.groupBy("component", "first", "second").applyInPandas(
        _compare(similarity, words), "a long, b long, texts long, links long"
    )


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    words: int = WORDS,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    tile: int = TILE,
) -> DataFrame:
    """Class and links of every document under Jaccard similarity of its word shingles.

    Words are lower-cased runs between ASCII spaces; a text of fewer than ``words`` words is one
    shingle. Two documents are linked when their shingle sets have a similarity of ``similarity`` or
    more; classes are the connected components of the links, named by their smallest doc_id.
    Returns doc_id, class_id, class_size, n_links (other documents linked, copies included),
    n_text_links (different shingle sets linked), n_copies (documents with the same set), key (of the
    row's values) and class (null without shingles). A
    pair at exactly the wanted similarity is found with probability ``recall`` or more, more similar
    ones more surely; what is found is compared exactly. Null and empty texts have no shingles and
    are classes of their own, as are texts without links; null ids and repeated rows are documents
    like others (a class of null ids alone has a null name); other columns are ignored.
    """
    length = prefix_length(trees, depth, similarity, recall)
    signed = stored(sign(docs, trees, length, words), "near-signed")
    named = ["set_high", "set_low"]
    nodes = signed.where("n_shingles > 0").groupBy(*named).agg(
        F.min("key").alias("key"),
        F.count("*").alias("copies"),
        F.max("n_shingles").alias("shingles"),
    )
    nodes = nodes.withColumn("node", F.xxhash64(*named))
    nodes = stored(nodes, "near-nodes")
    labelled = signed.select("key", *named, "labels").dropDuplicates([*named, "key"])
    labelled = labelled.join(nodes.select("key", *named, "node"), ["key", *named])
    blocks = candidate_blocks(labelled.select("node", "labels"))
    placed = nodes.join(blocks, "node")
    sizes = placed.groupBy("component").agg(
        F.ceil(F.greatest(F.count("*") / tile, F.sum("shingles") / TILE_SHINGLES))
        .cast("int")
        .alias("parts")
    )
    wanted = placed.join(sizes, "component").select("key", "node", "copies", "component", "parts")
    texts = docs.select(row_key("doc_id", "text").alias("key"), "text")
    found = texts.join(wanted, "key").dropDuplicates(["key", "node"])
    links = stored(verified_links(found, similarity, words), "near-links")
    counts = links.where("a = b").groupBy(F.col("a").alias("node")).agg(
        F.sum("texts").alias("n_text_links"), F.sum("links").alias("n_far_links")
    )
    classes = components(links.where("a <> b").select("a", "b"))
    per_set = (
        nodes.select(*named, "node", "copies")
        .join(counts, "node", "left")
        .join(classes, "node", "left")
        .select(
            *named,
            "copies",
            F.coalesce("component", "node").alias("class"),
            F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
            F.coalesce("n_far_links", F.lit(0)).alias("n_far_links"),
        )
    )
    rows = stored(
        signed.select("doc_id", "key", "n_shingles", *named).join(per_set, named, "left"),
        "near-rows",
    )
    names = rows.where("class IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")
    )
    names = stored(names, "near-classes")  # a join of two tables can split a large class
    out = rows.where("class IS NOT NULL").join(names, "class")
    single = rows.where("class IS NULL")
    columns = ["doc_id", "class_id", "class_size", "n_links", "n_text_links", "n_copies"]
    out = out.withColumns(
        {"n_links": F.col("copies") - 1 + F.col("n_far_links"), "n_copies": F.col("copies")}
    ).select(*columns, "key", "class")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    alone = {"class_id": F.col("doc_id"), "class_size": one, "n_links": zero}
    alone |= {"n_text_links": zero, "n_copies": one}
    return out.unionByName(single.withColumns(alone).select(*columns, "key", "class"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their class, each once.

    Null ids come last, then the smaller key; documents without shingles all stay.
    """
    found = near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = found.where("class IS NOT NULL").groupBy("class").agg(F.min_by("key", order).alias("key"))
    alone = found.where("class IS NULL").select("key")
    kept = first.select("key").unionByName(alone).distinct()
    named = docs.select(F.struct(*docs.columns).alias("row"))
    named = named.select("row", row_key("row.doc_id", "row.text").alias("key"))
    return named.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
