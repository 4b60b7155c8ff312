"""Merkle manifest of a dataset: one tree for each language, their roots under one root.

Leaves get a place in their tree by ranges of their order. A superblock is a run of 1,024 places,
which ends on a node of the tree ten levels up. Going up, every superblock is reduced to that node
and the nodes are superblocks of their own, until one is left. Going down, the nodes outside a
superblock that its proofs need travel as one row to where its leaves are: leaves and outer nodes
are cogrouped by superblock, and one pass reduces the block, joins its proofs with the outer part
and folds the leaves as they are claimed now. No task holds more than one superblock.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.llm.common import stored
from meritgrid.llm.places import numbered, with_row

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10  # a superblock has 2**LEVELS places

NODES = "tree string, place long, size long, digest string"
OUTER = "tree string, block long, path string, subroot string, root string"
PROVEN = "key string, leaf string, proof_sha256 string, folded_root string, subroot string, root string"


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its UTF-8 length, a colon and itself."""
    texts = [v.cast("string") for v in values]
    parts = [
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
        for t in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_above(size: int) -> int:
    """Levels between the leaves of a tree with ``size`` leaves and its root."""
    return (int(size) - 1).bit_length()


def block_levels(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of a superblock level by level: pairs become one node, a last single one too."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([_hash("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def siblings(nodes: list[list[str]], at: int) -> list[str]:
    """The path from a node of the lowest level to the top: L or R with the sibling, or A alone."""
    path = []
    for level in nodes[:-1]:
        if at % 2:
            path.append("L" + level[at - 1])
        else:
            path.append("R" + level[at + 1] if at + 1 < len(level) else "A")
        at //= 2
    return path


def fold(digest: str, path: Sequence[str]) -> str:
    """The digest that a node and the siblings of its path give at the top."""
    for step in path:
        if step[0] == "L":
            digest = _hash(step[1:] + digest)
        else:
            digest = _hash(digest + step[1:])  # alone: nothing follows
    return digest


def _in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("place", levels))


def _block_nodes(block: pd.DataFrame, levels: int) -> list[list[str]]:
    """Levels of a sorted superblock; a small tree ends below ``levels``."""
    return block_levels(block["digest"].tolist(), min(levels, levels_above(block["size"].iloc[0])))


def _climb(levels: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        nodes = _block_nodes(block := block.sort_values("place"), levels)
        size = -(-int(block["size"].iloc[0]) // (1 << (len(nodes) - 1)))
        rows = [(block["tree"].iloc[0], int(block["block"].iloc[0]), size, nodes[-1][0])]
        return pd.DataFrame(rows, columns=["tree", "place", "size", "digest"])

    return run


def _paths(block: pd.DataFrame, outer: pd.DataFrame, levels: int) -> Iterator[tuple[list[str], list[str]]]:
    """Local and outer part of the path of every row of a sorted superblock."""
    nodes = _block_nodes(block, levels)
    beyond = [step for step in outer["path"].iloc[0].split(",") if step]
    for at in range(len(block)):
        yield siblings(nodes, at), beyond


def _descend(levels: int):
    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        paths = [",".join([*near, *far]) for near, far in _paths(block, outer, levels)]
        names = {"tree": block["tree"], "block": block["place"], "path": paths}
        return pd.DataFrame(names).assign(subroot=outer["subroot"].iloc[0], root=outer["root"].iloc[0])

    return run


def _prove(levels: int, with_proof: bool):
    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        above: dict[str, str] = {}  # folds of the outer part by the block's digest; most are one
        rows = []
        for key, digest, claimed, (near, far) in zip(
            block["key"], block["digest"], block["claimed"], _paths(block, outer, levels)
        ):
            proof = _hash("".join(step[1:] for step in [*near, *far]))
            top = fold(claimed or digest, near)
            if top not in above:
                above[top] = fold(top, far)
            rows.append((key, digest, proof, above[top], ",".join([*near, *far]) if with_proof else None))
        out = pd.DataFrame(rows, columns=["key", "leaf", "proof_sha256", "folded_root", "proof"])
        out = out.assign(subroot=outer["subroot"].iloc[0], root=outer["root"].iloc[0])
        return out if with_proof else out.drop(columns="proof")

    return run


def _up(nodes: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """The nodes of every superlevel, the lowest first; the last holds one node of every tree."""
    out = [nodes.select("tree", "place", "size", "digest")]
    while largest > 1 or len(out) == 1:
        blocks = _in_blocks(out[-1], levels).groupBy("tree", "block")
        out.append(stored(blocks.applyInPandas(_climb(levels), NODES), "merkle-nodes"))
        largest = -(-largest // (1 << levels))
    return out


def _cogrouped(nodes: DataFrame, outer: DataFrame, levels: int):
    blocks = _in_blocks(nodes, levels).groupBy("tree", "block")
    return blocks.cogroup(outer.groupBy("tree", "block"))


def _down(superlevels: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """Outer paths of the superblocks of the lowest superlevel, from those of the roots."""
    for nodes in reversed(superlevels[1:-1]):
        found = _cogrouped(nodes, outer, levels).applyInPandas(_descend(levels), OUTER)
        outer = stored(found, "merkle-outer")
    return outer


def manifest(
    docs: DataFrame,
    group: str = "lang",
    order: str = "doc_id",
    fields: Sequence[str] = FIELDS,
    claimed: Column | None = None,
    with_proof: bool = False,
    levels: int = LEVELS,
) -> DataFrame:
    """Every row with its leaf, the roots above it, its proof and what its claimed leaf folds to.

    A leaf is the digest of ``fields``. Inside a value of ``group`` leaves ascend by ``order`` (null
    first, then the leaf), every two neighbours become their digest until one is left, the subroot; a
    last single node is hashed alone, and a lone leaf is the subroot itself. The subroots, null
    first and then by the bytes of the group, give the root the same way. ``claimed`` is the leaf
    digest to be verified, null or left out where it is the leaf itself.

    Returns the ``order`` column, leaf, subroot, root, proof_sha256 (digest of the siblings on the
    way to the root), folded_root, verified and, ``with_proof``, the proof: steps joined by commas, L
    or R before the sibling on that side, A where a node is alone. A superblock has ``2**levels``
    places. Null values, empty texts, null
    groups and ids are values like others; repeated rows are leaves of their own; an empty table gives
    an empty result; other columns play no part.
    """
    spark = docs.sparkSession
    name = F.col(group).cast("string")
    leaves = docs.select(
        F.when(name.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name)).alias("tree"),
        F.col(order).alias("sort_key"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"),
        (F.lit(None) if claimed is None else claimed).cast("string").alias("claimed"),
    )
    leaves = with_row(leaves, "merkle-leaves")
    placed = stored(
        numbered(leaves, "tree", ["sort_key", "digest", "row_id"]).withColumnRenamed("in_group", "size"),
        "merkle-placed",
    )
    sizes = placed.groupBy("tree").agg(F.max("size").alias("n")).agg(F.max("n"), F.count("*")).first()
    largest, trees = sizes[0] or 1, sizes[1]
    superlevels = _up(placed, largest, levels)
    tops = superlevels[-1].select(F.lit("").alias("forest"), F.col("tree").alias("name"), "digest")
    tops = numbered(tops, "forest", ["name"]).withColumnRenamed("in_group", "size")
    tops = stored(tops, "merkle-tops")
    forest = tops.select(F.col("forest").alias("tree"), "place", "size", "digest")
    above = _up(forest, trees, levels)
    nothing = F.lit("")
    root = above[-1].select(
        "tree",
        F.lit(0).cast("long").alias("block"),
        nothing.alias("path"),
        nothing.alias("subroot"),
        F.col("digest").alias("root"),
    )
    outer = _down(above, root, levels)
    paths = _cogrouped(forest, outer, levels).applyInPandas(_descend(levels), OUTER).select(F.col("block").alias("place"), "path", "root")
    outer = tops.join(paths, "place").select(
        F.col("name").alias("tree"),
        F.lit(0).cast("long").alias("block"),
        "path",
        F.col("digest").alias("subroot"),
        "root",
    )
    outer = _down(superlevels, stored(outer, "merkle-outer"), levels)
    held = placed.select(
        "tree", "place", "size", "digest", "claimed", F.col("sort_key").cast("string").alias("key")
    )
    kind = PROVEN + (", proof string" if with_proof else "")
    proven = _cogrouped(held, outer, levels).applyInPandas(_prove(levels, with_proof), kind)
    return proven.select(
        F.col("key").cast(docs.schema[order].dataType).alias(order),
        "leaf",
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
        *(["proof"] if with_proof else []),
    )
