"""Histogram sort into shards of equal bytes, with DataFrame operations only.

Documents are ordered by a 128-bit key: the hash of the text, 44 bits of the hash of the id and 20 bits
of the hash of a row number, so equal texts lie together and even equal rows can be divided. Splitters are found by rounds of exact byte counts: each round counts the bytes
of every key cell that still holds a wanted boundary, eight key bits finer, until the bytes below a
cell edge are within the tolerance. The rows then cross the network once, to their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.llm.common import filled, stored

KEY_BITS = 64
STEP = 8
SMALLEST = -(1 << 63)
ROW_BITS = (1 << 20) - 1

Splitter = tuple[int, int]


class _Probe:
    """One wanted boundary: its byte target and the cell it is searched in."""

    def __init__(self, target: float, tolerance: float):
        self.target, self.tolerance = target, tolerance
        self.below = 0
        self.cell: tuple[int, int] = (0, 0)  # prefix of the first and of the second key half
        self.settled = False
        self.splitter: Splitter | None = None  # None when settled past the last key


def _edge(depth: int, cell: tuple[int, int], after: bool) -> Splitter | None:
    """Smallest key of a cell, or of the cell after it; None past the last key."""
    first, second = cell
    if depth <= KEY_BITS:
        shift = KEY_BITS - depth
        first += 1 if after else 0
        return None if first << shift >= 1 << 63 else (first << shift, SMALLEST)
    shift = 2 * KEY_BITS - depth
    second += 1 if after else 0
    if second << shift < 1 << 63:
        return first, second << shift
    return None if first + 1 >= 1 << 63 else (first + 1, SMALLEST)


def _cell_columns(depth: int) -> tuple[Column, Column]:
    if depth <= KEY_BITS:
        return F.shiftright("first_key", KEY_BITS - depth), F.lit(0).cast("long")
    return F.col("first_key"), F.shiftright("second_key", 2 * KEY_BITS - depth)


def _histogram(keys: DataFrame, depth: int, parents: set[tuple[int, int]] | None) -> dict:
    """Exact bytes of every cell at ``depth`` bits, of the cells in ``parents`` only.

    At most 2**STEP rows for each parent, and parents are at most as many as the boundaries.
    """
    if parents is not None:
        first, second = _cell_columns(depth - STEP)
        if depth - STEP < KEY_BITS:
            keys = keys.where(first.isin([p[0] for p in parents]))
        else:
            names = [f"{a}:{b}" for a, b in parents]
            keys = keys.where(F.concat_ws(":", first, second).isin(names))
    first, second = _cell_columns(depth)
    rows = keys.groupBy(first.alias("a"), second.alias("b")).agg(F.sum("size").alias("n")).collect()
    return {(r.a, r.b): r.n for r in rows}


def _parent(depth: int, cell: tuple[int, int]) -> tuple[int, int]:
    if depth - STEP < KEY_BITS:
        return cell[0] >> STEP, 0
    if depth - STEP == KEY_BITS:
        return cell[0], 0
    return cell[0], cell[1] >> STEP


def find_splitters(
    keys: DataFrame, shards: int, cells_per_shard: int, tolerance: float
) -> list[Splitter]:
    """Cell edges whose exact bytes below are within ``tolerance`` shard sizes of equal parts."""
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return []
    parts = shards * cells_per_shard
    probes = []
    for i in range(1, parts):
        inner = i % cells_per_shard != 0
        probes.append(_Probe(total * i / parts, tolerance * total / shards * (20 if inner else 1)))
    live, parents = probes, None
    for depth in range(STEP, 2 * KEY_BITS + 1, STEP):
        counts = _histogram(keys, depth, parents)
        by_parent: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for cell in sorted(counts):
            by_parent.setdefault(_parent(depth, cell) if parents else (0, 0), []).append(cell)
        for probe in live:
            below = probe.below
            cells = by_parent[probe.cell]
            for cell in cells:
                if below + counts[cell] >= probe.target or cell == cells[-1]:
                    break
                below += counts[cell]
            low, high = probe.target - below, below + counts[cell] - probe.target
            if min(abs(low), abs(high)) <= probe.tolerance or depth == 2 * KEY_BITS:
                probe.splitter = _edge(depth, cell, after=abs(high) < abs(low))
                probe.settled = True
            probe.below, probe.cell = below, cell
        live = [p for p in live if not p.settled]
        if not live:
            break
        parents = {p.cell for p in live}
    past = ((1 << 63) - 1, (1 << 63) - 1)
    return [past if p.splitter is None else p.splitter for p in probes]


def _cell_of(splitters: list[Splitter], low: int, high: int) -> Column:
    """Number of splitters at or below the key, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    a, b = splitters[middle]
    above = (F.col("first_key") > a) | ((F.col("first_key") == a) & (F.col("second_key") >= b))
    right, left = _cell_of(splitters, middle + 1, high), _cell_of(splitters, low, middle)
    return F.when(above, right).otherwise(left)


def histogram_shards(
    docs: DataFrame,
    shards: int = 24,
    cells_per_shard: int = 8,
    tolerance: float = 0.0005,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document with the shard and slot that give shards of near equal bytes.

    A document's size is its UTF-8 bytes plus 8; a null text counts as empty. Shards differ by
    ``tolerance`` of a shard and one document at most. Equal texts are neighbours; a group of them
    that crosses a boundary is divided by id, and rows equal in text and id by a row number, which
    the stored key table fixes. A null id is a value like any other. Slots number a shard's rows from 0 without a gap. An empty table gives
    an empty result; other columns of ``docs`` play no part.
    """
    text = filled(text_col)
    by_id = F.xxhash64(F.col(id_col), F.lit("order")).bitwiseAND(~ROW_BITS)
    by_row = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(ROW_BITS)
    keys = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("first_key"),
            by_id.bitwiseOR(by_row).alias("second_key"),
        ),
        "shard-keys",
    )
    splitters = find_splitters(keys, shards, cells_per_shard, tolerance)
    cells = shards * cells_per_shard
    cell = _cell_of(splitters, 0, len(splitters)).cast("int").alias("cell")
    dealt = (
        keys.select("*", cell)
        .repartitionById(cells, F.col("cell"))
        .sortWithinPartitions("first_key", "second_key", "doc_id")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "cell",
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
        )
    )
    dealt = stored(dealt, "shard-rows")
    counts = {r.cell: r.n for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    starts, run = [], 0
    for i in range(cells):
        run = 0 if i % cells_per_shard == 0 else run
        starts.append(run)
        run += counts.get(i, 0)
    offsets = F.array(*[F.lit(n).cast("long") for n in starts])
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("cell") / cells_per_shard).cast("int").alias("shard"),
        (F.col("place") + F.get(offsets, F.col("cell"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
