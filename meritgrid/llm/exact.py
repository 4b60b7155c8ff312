"""Exact dedup on an extendible-hash index kept in shared files.

The key of a text is its 64-bit hash. A directory maps the top bits of a key to a bucket; a bucket
with too much text is split by one more bit, and the directory doubles when no spare bit is left. A
bucket that holds one hash only cannot be split and chains its entries. Each bucket has an owner
task, which gets the copies of its key range, already combined where they were read, walks them in
key order and compares bytes inside every chain. The entries are stored per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.llm.common import filled, lower_ascii, new_path, row_key, stored

ENTRY = (
    "bucket int, hash long, chain int, text_sha256 string, n_bytes long, keep_id long, "
    "group_size long"
)

class Directory:
    """Global depth, the bucket of every slot, and each bucket's local depth."""

    def __init__(self) -> None:
        self.depth = 0
        self.slots = [0]
        self.local = [0]

    def split(self, bucket: int) -> None:
        """Give the upper half of a bucket's slots to a new bucket, doubling first if it has one."""
        if self.local[bucket] == self.depth:
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.depth += 1
        self.local[bucket] += 1
        self.local.append(self.local[bucket])
        own = [i for i, b in enumerate(self.slots) if b == bucket]
        for i in own[len(own) // 2 :]:
            self.slots[i] = len(self.local) - 1

    def ranges(self) -> list[int]:
        """Buckets renumbered in key order, so that owners hold neighbouring key ranges."""
        order: dict[int, int] = {}
        return [order.setdefault(b, len(order)) for b in self.slots]


def _cells(keys: DataFrame, depth: int) -> dict[int, tuple[int, bool]]:
    """Bytes under every prefix of ``depth`` bits, and whether they are of a single hash."""
    rows = (
        keys.groupBy(F.shiftrightunsigned("hash", 64 - depth).alias("p"))
        .agg(
            F.sum("n_bytes").alias("n"),
            F.min("hash").alias("low"),
            F.max("hash").alias("high"),
        )
        .collect()
    )
    return {r.p: (r.n, r.low == r.high) for r in rows}


def build_directory(keys: DataFrame, capacity: int, max_depth: int = 12) -> Directory:
    """Split until every bucket holds ``capacity`` bytes, one hash, or has ``max_depth`` bits.

    The driver sees one count for each prefix of ``max_depth`` bits, 4,096 at most; ``n_bytes``
    must count each text about once (see ``dedup_exact``).
    """
    cells = _cells(keys, max_depth)
    directory = Directory()
    todo = [0]
    while todo:
        bucket = todo.pop()
        width = 1 << (max_depth - directory.depth)
        inside = [
            cells[c]
            for i, b in enumerate(directory.slots)
            if b == bucket
            for c in range(i * width, (i + 1) * width)
            if c in cells
        ]
        held = sum(n for n, _ in inside)
        single = len(inside) <= 1 and all(one for _, one in inside)
        if held > capacity and not single and directory.local[bucket] < max_depth:
            directory.split(bucket)
            todo += [bucket, len(directory.local) - 1]
    return directory


def _combine(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each different text of a batch: its count and largest id."""
    groups: dict[bytes, list] = {}
    hashes, ids = batch.column("hash").to_pylist(), batch.column("doc_id").to_pylist()
    for text, key, doc in zip(batch.column("text").to_pylist(), hashes, ids):
        found = groups.get(text)
        if found is None:
            groups[text] = [key, 1, doc]
        else:
            found[1] += 1
            if doc is not None and (found[2] is None or doc > found[2]):
                found[2] = doc
    return pa.RecordBatch.from_arrays(
        [
            pa.array([g[0] for g in groups.values()], pa.int64()),
            pa.array(list(groups), pa.binary()),
            pa.array([g[1] for g in groups.values()], pa.int64()),
            pa.array([g[2] for g in groups.values()], pa.int64()),
        ],
        names=["hash", "text", "n", "keep_id"],
    )


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _combine(batch)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of an owner's buckets from rows in key order; holds the chain of one hash."""
    import hashlib

    out: list[tuple] = []
    current: int | None = None
    bucket = 0
    chain: dict[bytes, list] = {}

    def close() -> None:
        for place, (text, (n, keep)) in enumerate(chain.items()):
            out.append(
                (bucket, current, place, hashlib.sha256(text).hexdigest(), len(text), keep, n)
            )
        chain.clear()

    def flush() -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 3]
        columns = list(zip(*out)) or [()] * 7
        names = [part.split()[0] for part in ENTRY.split(", ")]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
        )
        out.clear()
        return batch

    for batch in batches:
        names = ["hash", "bucket", "text", "n", "keep_id"]
        for key, b, text, n, doc in zip(*(batch.column(c).to_pylist() for c in names)):
            if key != current:
                close()
                current, bucket = key, b
            found = chain.get(text)  # a dict lookup compares the bytes of equal hashes
            if found is None:
                chain[text] = [n, doc]
            else:
                found[0] += n
                if doc is not None and (found[1] is None or doc > found[1]):
                    found[1] = doc
        if len(out) >= 4096:
            yield flush()
    close()
    yield flush()


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def build_index(
    docs: DataFrame, keys: DataFrame, hash_of=_hash, capacity: int | None = None
) -> DataFrame:
    """Entries (one for each different text) of ``docs``: doc_id, text; ``keys``: hash, n_bytes."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if capacity is None:
        total = keys.agg(F.sum("n_bytes")).first()[0] or 0
        capacity = min(64 << 20, max(1, total // (2 * partitions)))
    directory = build_directory(keys, capacity)
    slots = directory.ranges()
    slot = F.shiftrightunsigned("hash", 64 - directory.depth).cast("int")
    bucket = F.get(F.array(*map(F.lit, slots)), slot) if directory.depth else F.lit(0)
    rows = (
        docs.select(hash_of(F.col("text")).alias("hash"), F.col("text").cast("binary"), "doc_id")
        .mapInArrow(_combined, "hash long, text binary, n long, keep_id long")
        .select("*", bucket.cast("int").alias("bucket"))
        .repartitionById(max(slots) + 1, F.col("bucket"))
        .sortWithinPartitions("hash")
    )
    path = new_path(spark, "hash-index")
    rows.mapInArrow(_chains, ENTRY).write.partitionBy("bucket").parquet(path)
    return spark.read.schema(ENTRY).parquet(path)


def dedup_exact(docs: DataFrame, hash_of=_hash, capacity: int | None = None) -> DataFrame:
    """For every document the row of its group of equal texts that stays.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The largest
    ``doc_id`` of a group stays (null ids rank below all; a group of null ids alone keeps id null).
    Returns doc_id, keep_id, group_size (rows, repeated rows included), kept, text_sha256, n_bytes
    of the normalised text. A row repeated with the id that stays is kept each time it comes; a
    null id is kept only where the whole group has none. Other columns are ignored, an empty table
    gives an empty result. ``hash_of`` and ``capacity`` (bytes in a bucket) are there for tests.
    """
    texts = docs.select("doc_id", lower_ascii(filled()).alias("text"))
    keys = stored(
        texts.select(
            "doc_id",
            hash_of(F.col("text")).alias("hash"),
            F.sha2("text", 256).alias("text_sha256"),
            F.octet_length("text").cast("long").alias("n_bytes"),
        ),
        "exact-keys",
    )
    entries = build_index(texts, keys.select("hash", "n_bytes"), hash_of, capacity)
    return match_entries(keys, entries)


HOT_GROUPS = 1024


def match_entries(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Give every document its entry by hash and digest.

    Groups with more than 1/1024 of all rows are at most 1,024 entries and go by broadcast, so no
    task gathers the rows of such a group; the others are joined by hash.
    """
    found = ["hash", "text_sha256"]
    rows = keys.count()
    hot = entries.where(F.col("group_size") > max(1, rows // HOT_GROUPS)).limit(HOT_GROUPS)
    picked = hot.select(*found, "keep_id", "group_size", F.lit(True).alias("hot"))
    tagged = keys.join(F.broadcast(picked), found, "left")
    columns = ["doc_id", "keep_id", "group_size", "text_sha256", "n_bytes"]
    first = tagged.where("hot").select(columns)
    rest = tagged.where("hot IS NULL").drop("keep_id", "group_size", "hot")
    second = rest.join(
        entries.select(*found, "keep_id", "group_size"), found
    ).select(columns)
    return first.unionByName(second).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "n_bytes",
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``dedup_exact`` keeps, with their columns, each once."""
    kept = dedup_exact(docs).where("kept")
    kept = kept.select(row_key("doc_id", "text_sha256").alias("key"), "text_sha256").distinct()
    named = docs.select(F.struct(*docs.columns).alias("row")).select(
        "row", F.sha2(lower_ascii(F.coalesce("row.text", F.lit(""))), 256).alias("text_sha256")
    )
    named = named.select("*", row_key("row.doc_id", "text_sha256").alias("key"))
    key = ["key", "text_sha256"]
    return named.join(kept, key, "left_semi").dropDuplicates(key).select("row.*")
