"""Removal of repeated passages with a logarithmic family of sparse suffix arrays.

Every 400-byte window is owned by an anchor: the position of its smallest k-gram, which equal windows
share wherever they stand. An anchor and the bytes of its windows form a suffix entry. Entries are
indexed in batches: each batch becomes an array sorted by the entries' common core, is merge-scanned
with the levels already there for windows of equal bytes, and levels of equal size are merged. Entries
whose k-gram occurs once in the whole table match nothing and are left out before.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgrid.llm.common import remove, row_key, small_batches, stored, stored_at
from meritgrid.llm.near import text_word_lists

LENGTH = 400
GRAM = 64
BLOCKS = 4
BATCHES = 4
SEGMENT = 1 << 20
SCAN_ROWS = 8192
PLACE_BITS = 24
SEED = 90_001

ANCHORS = "key long, place long, gram long, context_a long, context_b long"
ENTRIES = (
    "core long, check long, context_a long, context_b long, block int, low int, high int, "
    "margin binary"
)
HITS = "context_a long, context_b long, low int, high int"


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


class Rolling:
    """Hashes of any substring of a buffer from prefix sums modulo 2**64."""

    def __init__(self, which: int):
        random = np.random.default_rng(SEED + which)
        self.table = random.integers(1, 1 << 63, 256, np.uint64)
        base = int(random.integers(1, 1 << 62)) * 2 + 1
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (sums[stop] - sums[start]) * self.inverses[start]


@functools.lru_cache(maxsize=2)
def rolling(which: int) -> Rolling:
    return Rolling(which)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, by minima from both sides of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def buffer_anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Anchors of the windows inside the segments of a buffer.

    Returns, for each run of windows with a common anchor: its segment, the anchor, the first and
    last window, the k-gram's hash and two hashes of the run's bytes and shape.
    """
    first, second = rolling(0), rolling(1)
    sums, sums2 = first.sums(data), second.sums(data)
    places = np.arange(len(data) - gram + 1)
    grams = _mix(first.between(sums, places, places + gram))
    mask = np.uint64((1 << PLACE_BITS) - 1)
    minima = window_minima((grams & ~mask) | places.astype(np.uint64), length - gram + 1)
    inside = np.zeros(len(data) + 1, np.int64)
    long_enough = ends - begins >= length
    np.add.at(inside, begins[long_enough], 1)
    np.add.at(inside, ends[long_enough] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside)[: len(minima)] > 0)
    anchor = (minima[window] & mask).astype(np.int64)
    turn = np.ones(len(window), bool)
    turn[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(turn)
    last = np.append(at[1:], len(window))[: len(at)] - 1
    low, high, anchor = window[at], window[last], anchor[at]
    shape = _mix(((anchor - low) << 20 | (high - low)).astype(np.uint64) + np.uint64(7))
    context_a = _mix(first.between(sums, low, high + length) ^ shape)
    context_b = _mix(second.between(sums2, low, high + length) + shape)
    segment = np.searchsorted(begins, low, "right") - 1
    return segment, anchor, low, high, grams[anchor], context_a, context_b


def _buffers(texts: list, length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Bytes of texts gathered in buffers, with (row, offset in the text, offset in the buffer)."""
    parts, marks, size = [], [], 0
    for row, text in enumerate(texts):
        data = (text or "").encode()
        if len(data) < length:
            continue
        for start in range(0, len(data) - length + 1, SEGMENT):
            part = data[start : start + SEGMENT + length - 1]
            if parts and size + len(part) > SEGMENT:
                yield np.frombuffer(b"".join(parts), np.uint8), marks
                parts, marks, size = [], [], 0
            marks.append((row, start, size))
            parts.append(part)
            size += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), marks


def find_anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Anchors of every document: key of the row's values, place, k-gram and context hashes.

    ``place`` packs the anchor's position and its distance from the last and the first window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keys = batch.column("key").to_numpy()
            for data, marks in _buffers(batch.column("text").to_pylist(), length):
                row, offset, begin = (np.array(c, np.int64) for c in zip(*marks))
                ends = np.append(begin[1:], len(data))
                found = buffer_anchors(data, begin, ends, length, gram)
                segment, anchor, low, high, grams, context_a, context_b = found
                position = anchor - begin[segment] + offset[segment]
                place = position << 24 | (anchor - high) << 12 | (anchor - low)
                columns = [keys[row[segment]], place, grams, context_a, context_b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(np.int64)) for c in columns],
                    names=[part.split()[0] for part in ANCHORS.split(", ")],
                )

    keyed = docs.select(row_key("doc_id", "text").alias("key"), "text")
    return keyed.mapInArrow(run, ANCHORS)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 24, place >> 12 & 4095, place & 4095


def text_entries(data: np.ndarray, place: np.ndarray, length: int, gram: int):
    """Suffix entries of a text's anchors, one for each block of window distances that it has.

    All windows of a block contain its core; what tells them apart is the margin, the bytes before
    and after the core. Yields (which anchor, block, core hash, check hash, low, high, margin).
    """
    anchor, nearest, farthest = _unpack(place)
    width = -(-(length - gram + 1) // BLOCKS)
    first, second = rolling(0), rolling(1)
    sums, sums2 = first.sums(data), second.sums(data)
    raw = data.tobytes()
    for block in range(BLOCKS):
        begin = block * width
        low, high = np.maximum(nearest, begin), np.minimum(farthest, begin + width - 1)
        which = np.flatnonzero(low <= high)
        a, low, high = anchor[which], low[which], high[which]
        left, right = a - begin, a - (begin + width - 1) + length  # the core's ends
        salt = np.uint64(block + 1)
        core = _mix(first.between(sums, left, right) ^ _mix(np.full(len(a), salt, np.uint64)))
        check = _mix(second.between(sums2, left, right) + salt)
        before, after = (a - high).tolist(), (a - low + length).tolist()
        for i, (w, x, y) in enumerate(zip(which.tolist(), left.tolist(), right.tolist())):
            margin = raw[before[i] : x] + raw[y : after[i]]
            yield w, block, core[i], check[i], int(low[i]), int(high[i]), margin


def slice_entries(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """Entries of the ``wanted`` anchors (key, place, context_a, context_b), read from their texts."""
    lists = wanted.groupBy("key").agg(
        F.collect_list(F.struct("place", "context_a", "context_b")).alias("anchors")
    )
    texts = docs.select(row_key("doc_id", "text").alias("key"), "text").join(lists, "key")
    names = [part.split()[0] for part in ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 4, *[pa.int32()] * 3, pa.binary()]
        for batch in small_batches(batches):
            rows: list[tuple] = []
            for text, anchors in zip(
                batch.column("text").to_pylist(), batch.column("anchors").to_pylist()
            ):
                place = np.array([x["place"] for x in anchors], np.int64)
                data = np.frombuffer(text.encode(), np.uint8)
                for w, block, core, check, low, high, margin in text_entries(
                    data, place, length, gram
                ):
                    x = anchors[w]
                    rows.append(
                        (
                            int(core.astype(np.int64)),
                            int(check.astype(np.int64)),
                            x["context_a"],
                            x["context_b"],
                            block,
                            low,
                            high,
                            margin,
                        )
                    )
                if len(rows) >= SCAN_ROWS:
                    yield _record(rows, kinds, names)
                    rows = []
            if rows:
                yield _record(rows, kinds, names)

    return texts.select("text", "anchors").mapInArrow(run, ENTRIES)


def _record(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _owners(entries: DataFrame, parts: int) -> DataFrame:
    """Entries at the owner of their core's range, in core order."""
    owner = F.pmod(F.shiftrightunsigned("core", 40), F.lit(parts)).cast("int")
    return entries.repartitionById(parts, owner).sortWithinPartitions("core")


def match_windows(rows: pa.Table, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and ranges of window distances whose bytes another entry of the same core has too.

    ``width``: bytes of a window outside its core. Runs of equal windows without a new entry are
    skipped, as an earlier scan has reported them.
    """
    low, high = (rows.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
    core, check = (rows.column(c).to_numpy().view(np.uint64) for c in ("core", "check"))
    new = rows.column("new").to_numpy(zero_copy_only=False)
    margins = rows.column("margin").to_pylist()
    data = np.frombuffer(b"".join(margins), np.uint8)
    sizes = np.fromiter(map(len, margins), np.int64, len(margins))
    begin = np.cumsum(sizes) - sizes
    count = high - low + 1
    owner = np.repeat(np.arange(len(low)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start, distance = begin[owner] + step, high[owner] - step
    first = rolling(0)
    if width:
        hashes = first.between(first.sums(data), start, start + width)
    else:
        hashes = np.zeros(len(start), np.uint64)
    salt = _mix(core ^ _mix(check))
    keys = _mix(hashes ^ salt[owner] ^ _mix(distance.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    hit = np.zeros(len(keys), bool)
    if same.any():
        a, b = order[:-1][same], order[1:][same]
        span = np.arange(width)
        for i in range(0, len(a), 1 << 16):
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            equal = (data[start[x][:, None] + span] == data[start[y][:, None] + span]).all(axis=1)
            equal &= (core[owner[x]] == core[owner[y]]) & (check[owner[x]] == check[owner[y]])
            equal &= distance[x] == distance[y]
            if not equal.all():
                return _match_plainly(core, check, new, low, high, margins, width)
        run = np.concatenate([[0], np.cumsum(~same)])  # number of each run of equal windows
        fresh = np.bincount(run, new[owner[order]]) > 0
        many = np.bincount(run) > 1
        hit[order] = (fresh & many)[run]
    return _ranges(hit, owner, distance)


def _ranges(hit: np.ndarray, owner: np.ndarray, distance: np.ndarray):
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    turn = np.ones(len(at), bool)
    turn[1:] = (np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1])
    begins = np.flatnonzero(turn)
    ends = np.append(begins[1:], len(at)) - 1
    return [(owner[at[begins]], distance[at[ends]], distance[at[begins]])]


def _match_plainly(core, check, new, low, high, margins, width):
    """The same by a dictionary of bytes, for rows in which two different windows hash alike."""
    groups: dict[tuple, list] = {}
    for i, margin in enumerate(margins):
        for step in range(int(high[i] - low[i]) + 1):
            d = int(high[i]) - step
            key = (int(core[i]), int(check[i]), d, margin[step : step + width])
            groups.setdefault(key, []).append(i)
    found = [
        (i, key[2], key[2])
        for key, own in groups.items()
        if len(own) > 1 and any(new[i] for i in own)
        for i in own
    ]
    return [tuple(np.array(c, np.int64) for c in zip(*found))] if found else []


def _scan(length: int, gram: int):
    width = -(-(length - gram + 1) // BLOCKS) - 1
    names = [part.split()[0] for part in HITS.split(", ")]

    def report(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for at, low, high in match_windows(rows, width):
            a = rows.column("context_a").to_numpy()[at]
            b = rows.column("context_b").to_numpy()[at]
            columns = [a, b, low.astype(np.int32), high.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < SCAN_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cores = table.column("core").to_numpy()
            cut = int(np.searchsorted(cores, cores[-1], "left"))  # the last core may go on
            if cut:
                yield from report(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).combine_chunks().to_batches()
                size = table.num_rows - cut
        if held:
            yield from report(pa.Table.from_batches(held).combine_chunks())

    return run


class IndexFamily:
    """Levels of sorted entries; adding a batch scans them all and merges levels of equal size."""

    def __init__(self, parts: int, length: int, gram: int):
        self.parts, self.length, self.gram = parts, length, gram
        self.levels: list[tuple[int, DataFrame, str]] = []  # batches in it, entries, path

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch; returns the window ranges that it shares with itself or a level."""
        fresh, path = stored_at(_owners(batch, self.parts), "suffix-level")
        both = fresh.withColumn("new", F.lit(True))
        for _, level, _ in self.levels:
            both = both.unionByName(level.withColumn("new", F.lit(False)))
        scanned = _owners(both, self.parts).mapInArrow(_scan(self.length, self.gram), HITS)
        hits = stored(scanned, "suffix-hits")
        self.levels.append((1, fresh, path))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, low, low_path), (m, high, high_path) = self.levels.pop(), self.levels.pop()
            merged, path = stored_at(_owners(low.unionByName(high), self.parts), "suffix-level")
            self.levels.append((n + m, merged, path))
            for old in (low_path, high_path):
                remove(batch.sparkSession, old)
        return hits

    def close(self, spark) -> None:
        for _, _, path in self.levels:
            remove(spark, path)
        self.levels = []


def release_shuffles(spark) -> None:
    """Let Spark delete the shuffle files of finished jobs: its cleaner follows the driver's GC."""
    spark.sparkContext._jvm.System.gc()


def repeated_ranges(docs: DataFrame, length: int, gram: int, batches: int) -> DataFrame:
    """Byte ranges covered by windows that start anywhere else too: key, start, stop."""
    spark = docs.sparkSession
    anchors = stored(find_anchors(docs, length, gram), "anchors")
    context = ["gram", "context_a", "context_b"]
    contexts, contexts_path = stored_at(
        anchors.groupBy(*context).agg(
            F.count("*").alias("copies"), F.min(F.struct("key", "place")).alias("sample")
        ),
        "contexts",
    )
    grams = contexts.groupBy("gram").agg(
        F.count("*").alias("n"), F.sum("copies").alias("copies_of_gram")
    )
    grams = grams.where("copies_of_gram > 1").select("gram", "n")
    common, _ = stored_at(contexts.join(grams, "gram"), "common-contexts")
    remove(spark, contexts_path)
    release_shuffles(spark)
    mixed = common.where("n > 1").select("sample.*", "context_a", "context_b")
    entries, entries_path = stored_at(slice_entries(docs, mixed, length, gram), "suffix-entries")
    release_shuffles(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    family = IndexFamily(parts, length, gram)
    copied = common.where("copies > 1").select(
        "context_a",
        "context_b",
        F.shiftright(F.col("sample.place"), 12).bitwiseAND(4095).cast("int").alias("low"),
        F.col("sample.place").bitwiseAND(4095).cast("int").alias("high"),
    )
    for i in range(batches):
        part = entries.where(F.pmod(F.xxhash64("context_a"), F.lit(batches)) == i)
        copied = copied.unionByName(family.add(part))
        release_shuffles(spark)
    family.close(spark)
    pair = ["context_a", "context_b"]
    spans = copied.groupBy(*pair).agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    spans = stored(spans, "suffix-spans")
    remove(spark, entries_path)
    release_shuffles(spark)
    position = F.shiftrightunsigned("place", 24)
    return (
        anchors.select("key", "place", *pair)
        .join(spans, pair)
        .select("key", position.alias("at"), F.inline("spans"))
        .select(
            "key",
            (F.col("at") - F.col("high")).alias("start"),
            (F.col("at") - F.col("low") + length).alias("stop"),
        )
    )


WORDS = 51  # a passage of over 50 words
WORD_GRAM = 25


def _word_windows(words: np.ndarray, sizes: list[int], length: int, gram: int):
    """Row, hash and smallest gram of every window of ``length`` words inside one text."""
    sizes = np.array(sizes, np.int64)
    begins = np.cumsum(sizes) - sizes
    if len(words) < length:
        return (np.empty(0, np.int64), *[np.empty(0, np.uint64)] * 2)
    roll = rolling(0)
    roll._grow(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * roll.powers[: len(words)], out=sums[1:])
    places = np.arange(len(words) - gram + 1)
    grams = _mix(roll.between(sums, places, places + gram))
    smallest = window_minima(grams, length - gram + 1)
    row = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - length + 1))
    at = np.concatenate([np.arange(b, b + max(0, n - length + 1)) for b, n in zip(begins, sizes)])
    return row, _mix(roll.between(sums, at, at + length)), smallest[at]


def _each_words(batches: Iterator[pa.RecordBatch], length: int, gram: int):
    """Batches of bounded text with the windows of their texts (see ``_word_windows``)."""
    for batch in small_batches(batches):
        words, sizes = text_word_lists(batch.column("text").to_pylist())
        yield batch, *_word_windows(words, sizes, length, gram)


def shared_windows(docs: DataFrame, length: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """``key, copied, n_shared_windows``: windows of ``length`` words that another document has too.

    Words are lower-cased runs between spaces. Equal windows have the same smallest gram, so only the
    windows of grams that several texts have are compared, by their 64-bit hashes, and each text once:
    where another document has the whole text (``copied``) all its windows are shared, and the number
    says only how many of them other texts have.
    """
    spark = docs.sparkSession
    rows = docs.select(row_key("doc_id", "text").alias("key"), F.xxhash64("text").alias("whole"), "text")

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, _, smallest in _each_words(batches, length, gram):
            turn = np.ones(len(row), bool)  # neighbouring windows mostly have the same smallest gram
            turn[1:] = (row[1:] != row[:-1]) | (smallest[1:] != smallest[:-1])
            keys = batch.column("whole").to_numpy()[row[turn]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(smallest[turn].view(np.int64))], names=["whole", "gram"]
            )

    grams, grams_path = stored_at(rows.select("whole", "text").mapInArrow(grams_of, "whole long, gram long"), "word-grams")
    several = grams.groupBy("gram").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b")
    lists = grams.join(several.select("gram"), "gram").groupBy("whole").agg(F.collect_set("gram").alias("grams"))
    ends = [F.min("key").alias("first"), F.max("key").alias("last")]
    texts = stored(rows.select("key", "whole").groupBy("whole").agg(*ends), "word-texts")
    read = lists.join(texts.select("whole", F.col("first").alias("key")), "whole")

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, window, smallest in _each_words(batches, length, gram):
            wanted = batch.column("grams").to_pylist()
            cuts = np.searchsorted(row, np.arange(len(wanted) + 1))
            found = []
            for own, i, j in zip(wanted, cuts, cuts[1:]):
                held = np.isin(smallest[i:j].view(np.int64), np.array(own, np.int64))
                found.append(np.unique(window[i:j][held].view(np.int64), return_counts=True))
            whole = np.repeat(batch.column("whole").to_numpy(), [len(n) for _, n in found])
            different, n = (np.concatenate(c) for c in zip(*found))
            columns = [pa.array(whole), pa.array(different), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["whole", "window", "n"])

    # a row may come twice, with the same id and text: its windows are the same then
    some = rows.select("key", "text").join(read, "key").select("whole", "grams", "text")
    windows = some.mapInArrow(windows_of, "whole long, window long, n int")
    windows, windows_path = stored_at(windows, "word-windows")
    remove(spark, grams_path)
    release_shuffles(spark)
    shared = windows.groupBy("window").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b")
    found = windows.join(shared.select("window"), "window").distinct().groupBy("whole").agg(F.sum("n").alias("n"))
    found = stored(found, "shared-windows")
    remove(spark, windows_path)
    release_shuffles(spark)
    facts = texts.join(found, "whole", "left").where("n IS NOT NULL OR first <> last")
    facts = facts.select("whole", (F.col("first") != F.col("last")).alias("copied"), "n")
    counted = F.coalesce("n", F.lit(0)).cast("long").alias("n_shared_windows")
    return rows.select("key", "whole").distinct().join(facts, "whole").select("key", "copied", counted)


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SHARED = ", n_shared_windows long"


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by ranges; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def remove_passages(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int | None = None,
    batches: int = BATCHES,
    with_text: bool = False,
) -> DataFrame:
    """Every text without the bytes of ``length``-byte strings that also start anywhere else.

    Texts are judged as UTF-8 bytes on the input; matches stay inside a document but may repeat in
    the same one; overlapping strings all count. Returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and n_shared_windows (windows of 51 words that a document of another id or
    text has too, which may be shorter than ``length`` bytes and then stay); ``with_text`` adds spans
    (start, stop) and the remaining bytes.
    A null text counts as empty; repeated rows are copies of each other and lose all but what is
    shorter than ``length``; null ids are documents like others; an empty table gives an empty
    result; other columns are ignored.
    """
    gram = gram or max(1, min(GRAM, length // 4))
    ranges = repeated_ranges(docs, length, gram, batches)
    lists = ranges.distinct().groupBy("key").agg(
        F.collect_list(F.struct("start", "stop")).alias("ranges")
    )
    facts = lists.join(shared_windows(docs), "key", "full")
    texts = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    joined = texts.join(facts, "key", "left").select("doc_id", "text", "ranges", "copied", "n_shared_windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows, spans, kept_bytes = [], [], []
            for text, found in zip(
                batch.column("text").to_pylist(), batch.column("ranges").to_pylist()
            ):
                data = (text or "").encode()
                runs = merged([(r["start"], r["stop"]) for r in found or []])
                digest, last, removed, kept = hashlib.sha256(), 0, 0, []
                for start, stop in [*runs, (len(data), len(data))]:
                    digest.update(data[last:start])
                    if with_text:
                        kept.append(data[last:start])
                    removed += stop - start
                    last = stop
                rows.append((len(data), removed, len(runs), digest.hexdigest()))
                spans.append([{"start": a, "stop": b} for a, b in runs])
                kept_bytes.append(b"".join(kept))
            columns = list(zip(*rows)) if rows else [()] * 4
            arrays = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]]]
            own = zip(*[batch.column(c).to_pylist() for c in ("text", "copied", "n_shared_windows")])
            windows = [max(0, len((t or "").encode().split()) - WORDS + 1) if copied else n or 0 for t, copied, n in own]
            arrays += [pa.array(columns[3], pa.string()), pa.array(windows, pa.int64())]
            names = [part.split()[0] for part in (REMOVED + SHARED).split(", ")]
            if with_text:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                arrays += [pa.array(spans, kind), pa.array(kept_bytes, pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    extra = ", spans array<struct<start:long,stop:long>>, kept binary" if with_text else ""
    return joined.mapInArrow(run, REMOVED + SHARED + extra)
