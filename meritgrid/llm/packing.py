"""Order-preserving packing by dynamic programming with a monotone queue.

Each input partition is one stream of documents in their order. The stream is cut into windows of at
most the sequence length; cuts stand at document ends, at sentence ends, or where a sentence is
longer than a window, inside it. The cost of a plan is its padding plus a penalty for every cut that
does not end a document. With ``g(i) = cost(i) + position(i)`` the cheapest predecessor of a cut is
the smallest ``g`` in a sliding range of positions, which a monotone queue gives in constant time.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from meritgrid.llm.bpe import encoder
from meritgrid.llm.common import small_batches

LENGTH = 2048
END_ID = 1
SENTENCE_PENALTY = 8
INSIDE_PENALTY = 24
SPARE_CUTS = 64
CHUNK_WINDOWS = 256

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long"
)


def sentence_ends(ids: np.ndarray, enders: np.ndarray) -> np.ndarray:
    """Positions after tokens that end a sentence, within the document."""
    return np.flatnonzero(enders[np.minimum(ids, len(enders) - 1)]) + 1


def cut_points(
    size: int, document_ends: np.ndarray, ends: np.ndarray, length: int, begin: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions of a stream of ``size`` tokens, from ``begin``, and their penalties.

    Document ends cost nothing, sentence ends a little; every ``SPARE_CUTS`` tokens a cut inside a
    sentence is offered at a higher price, so that no gap exceeds a window.
    """
    step = max(1, min(SPARE_CUTS, length))
    inside = np.arange(begin + step, size, step)
    points = np.concatenate([inside, ends, document_ends, [size]]).astype(np.int64)
    penalties = np.repeat(
        np.array([INSIDE_PENALTY, SENTENCE_PENALTY, 0, 0], np.int64),
        [len(inside), len(ends), len(document_ends), 1],
    )
    order = np.lexsort((penalties, points))
    points, penalties = points[order], penalties[order]
    first = np.ones(len(points), bool)
    first[1:] = points[1:] != points[:-1]
    keep = first & (points > begin) & (points <= size)
    return points[keep], penalties[keep]


def plan_windows(
    points: np.ndarray, penalties: np.ndarray, length: int, begin: int = 0
) -> list[int]:
    """Cut positions of the cheapest plan that ends at the last point.

    A window's padding is what it lacks to ``length``.
    """
    position = [begin, *points.tolist()]
    penalty = [0, *penalties.tolist()]
    n = len(position)
    reduced, back = [begin] * n, [0] * n  # reduced: cost + position
    queue: deque[int] = deque([0])
    for j in range(1, n):
        p = position[j]
        while p - position[queue[0]] > length:
            queue.popleft()
        back[j] = queue[0]
        value = reduced[j] = reduced[queue[0]] + length + penalty[j]
        while queue and reduced[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(position[j])
        j = back[j]
    return cuts[::-1]


class Stream:
    """Documents of one partition; windows leave it as soon as enough tokens are there."""

    def __init__(self, partition: int, length: int, enders: np.ndarray):
        self.partition, self.length, self.enders = partition, length, enders
        self.sequence = 0
        self.documents: list[list] = []  # doc_id, its tokens before the stream's start, ids
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append([doc_id, 0, ids])
        self.size += len(ids)

    def ready(self) -> bool:
        return self.size >= self.length * CHUNK_WINDOWS

    def cut(self, last: bool) -> list[tuple]:
        """Pieces of all windows planned over what is held; the last one stays unless at the end."""
        if not self.size:
            return []
        ends, marks, at = [], [], 0
        for _, skipped, ids in self.documents:
            marks.append(sentence_ends(ids[skipped:], self.enders) + at)
            at += len(ids) - skipped
            ends.append(at)
        points, penalties = cut_points(
            at, np.array(ends), np.concatenate(marks), self.length
        )
        cuts = plan_windows(points, penalties, self.length)
        if not last and len(cuts) > 1:
            cuts.pop()
        return self._pieces(cuts)

    def _pieces(self, cuts: list[int]) -> list[tuple]:
        out, begin, current = [], 0, 0
        for end in cuts:
            sequence = (self.partition << 33) | self.sequence
            self.sequence += 1
            offset = 0
            while begin < end:
                doc_id, skipped, ids = self.documents[current]
                take = min(len(ids) - skipped, end - begin)
                part = ids[skipped : skipped + take].astype("<u4").tobytes()
                out.append(
                    (doc_id, skipped, take, zlib.crc32(part), len(ids), sequence, offset)
                )
                offset += take
                begin += take
                self.documents[current][1] += take
                if self.documents[current][1] == len(ids):
                    current += 1
        self.documents = self.documents[current:]
        self.size -= begin
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in PIECES.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def sentence_enders(vocab) -> np.ndarray:
    """For each id whether its token closes a sentence: a word end after a stop, ! or ?."""
    return np.array(
        [t.endswith("</w>") and t[:-4][-1:] in (".", "!", "?") for t in vocab.tokens], bool
    )


def pack_documents(docs: DataFrame, vocab_path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens.

    A document is the ids of its text and then id 1 (a null text: id 1 alone). Documents keep the
    order they have in their partition; each partition is packed on its own, so sequence ids are
    unique but not gapless, and a partition's last sequence may be short. Cuts are planned over
    ``CHUNK_WINDOWS`` windows at a time, the last of which stays open. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each id lies in exactly one piece; repeated
    rows and null ids are packed like others; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocab_path, None, False)
        context = TaskContext.get()
        partition = context.partitionId() if context else 0
        stream = Stream(partition, length, sentence_enders(own.vocab))
        for batch in small_batches(batches):
            names = batch.column("doc_id").to_pylist()
            for doc_id, (ids, _) in zip(names, own.encode(batch.column("text").to_pylist())):
                stream.add(doc_id, np.append(ids, np.uint32(END_ID)))
                if stream.ready():
                    yield _batch(stream.cut(last=False))
        yield _batch(stream.cut(last=True))

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
