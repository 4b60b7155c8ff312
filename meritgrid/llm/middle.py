"""Fill-in-the-middle transformation with a wavelet matrix over character classes.

The bytes of many texts are one sequence of classes: line end, sentence end, space, part of a longer
character, and others. A wavelet matrix answers how often a class occurs before a place (rank) and where
its k-th occurrence is (select), for all texts at once. Ranks add up to counts of lines, sentences or
characters; a cut after k units is found by select, or where several classes end a unit by bisection on
ranks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.llm.common import filled, small_batches

PART, OTHER, SPACE, LINE, STOP = range(5)  # a byte's class; a character's own is at its last byte
DEPTH = 3
UNITS = {"lines": (LINE,), "sentences": (LINE, STOP), "chars": (OTHER, SPACE, LINE, STOP)}
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
RATE = 100  # percent of the texts that are transformed
SPM_SHARE = 50  # percent of those with the suffix first

CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Bits:
    """A bit vector that counts and finds its ones and zeros, 64 at a time."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        self.ones_before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros_before = 64 * np.arange(len(self.words) + 1) - self.ones_before
        self.ones = int(self.ones_before[-1])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.ones_before[word] + np.bitwise_count(below)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one or zero, from 0."""
        before = self.ones_before if one else self.zeros_before
        word = np.searchsorted(before, k, "right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        seen = np.cumsum(bits if one else 1 - bits, axis=1, dtype=np.int64)
        return word * 64 + (seen <= (k - before[word])[:, None]).sum(axis=1)


class WaveletMatrix:
    """Rank and select of every symbol of a sequence over ``2**depth`` symbols."""

    def __init__(self, symbols: np.ndarray, depth: int = DEPTH):
        self.n, self.levels = len(symbols), []
        for shift in reversed(range(depth)):
            bits = (symbols >> shift & 1).astype(bool)
            level = Bits(bits)
            self.levels.append((shift, level, self.n - level.ones))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def _follow(self, symbol: int, place: np.ndarray) -> np.ndarray:
        for shift, level, zeros in self.levels:
            ones = level.rank(place)
            place = zeros + ones if symbol >> shift & 1 else place - ones
        return place

    def rank(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol before each place."""
        return self._follow(symbol, place) - self._follow(symbol, np.zeros(1, np.int64))

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th occurrence of the symbol, from 0."""
        place = self._follow(symbol, np.zeros(1, np.int64)) + k
        for shift, level, zeros in reversed(self.levels):
            one = bool(symbol >> shift & 1)
            place = level.select(place - zeros if one else place, one)
        return place

    def count(self, symbols: Sequence[int], place: np.ndarray) -> np.ndarray:
        """Occurrences of any of the symbols before each place."""
        return sum(self.rank(s, place) for s in symbols)

    def after(self, symbols: Sequence[int], begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """First place in (begin, end] with ``k`` of the symbols since ``begin``, which must exist."""
        want = self.count(symbols, begin) + k
        if len(symbols) == 1:
            return self.select(symbols[0], want - 1) + 1
        low, high = begin, end.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            enough = self.count(symbols, middle) >= want
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return high


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of every byte of UTF-8 texts.

    Spaces are those of ASCII. A sentence ends after . ! ? before a space or line end, and after the
    ideographic full stop.
    """
    following = np.append(data[1:], 0)
    out = np.full(len(data), OTHER, np.uint8)
    out[(data == 32) | ((data >= 9) & (data <= 13))] = SPACE
    ends = (data == ord(".")) | (data == ord("!")) | (data == ord("?"))
    out[ends & ((following == 32) | ((following >= 9) & (following <= 13)))] = STOP
    stop = np.flatnonzero(data == 0x82)
    stop = stop[(stop >= 2)]
    out[stop[(data[stop - 1] == 0x80) & (data[stop - 2] == 0xE3)]] = STOP
    out[data == 10] = LINE
    out[following >> 6 == 2] = PART
    return out


def cut_texts(texts: list[bytes], picks: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Units of every text, ends of prefix and middle in bytes, and the characters of both.

    ``picks``: two numbers a text, taken modulo the units plus one; the smaller ends the prefix.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(sizes)
    begin = end - sizes
    classes = byte_classes(np.frombuffer(b"".join(texts), np.uint8))
    matrix, symbols = WaveletMatrix(classes), UNITS[unit]
    whole = matrix.count(symbols, end) - matrix.count(symbols, begin)
    last = classes[np.maximum(end - 1, 0)] if len(classes) else np.zeros(len(texts), np.uint8)
    units = whole + ((sizes > 0) & ~np.isin(last, symbols))
    cuts = np.sort(picks % (units + 1)[:, None], axis=1)
    places = []
    for k in cuts.T:
        place = np.where(k == 0, begin, end)
        inner = np.flatnonzero((k > 0) & (k < units))
        if len(inner):
            place[inner] = matrix.after(symbols, begin[inner], end[inner], k[inner])
        places.append(place)
    first, second = places
    chars = [p - matrix.rank(PART, p) for p in (begin, first, second)]
    return units, first - begin, second - begin, chars[1] - chars[0], chars[2] - chars[1]


def fill_in_middle(
    docs: DataFrame,
    unit: str = "lines",
    rate: int = RATE,
    spm_share: int = SPM_SHARE,
    seed: int = SEED,
    markers: Sequence[str] = MARKERS,
) -> DataFrame:
    """Every text as prefix, suffix and middle behind their markers, for infilling.

    Texts are cut into ``unit``: lines, sentences or chars. Both cuts and the form come from the hash
    of seed and id. ``psm`` has the order prefix, suffix, middle, ``spm`` suffix, prefix, middle;
    ``plain`` is the text itself: ``rate`` percent of the texts are not plain, and empty texts and
    those with a marker always are. Returns doc_id, n (units), form, prefix_chars, middle_chars
    (null if plain) and output; ``restored`` gives the text back.

    A null text is empty; a null id hashes like no characters, repeated rows have equal results; an
    empty table gives an empty result; other columns play no part. A text of any length is cut whole.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    numbers = [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    marks = [m.encode() for m in markers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = pc.cast(batch.column("text"), pa.binary()).to_pylist()
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
            units, first, second, before, middle = cut_texts(texts, np.stack([h1, h2], axis=1), unit)
            plain = np.array([not t or any(m in t for m in marks) for t in texts]) | (h3 % 100 >= rate)
            spm = h4 % 100 < spm_share
            forms = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            out = []
            for text, form, a, b in zip(texts, forms, first.tolist(), second.tolist()):
                parts = [marks[0] + text[:a], marks[1] + text[b:], marks[2] + text[a:b]]
                if form == "spm":
                    parts[:2] = parts[1::-1]
                out.append(text if form == "plain" else b"".join(parts))
            arrays = [
                batch.column("doc_id"),
                pa.array(units, pa.int64()),
                pa.array(forms, pa.string()),
                pa.array(before, pa.int64(), mask=plain),
                pa.array(middle, pa.int64(), mask=plain),
                pa.array(out, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in CUT.split(", ")])

    read = docs.select(F.col("doc_id").cast("long"), filled().alias("text"), *numbers)
    return read.mapInArrow(run, CUT)


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output of ``fill_in_middle`` was made from, read back from output and form."""
    pattern = "|".join(r"\Q" + m + r"\E" for m in markers)
    parts = F.split(output, pattern, -1)  # what stands before the first marker is empty
    part = [F.get(parts, F.lit(i)) for i in (1, 2, 3)]
    psm, spm = F.concat(part[0], part[2], part[1]), F.concat(part[1], part[2], part[0])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
