"""BPE encoding and decoding with a lexicon automaton and exact merges.

Words that are frequent in the corpus are compiled with their ids into a minimal acyclic automaton
(suffixes are shared; the number of words below each transition turns a path into the word's index,
its output). The automaton is a file of flat arrays that Spark ships to the executors, where it is
memory-mapped. Words it lacks are merged exactly, all unseen words of a piece of text at once.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meritgrid.llm.common import new_path, small_batches, stored, text_slices, write_bytes

NO_MERGE = np.int64(1 << 40)
LONG_WORD = 192
SLOT_BITS = 20
PACKED = "<u4"
FIRST_UNASSIGNED = 0x378
BEYOND = re.compile("[\u0378-\U0010ffff]")
PIECE_CHARS = 1 << 22
MEMO_WORDS = 250_000
LEXICON_WORDS = 1 << 16
CLASSES = 16  # of word counts, for each doubling


def byte_characters() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, read from its tokenizer file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.words_and_breaks = regex.compile("\n|" + split)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        ids = {**model["vocab"], **self.specials}
        self.tokens = [""] * (max(ids.values()) + 1)
        for token, number in ids.items():
            self.tokens[number] = token
        self.shown = [t.encode() for t in self.tokens]
        end = model["end_of_word_suffix"]
        letters = byte_characters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + end] for c in letters], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.size = len(self.tokens)
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(self.keys))
        self.table = {int(k): (r, int(m)) for r, (k, m) in enumerate(zip(keys, made))}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; NO_MERGE where there is none (or an id is negative).

        A slot holds one of the keys hashed to it; keys that lost theirs are found by bisection.
        """
        key = left * self.size + right
        at = self.slots[self._slot(key)]
        held = self.keys[at]
        hit = held == key
        other = np.nonzero(~hit & (self._slot(held) == self._slot(key)))
        if len(other[0]):
            at[other] = np.minimum(np.searchsorted(self.keys, key[other]), len(self.keys) - 1)
            hit[other] = self.keys[at[other]] == key[other]
        hit &= (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NO_MERGE), self.made[at]

    @functools.cached_property
    def unassigned(self) -> re.Pattern:
        """Code points that ``unicodedata`` does not know; a newer library may treat them otherwise."""
        codes = [c for c in range(FIRST_UNASSIGNED, 0x110000) if unicodedata.category(chr(c)) == "Cn"]
        edges = [0, *(i for i in range(1, len(codes)) if codes[i] != codes[i - 1] + 1), len(codes)]
        runs = [f"{chr(codes[i])}-{chr(codes[j - 1])}" for i, j in zip(edges, edges[1:])]
        return re.compile("[" + "".join(runs) + "]")

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalise(text: str) -> str:
    """NFC and lower case letter by letter; white space only separates words."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


SPECIAL, WHOLE = " ", "\n"  # first letters of marked chunks; no plain chunk begins with them


def is_odd(vocab: Vocabulary, text: str) -> bool:
    """Whether a text needs more than normalising and splitting at white space."""
    if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return True
    return (
        not text.isascii()
        and BEYOND.search(text) is not None
        and vocab.unassigned.search(text) is not None
    )


def odd_chunks(vocab: Vocabulary, text: str) -> list[str]:
    """Chunks of a text with special tokens, separator controls or unassigned characters."""
    out: list[str] = []
    for part in vocab.special.split(text):
        if part in vocab.specials:
            out.append(SPECIAL + part)
        elif BEYOND.search(part) and vocab.unassigned.search(part):
            letters = {c: b for b, c in enumerate(byte_characters())}
            shown = vocab.library.normalizer.normalize_str(part)
            words = vocab.library.pre_tokenizer.pre_tokenize_str(shown)
            out += [WHOLE + bytes(map(letters.__getitem__, w)).decode() for w, _ in words]
        else:
            out += [WHOLE + w for w in vocab.words.findall(normalise(part))]
    return out


def chunk_words(vocab: Vocabulary, chunk: str) -> list[str]:
    if chunk[:1] == SPECIAL:
        return [chunk]
    return [chunk[1:]] if chunk[:1] == WHOLE else vocab.words.findall(chunk)


def chunked(vocab: Vocabulary, texts: list) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The texts as runs between white space, which words never cross.

    Returns where each text's chunks begin (with the end), the number of each chunk's value, and
    the different values. Splitting and numbering run on Arrow arrays.
    """
    plain, odd = [], {}
    for i, text in enumerate(texts):
        if text and is_odd(vocab, text):
            odd[i] = odd_chunks(vocab, text)
            text = None
        plain.append(normalise(text) if text else "")
    lists = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
    starts = lists.offsets.to_numpy().astype(np.int64)
    numbered = lists.values.dictionary_encode()
    numbers = numbered.indices.to_numpy().astype(np.int64)
    values = numbered.dictionary.to_pylist()
    if odd:
        parts = np.split(numbers, starts[1:-1])
        for i, chunks in odd.items():
            parts[i] = np.arange(len(values), len(values) + len(chunks))
            values += chunks
        numbers = np.concatenate(parts)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return starts, numbers, values


def merge_long(vocab: Vocabulary, symbols: list[int]) -> list[int]:
    """Merge one word by a heap of pairs, lowest rank first, leftmost among equals."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (found := vocab.table.get(symbols[i] * vocab.size + symbols[j])):
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], alive[j] = new, False
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s, ok in zip(symbols, alive) if ok]


def _merge_group(vocab: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Merge words given as rows padded with -1; one merge in every row each round."""
    done = np.full(symbols.shape, -1, np.int64)
    rows = np.arange(len(symbols))
    ranks, made = vocab.rank(symbols[:, :-1], symbols[:, 1:])
    while len(rows):
        best = ranks.argmin(axis=1)
        line = np.arange(len(rows))
        go = ranks[line, best] < NO_MERGE
        if not go.all():
            done[rows[~go], : symbols.shape[1]] = symbols[~go]
            rows, symbols, ranks, made, best = (x[go] for x in (rows, symbols, ranks, made, best))
            line = np.arange(len(rows))
        if not len(rows):
            break
        symbols[line, best] = made[line, best]
        width = symbols.shape[1]
        place = np.arange(width - 1)
        symbols = np.take_along_axis(symbols, place + (place > best[:, None]), 1)
        pairs = np.arange(width - 2)
        move = pairs + (pairs > best[:, None])
        ranks, made = np.take_along_axis(ranks, move, 1), np.take_along_axis(made, move, 1)
        if not width - 2:
            done[rows, : symbols.shape[1]] = symbols
            break
        for beside in (best - 1, best):
            ok = (beside >= 0) & (beside < width - 2)
            at = np.clip(beside, 0, width - 3)
            r, m = vocab.rank(symbols[line, at], symbols[line, at + 1])
            ranks[line[ok], at[ok]], made[line[ok], at[ok]] = r[ok], m[ok]
    return done


def merge_words(vocab: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Exact ids of each word, packed, by merging words of similar length together."""
    out = [b""] * len(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        widest = max(4, int(sizes[order[start]]) * 5 // 4)
        stop = int(np.searchsorted(sizes[order], widest, "right"))
        stop = max(start + 1, min(stop, start + (1 << 21) // widest))
        group = order[start:stop]
        start = stop
        width = int(sizes[group[-1]])
        if width > LONG_WORD:
            for i in group:
                data = np.frombuffer(words[i], np.uint8)
                symbols = vocab.inner[data].tolist()
                symbols[-1] = int(vocab.last[data[-1]])
                out[i] = np.array(merge_long(vocab, symbols), PACKED).tobytes()
            continue
        flat = np.frombuffer(b"".join(words[i] for i in group), np.uint8)
        n = sizes[group]
        filled = np.arange(width) < n[:, None]
        symbols = np.full((len(group), width), -1, np.int64)
        symbols[filled] = vocab.inner[flat]
        ends = flat[np.cumsum(n) - 1]
        symbols[np.arange(len(group)), n - 1] = vocab.last[ends]
        if width > 1:
            symbols = _merge_group(vocab, symbols)
        stops = np.cumsum((symbols >= 0).sum(axis=1) * 4).tolist()
        values = symbols[symbols >= 0].astype(PACKED).tobytes()
        begin = 0
        for i, end in zip(group.tolist(), stops):
            out[i] = values[begin:end]
            begin = end
    return out


# ---------------------------------------------------------------- lexicon automaton


def compile_lexicon(words: list[bytes], ids: list[bytes]) -> bytes:
    """Minimal acyclic automaton of sorted different words, with their ids by index, as flat arrays."""
    nodes: list[tuple[bool, tuple]] = []  # final, ((byte, child), ...)
    counts: list[int] = []
    known: dict[tuple, int] = {}

    def freeze(final: bool, edges: list) -> int:
        key = (final, tuple(edges))
        found = known.get(key)
        if found is None:
            found = known[key] = len(nodes)
            nodes.append(key)
            counts.append(int(final) + sum(counts[child] for _, child in edges))
        return found

    path: list[list] = [[False, [], b""]]  # open nodes along the last word
    last = b""
    for word in [*words, None]:
        common = 0
        if word is not None:
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
        while len(path) > common + 1:
            final, edges, _ = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(final, edges)))
        if word is None:
            break
        path += [[False, [], b""] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
    root = freeze(path[0][0], path[0][1])
    keys, targets, skips = [], [], []
    for state, (final, edges) in enumerate(nodes):
        below = int(final)
        for byte, child in edges:
            keys.append(state << 8 | byte)
            targets.append(child)
            skips.append(below)
            below += counts[child]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)])  # bytes
    arrays = [
        np.array(keys, np.int64),
        np.array(targets, np.int64),
        np.array(skips, np.int64),
        np.array([f for f, _ in nodes], np.int64),
        np.asarray(starts, np.int64),
    ]
    values = b"".join(ids)
    head = np.array([root, *map(len, arrays), len(values)], np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays) + values


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        head = np.frombuffer(data[:56], np.int64)
        self.root, at, parts = int(head[0]), 56, []
        for size in head[1:6].tolist():
            parts.append(np.frombuffer(data[at : at + 8 * size], np.int64))
            at += 8 * size
        self.keys, self.targets, self.skips, self.final, self.starts = parts
        self.values = data[at:]

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, -1 where it is not in the lexicon; all words step together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        state = np.full(len(words), self.root, np.int64)
        index = np.zeros(len(words), np.int64)
        if not len(self.keys):
            return np.full(len(words), -1, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        live = np.arange(len(words))
        step = 0
        while len(live):
            live = live[sizes[live] > step]
            key = state[live] << 8 | flat[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            index[live] += self.skips[at]
            step += 1
        good = state >= 0
        good[good] = self.final[state[good]] == 1
        return np.where(good, index, -1)

    def packed(self, index: np.ndarray) -> list[bytes]:
        begin, end = self.starts[index].tolist(), self.starts[index + 1].tolist()
        values = memoryview(self.values)
        return [bytes(values[a:b]) for a, b in zip(begin, end)]


@functools.lru_cache(maxsize=4)
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)


# ---------------------------------------------------------------- encoding


def packed_words(vocab: Vocabulary, known: Lexicon | None, words: Iterable[str]) -> dict[str, bytes]:
    """Packed ids of different words: by the lexicon where it has them, by merging otherwise."""
    plain, out = [], {}
    for w in words:
        if w[0] == SPECIAL:
            out[w] = np.array([vocab.specials[w[1:]]], PACKED).tobytes()
        else:
            plain.append(w)
    data = [w.encode() for w in plain]
    found = known.find(data) if known is not None else np.full(len(data), -1)
    unseen, seen = np.flatnonzero(found < 0), np.flatnonzero(found >= 0)
    merged = merge_words(vocab, [data[i] for i in unseen.tolist()])
    out.update(zip((plain[i] for i in unseen.tolist()), merged))
    if len(seen):
        out.update(zip((plain[i] for i in seen.tolist()), known.packed(found[seen])))
    return out


def shown_words(vocab: Vocabulary, packed: dict[str, bytes]) -> dict[str, bytes]:
    """Decoded bytes of the same words, a space after every token."""
    ids = np.frombuffer(b"".join(packed.values()), PACKED).tolist()
    tokens, out, at = list(map(vocab.shown.__getitem__, ids)), {}, 0
    for word, value in packed.items():
        end = at + len(value) // 4
        out[word] = b" ".join([*tokens[at:end], b""])
        at = end
    return out


def gather(data: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The runs ``numbers`` of ``data``, one after another; run i is ``sizes[i]`` items long."""
    begins, chosen = np.cumsum(sizes) - sizes, sizes[numbers]
    shift = begins[numbers] - (np.cumsum(chosen) - chosen)
    places = np.repeat(shift, chosen)
    places += np.arange(len(places))
    return data[places]


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class Encoder:
    """Encodes texts piece by piece; a bounded memo keeps what recent words became."""

    def __init__(self, vocab: Vocabulary, known: Lexicon | None = None, shown: bool = True):
        self.vocab, self.known, self.with_shown = vocab, known, shown
        self.packed: dict[str, bytes] = {}
        self.shown: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.packed]
        if len(self.packed) + len(new) > MEMO_WORDS:
            stay = [w for w in words if w in self.packed]
            self.packed = {w: self.packed[w] for w in stay}
            self.shown = {w: self.shown[w] for w in stay} if self.with_shown else {}
        packed = packed_words(self.vocab, self.known, new)
        self.packed.update(packed)
        if self.with_shown:
            self.shown.update(shown_words(self.vocab, packed))

    def _words(self, values: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Words of each chunk: how many, their numbers chunk by chunk, and the different words."""
        marked = len(values)
        while marked and values[marked - 1][:1] in (SPECIAL, WHOLE):
            marked -= 1
        found = self.vocab.words_and_breaks.findall("\n".join(values[:marked]))
        odd = [v if v[0] == SPECIAL else v[1:] for v in values[marked:]]
        numbered = pa.array(found + ["\n"] * bool(marked) + odd, pa.string()).dictionary_encode()
        numbers = numbered.indices.to_numpy().astype(np.int64)
        words = numbered.dictionary.to_pylist()
        plain, rest = numbers[: len(numbers) - len(odd)], numbers[len(numbers) - len(odd) :]
        if not marked:
            return np.ones(len(odd), np.int64), rest, words
        breaks = plain == words.index("\n")
        sizes = np.diff(np.flatnonzero(breaks), prepend=-1) - 1
        sizes = np.concatenate([sizes, np.ones(len(odd), np.int64)])
        return sizes, np.concatenate([plain[~breaks], rest]), words

    def encode(self, texts: list, limit: int = PIECE_CHARS) -> Iterator[tuple[np.ndarray, bytes]]:
        """For each text its ids and its decoded bytes (empty if not asked for)."""
        for start, stop in text_slices(texts, limit):
            starts, chunks, values = chunked(self.vocab, texts[start:stop])
            sizes, numbers, words = self._words(values)
            order = gather(numbers, sizes, chunks)
            starts = _edges(sizes[chunks])[starts]
            self.learn([w for w in words if w != "\n"])
            parts = [self.packed.get(w, b"") for w in words]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            ids = gather(np.frombuffer(b"".join(parts), PACKED), sizes, order)
            edges = _edges(sizes[order])[starts].tolist()
            if self.with_shown:
                parts = [self.shown.get(w, b"") for w in words]
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                shown = gather(np.frombuffer(b"".join(parts), "u1"), sizes, order).tobytes()
                ends = _edges(sizes[order])[starts].tolist()
            for i in range(stop - start):
                text = shown[ends[i] : max(ends[i], ends[i + 1] - 1)] if self.with_shown else b""
                yield ids[edges[i] : edges[i + 1]], text


@functools.lru_cache(maxsize=4)
def encoder(vocab_path: str, lexicon_path: str | None = None, shown: bool = True) -> Encoder:
    known = lexicon(lexicon_path) if lexicon_path else None
    return Encoder(vocabulary(vocab_path), known, shown)


def decode(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The decoded text of any ids: their tokens with a space between."""
    return b" ".join([vocab.shown[i] for i in ids.tolist()])


def frequent_words(docs: DataFrame, vocab_path: str, size: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words of all texts, ``size`` at most, with counts.

    Counting is lossy in the usual bounded way: a run between spaces is counted where a piece has
    it three times or more, so its count is short by two per piece at most. The lexicon only
    speeds encoding up; results do not depend on what it holds.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in small_batches(batches):
            often: Counter = Counter()
            texts = batch.column("text").to_pylist()
            for start, stop in text_slices(texts, PIECE_CHARS):
                _, numbers, values = chunked(vocab, texts[start:stop])
                for i, n in enumerate(np.bincount(numbers, minlength=len(values)).tolist()):
                    if n > 2 and values[i][:1] != SPECIAL:
                        for word in chunk_words(vocab, values[i]):
                            often[word] += n
            rows = list(often.items())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w for w, _ in rows], pa.string()),
                    pa.array([n for _, n in rows], pa.int64()),
                ],
                names=["word", "n"],
            )

    words = docs.select("text").mapInArrow(counted, "word string, n long")
    totals = words.where(F.octet_length("word") <= 64).groupBy("word").agg(F.sum("n").alias("n"))
    totals = stored(totals, "word-counts")
    class_of = F.floor(F.log2("n") * CLASSES).cast("int")  # a few hundred classes of counts
    sizes = totals.groupBy(class_of.alias("c")).agg(F.count("*").alias("size")).collect()
    held, least = 0, None
    for row in sorted(sizes, key=lambda r: -r.c):
        held += row.size
        if held > size:
            break
        least = row.c
    return totals.where(class_of >= least) if least is not None else totals.limit(0)


def ship_lexicon(docs: DataFrame, vocab_path: str, size: int = LEXICON_WORDS) -> str:
    """Compile the frequent words and let Spark ship the file; returns its name on executors.

    The driver holds ``size`` words at most.
    """
    spark = docs.sparkSession
    vocab = vocabulary(vocab_path)
    words = sorted(r.word.encode() for r in frequent_words(docs, vocab_path, size).collect())
    data = compile_lexicon(words, merge_words(vocab, words))
    path = new_path(spark, "lexicon")
    write_bytes(spark, path, data)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(
    docs: DataFrame, vocab_path: str, lexicon_size: int = LEXICON_WORDS, with_ids: bool = False
) -> DataFrame:
    """Ids of every whole text, and the text decoded from them.

    Returns doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit integers) and
    decoded_sha256; ``with_ids`` adds the columns ids (array) and decoded. Special tokens in a text
    are taken as such. A null text counts as empty; repeated rows are encoded each; an empty table
    gives an empty result; other columns are ignored.
    """
    name = ship_lexicon(docs, vocab_path, lexicon_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocab_path, SparkFiles.get(name))
        for batch in small_batches(batches):
            rows, ids, decoded = [], [], []
            for found, shown in own.encode(batch.column("text").to_pylist()):
                digest = hashlib.sha256(found.astype(PACKED).tobytes()).hexdigest()
                rows.append((len(found), digest, hashlib.sha256(shown).hexdigest()))
                if with_ids:
                    ids.append(found.astype(np.int64))
                    decoded.append(shown.decode())
            n, first, second = (list(c) for c in zip(*rows)) if rows else ([], [], [])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), first, second]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            columns = [pa.array(c, pa.string()) if isinstance(c, list) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ENCODED + (", ids array<long>, decoded string" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
