"""Language of words and texts by a linear-chain conditional random field.

Every word gets emission scores from its affixes, character n-grams and, for known words, a lexicon
entry; learned transitions tie neighbouring words together. Forward-backward gives each word's
posterior over the languages, also in code-switched text; a text's language is the one that holds
most of its letters. The field is fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritgrid.llm.common import small_batches, text_slices

HASHED = 1 << 16
LEXICON_WORDS = 20_000
LEXICON_COUNT = 3
WINDOW_WORDS = 32
SPLICED = 8
UNKNOWN = "und"
NOT_LETTERS = regex.compile(r"[^\p{L}\n]+")
MEMO_WORDS = 150_000

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # hashed features, then lexicon words, by language
    transitions: np.ndarray  # log scores, from row to column
    lexicon: dict[str, int]
    grams: np.ndarray  # sorted codes of the learned 3-grams
    floor: float  # least share of learned 3-grams of a text in a learned language


def marked_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with marks at their ends, and the word number of each."""
    marked = "\x01" + "\x02\x01".join(words) + "\x02"
    codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return codes, np.cumsum(codes == 1) - 1


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, code) of every 3-gram with word ends: as many as the word has letters."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    codes, owner = marked_codes(words)
    at = np.flatnonzero(owner[:-2] == owner[2:])
    shift = np.uint64(21)
    return owner[at], ((codes[at] << shift) | codes[at + 1]) << shift | codes[at + 2]


def contained(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are in the sorted array."""
    if not len(known):
        return np.zeros(len(codes), bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def learned_grams(texts: list[str], labels: list[str]) -> tuple[np.ndarray, float]:
    """3-grams of two documents or more, and the floor of a text's share of them.

    For each language, the share its documents reach with all learned 3-grams is set against the
    share they would reach if that language had not been learned. The floor is the lowest midpoint
    of the two medians, so it follows the number of languages and how near they are; it stays a
    tenth below what nearly all fitted documents reach.
    """
    languages = sorted(set(labels))
    found = [np.unique(word_grams(text_words(t))[1], return_counts=True) for t in texts]
    if not any(len(grams) for grams, _ in found):
        return np.empty(0, np.uint64), 0.0
    every = np.unique(np.concatenate([grams for grams, _ in found]))
    in_docs = np.zeros((len(every), len(languages)), np.int32)
    for (grams, _), label in zip(found, labels):
        in_docs[np.searchsorted(every, grams), languages.index(label)] += 1
    total = in_docs.sum(axis=1)
    reached, middles = [], []
    for j, language in enumerate(languages):
        own, foreign = [], []
        for (grams, counts), label in zip(found, labels):
            if label == language and len(grams):
                at = np.searchsorted(every, grams)
                own.append((total[at] >= 2) @ counts / counts.sum())
                foreign.append((total[at] - in_docs[at, j] >= 2) @ counts / counts.sum())
        if own:
            reached += own
            middles.append((np.median(own) + np.median(foreign)) / 2)
    return every[total >= 2], float(min(*middles, 0.9 * np.quantile(reached, 0.01)))


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) pairs: 2- and 3-grams with word ends, 3-letter affixes, the word."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, owner = marked_codes(words)
    mix = np.uint64(0x9E3779B97F4A7C15)
    numbers, features = [], []
    for n in (2, 3, 4):
        count = len(codes) - n + 1
        if count < 1:
            continue
        good = owner[:count] == owner[n - 1 :]
        if n == 4:
            good &= (codes[:count] == 1) | (codes[n - 1 :] == 2)
        at = np.flatnonzero(good)
        mixed = np.full(len(at), n, np.uint64)
        for i in range(n):
            mixed = (mixed ^ codes[at + i]) * mix
            mixed ^= mixed >> np.uint64(29)
        numbers.append(owner[at])
        features.append((mixed % np.uint64(HASHED)).astype(np.int64))
    known = [(i, HASHED + lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    numbers.append(np.array([i for i, _ in known], np.int64))
    features.append(np.array([f for _, f in known], np.int64))
    return np.concatenate(numbers), np.concatenate(features)


def emissions(model_weights: np.ndarray, words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    numbers, features = word_features(words, lexicon)
    return np.stack(
        [
            np.bincount(numbers, model_weights[features, k], len(words))
            for k in range(model_weights.shape[1])
        ],
        axis=1,
    )


def forward_backward(
    scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word, and the expected transitions summed over all sequences.

    ``scores``: emission scores of the words of all sequences, one after another; ``starts``: where
    each sequence begins, and the end. All sequences step together.
    """
    k = scores.shape[1]
    if not len(scores):
        return scores, np.zeros((k, k))
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max()).astype(emit.dtype)
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = starts[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    for t in range(longest):
        at = begin[: active[t]] + t
        now = emit[at] if t == 0 else (alpha[at - 1] @ step) * emit[at]
        alpha[at] = now / now.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(longest - 1, 0, -1):
        at = begin[: active[t]] + t
        after = emit[at] * beta[at]
        before = after @ step.T
        both = alpha[at - 1] * before
        pairs += (alpha[at - 1] / both.sum(axis=1, keepdims=True)).T @ after * step
        beta[at - 1] = before / before.sum(axis=1, keepdims=True)
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True), pairs


def text_words(text: str | None) -> list[str]:
    """Letters of each white-space run, lower-cased; runs without letters are left out."""
    cleaned = NOT_LETTERS.sub("", "\n".join((text or "").lower().split()))
    return [w for w in cleaned.split("\n") if w]


def spliced_pairs(gold: list[int], every: int = SPLICED) -> list[tuple[int, int]]:
    """Places of windows to join: every ``every``-th one with the next of another label, cyclically."""
    out = []
    for n, a in enumerate(range(0, len(gold), every)):
        start = a + 1 + n % 97  # the next window itself is mostly of the same text
        others = (i % len(gold) for i in range(start, start + len(gold)))
        b = next((i for i in others if gold[i] != gold[a]), None)
        if b is not None:
            out.append((a, b))
    return out


def fit(
    texts: list[str], labels: list[str], windows: int = 6, rounds: int = 25, rate: float = 0.5
) -> Model:
    """Fit the field on windows of words spread over each labelled text.

    Every ``SPLICED``-th window is joined, half and half, with one of another language as well, so that
    the transitions learn how often and between which languages a text switches.
    """
    languages = sorted(set(labels))
    k = len(languages)
    counts: Counter = Counter()
    sequences, gold = [], []
    for text, label in zip(texts, labels):
        words = text_words(text)
        counts.update(words)
        starts = np.unique(
            np.linspace(0, max(0, len(words) - WINDOW_WORDS), windows).astype(int)
        )
        for s in starts:
            part = words[s : s + WINDOW_WORDS]
            if part:
                sequences.append(part)
                gold.append(languages.index(label))
    tags = [np.full(len(part), label) for part, label in zip(sequences, gold)]
    for a, b in spliced_pairs(gold):
        half, rest = len(sequences[a]) // 2, len(sequences[b]) // 2
        sequences.append(sequences[a][:half] + sequences[b][rest:])
        tags.append(np.concatenate([tags[a][:half], tags[b][rest:]]))
    often = [w for w, n in counts.most_common(LEXICON_WORDS) if n >= LEXICON_COUNT]
    lexicon = {w: i for i, w in enumerate(often)}
    weights = np.zeros((HASHED + len(lexicon), k))
    transitions = np.zeros((k, k))
    grams, floor = learned_grams(texts, labels)
    if k < 2:
        return Model(languages, weights.astype(np.float32), transitions, lexicon, grams, floor)
    vocabulary = sorted({w for s in sequences for w in s})
    number = {w: i for i, w in enumerate(vocabulary)}
    order = np.array([number[w] for s in sequences for w in s])
    sizes = np.array([len(s) for s in sequences])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    truth = np.zeros((len(order), k))
    truth[np.arange(len(order)), np.concatenate(tags)] = 1
    true_pairs = np.zeros((k, k))
    for tag in tags:
        np.add.at(true_pairs, (tag[:-1], tag[1:]), 1)
    owners, features = word_features(vocabulary, lexicon)
    square, square_t = np.full(weights.shape, 1e-8), np.full((k, k), 1e-8)
    total = len(order)
    for _ in range(rounds):
        scores = np.stack(
            [np.bincount(owners, weights[features, j], len(vocabulary)) for j in range(k)], axis=1
        )
        post, pairs = forward_backward(scores[order], starts, transitions)
        miss = truth - post
        for j in range(k):
            by_word = np.bincount(order, miss[:, j], len(vocabulary))
            slope = np.bincount(features, by_word[owners], len(weights)) / total
            slope -= 1e-6 * weights[:, j]
            square[:, j] += slope**2
            weights[:, j] += rate * slope / np.sqrt(square[:, j])
        slope_t = (true_pairs - pairs) / total - 1e-3 * transitions
        square_t += slope_t**2
        transitions = transitions + rate * slope_t / np.sqrt(square_t)
    return Model(languages, weights.astype(np.float32), transitions, lexicon, grams, floor)


class Tagger:
    """Applies a model to texts; a bounded memo keeps the scores of recent words."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def _word_scores(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > MEMO_WORDS:
            self.rows, self.scores, new = {}, self.scores[:0], words
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        fresh = emissions(self.model.weights, new, self.model.lexicon).astype(np.float32)
        self.scores = np.concatenate([self.scores, fresh]) if len(new) else self.scores
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        return self.scores[at]

    def posteriors(self, texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its words' letter counts and posteriors (words with letters only)."""
        for start, stop in text_slices(texts):
            plain = [(t or "").lower() for t in texts[start:stop]]
            lists = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
            numbered = lists.values.dictionary_encode()
            values = numbered.dictionary.to_pylist()
            words = NOT_LETTERS.sub("", "\n".join(values)).split("\n") if values else []
            chunk = numbered.indices.to_numpy().astype(np.int64)
            letters = np.fromiter(map(len, words), np.int64, len(words))
            has = letters[chunk] > 0
            edges = np.concatenate([[0], np.cumsum(has)])[lists.offsets.to_numpy()]
            chunk = chunk[has]
            different = sorted({w for w in words if w})
            place = {w: i for i, w in enumerate(different)}
            to_word = np.fromiter((place.get(w, 0) for w in words), np.int64, len(words))
            scores = self._word_scores(different)[to_word[chunk]]
            post, _ = forward_backward(scores, edges, self.model.transitions)
            sizes = letters[chunk]
            for i in range(stop - start):
                a, b = edges[i], edges[i + 1]
                yield sizes[a:b], post[a:b]

    def predict(self, texts: list) -> list[tuple[str, float]]:
        """Language with most letters and its share of them; ``und`` and 0 without letters."""
        out = []
        for sizes, post in self.posteriors(texts):
            if not len(sizes) or not self.model.languages:
                out.append((UNKNOWN, 0.0))
                continue
            share = sizes @ post / sizes.sum()
            best = int(share.argmax())
            out.append((self.model.languages[best], min(1.0, float(share[best]))))
        return out

    def familiarity(self, texts: list) -> list[float]:
        """For each text the share of its 3-grams that were learned; 0 without letters."""
        out: list[float] = []
        for start, stop in text_slices(texts):
            lists = [text_words(t) for t in texts[start:stop]]
            different = list({w for words in lists for w in words})
            numbers, codes = word_grams(different)
            hits = np.bincount(numbers, contained(codes, self.model.grams), len(different))
            known = dict(zip(different, hits.tolist()))
            out += [sum(map(known.__getitem__, words)) / max(1, sum(map(len, words))) for words in lists]
        return out


def held_out() -> Column:
    """Documents whose crc32 of the id's digits leaves 2 on division by 4; never learnt from."""
    digest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return digest % 4 == 2


def train(docs: DataFrame, sample_docs: int = 300, max_chars: int = 20_000) -> Model:
    """Fit a model on ``sample_docs`` different texts of each language, chosen by hash.

    Only documents that are not held out and have a language count, of at most ``max_chars``
    characters. The texts with the smallest hashes are taken, each once, whatever ids they have and
    however often they come, so the driver holds ``sample_docs * max_chars`` characters per language at
    most, and a language with fewer different texts gives all of them.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    labelled = labelled.where(F.length("text") <= max_chars)
    labelled = labelled.select("doc_id", "text", "lang", F.xxhash64("text", F.lit("sample")).alias("place"))
    places = labelled.groupBy("lang", "place").agg(F.min("doc_id").alias("pick"))
    order = Window.partitionBy("lang").orderBy("place")
    first = places.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs)
    first = F.broadcast(first.select(F.col("lang").alias("of"), F.col("place").alias("at"), "pick"))
    same = (F.col("lang") == F.col("of")) & (F.col("place") == F.col("at"))
    chosen = labelled.join(first, same & F.col("doc_id").eqNullSafe(F.col("pick")), "left_semi")
    rows = chosen.dropDuplicates(["lang", "place"]).select("text", "lang", "place").collect()
    rows.sort(key=lambda r: (r.lang, r.place))
    return fit([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score (0 to 1).

    ``lang`` is read for fitting only. A null text, or one without letters, gets ``und`` with score
    0, as does every text when there is nothing to learn from. Repeated rows are judged each; a null
    id is never held out; an empty table gives an empty result; other columns are ignored.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in small_batches(batches):
            found = tagger.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, PREDICTED)


def keep_identified(docs: DataFrame, floor: float | None = None) -> DataFrame:
    """The rows of ``docs`` with letters that are in learned languages, one or several mixed.

    The share of a text's 3-grams that were learned must reach the floor, by default the model's.
    The share of the top language says nothing about that: it is 1 / k at least, whatever the text.
    """
    model = train(docs)
    floor = model.floor if floor is None else floor
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in small_batches(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            found = zip(tagger.predict(texts), tagger.familiarity(texts))
            good = [lang != UNKNOWN and share >= floor for (lang, _), share in found]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
