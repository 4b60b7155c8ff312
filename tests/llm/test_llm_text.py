"""Quality, personal data, tokens, packing, language, formatting and sharding."""

import hashlib
import itertools
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meritgrid.llm import bpe, chat, langid, packing, pii, quality, shard
from meritgrid.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ quality


def signals_by_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_quality(docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        rows = quality.quality_rules(table).collect()
        got = sorted((str(r.doc_id), *r[1:6]) for r in rows)
        assert got == sorted((str(i), *signals_by_force(t)) for i, t in texts_of(table))
        for r in rows:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality.quality_rules(no_docs).count() == 0


def test_quality_drops_symbols_and_keeps_prose(spark):
    rng = random.Random(1)
    prose = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(60)), "en", "a") for i in range(300)]
    junk = [(1000 + i, t.replace(" ", "*** ### "), "en", "a") for i, t, _, _ in prose[:20]]
    found = quality.quality_rules(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(20))


# ------------------------------------------------------------------ personal data


def test_base_spans_equal_the_plain_patterns():
    plain = [
        re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        re.compile(r"[0-9]([\x20-]?[0-9])+"),
        re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    good = [lambda t: True, pii.valid_ip, pii.valid_card, pii.valid_phone]
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("ab@.12 5+-()é9@.") for _ in range(rng.randrange(40)))
        want = [(k, *m.span()) for k, p in enumerate(plain) for m in p.finditer(text) if good[k](m[0])]
        assert pii.base_spans(text) == want, text
    assert pii.valid_card("4539 1488 0343 6467") and not pii.valid_card("4539 1488 0343 6468")
    assert pii.valid_ip("0000255.1.2.3") and not pii.valid_ip("256.1.2.3")
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000) == []


def test_pii(spark, no_docs, odd_docs):
    rows = [(i, f"call +1 (555) 010-{1000 + i} or mail a{i}@b.org from 10.0.0.{i}") for i in range(30)]
    rows += [(100 + i, f"phone (555) 010-{2000 + i} please") for i in range(10)]
    rows += [(200, None), (201, ""), (None, "x@y.zz"), (202, "token = 8cd5c291ad0fad3e545")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(table).collect()}
    assert (found[3].n_email, found[3].n_ip, found[3].n_card, found[3].n_phone) == (1, 1, 0, 1)
    parts = found[3].spans.split(",")
    assert found[3].base_sha256 == hashlib.sha256(",".join(parts).encode()).hexdigest()
    assert [p.split(":")[0] for p in parts] == ["email", "ip", "phone"]
    assert found[104].n_phone == 0 and found[104].spans.startswith("phone:6:")
    assert found[200].spans == found[201].spans == found[202].spans == ""
    assert found[None].n_email == 1
    masked = {r.doc_id: r.text for r in pii.mask_pii(table).collect()}
    assert masked[3] == "call [PHONE] or mail [EMAIL] from [IP]" and masked[200] is None
    assert pii.find_pii(no_docs).count() == 0 and pii.find_pii(odd_docs).count() == odd_docs.count()


def test_reliabilities_follow_agreement():
    code = lambda votes: sum((v + 1) * 3 ** (len(votes) - 1 - i) for i, v in enumerate(votes))
    votes = np.array([code((1, 1, 1, 1, 1)), code((0, -1, 0, -1, -1)), code((0, 1, 0, 1, 1))])
    real = pii.estimate_reliabilities(votes, np.array([500.0, 400.0, 60.0]))
    assert real[0] > 0.9 and real[1] < 0.1 and real[2] > real[1]


# ------------------------------------------------------------------ tokens


def unicode_texts():
    rng = random.Random(7)
    odd = ["", " ", "ΣΑΣ Σ", "İstanbul", "é é", "<|endoftext|>x<|startoftext|> <|endoftext|", "don't we'LL", "a\x1cb\x85c\xa0d", "12३٤½", "a" * 3000 + " " + "ab" * 900, "\x00\x01", None, "᫸͸x"]
    for _ in range(600):
        odd.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x3100), rng.randrange(0xE000, 0x1FFFF), 32])) for _ in range(rng.randrange(1, 30))))
    return odd


def test_encoder_equals_the_library(docs, library):
    texts = [t for _, t in texts_of(docs)] + unicode_texts()
    vocab = bpe.vocabulary(vocabulary_path())
    words = sorted({w.encode() for t in texts[:100] for w in vocab.words.findall(bpe.normalise(t or ""))})
    data = bpe.compile_lexicon(words, bpe.merge_words(vocab, words))
    with tempfile.NamedTemporaryFile() as file:
        file.write(data)
        file.flush()
        known = bpe.Lexicon(file.name)
        assert (known.find(words) == np.arange(len(words))).all()
        assert known.find([w + b"\x01" for w in words]).max() == -1
        for lexicon in (None, known):
            for limit in (1000, 1 << 22):
                own = list(bpe.Encoder(vocab, lexicon).encode(texts, limit))
                for text, (ids, shown) in zip(texts, own, strict=True):
                    want = library.encode(text or "", add_special_tokens=False).ids
                    assert ids.tolist() == want
                    assert shown.decode() == library.decode(want, skip_special_tokens=False)


def test_encode_documents(odd_docs, no_docs, library):
    found = bpe.encode_documents(odd_docs, vocabulary_path(), with_ids=True).collect()
    assert len(found) == odd_docs.count()
    want = Counter(tuple(library.encode(t or "", add_special_tokens=False).ids) for _, t in texts_of(odd_docs))
    assert Counter(tuple(r.ids) for r in found) == want
    for r in found:
        assert hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256
    assert bpe.encode_documents(no_docs, vocabulary_path()).count() == 0


def test_long_words_merge_as_short_ones():
    vocab = bpe.vocabulary(vocabulary_path())
    for word in (b"international", b"aaaaaaa", "straße".encode()):
        symbols = [*vocab.inner[list(word[:-1])].tolist(), int(vocab.last[word[-1]])]
        assert np.array(bpe.merge_long(vocab, symbols), bpe.PACKED).tobytes() == bpe.merge_words(vocab, [word])[0]


# ------------------------------------------------------------------ packing


def test_plan_is_the_cheapest():
    rng = random.Random(6)
    for _ in range(60):
        points = sorted(rng.sample(range(1, 60), rng.randrange(3, 12)))
        points = sorted({*points, *range(8, 60, 8), 60})
        penalties = [rng.choice([0, 2, 5]) for _ in points]
        length = 16
        position, cost = [0, *points], {0: 0}
        for j, p in enumerate(position[1:], 1):
            cost[j] = min(
                cost[i] + length - (p - position[i]) + penalties[j - 1]
                for i in range(j)
                if p - position[i] <= length
            )
        cuts = packing.plan_windows(np.array(points), np.array(penalties), length)
        ends = [0, *cuts]
        paid = sum(length - (b - a) + penalties[points.index(b)] for a, b in zip(ends, cuts))
        assert cuts[-1] == 60 and max(b - a for a, b in zip(ends, cuts)) <= length
        assert paid == cost[len(points)]


def test_packing(odd_docs, no_docs, docs, library):
    for table in (odd_docs, docs):
        pieces = packing.pack_documents(table, vocabulary_path()).collect()
        want = Counter()
        for doc_id, text in texts_of(table):
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
            want[(doc_id, len(ids))] += len(ids)
        got = Counter()
        for p in pieces:
            got[(p.doc_id, p.doc_tokens)] += p.length
        assert got == want
        windows = {}
        for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
            assert p.offset == windows.get(p.sequence_id, 0)
            windows[p.sequence_id] = p.offset + p.length
        assert max(windows.values()) <= 2048
    one = {t: [*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t in texts_of(docs)}
    by_id = dict(texts_of(docs))
    for p in pieces[:200]:
        ids = one[by_id[p.doc_id]][p.start : p.start + p.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == p.ids_crc32
    full = sum(windows.values()) / (2048 * len(windows))
    assert full > 0.9
    assert packing.pack_documents(no_docs, vocabulary_path()).count() == 0


# ------------------------------------------------------------------ language


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    scores, transitions = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    starts = np.array([0, 4, 4, 7])
    post, pairs = langid.forward_backward(scores, starts, transitions)
    want, want_pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 7)):
        total = 0
        part, part_pairs = np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.exp(sum(scores[a + i, s] for i, s in enumerate(path)) + sum(transitions[x, y] for x, y in zip(path, path[1:])))
            total += w
            for i, s in enumerate(path):
                part[i, s] += w
            for x, y in zip(path, path[1:]):
                part_pairs[x, y] += w
        want[a:b] = part / total
        want_pairs += part_pairs / total
    assert np.allclose(post, want) and np.allclose(pairs, want_pairs)


def test_language_held_out_and_code_switched(docs, odd_docs, no_docs, spark):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    model = langid.train(docs)
    found = langid.identify(docs, model).collect()
    out = [r for r in found if r.held_out]
    assert len(out) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.97 * len(out)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    by_lang = {}
    for r in docs.collect():
        by_lang.setdefault(r.lang, r.text)
    mixed = " ".join(by_lang["en"].split()[:40] + by_lang["de"].split()[:40])
    (sizes, post), = langid.Tagger(model).posteriors([mixed])
    best = [model.languages[i] for i in post.argmax(axis=1)]
    assert best[:35].count("en") > 25 and best[-35:].count("de") > 25
    und = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd_docs).collect() if r.lang_pred == "und"}
    assert {11, 12, 13, 15} <= {u[0] for u in und} and all(u[2] == 0 for u in und)
    assert langid.identify(no_docs).count() == 0
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and not {11, 12, 13, 15} & {r.doc_id for r in kept.collect()}


def test_language_stage_drops_gibberish_and_unlearned_languages(docs, spark):
    rng = random.Random(3)
    by_lang = {}
    for r in docs.collect():
        by_lang.setdefault(r.lang, r.text)
    gibberish = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(120))
    polish = "W całym kraju mieszkańcy czekają na wyniki badań, które przeprowadzono w zeszłym roku przez zespół naukowców"
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto"
    mixed = " ".join(" ".join(t.split()[:30]) for t in by_lang.values())
    extra = spark.createDataFrame([(-1, gibberish), (-2, polish), (-3, finnish), (-4, mixed)], "doc_id long, text string")
    given = docs.unionByName(extra, allowMissingColumns=True)
    kept = {r.doc_id for r in langid.keep_identified(given).collect()}
    assert not {-1, -2, -3} & kept and -4 in kept
    assert {r.doc_id for r in docs.collect() if r.text} <= kept


# ------------------------------------------------------------------ formatting


def test_trees_best_branch_and_round_trip(spark):
    control = "\\### a: </turn>\n \\b\\h ####"
    rows = [
        (1, 1, None, 1.0, "user", control),
        (1, 2, 1, 1.0, "assistant", "worse"),
        (1, 3, 1, 5.0, "assistant", control),
        (1, 4, 3, 0.0, "us:er", None),
        (1, 5, 4, 2.0, "assistant", "end"),
        (2, 1, 9, None, None, ""),
        (3, 1, 2, 1.0, "user", "cycle"),
        (3, 2, 1, 1.0, "user", "cycle"),
        (None, 7, None, 1.0, "assistant", "null tree"),
    ]
    table = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    read = chat.format_trees(table).select(
        "tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    got = {r.tree: ([tuple(t) for t in r.turns], r.loss) for r in read.collect()}
    assert got == {
        1: ([("user", control), ("assistant", control), ("us:er", ""), ("assistant", "end")], control + "end"),
        2: ([("", "")], ""),
        None: ([("assistant", "null tree")], "null tree"),
    }
    every = chat.format_trees(table, paths=None)
    assert every.where("tree = 1").count() == 2
    assert chat.format_trees(table.limit(0)).count() == 0


# ------------------------------------------------------------------ sharding


def check_shards(found, docs, shards):
    rows = found.collect()
    assert len(rows) == docs.count()
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    want = Counter((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts_of(docs))
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(shards)]
    largest = max((r.size for r in rows), default=0)
    assert not rows or max(sizes) - min(sizes) <= 2 * largest + 0.01 * sum(sizes)
    return sizes


def test_shards(spark, docs, odd_docs, no_docs):
    check_shards(shard.histogram_shards(docs), docs, 24)
    check_shards(shard.histogram_shards(odd_docs, shards=3, cells_per_shard=2), odd_docs, 3)
    assert shard.histogram_shards(no_docs).count() == 0
    hot = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")
    )
    sizes = check_shards(shard.histogram_shards(hot), hot, 24)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 24 + 40


def test_rows_equal_in_text_and_id_are_divided(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text")
    )
    sizes = check_shards(shard.histogram_shards(rows), rows, 24)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 24 + 40


def test_numbers_that_fail_their_checksum_are_refused(spark):
    rows = [(i, f"card 4539 1488 0343 6467 of a{i}@b.org from 10.0.0.{i}") for i in range(20)]
    rows += [(100 + i, f"seen near 21234656597892{40 + i} in the list") for i in range(8) if not pii.luhn(f"21234656597892{40 + i}")]
    rows += [(200 + i, f"reach jane{i} [at] mail{i} [dot] org today") for i in range(6)]
    rows += [(300, "two 4465758382889437 4465758382889437 in a row"), (301, "on 2021-05-12 10-11 or 1 555 0100 200 300 400 50")]
    found = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == "" for i in found if 100 <= i < 200 or i == 301)
    assert all(found[i].startswith("email:6:") for i in found if 200 <= i < 300)
    assert found[300] == "card:4:20,card:21:37"


def test_language_sample_does_not_depend_on_ids(spark, docs):
    some = docs.where("lang IN ('en', 'de')").withColumn("doc_id", F.when(F.col("lang") == "de", 3).cast("long"))
    hot = some.unionByName(spark.range(2000).join(some.where("lang = 'en'").limit(1)).drop("id"))
    model = langid.train(hot, sample_docs=20)
    assert model.languages == ["de", "en"]
    found = langid.identify(docs.where("lang IN ('en', 'de')").select("doc_id", "text"), model)
    right = found.join(docs.select("doc_id", "lang"), "doc_id")
    assert right.where("lang = lang_pred").count() >= 0.95 * right.count()


def test_transitions_learn_that_texts_switch():
    english, german = "the and of with that have this from they".split(), "der und mit das nicht eine auch auf sich".split()
    model = langid.fit([" ".join(english * 8)] * 12 + [" ".join(german * 8)] * 12, ["en"] * 12 + ["de"] * 12)
    assert langid.spliced_pairs([0, 0, 1, 1], every=2) == [(0, 2), (2, 0)]
    (_, post), = langid.Tagger(model).posteriors([" ".join(english + german + english)])
    best = [model.languages[i] for i in post.argmax(axis=1)]
    assert best == ["en"] * 9 + ["de"] * 9 + ["en"] * 9


def test_plans_over_many_windows_leave_the_last_one_open():
    rng = np.random.default_rng(5)
    enders = np.array([False] * 9 + [True])
    length = 64  # cuts cost up to 24, so padding is only small for windows well above that
    stream, given, pieces, plans = packing.Stream(3, length, enders), {}, [], 0
    for doc in range(5000):
        given[doc] = np.append(rng.integers(0, 10, rng.integers(0, 9) if doc % 500 else 9000), 1).astype(np.uint32)
        stream.add(doc, given[doc])
        if stream.ready():
            plans += 1
            pieces += stream.cut(last=False)
            assert 0 < stream.size <= length
    pieces += stream.cut(last=True)
    assert plans > 2 and not stream.size and stream.cut(last=True) == []
    held, filled_to = Counter(), Counter()
    for doc, start, size, digest, tokens, sequence, offset in pieces:
        assert start == held[doc] and offset == filled_to[sequence] and tokens == len(given[doc])
        assert digest == zlib.crc32(given[doc][start : start + size].astype("<u4").tobytes())
        held[doc] += size
        filled_to[sequence] += size
    assert all(held[doc] == len(ids) for doc, ids in given.items())
    assert max(filled_to.values()) <= length and sorted(filled_to) == [(3 << 33) | i for i in range(len(filled_to))]
    assert sum(filled_to.values()) >= 0.9 * length * len(filled_to)
