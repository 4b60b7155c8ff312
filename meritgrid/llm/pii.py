"""Personal data by weak supervision.

Strict patterns give the base spans. Looser patterns give more candidates; regex, gazetteer and
context labelers vote on all of them. Counts of vote patterns over the whole table feed an
expectation-maximisation over the loose candidates that estimates each labeler's reliability without
labels; base spans count as real, an abstention says nothing, and priors keep every labeler better
than chance, so that one class cannot swallow all. The posteriors train a span classifier on the form
of a span, which decides on the added spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.llm.common import small_batches, stored

KINDS = ("email", "ip", "card", "phone")

# The strict patterns. The look-behinds only spare the engine starts inside a run.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

LOOSE_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:[\[({] ?dot ?[\])}]|\.) ?[A-Za-z0-9-]{1,63}){1,5}"
)
AT_MARK = re.compile(r"[\[({] ?at ?[\])}]")
LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
LOOSE_CARD = re.compile(
    r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7})(?![0-9])"
)
LOOSE_PHONE = re.compile(
    r"(?<![0-9A-Za-z])\(?[0-9]{2,4}\)?[ .-](?:[0-9]{2,4}[ .-]){1,3}[0-9]{2,4}(?![0-9A-Za-z])"
)
HAS_DIGIT = re.compile("[0-9]")

#: Gazetteer: words that announce a kind, in the languages at hand; a parameter of the operator.
CUE_WORDS = {
    "email": (
        "e-mail email mail contact contacto contatto kontakt courriel correo correio posta reply "
        "schreiben écrire escribir address adresse"
    ).split(),
    "ip": (
        "ip ipv4 ipv6 host hostname server serveur servidor gateway router proxy subnet dns node "
        "address adresse dirección"
    ).split(),
    "card": (
        "card cards visa mastercard amex maestro discover credit debit carte karte kreditkarte "
        "tarjeta cartão carta crédito crédit payment paiement zahlung pago"
    ).split(),
    "phone": (
        "tel telephone phone call fax mobile cell whatsapp hotline telefon handy anruf téléphone "
        "appel portable teléfono llame móvil telefone telefono"
    ).split(),
}


def cue_patterns(words: dict[str, list[str]]) -> dict[str, re.Pattern]:
    """One pattern for each kind that finds its gazetteer words, whole and in any case."""
    out = {}
    for kind in KINDS:
        listed = sorted(words.get(kind, ()), key=lambda w: (-len(w), w))
        out[kind] = re.compile(rf"(?i)\b(?:{'|'.join(map(re.escape, listed))})\b" if listed else r"(?!)")
    return out


CUES = cue_patterns(CUE_WORDS)
CUE_REACH = 40
SECRET_BEFORE = re.compile(r"""(?:=|["'`/_#]|\bkey|\btoken|\bid|\bno\.?) ?["'`]?$""")

#: Votes: 1 for, -1 against, 0 abstains; as digits 0..2 of a base-3 number, this many labelers.
LABELERS = ("strict pattern", "checksum or range", "gazetteer", "free standing", "not a secret")

SPANS = (
    "array<struct<kind:int,start:int,stop:int,base:boolean,votes:int,form:int>>"
)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping strict addresses, from each @ outwards, in linear time."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            last = match.end()
            found.append((start, last))
        at = text.find("@", last if match else at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def valid_card(text: str) -> bool:
    digits = _only_digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def valid_phone(text: str) -> bool:
    return 9 <= len(_only_digits(text)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the strict patterns, by kind and start; failing matches are dropped."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if HAS_DIGIT.search(text):
        for kind, pattern, valid in ((1, IP, valid_ip), (2, CARD, valid_card)):
            out += [(kind, *m.span()) for m in pattern.finditer(text) if valid(m[0])]
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if valid_phone(m[0])]
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if AT_MARK.search(text):
        out += [(0, *m.span()) for m in LOOSE_EMAIL.finditer(text)]
    if HAS_DIGIT.search(text):
        if ":" in text:
            out += [(1, *m.span()) for m in LOOSE_IP.finditer(text)]
        out += [(2, *m.span()) for m in LOOSE_CARD.finditer(text)]
        out += [(3, *m.span()) for m in LOOSE_PHONE.finditer(text) if valid_phone(m[0])]
    return out


DATE_LIKE = re.compile(r"(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}(?![0-9])")
NAME_END = re.compile(r"[A-Za-z]{2,}$")


def _in_a_list(text: str, start: int, stop: int) -> bool:
    """Whether more digits stand right before or after, as in a list of numbers."""
    around = text[max(0, start - 2) : start] + text[stop : stop + 2]
    return HAS_DIGIT.search(around) is not None


def _sound(text: str, kind: int, start: int, stop: int) -> bool:
    """Whether a loose candidate of a kind passes what can be checked about it."""
    span = text[start:stop]
    if kind == 0:
        return NAME_END.search(span) is not None
    if kind == 1:  # eight groups of two decimals are a row of numbers
        return any(c.isalpha() for c in span) or max(map(len, span.split(":"))) > 2
    if kind == 2:
        return valid_card(span)
    return valid_phone(span) and not DATE_LIKE.match(span) and not _in_a_list(text, start, stop)


def _votes(text: str, kind: int, start: int, stop: int, base: bool, cues: dict) -> int:
    before, after = text[max(0, start - CUE_REACH) : start], text[stop : stop + 1]
    name = KINDS[kind]
    sound = base or _sound(text, kind, start, stop)
    standing = not (before[-1:].isalnum() or after.isalnum())
    votes = (
        1 if base else 0,
        1 if sound else -1,
        1 if cues[name].search(before) else 0,
        1 if standing else -1,
        -1 if SECRET_BEFORE.search(before) else 1,
    )
    code = 0
    for vote in votes:
        code = code * 3 + vote + 1
    return code


def _form(text: str, kind: int, start: int, stop: int) -> int:
    """What a span looks like, by a few small numbers packed into one: the classifier's input."""
    span = text[start:stop]
    digits = len(_only_digits(span))
    marks = sum(not c.isalnum() for c in span)
    left, right = text[start - 1 : start] if start else "", text[stop : stop + 1]
    parts = (
        (kind, 4),
        (min(digits // 2, 10), 11),
        (min(marks, 7), 8),
        (int(left == "" or left.isspace()) + 2 * int(left in "=\"'`"), 4),
        (int(right == "" or right.isspace() or right in ".,;!?)"), 2),
        (int(span[0] in "+("), 2),
        (int(luhn(_only_digits(span))) if digits else 0, 2),
    )
    code = 0
    for value, size in parts:
        code = code * size + min(value, size - 1)
    return code


FORM_SIZES = (4, 11, 8, 4, 2, 2, 2)


def candidate_spans(text: str | None, cues: dict = CUES) -> list[dict]:
    """Base spans, then loose candidates that touch no base span, with votes and form."""
    if not text:
        return []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    rows = [(k, a, b, True) for k, a, b in base]
    extra = []
    for kind, a, b in sorted(loose_spans(text), key=lambda s: (s[1], s[1] - s[2])):
        if not extra or a >= extra[-1][2]:
            extra.append((kind, a, b))
    i = 0
    for kind, a, b in extra:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if all(not (x < b and a < y) for x, y in taken[i : i + 4]):
            rows.append((kind, a, b, False))
    rows.sort(key=lambda r: r[:3])
    return [
        {
            "kind": k,
            "start": a,
            "stop": b,
            "base": own,
            "votes": _votes(text, k, a, b, own, cues),
            "form": _form(text, k, a, b),
        }
        for k, a, b, own in rows
    ]


def find_candidates(docs: DataFrame, cue_words: dict[str, list[str]] = CUE_WORDS) -> DataFrame:
    """doc_id and the candidate spans of every row, with votes and form."""
    numbers = [(name, pa.int32()) for name in ("kind", "start", "stop")]
    votes = [("votes", pa.int32()), ("form", pa.int32())]
    kind = pa.list_(pa.struct([*numbers, ("base", pa.bool_()), *votes]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = cue_patterns(cue_words)
        for batch in small_batches(batches):
            lists = [candidate_spans(t, cues) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lists, kind)], names=["doc_id", "found"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, found {SPANS}")


def vote_counts(found: DataFrame) -> pd.DataFrame:
    """Candidates counted by kind, votes and form over all documents; the codes bound the rows."""
    each = found.select(F.inline("found"))
    counts = each.groupBy("kind", "votes", "form").agg(F.count("*").alias("n"))
    return counts.toPandas().sort_values(["kind", "votes", "form"]).reset_index(drop=True)


def _digits(codes: np.ndarray) -> np.ndarray:
    places = 3 ** np.arange(len(LABELERS) - 1, -1, -1)
    return codes[:, None] // places % 3


#: Expected share of yes votes of every labeler but the first, on real and on false candidates (context
#: says yes to most of what it sees), and the weight of that expectation: votes at least, and a share
#: of the loose candidates.
YES_REAL = (0.95, 0.9, 0.9, 0.9)
YES_FALSE = (0.1, 0.3, 0.6, 0.6)  # one random number in ten passes the checksum
PRIOR_VOTES, PRIOR_SHARE = 20.0, 0.25


def estimate_reliabilities(votes: np.ndarray, weights: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior that a candidate is real, for each row of vote codes, by EM over two classes.

    A yes of the first labeler, the strict pattern, marks a base span, which is real. Each other
    labeler has a share of yes votes in either class; abstentions carry no evidence. The class share is
    that of loose candidates. The priors grow with the candidates, so that a labeler who says yes to
    all of them is never taken as proof and one who can say no keeps its meaning.
    """
    digits = _digits(votes)
    strict, rest = digits[:, 0] == 2, digits[:, 1:]
    yes, no = (rest == 2).astype(float), (rest == 0).astype(float)
    loose = np.where(strict, 0.0, weights)
    prior = max(PRIOR_VOTES, PRIOR_SHARE * loose.sum())
    share = 0.5
    expected = np.array([YES_REAL, YES_FALSE])
    rates = expected.copy()
    real = np.where(strict, 1.0, 0.5)
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + yes @ np.log(rates[0] / rates[1])
        odds += no @ np.log((1 - rates[0]) / (1 - rates[1]))
        new = np.where(strict, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        if np.abs(new - real).max(initial=0.0) < 1e-6:
            return new
        real = new
        share = ((real * loose).sum() + 1) / (loose.sum() + 2)
        for c, belief in enumerate((real, 1 - real)):
            said, against = (belief * weights) @ yes, (belief * weights) @ no
            rates[c] = (said + prior * expected[c]) / (said + against + prior)
    return real


def form_features(forms: np.ndarray) -> np.ndarray:
    """One-hot parts of form codes, with a constant."""
    rest, blocks = forms.copy(), []
    for size in reversed(FORM_SIZES):
        blocks.append(np.eye(size)[rest % size])
        rest //= size
    return np.hstack([np.ones((len(forms), 1)), *blocks])


def train_classifier(
    forms: np.ndarray, belief: np.ndarray, weights: np.ndarray, steps: int = 300
) -> np.ndarray:
    """Logistic regression on soft labels; weights saturate so that no frequent form drowns others."""
    x, mass = form_features(forms), np.log1p(weights)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (mass * (p - belief)) / max(mass.sum(), 1) + 1e-4 * w
        w -= 2.0 * slope
    return w


def train(found: DataFrame) -> dict[int, list[int]]:
    """Forms accepted for added spans, by kind, learnt from all candidates of the table.

    A candidate is added if the classifier gives its form ``ACCEPT`` or more. What the driver holds
    is one row per vote pattern and form, a bounded number.
    """
    counts = vote_counts(found)
    accepted: dict[int, list[int]] = {}
    if counts.empty:
        return accepted
    belief = np.zeros(len(counts))
    for kind in counts["kind"].unique():
        rows = (counts["kind"] == kind).to_numpy()
        belief[rows] = estimate_reliabilities(
            counts["votes"].to_numpy()[rows], counts["n"].to_numpy(float)[rows]
        )
    forms, weights = counts["form"].to_numpy(), counts["n"].to_numpy(float)
    w = train_classifier(forms, belief, weights)
    p = 1 / (1 + np.exp(-form_features(forms) @ w))
    for kind, form, chance in zip(counts["kind"], forms, p):
        if chance >= ACCEPT and int(form) not in accepted.setdefault(int(kind), []):
            accepted[int(kind)].append(int(form))
    return accepted


ACCEPT = 0.8


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])
        ),
        ",",
    )


def _count_of_kind(kind: int) -> Column:
    own = F.filter("found", lambda s: s["base"] & (s["kind"] == kind))
    return F.size(own).cast("long")


def find_pii(docs: DataFrame, cue_words: dict[str, list[str]] = CUE_WORDS) -> DataFrame:
    """Personal data of every document.

    Returns doc_id, n_email, n_ip, n_card, n_phone (strict spans), base_sha256 of the strict spans
    and ``spans``, all spans with the added ones (kind:start:end in code points, end exclusive, by
    kind and start). A null text counts as empty; repeated rows are searched each; an empty table
    gives an empty result; other columns are ignored. ``cue_words`` is the gazetteer.
    """
    found = stored(find_candidates(docs, cue_words), "pii-candidates")
    accepted = train(found)
    forms = [f for kind in sorted(accepted) for f in accepted[kind]]
    allowed = F.array(*[F.lit(f) for f in forms]).cast("array<int>")
    base = F.filter("found", lambda s: s["base"])
    every = F.filter("found", lambda s: s["base"] | F.array_contains(allowed, s["form"]))
    counted = [_count_of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counted,
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )


def mask_text(text: str, accepted: dict[int, list[int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    forms = {f for kind in accepted.values() for f in kind}
    spans = [s for s in candidate_spans(text) if s["base"] or s["form"] in forms]
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
        if s["start"] >= last:
            out += [text[last : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        last = max(last, s["stop"])
    return "".join([*out, text[last:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets and ``n_chars`` counted anew.

    A null text stays null with a null ``n_chars``, an empty one stays empty; repeated rows are masked
    each; an empty table gives an empty result; other columns are passed on.
    """
    accepted = train(find_candidates(docs))

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            at = batch.schema.get_field_index("text")
            texts = [
                None if t is None else mask_text(t, accepted)
                for t in batch.column(at).to_pylist()
            ]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))

    out = docs.mapInArrow(masked, docs.schema)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), size))
    return out
