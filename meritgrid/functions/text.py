"""Name normalisers and other text expressions; all stay inside Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritgrid.functions.exprs import col, once
from meritgrid.rules import names as rules


def filled(text: Column | str) -> Column:
    return F.coalesce(col(text), F.lit(""))


def lower_name(text: Column | str) -> Column:
    """Lower-case and trimmed; null becomes blank."""
    return F.trim(F.lower(filled(text)))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def alnum_key(text: Column | str) -> Column:
    """Lower-case letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(filled(text)), "[^a-z0-9]+", " "))


def score_key(text: Column | str) -> Column:
    """Key of the scored table: lower-case, ``-_,.&'"`` as spaces."""
    return squeeze(F.translate(lower_name(text), "-_,.&'\"", "       "))


def without_parentheses(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\([^)]*\)", ""))


def unified_company(text: Column) -> Column:
    long_form = F.regexp_replace(text, r"(?i)\bprivate\s+limited\b", "pvt. ltd.")
    return F.regexp_replace(long_form, r"(?i)\bpvt\.?\s*ltd\b", "pvt. ltd.")


def strip_tail(text: Column, token: Column) -> Column:
    """Text without the token at its end and without separators left there."""
    tail = F.lower(F.trim(F.coalesce(token, F.lit(""))))
    cut = F.rtrim(F.left(text, F.length(text) - F.length(tail)), F.lit(" ,-/"))
    return F.when((tail != "") & F.endswith(F.lower(text), tail), cut).otherwise(text)


def canonical_name(name: Column | str, city: Column | str, state: Column | str, country: Column | str) -> Column:
    """Name without parentheses, with one company form and without place names at its end."""
    return F.lower(squeeze(_without_places(name, city, state, country)))


def _without_places(name: Column | str, city: Column | str, state: Column | str, country: Column | str) -> Column:
    text = unified_company(squeeze(without_parentheses(filled(name))))
    tails = F.array(
        *[filled(c) for c in (country, state, city)], *[F.lit(t) for t in rules.COUNTRY_TAILS]
    )
    return F.aggregate(tails, text, strip_tail)


def loader_name(name: Column | str, city: Column | str, state: Column | str, country: Column | str) -> Column:
    """Variant used when sources are loaded: commas are followed by one space."""
    text = _without_places(name, city, state, country)
    return F.lower(F.trim(F.regexp_replace(text, r"\s*,\s*", ", ")))


def _drop(text: Column, patterns: Sequence[str], by: str) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, by)
    return text


def company_key(name: Column | str) -> Column:
    """Without punctuation and company words; inner spaces stay as they fall."""
    spaced = F.regexp_replace(lower_name(name), r"[\.,'’&()\-]", " ")
    return F.trim(_drop(F.regexp_replace(spaced, r"\s+", " "), rules.COMPANY_SUFFIXES, ""))


def lab_match_key(name: Column | str) -> Column:
    return squeeze(_drop(lower_name(name), [*rules.LAB_MATCH_PATTERNS, r"(?U)[^\w\s]"], " "))


def registry_key(name: Column | str) -> Column:
    words = [rf"\b{word}\b\.?" for word in rules.REGISTRY_WORDS]
    text = _drop(F.lower(filled(name)), words, "")
    return squeeze(F.regexp_replace(text, r"(?U)[^\w\s]", " "))


def hospital_key(name: Column | str) -> Column:
    pattern = r"\s*(" + "|".join(rules.HOSPITAL_SUFFIXES) + r")\s*"
    return squeeze(F.regexp_replace(F.lower(filled(name)), pattern, " "))


def lab_key(name: Column | str) -> Column:
    pattern = r"\s*(" + "|".join(rules.LAB_SUFFIXES) + r")\s*"
    return squeeze(F.regexp_replace(F.lower(filled(name)), pattern, " "))


def search_key(name: Column | str) -> Column:
    text = F.regexp_replace(filled(name), r"(?i)\b(" + "|".join(rules.SEARCH_WORDS) + r")\b", "")
    return squeeze(F.regexp_replace(text, r"(?U)[^\w\s]", " "))


def plain_words(name: Column | str) -> Column:
    """Without punctuation, trimmed; the form compared by the tiered name match."""
    return F.trim(F.regexp_replace(F.lower(filled(name)), r"(?U)[^\w\s]", ""))


def words(text: Column | str) -> Column:
    """Distinct words in sorted order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(filled(text), r"\s+"), lambda w: w != "")))


def word_list(text: Column | str) -> Column:
    """All words in text order."""
    return F.filter(F.split(filled(text), r"\s+"), lambda w: w != "")


def cert_key(name: Column | str) -> Column:
    """Certification name reduced to its body or ISO number for duplicate detection."""
    text = F.upper(F.trim(filled(name)))
    for phrase, short in rules.CERT_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(short))
    text = F.regexp_replace(text, r"ISO\s*(\d+)", "ISO$1")
    text = F.regexp_replace(text, r"ISO\s*-\s*(\d+)", "ISO$1")
    for filler in rules.CERT_FILLERS:
        text = F.replace(text, F.lit(filler), F.lit(" "))
    text = squeeze(F.regexp_replace(text, r"(?U)[^\w\s]", " "))

    def reduced(text: Column) -> Column:
        number = F.regexp_extract(text, r"ISO\s*(\d+)", 1)
        return (
            F.when(text.contains("JCI"), "JCI")
            .when(text.contains("NABH"), "NABH")
            .when(text.contains("CAP"), "CAP")
            .when(number != "", F.concat(F.lit("ISO"), number))
            .otherwise(text)
        )

    return once(text, reduced)


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all words of two distinct-word arrays; two empty arrays are equal."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, 1.0).otherwise(shared / F.nullif(union, F.lit(0)))


def word_similarity(left: Column, right: Column) -> Column:
    """Jaccard of two distinct-word arrays; 0 when one of them is empty."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(jaccard(left, right))


def word_overlap(search: Column, target: Column) -> Column:
    """Share of the search words found in the target."""
    shared = F.size(F.array_intersect(search, target))
    return F.when((F.size(search) == 0) | (F.size(target) == 0), 0.0).otherwise(
        shared / F.nullif(F.size(search), F.lit(0))
    )
