"""Small column builders shared by every operator."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it stands there or in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that neither later filters nor later expressions compute again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


FEW_PHRASES = 3  # longer lists become one pattern, which keeps plans small


def has(text: Column | str, *phrases: str) -> Column:
    """True when one of the phrases occurs in the text; null text holds none."""
    filled = F.coalesce(col(text), F.lit(""))
    if len(phrases) > FEW_PHRASES:
        return filled.rlike("|".join(re.escape(p) for p in phrases))
    return any_of(filled.contains(p) for p in phrases)


def first_rule(text: Column | str, rules: Sequence[tuple[Sequence[str], Any]], default: Any) -> Column:
    """Value of the first rule one of whose phrases occurs in the text."""
    chain = None
    for phrases, value in rules:
        test = has(text, *phrases)
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def lookup(key: Column | str, values: Mapping[str, Any], default: Any = None) -> Column:
    """Literal-map lookup; the maps are fixed rule tables."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def band(value: Column, bands: Sequence[tuple[float, Any]], default: Any) -> Column:
    """Value of the first band whose lower bound the value reaches."""
    chain = None
    for bound, label in bands:
        test = value >= F.lit(bound)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def hits(text: Column | str, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur in the text."""
    return sum((F.when(has(text, p), 1).otherwise(0) for p in phrases), F.lit(0))


def found_phrases(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that occur in the text, in list order."""
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))


def blank_to_null(c: Column | str) -> Column:
    trimmed = F.trim(col(c))
    return F.when(trimmed != "", trimmed)


def first_filled(*columns: Column | str) -> Column:
    """First value that is not null or blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def num(value: Column | str, digits: int = 6) -> Column:
    """Rounded double for comparable outputs."""
    return F.round(col(value).cast("double"), digits)
