"""Row filters: group-level names, junk, facility checks, structural splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.exprs import any_of, has
from meritgrid.functions.text import filled, word_list
from meritgrid.rules import filters as rules
from meritgrid.rules.names import GOVERNMENT_WORDS, GROUP_WORDS


def group_level_names(orgs: DataFrame) -> DataFrame:
    """Adds ``is_group``: a group word in the name, or a bare name that starts another name.

    Every other name contributes its prefixes that end before a space or comma; the test is an
    equi-join on the distinct prefixes.
    """
    name = F.trim(filled("name"))
    others = orgs.select(name.alias("_o")).distinct()
    cuts = F.filter(
        F.sequence(F.lit(2), F.greatest(F.length("_o"), F.lit(2))),
        lambda i: F.substring(F.col("_o"), i, F.lit(1)).isin(" ", ","),
    )
    prefixes = others.select(
        F.explode(F.transform(cuts, lambda i: F.substring(F.col("_o"), F.lit(1), i - 1))).alias("_name")
    )
    bare = ~(prefixes["_name"].contains(",") | (prefixes["_name"].contains("(") & prefixes["_name"].contains(")")))
    heads = prefixes.filter(bare).distinct().withColumn("_head", F.lit(1)).hint("merge")
    worded = has(F.lower(name), *GROUP_WORDS)
    joined = orgs.withColumn("_name", name).join(heads, "_name", "left")
    flag = (name != "") & (worded | F.col("_head").isNotNull())
    return joined.withColumn("is_group", flag.cast("int")).drop("_name", "_head")


def not_junk(name: Column | str) -> Column:
    """Scraped names that are long enough and are no navigation text."""
    lowered = F.trim(F.lower(filled(name)))
    noisy = any_of(lowered.contains(w) & (F.length(lowered) < n) for w, n in rules.NOISE_WORDS)
    return (F.length(lowered) >= rules.MIN_NAME_LENGTH) & ~has(lowered, *rules.NOISE_ALWAYS) & ~noisy


def hospital_block(block: Column | str) -> Column:
    """Text blocks that name a hospital and a place, a contact or enough words."""
    raw = filled(block)
    lowered = F.lower(raw)
    detail = has(lowered, *rules.LOCATION_BLOCK_WORDS) | raw.rlike(rules.CONTACT_PATTERN) | (F.length(raw) > 50)
    return (F.length(raw) >= 10) & has(lowered, *rules.HOSPITAL_BLOCK_WORDS) & detail


def real_facility(place_id: Column | str, address: Column | str, types: Column | str, name: Column | str) -> Column:
    """Rows with a genuine id, a real address, a healthcare type and a healthcare name."""
    ident, where = filled(place_id), filled(address)
    kinds = F.transform(F.col(types) if isinstance(types, str) else types, F.lower)
    typed = F.exists(kinds, lambda t: any_of(F.contains(t, F.lit(k)) for k in rules.FACILITY_TYPES))
    return (
        (F.length(ident) >= 10)
        & ~F.startswith(ident, F.lit("fallback_"))
        & (where != "")
        & ~where.isin(rules.PLACEHOLDER_ADDRESSES)
        & F.coalesce(typed, F.lit(False))
        & has(F.lower(filled(name)), *rules.FACILITY_NAME_WORDS)
    )


def is_private(name: Column | str) -> Column:
    return ~has(F.lower(filled(name)), *GOVERNMENT_WORDS)


def valid_name(name: Column | str) -> Column:
    """Organisation names: no rejected pattern, three letters in a row, not just a city."""
    text = F.trim(filled(name))
    lowered = F.lower(text)
    rejected = any_of(text.rlike(p) for p in rules.NOT_A_NAME)
    place = has(lowered, *[c.lower() for c in rules.CITIES])
    care = has(lowered, *[w.lower() for w in rules.HEALTHCARE_WORDS])
    only_place = place & ~care & (F.size(word_list(text)) < 3)
    passed = (F.length(text) >= 4) & ~rejected & text.rlike("[A-Za-z]{3,}") & ~only_place
    # one expression for the optimizer instead of conjuncts it would derive constraints from
    return F.coalesce(passed, F.lit(False))


def country_filter(
    countries: DataFrame, low: float, high: float, min_hospitals: int, codes: Sequence[str] | None = None
) -> DataFrame:
    """Country rows by score range, hospital count and an optional code set."""
    kept = countries.filter(F.col("score").between(low, high) & (F.col("hospitals") >= min_hospitals))
    return kept.filter(F.col("code").isin(list(codes))) if codes else kept


def structure_of(lines: Column | str) -> Column:
    """Kind of a JSON text: object, string, list, number, literal or broken."""
    t = F.trim(filled(lines))
    return (
        F.when(F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull(), "dict")
        .when(F.startswith(t, F.lit('"')) & F.try_parse_json(t).isNotNull(), "str")
        .when(F.startswith(t, F.lit("[")) & F.try_parse_json(t).isNotNull(), "list")
        .when(t.rlike(r"^-?[0-9.]+$"), "number")
        .when(t.isin("true", "false", "null"), "literal")
        .otherwise("broken")
    )


def structure_split(rows: DataFrame, column: str, samples: int = 5) -> DataFrame:
    """Counts per kind, and the first samples of entries that are no objects."""
    from meritgrid.operators.ordering import first_rows

    tagged = rows.withColumn("kind", structure_of(column))
    counts = tagged.groupBy("kind").agg(F.count("*").alias("n")).select("kind", "n", F.lit(None).cast("string").alias("sample"))
    odd = first_rows(tagged.filter("kind = 'str'"), ["kind"], ["seq"], samples)
    return counts.union(odd.select("kind", F.col("seq"), F.left(F.col(column), F.lit(100))))
