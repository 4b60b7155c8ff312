"""Nested and loosely typed values: certification items, containers, truthiness, sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meritgrid.functions.exprs import col

CERT_ITEM = "struct<name:string,type:string,status:string,score_impact:double,certificate_number:string,issuer:string>"


def clean_cert_items(items: Column | str) -> Column:
    """JSON texts of certification items -> structs; bare strings become active certifications.

    Objects keep their fields, blank strings and other JSON types are dropped.
    """
    def one(item: Column) -> Column:
        trimmed = F.trim(item)
        bare = F.trim(F.get_json_object(F.concat(F.lit('{"v":'), trimmed, F.lit("}")), "$.v"))
        as_object = F.from_json(trimmed, CERT_ITEM)
        as_name = F.struct(
            bare.alias("name"),
            F.lit(None).cast("string").alias("type"),
            F.lit("Active").alias("status"),
            F.lit(None).cast("double").alias("score_impact"),
            F.lit(None).cast("string").alias("certificate_number"),
            F.lit(None).cast("string").alias("issuer"),
        )
        return F.when(F.startswith(trimmed, F.lit("{")), as_object).when(
            F.startswith(trimmed, F.lit('"')) & (bare != ""), as_name
        )

    return F.array_compact(F.transform(col(items), one))


def accredited_bodies(by_body: Column | str) -> Column:
    """Map body -> struct(status, ...) turned into entries, accredited bodies only."""
    kept = F.map_filter(col(by_body), lambda _, cert: cert["status"] == "Accredited")
    return F.transform(
        F.map_entries(kept),
        lambda e: F.struct(F.upper(e["key"]).alias("name"), e["value"]["status"].alias("status")),
    )


def truthy(df: DataFrame, name: str) -> Column:
    """Not null, not blank, not zero, not false, not an empty collection."""
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, T.StringType):
        test = value != ""
    elif isinstance(kind, T.BooleanType):
        test = value
    elif isinstance(kind, T.NumericType):
        test = value != 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(value) > 0
    else:
        test = value.isNotNull()
    return F.coalesce(test, F.lit(False))


def richness(df: DataFrame, columns: Sequence[str]) -> Column:
    """Number of filled columns in a row."""
    return sum((F.when(truthy(df, c), 1).otherwise(0) for c in columns), F.lit(0))


def collect_sources(*values: Column) -> Column:
    """Texts and text arrays put together: trimmed, blanks dropped, first occurrences kept."""
    joined = F.flatten(F.array(*values))
    trimmed = F.transform(joined, lambda s: F.trim(s))
    return F.array_distinct(F.filter(trimmed, lambda s: s.isNotNull() & (s != "")))


def as_list(value: Column | str) -> Column:
    """One text as a list; null becomes an empty list."""
    c = col(value)
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
