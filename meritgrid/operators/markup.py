"""Elements of HTML by tag depth, with array functions only.

A page is split before every ``<``, so each chunk is a tag and the text behind it. One pass over the
opening and closing chunks of a tag keeps the stack of open ones, which gives every element its end
and its depth however deep elements of the same tag are nested. Elements that are never closed end with
the page; closing tags without an opening one are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritgrid.functions.exprs import col, once

SPAN = "array<struct<first:int,last:int,depth:int>>"


def chunks(html: Column | str) -> Column:
    """Tags with the text behind them; what stands before the first tag is a chunk too."""
    return F.split(col(html), "(?=<)")


def _events(parts: Column, tag: str) -> Column:
    """Places of the opening (1) and closing (-1) tags among the chunks, numbered from 1."""
    opening, closing = rf"(?is)^<{tag}\b[^>]*>?", rf"(?is)^</{tag}\b"
    kind = lambda c: F.when(c.rlike(opening), 1).when(c.rlike(closing), -1).otherwise(0)
    marked = F.transform(parts, lambda c, i: F.struct((i + 1).alias("at"), kind(c).alias("kind")))
    return F.filter(marked, lambda e: e["kind"] != 0)


def spans(parts: Column, tag: str) -> Column:
    """First and last chunk and depth (from 1) of every element of the tag, by first chunk.

    The last chunk starts with the closing tag; it is one past the page for elements never closed.
    """
    nothing, open_ = F.array().cast(SPAN), F.array().cast("array<int>")
    start = F.struct(open_.alias("stack"), nothing.alias("done"))

    def step(state: Column, event: Column) -> Column:
        stack, done = state["stack"], state["done"]
        depth = F.size(stack)
        element = F.struct(
            F.try_element_at(stack, F.lit(-1)).alias("first"), event["at"].alias("last"), depth.alias("depth")
        )
        opened = F.struct(F.array_append(stack, event["at"]).alias("stack"), done.alias("done"))
        closed = F.struct(F.slice(stack, F.lit(1), F.greatest(depth - 1, F.lit(0))).alias("stack"), F.array_append(done, element).alias("done"))
        return F.when(event["kind"] == 1, opened).when(depth > 0, closed).otherwise(state)

    def closed_with_page(end: Column) -> Column:
        rest = F.transform(end["stack"], lambda at, i: F.struct(at.alias("first"), (F.size(parts) + 1).alias("last"), (i + 1).alias("depth")))
        return F.array_sort(F.concat(end["done"], rest.cast(SPAN)))

    return once(F.aggregate(_events(parts, tag), start, step), closed_with_page)


def _closing(parts: Column, at: Column) -> Column:
    """The closing tag that a chunk starts with, without the text behind it."""
    return F.regexp_extract(F.coalesce(F.get(parts, at - 1), F.lit("")), r"(?s)^</[^>]*>?", 0)


def text_of(parts: Column, span: Column) -> Column:
    """Raw HTML of an element; what follows its closing tag is left out."""
    whole = F.slice(parts, span["first"], span["last"] - span["first"])
    return F.concat(F.array_join(whole, ""), _closing(parts, span["last"]))


def own_text_of(parts: Column, span: Column, all_spans: Column) -> Column:
    """Raw HTML of an element without the elements of its tag nested in it.

    The text behind a nested closing tag is the outer element's again.
    """
    inner = F.filter(all_spans, lambda s: (s["first"] > span["first"]) & (s["last"] <= span["last"]) & (s["depth"] == span["depth"] + 1))
    numbers = F.sequence(span["first"], span["last"] - 1)

    def kept(at: Column, inner: Column) -> Column:
        chunk = F.element_at(parts, at)
        ends = F.exists(inner, lambda s: s["last"] == at)
        inside = F.exists(inner, lambda s: (s["first"] <= at) & (at < s["last"]))
        behind = F.regexp_replace(chunk, r"(?s)^<[^>]*>?", "")
        return F.when(inside, "").when(ends, behind).otherwise(chunk)

    chunks_of = once(inner, lambda nested: F.transform(numbers, lambda at: kept(at, nested)))
    return F.concat(F.array_join(chunks_of, ""), _closing(parts, span["last"]))
