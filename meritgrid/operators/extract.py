"""Records out of web pages and texts: certifications, initiatives, contacts, tables, entries.

Pages are ``page_id, url, html`` rows and texts ``doc_id, text`` rows. Rules come from tables
and everything is a Spark expression over the whole page; rows multiply only by rule, table row
or line, all bounded by the page itself.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritgrid.functions import cleaning
from meritgrid.functions.exprs import col, computed_once, first_rule, has, hits, once
from meritgrid.functions.text import filled, squeeze
from meritgrid.operators import markup, merge, score_more
from meritgrid.operators.ordering import first_rows
from meritgrid.rules import extraction as rules
from meritgrid.rules import scoring as score_rules

# --- page text -----------------------------------------------------------------------------


def written_out(text: Column) -> Column:
    for entity, plain in rules.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def without_code(html: Column | str) -> Column:
    """HTML without scripts, styles and comments."""
    text = F.regexp_replace(filled(html), r"(?is)<script.*?</script>", "")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", "")
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def visible(clean: Column | str, separator: str = "") -> Column:
    """Text of code-free HTML; tags are replaced by the separator and entities written out."""
    return written_out(F.regexp_replace(col(clean), r"(?s)<[^>]*>", separator))


def page_text(html: Column | str, separator: str = "") -> Column:
    """Visible text of a page."""
    return visible(without_code(html), separator)


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def text_nodes(html: Column | str) -> Column:
    """Texts between tags, cleaned, blanks dropped."""
    nodes = F.split(without_code(html), r"(?s)<[^>]*>")
    return F.filter(F.transform(nodes, lambda n: cleaning.clean_text(written_out(n))), lambda n: n != "")


def staged(pages: DataFrame, *keep: str) -> DataFrame:
    """Page rows with code-free HTML ``_clean`` and visible text ``_text``, computed once."""
    clean = pages.select("page_id", *keep, without_code("html").alias("_clean"))
    return clean.withColumn("_text", visible("_clean"))


def first_hit(text: Column, patterns: Sequence[str], reach: int) -> Column:
    """struct(match, context) of the first pattern that occurs; null when none does."""
    options = []
    for p in patterns:
        hit = F.regexp_extract(text, p, 0)
        at = F.position(hit, text)
        start = F.greatest(F.lit(1), at - reach)
        around = F.substring(text, start, at - start + F.length(hit) + reach)
        options.append(F.when(hit != "", F.struct(hit.alias("match"), F.trim(around).alias("context"))))
    return F.coalesce(*options)


def page_certifications(pages: DataFrame, patterns: Mapping[str, Sequence[str]] = rules.BODY_PATTERNS) -> DataFrame:
    """First hit per body in the page text with its surroundings and the last year in them."""
    held = staged(pages).select("page_id", F.lower("_text").alias("_t"))
    hits_by_body = held.select("page_id", *[first_hit(F.col("_t"), o, 100).alias(f"_h{i}") for i, o in enumerate(patterns.values())])
    finds = [
        F.when(F.col(f"_h{i}").isNotNull(), F.struct(F.lit(body).alias("name"), F.col(f"_h{i}.match"), F.col(f"_h{i}.context")))
        for i, body in enumerate(patterns)
    ]
    rows = hits_by_body.select("page_id", F.inline(F.array_compact(F.array(*finds))))
    years = F.regexp_extract_all(F.col("context"), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return rows.withColumn("year", F.try_element_at(years, F.lit(-1)))


def logo_certifications(pages: DataFrame, bodies: Sequence[str] = tuple(rules.BODY_PATTERNS), wanted: str = rules.LOGO_WORDS) -> DataFrame:
    """Bodies named in the alternative texts of images."""
    alts = F.regexp_extract_all(filled("html"), F.lit(r'(?is)<img[^>]*\balt="([^"]*)"'), F.lit(1))
    alt = pages.select("page_id", F.posexplode(alts).alias("pos", "alt")).filter(F.col("alt").rlike(wanted))
    named = F.array_compact(F.array(*[F.when(F.contains(F.lower("alt"), F.lit(b.lower())), F.lit(b)) for b in bodies]))
    return alt.select("page_id", "pos", F.explode(named).alias("name"))


def keyword_contexts(pages: DataFrame, keywords: Sequence[str] = tuple(rules.PAGE_KEYWORDS), reach: int = 50) -> DataFrame:
    """One row per keyword in the page text with its first surroundings on one line."""
    held = staged(pages).select("page_id", F.lower("_text").alias("_t"))
    found = held.select("page_id", "_t", *[F.position(F.lit(k), F.col("_t")).alias(f"_p{i}") for i, k in enumerate(keywords)])
    finds = []
    for i, k in enumerate(keywords):
        literal = re.escape(k)
        at = F.col(f"_p{i}")
        # nothing outside this window can take part in the first match
        window = F.substring(F.col("_t"), F.greatest(F.lit(1), at - reach), F.lit(3 * reach + len(k)))
        context = F.regexp_extract(window, f".{{0,{reach}}}{literal}.{{0,{reach}}}", 0)
        finds.append(F.when(at > 0, F.struct(F.lit(k).alias("keyword"), F.trim(context).alias("context"))))
    return found.select("page_id", F.inline(F.array_compact(F.array(*finds))))


def page_initiatives(
    pages: DataFrame, keywords: Mapping[str, tuple[int, str]] = rules.INITIATIVE_KEYWORDS, boosts: Sequence[str] = tuple(rules.BOOST_WORDS)
) -> DataFrame:
    """Initiatives of text nodes: three nodes per keyword, name, category and impact, near repeats out.

    Nodes between 21 and 499 letters count; at most five initiatives stay per page, in keyword
    and node order.
    """
    nodes = pages.select("page_id", F.posexplode(text_nodes("html")).alias("node", "description"))
    rule = F.array(
        *[F.struct(F.lit(i).alias("rule"), F.lit(k).alias("keyword"), F.lit(impact).alias("base"), F.lit(cat).alias("category"))
          for i, (k, (impact, cat)) in enumerate(keywords.items())]
    )
    matched = F.filter(rule, lambda r: F.contains(F.lower("description"), r["keyword"]))
    hits_rows = nodes.select("page_id", "node", "description", F.inline(matched))
    three = first_rows(hits_rows, ["page_id", "rule"], ["node"], 3)
    sized = three.filter((F.length("description") > 20) & (F.length("description") < 500))
    sentence = F.try_element_at(
        F.filter(F.split("description", r"\."), lambda s: F.contains(F.lower(s), F.col("keyword"))), F.lit(1)
    )
    name = F.coalesce(
        F.nullif(F.left(F.trim(sentence), F.lit(80)), F.lit("")), F.concat(cleaning.title_case(F.col("keyword")), F.lit(" Program"))
    )
    impact = F.least(F.col("base") + hits(F.lower("description"), boosts) * 2, F.lit(20))
    named = sized.select("page_id", "rule", "node", name.alias("name"), "category", impact.alias("impact_score"), "keyword")
    # at most three rows per rule and page are left, so the page list is bounded by the rule table
    ordered = named.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rule", "node", "name", "category", "impact_score"))).alias("_i"))
    kept = ordered.select("page_id", "_i", merge.drop_similar_texts(F.transform("_i", lambda x: x["name"])).alias("_n"))
    rows = kept.select("page_id", "_n", F.inline("_i")).withColumn("place", F.array_position("_n", F.col("name"))).filter("place > 0")
    return first_rows(rows, ["page_id", "place"], ["rule", "node"]).drop("_n")


def class_element(html: Column, classes: Sequence[str]) -> Column:
    """Raw HTML of the first element whose class holds one of the words; empty without one.

    Its end is the closing tag of its own name at its depth.
    """
    marked = rf'(?is)^<[a-z][a-z0-9]*\b[^>]*\bclass="[^"]*\b(?:{"|".join(classes)})\b[^"]*"'
    parts = markup.chunks(html)
    places = F.transform(parts, lambda c, i: F.when(c.rlike(marked), i + 1))
    first = F.array_min(places)
    # chunks from the first one on: the fold stops counting when depth is back at zero
    rest = F.slice(parts, first, F.size(parts))
    tag = F.lower(F.regexp_extract(F.element_at(rest, F.lit(1)), r"^<([A-Za-z][A-Za-z0-9]*)", 1))
    name = lambda c: F.lower(F.regexp_extract(c, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    step = lambda c: F.when(name(c) != tag, 0).when(F.startswith(c, F.lit("</")), -1).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def count(state: Column, chunk: Column) -> Column:
        depth = state["depth"] + step(chunk)
        moved = F.struct(depth.alias("depth"), (state["n"] + 1).alias("n"), (depth <= 0).alias("done"))
        return F.when(state["done"], state).otherwise(moved)

    end = F.aggregate(rest, start, count)
    held = F.when(end["done"], end["n"] - 1).otherwise(end["n"])  # without the closing tag
    return F.when(first.isNull(), "").otherwise(F.array_join(F.slice(rest, F.lit(1), held), ""))


def contact_details(pages: DataFrame, *keep: str) -> DataFrame:
    """Phone, email, address, city and state of every page."""
    block = class_element(F.col("_clean"), rules.ADDRESS_CLASSES)
    found = staged(pages, *keep).select(
        "page_id",
        *keep,
        F.trim(F.regexp_extract(visible("_clean", " "), rules.PHONE_PATTERN, 0)).alias("phone"),
        F.regexp_extract(visible("_clean", " "), rules.EMAIL_PATTERN, 0).alias("email"),
        squeeze(visible(block, " ")).alias("_block"),
        squeeze(F.regexp_extract(visible("_clean", "\n"), rules.ADDRESS_LABEL, 1)).alias("_label"),
    )
    parts = F.split("_block", ",")
    part = lambda k: F.when(F.size(parts) >= 2, F.trim(F.try_element_at(parts, F.lit(k)))).otherwise("")
    address = F.when(F.col("_block") != "", F.col("_block")).otherwise(F.col("_label"))
    return found.select(
        "page_id", *keep, "phone", "email", short_address(address).alias("address"), part(-2).alias("city"), part(-1).alias("state")
    )


def short_address(address: Column, limit: int = 180) -> Column:
    """Address cut at the last comma within the limit, without JSON remains."""
    head = F.left(address, F.lit(limit))
    at_comma = F.regexp_extract(head, r"(?s)^(.+),[^,]*$", 1)
    cut = F.when(at_comma != "", at_comma).otherwise(head)
    text = F.trim(F.when(F.length(address) > limit, cut).otherwise(address))
    return F.trim(F.translate(text, '{}"', ""))


def basic_info(pages: DataFrame, *keep: str) -> DataFrame:
    """Name, description, facility type and services of every page."""
    tag = lambda t: squeeze(visible(F.regexp_extract("_clean", rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1)))
    meta = lambda attr, value: F.trim(
        written_out(F.regexp_extract("_clean", rf'(?is)<meta[^>]*{attr}="{value}"[^>]*content="([^"]*)"', 1))
    )
    found = staged(pages, *keep).select(
        "page_id",
        *keep,
        tag("h1").alias("_h1"),
        tag("title").alias("_title"),
        meta("property", "og:title").alias("_og"),
        meta("name", "description").alias("_d1"),
        meta("property", "og:description").alias("_d2"),
        F.lower("_text").alias("_t"),
    )
    fits = lambda c: F.when((F.length(c) > 3) & (F.length(c) < 100), F.col(c))
    long = lambda c: F.when(F.length(c) > 20, F.col(c))
    services = F.filter(F.array(*[F.lit(s) for s in rules.SERVICES]), lambda s: F.contains(F.col("_t"), s))
    return found.select(
        "page_id",
        *keep,
        F.coalesce(fits("_h1"), fits("_title"), F.col("_og")).alias("name"),
        F.coalesce(long("_d1"), long("_d2"), F.lit("")).alias("description"),
        first_rule(F.col("_t"), rules.PAGE_TYPES, rules.PAGE_TYPE_DEFAULT).alias("facility_type"),
        F.transform(services, cleaning.title_case).alias("services"),
    )


def page_records(
    pages: DataFrame, patterns: Mapping[str, Sequence[str]] = rules.BODY_PATTERNS, keywords: Sequence[str] = tuple(rules.PAGE_KEYWORDS)
) -> DataFrame:
    """One record per page: name, contacts, distinct certification and initiative counts, confidence."""
    found = page_certifications(pages, patterns).select("page_id", "name").union(
        logo_certifications(pages, tuple(patterns)).select("page_id", "name")
    )
    n_certs = found.distinct().groupBy("page_id").agg(F.count("*").alias("n_certs"))
    n_init = keyword_contexts(pages, keywords).groupBy("page_id").agg(F.count("*").alias("n_initiatives"))
    joined = (
        basic_info(pages)
        .join(contact_details(pages), "page_id")
        .join(n_certs, "page_id", "left")
        .join(n_init, "page_id", "left")
        .fillna(0, subset=["n_certs", "n_initiatives"])
    )
    given = lambda c: filled(c) != ""
    return joined.withColumn(
        "confidence",
        score_more.page_confidence(
            given("name"), given("description"), given("phone") | given("email"), given("address"),
            F.col("n_certs"), F.col("n_initiatives"),
        ),
    )


# --- tables and blocks ---------------------------------------------------------------------


def _cells(row: Column) -> Column:
    raw = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(raw, lambda c: F.trim(written_out(F.regexp_replace(c, r"(?s)<[^>]*>", ""))))


def page_tables(pages: DataFrame) -> DataFrame:
    """Every table in the order of its start; a table inside a cell is one of its own."""
    split = computed_once(pages.select("page_id", "html"), _parts=markup.chunks(without_code("html"))).drop("html")
    spanned = computed_once(split, _spans=markup.spans(F.col("_parts"), "table"))
    each = spanned.select("page_id", "_parts", "_spans", F.posexplode("_spans").alias("table_no", "_span"))
    own = markup.own_text_of(F.col("_parts"), F.col("_span"), F.col("_spans"))
    return computed_once(each, _table=own).select("page_id", "table_no", "_table")


def table_rows(pages: DataFrame, columns: Sequence[str], table_id: str | None = None) -> DataFrame:
    """Table rows after the header with enough cells, cells named by position."""
    tables = page_tables(pages)
    if table_id is not None:
        tables = tables.filter(F.col("_table").rlike(rf'(?is)^<table\b[^>]*\bid="{table_id}"'))
    rows = F.regexp_extract_all("_table", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))
    each = tables.select("page_id", "table_no", F.posexplode(rows).alias("row_number", "_row")).filter("row_number > 0")
    split = computed_once(each, _c=_cells(F.col("_row")))
    return split.filter(F.size("_c") >= len(columns)).select(
        "page_id", "table_no", "row_number", *[F.col("_c")[i].alias(c) for i, c in enumerate(columns)]
    )


PORTAL_COLUMNS = ["serial_number", "reference_number", "name", "accreditation_number", "valid_from", "valid_upto", "remarks"]


def table_profile(pages: DataFrame) -> DataFrame:
    """Per table: id, rows, columns, headers and whether it speaks about hospitals."""
    rows = F.regexp_extract_all("_table", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))
    headers = _cells(F.coalesce(F.try_element_at("_rows", F.lit(1)), F.lit("")))
    text = F.lower(F.regexp_replace("_table", r"(?s)<[^>]*>", ""))
    tables = computed_once(computed_once(page_tables(pages), _rows=rows), _headers=headers)
    return tables.select(
        "page_id",
        "table_no",
        F.regexp_extract("_table", r'(?is)^<table\b[^>]*\bid="([^"]*)"', 1).alias("table_id"),
        F.size("_rows").alias("n_rows"),
        F.size("_headers").alias("n_columns"),
        F.array_join("_headers", "|").alias("headers"),
        has(text, *rules.TABLE_WORDS).cast("int").alias("has_hospital_data"),
    )


def element_counts(html: Column | str) -> Column:
    """struct of links, forms, images, lists and paragraphs on a page."""
    count = lambda tag: F.regexp_count(filled(html), F.lit(rf"(?i)<{tag}\b"))
    return F.struct(*[count(t).alias(n) for t, n in (("a", "links"), ("form", "forms"), ("img", "images"), ("li", "items"), ("p", "paragraphs"))])


def json_ld_rows(pages: DataFrame) -> DataFrame:
    """Organisation rows of JSON-LD blocks; the address may be an object or a text."""
    blocks = F.regexp_extract_all(filled("html"), F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    each = pages.select("page_id", F.explode(blocks).alias("_j")).filter(F.try_parse_json("_j").isNotNull())
    get = lambda p: F.get_json_object("_j", p)
    nested = get("$.address.streetAddress").isNotNull() | get("$.address.addressLocality").isNotNull() | get("$.address.addressRegion").isNotNull()
    return each.select(
        "page_id",
        F.coalesce(get("$.name"), F.lit("")).alias("name"),
        F.when(nested, F.coalesce(get("$.address.streetAddress"), F.lit(""))).otherwise(F.coalesce(get("$.address"), F.lit(""))).alias("address"),
        F.coalesce(get("$.address.addressLocality"), F.lit("Unknown")).alias("city"),
        F.coalesce(get("$.address.addressRegion"), F.lit("Unknown")).alias("state"),
        F.coalesce(get("$.telephone"), F.lit("")).alias("phone"),
        F.coalesce(get("$.email"), F.lit("")).alias("email"),
        F.coalesce(get("$.url"), F.lit("")).alias("website"),
    )


BLOCK_TAGS = ("div", "li", "article", "section", "tr")
BLOCK_CLASSES = ("organization", "hospital", "result", "card", "listing")


def page_blocks(pages: DataFrame, tags: Sequence[str] = BLOCK_TAGS, classes: Sequence[str] = BLOCK_CLASSES) -> DataFrame:
    """Repeated blocks: elements whose class holds one of the words, by tag depth.

    An element that holds several blocks of one class is their container and no block itself; a
    block inside another block that is none is a part of it. Nested elements stay in their block.
    """
    split = computed_once(pages.select("page_id", "html"), _parts=markup.chunks(without_code("html"))).drop("html")
    css = lambda s: F.regexp_extract(F.element_at("_parts", s["first"]), r'(?is)^<[a-z0-9]+\b[^>]*\bclass="([^"]*)"', 1)
    named = [
        F.transform(markup.spans(F.col("_parts"), t), lambda s: F.struct(s["first"], s["last"], css(s).alias("css")))
        for t in tags
    ]
    wanted = F.filter(F.concat(*named), lambda s: s["css"].rlike(rf"(?i)(?:{'|'.join(classes)})"))
    found = computed_once(split, _all=F.array_sort(wanted))
    inside = lambda a, b: (a["first"] > b["first"]) & (a["last"] < b["last"])
    kinds = lambda s: F.transform(F.filter("_all", lambda x: inside(x, s)), lambda x: x["css"])
    single = F.filter("_all", lambda s: once(kinds(s), lambda k: F.size(k) == F.size(F.array_distinct(k))))
    kept = computed_once(found, _single=single)
    outer = F.filter("_single", lambda s: ~F.exists("_single", lambda x: inside(s, x)))
    each = kept.select("page_id", "_parts", F.posexplode(outer).alias("block_no", "_span"))
    return computed_once(each, _b=markup.text_of(F.col("_parts"), F.col("_span"))).select("page_id", "block_no", "_b")


def directory_blocks(
    pages: DataFrame, tags: Sequence[str] = BLOCK_TAGS, classes: Sequence[str] = BLOCK_CLASSES,
    state: str = "Unknown", category: str = "Unknown",
) -> DataFrame:
    """Repeated blocks (cards, list items) -> organisation rows; search parameters fill gaps."""
    each = page_blocks(pages, tags, classes)
    plain = lambda c: squeeze(written_out(F.regexp_replace(c, r"(?s)<[^>]*>", "")))
    lines = written_out(F.regexp_replace(F.regexp_replace("_b", r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|span)>", "\n"), r"(?s)<[^>]*>", ""))
    within = computed_once(each, _t=F.trim(lines))
    filled_in = lambda c: once(c, lambda x: F.nullif(x, F.lit("")))
    heading = plain(F.regexp_extract("_b", r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>", 1))
    by_class = plain(F.regexp_extract("_b", r'(?is)<[a-z]+[^>]*class="[^"]*(?:name|title)[^"]*"[^>]*>(.*?)</', 1))
    strong = plain(F.regexp_extract("_b", r"(?is)<(?:strong|b)>(.*?)</", 1))
    attribute = F.trim(F.regexp_extract("_b", r'(?is)data-(?:name|hospital|organization)="([^"]*)"', 1))
    line = F.trim(F.split("_t", r"\n")[0])
    first_line = F.left(F.when(F.length(line) > 5, line).otherwise(F.col("_t")), F.lit(100))
    name = F.coalesce(*[filled_in(c) for c in (heading, by_class, strong, attribute, first_line)])
    find = lambda patterns: F.coalesce(
        *[filled_in(stripped(F.regexp_extract("_t", p, 1))) for p in patterns], F.lit("")
    )
    address = find(rules.BLOCK_ADDRESS)
    place = r"([A-Za-z\s]+),\s*([A-Za-z\s]+)$"
    dates_of = F.regexp_extract_all("_t", F.lit(r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"), F.lit(1))
    days = F.col("_days")
    named = computed_once(within, name=name).filter(F.length("name") > 2)
    rows = computed_once(named, address=address, _days=dates_of).select(
        "page_id",
        "block_no",
        "name",
        "address",
        find([rules.BLOCK_PHONE]).alias("phone"),
        F.regexp_extract("_t", rules.EMAIL_PATTERN, 0).alias("email"),
        F.regexp_extract("_b", r'(?is)<a\b[^>]*href="(http[^"]*)"', 1).alias("website"),
        first_rule(F.lower("_t"), rules.BLOCK_LEVELS, "Unknown").alias("accreditation_level"),
        F.lit(category).alias("accreditation_category"),
        F.when(F.size(days) >= 2, F.try_element_at(days, F.lit(1))).alias("valid_from"),
        F.when(F.size(days) >= 2, F.try_element_at(days, F.lit(2))).otherwise(F.try_element_at(days, F.lit(1))).alias("valid_until"),
        find(rules.BLOCK_CERTIFICATE).alias("certificate_number"),
    )
    city, region = F.trim(F.regexp_extract("address", place, 1)), F.trim(F.regexp_extract("address", place, 2))
    return (
        rows.withColumn("city", F.when(city != "", city).otherwise("Unknown"))
        .withColumn("state", F.when((region != "") & F.lit(state == "Unknown"), region).otherwise(state))
    )


# --- free text -----------------------------------------------------------------------------


def names_in_text(texts: DataFrame, patterns: Sequence[str] = tuple(rules.NAME_PATTERNS)) -> DataFrame:
    """Distinct organisation names longer than five letters per text."""
    finds = F.flatten(F.array(*[F.regexp_extract_all(filled("text"), F.lit(p), F.lit(1)) for p in patterns]))
    trimmed = F.array_distinct(F.filter(F.transform(finds, stripped), lambda n: F.length(n) > 5))
    return texts.select("doc_id", F.explode(trimmed).alias("name"))


def lines_of(texts: DataFrame) -> DataFrame:
    """Trimmed lines with their number."""
    each = texts.select("doc_id", F.posexplode(F.split(filled("text"), r"\n")).alias("line_no", "_l"))
    return computed_once(each, line=stripped(F.col("_l"))).drop("_l")


def document_rows(texts: DataFrame, cities: Sequence[str] | None = None) -> DataFrame:
    """Registry documents: pipe rows after the first header line, other lines by name pattern.

    Each row carries name, number, ISO standard, date, scope and the cities found.
    """
    from meritgrid.rules.filters import CITIES

    gazetteer = tuple(cities or CITIES)
    lines = lines_of(texts).filter("line != ''")
    header = has("line", *rules.LINE_HEADERS)
    first = lines.filter(header).groupBy("doc_id").agg(F.min("line_no").alias("_head"))
    marked = lines.filter(~header).join(first, "doc_id", "left")
    in_table = F.col("line").contains("|") & (F.col("line_no") > F.col("_head"))
    in_table = F.coalesce(in_table, F.lit(False))
    return _piped_rows(marked.filter(in_table), gazetteer).unionByName(_line_rows(marked.filter(~in_table), gazetteer))


def _piped_rows(lines: DataFrame, gazetteer: Sequence[str]) -> DataFrame:
    """Pipe rows: the first text cell is the name, other cells are told apart by pattern."""
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rows = computed_once(lines.select("doc_id", "line_no", "line"), _c=cells).drop("line").filter(F.size("_c") >= 2)
    at = F.array_min(F.array_compact(F.transform("_c", lambda c, i: F.when(~c.rlike(r"^\d+$"), i))))
    rows = computed_once(rows, _at=at)
    others = F.filter(
        F.transform("_c", lambda c, i: F.when((i != F.col("_at")) & ~((i == 0) & c.rlike(r"^\d+$")), c)), lambda c: c.isNotNull()
    )
    place = "(?i)" + "|".join(gazetteer)

    def kind(c: Column) -> Column:
        return (
            F.when(c.rlike(place), "place")
            .when(c.rlike(rules.LINE_NUMBER), "number")
            .when(c.rlike(rules.LINE_ISO), "iso")
            .when(c.rlike(rules.LINE_DATE), "date")
            .when(c.rlike(rules.LINE_SCOPE), "scope")
        )

    name = cleaning.document_name(F.try_element_at("_c", F.col("_at") + 1))
    rows = computed_once(rows, name=name).filter(F.length("name") > 3)
    rows = computed_once(rows, _o=F.transform(others, lambda c: F.struct(c.alias("c"), kind(c).alias("k"))))
    of_kind = lambda k: F.transform(F.filter("_o", lambda o: o["k"] == k), lambda o: o["c"])
    last = lambda k: F.try_element_at(of_kind(k), F.lit(-1))
    spots = F.array_join(of_kind("place"), " ")
    return rows.select(
        "doc_id", "line_no", "name",
        F.coalesce(last("number"), F.lit("")).alias("accreditation_number"),
        F.coalesce(last("iso"), F.lit("ISO 15189")).alias("iso_standard"),
        F.coalesce(last("date"), F.lit("")).alias("validity_date"),
        F.coalesce(last("scope"), F.lit("")).alias("scope"),
        F.array_join(cleaning.cities_in(spots, gazetteer), "|").alias("locations"),
        F.lit("table").alias("method"),
    )


def _line_rows(lines: DataFrame, gazetteer: Sequence[str]) -> DataFrame:
    """Other lines: whole line is a name; fields are found inside it."""
    usable = lines.filter(~has(F.lower("line"), *rules.LINE_SKIPS) & F.col("line").rlike(rules.LINE_NAME))
    find = lambda p: F.regexp_extract("line", p, 0)
    iso = find(rules.LINE_ISO)
    named = computed_once(usable, name=cleaning.document_name(find(rules.LINE_NAME)))
    return named.filter(F.length("name") >= 4).select(
        "doc_id", "line_no", "name",
        find(rules.LINE_NUMBER).alias("accreditation_number"),
        F.when(iso != "", iso).otherwise("ISO 15189").alias("iso_standard"),
        find(rules.LINE_DATE).alias("validity_date"),
        find(rules.LINE_SCOPE).alias("scope"),
        F.array_join(cleaning.cities_in("line", gazetteer), "|").alias("locations"),
        F.lit("line").alias("method"),
    )


def laboratory_entries(texts: DataFrame) -> DataFrame:
    """Text lines -> laboratory entries: a name line starts one, later phone and site lines join it.

    The address is the run of up to four lines after the name that are neither blank nor a phone
    or site. The window runs inside one document, whose lines came out of one text cell.
    """
    lines = lines_of(texts)
    text = F.col("line")
    is_name = has(F.lower(text), *rules.LAB_LINE_WORDS) & (F.length(text) > 10) & (F.length(text) < 100) & text.rlike(r"\p{L}")
    phone = cleaning.has_phone(text)
    site = has(F.lower(text), "website") | F.startswith(text, F.lit("http"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.select(
        "doc_id", "line_no", "line", is_name.alias("_name"), (phone & ~is_name).alias("_phone"),
        (site & ~is_name & ~phone).alias("_site"), ((text == "") | phone | site).alias("_stop"),
    )
    entry = F.sum(F.col("_name").cast("int")).over(w)
    following = [F.struct(F.lead("line", j).over(w).alias("l"), F.coalesce(F.lead("_stop", j).over(w), F.lit(True)).alias("s")) for j in range(1, 5)]
    grouped = marked.withColumn("entry_no", entry).withColumn("_next", F.array(*following)).filter("entry_no > 0")
    stop = F.array_min(F.transform("_next", lambda x, i: F.when(x["s"], i).otherwise(F.lit(4))))
    address = F.array_join(F.transform(F.slice("_next", F.lit(1), stop), lambda x: x["l"]), ", ")
    return grouped.withColumn("_address", address).groupBy("doc_id", "entry_no").agg(
        F.max(F.when(F.col("_name"), F.col("line"))).alias("name"),
        F.max(F.when(F.col("_name"), F.col("_address"))).alias("address"),
        F.max_by(F.when(F.col("_phone"), F.col("line")), F.when(F.col("_phone"), F.col("line_no"))).alias("phone"),
        F.max_by(F.when(F.col("_site"), F.col("line")), F.when(F.col("_site"), F.col("line_no"))).alias("website"),
    )


def phrase_tags(texts: DataFrame, dictionary: Mapping[str, Sequence[str]]) -> DataFrame:
    """Tags whose phrases occur in a text, with the number of different phrases."""
    lowered = F.lower(filled("text"))
    tags = [
        F.struct(F.lit(tag).alias("tag"), hits(lowered, phrases).cast("long").alias("n_phrases")) for tag, phrases in dictionary.items()
    ]
    return texts.select("doc_id", F.inline(F.array(*tags))).filter("n_phrases > 0")


def accreditation_tags(texts: DataFrame) -> DataFrame:
    return phrase_tags(texts, score_rules.ACCREDITATION_PHRASES)


def indicator_tags(texts: DataFrame) -> DataFrame:
    return phrase_tags(texts, score_rules.INDICATOR_PHRASES)


def lexicon_sentiment(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean polarity of the words of a text that the lexicon knows, 0 without any."""
    token = F.explode(F.split(F.lower(filled("text")), r"[^\p{L}]+"))
    known = texts.select("doc_id", token.alias("word")).join(lexicon.select("word", "polarity"), "word")
    scored = known.groupBy("doc_id").agg(F.avg("polarity").alias("_s"), F.count("*").alias("n_words"))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("_s", F.lit(0.0))))
    return texts.select("doc_id").join(scored, "doc_id", "left").select("doc_id", value.alias("sentiment"), F.coalesce("n_words", F.lit(0)).alias("n_words"))
