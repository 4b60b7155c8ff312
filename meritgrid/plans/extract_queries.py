"""Queries over page and text extraction.

The invented prose holds none of the reference phrases, so pattern and keyword tables made of its
frequent words are passed in; tables, blocks and lines are derived from organisation rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgrid.functions.exprs import num
from meritgrid.operators import extract
from meritgrid.plans.registry import Views, query
from meritgrid.plans.text_queries import pick
from meritgrid.session import small_table

PATTERNS = {
    "ALPHA": [r"zzz never", r"of the\w*", r"and the"],
    "BETA": [r"was.*ing the", r"la \w+"],
    "GAMMA": [r"der \w+ und", "que de"],
    "NABH": [r"nabh"],
}
KEYWORDS = ["of the", "de la", "in the", "und die", "never here"]
INITIATIVES = {"and the": (12, "First"), "was": (15, "Second"), "der": (8, "Third"), "que": (10, "Fourth")}
BOOSTS = ["tion", "ment"]


@query("page_texts")
def _page_texts(v: Views) -> DataFrame:
    body = extract.page_text("html")
    return v.pages.select("page_id", F.length(body).cast("long").alias("n_chars"), F.md5(body).alias("digest"))


@query("page_certifications")
def _page_certs(v: Views) -> DataFrame:
    return extract.page_certifications(v.pages, PATTERNS).select("page_id", "name", "match", "context")


@query("logo_certifications")
def _logos(v: Views) -> DataFrame:
    image = F.concat(F.lit('<img src="x.png" alt="'), pick(["JCI certified", "plain", "NABH &amp; ISO logo", "iso 9001"], F.col("page_id")), F.lit('"><IMG class=a alt="Jci" >'))
    pages = v.pages.select("page_id", F.concat("html", image).alias("html"))
    return extract.logo_certifications(pages).select("page_id", "name").groupBy("page_id", "name").agg(F.count("*").alias("n"))


@query("keyword_contexts")
def _contexts(v: Views) -> DataFrame:
    return extract.keyword_contexts(v.pages, KEYWORDS).select("page_id", "keyword", F.length("context").cast("long").alias("n_context"))


@query("page_initiatives")
def _initiatives(v: Views) -> DataFrame:
    return extract.page_initiatives(v.pages, INITIATIVES, BOOSTS).select("page_id", "place", "name", "category", "impact_score")


@query("contact_details")
def _contacts(v: Views) -> DataFrame:
    """Contacts of the pages as they are, every one with an address block of nested tags at its end."""
    extra = F.concat(
        F.lit('<div class="contact-address"><div><b>'), F.col("page_id").cast("string"), F.lit(" High</b> Street,</div> <span>Springfield</span>, Ohio</div><p>Call (555) 010-"),
        F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"), F.lit(" or desk@site"), (F.col("page_id") % 7).cast("string"), F.lit(".example.org</p>"),
    )
    return extract.contact_details(v.pages.select("page_id", F.concat("html", extra).alias("html")))


@query("page_basics")
def _basics(v: Views) -> DataFrame:
    info = extract.basic_info(v.pages)
    return info.select("page_id", "name", "facility_type", F.array_join("services", "|").alias("services"))


@query("page_records")
def _records(v: Views) -> DataFrame:
    out = extract.page_records(v.pages, PATTERNS, KEYWORDS)
    return out.select("page_id", F.col("n_certs").cast("long").alias("n_certs"), F.col("n_initiatives").cast("long").alias("n_initiatives"), num("confidence").alias("confidence"))


def org_tables(v: Views) -> DataFrame:
    """One page per organisation with a portal table of two data rows."""
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit("</td>"))
    row = lambda no: F.concat(
        F.lit("<tr class='r'>"), cell(F.lit(no)), cell(F.concat(F.lit("R"), F.col("seq").cast("string"))), cell(F.concat(F.lit("<b>"), F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("</b>"))),
        cell(F.lit("PEH-2015-0001")), cell(F.lit("04 May 2015")), cell(F.lit("03 May 2018")), cell(F.col("state")), F.lit("</tr>")
    )
    short = F.when(F.col("seq") % 3 == 0, "<tr><td>only</td></tr>").otherwise("")
    table = F.concat(F.lit('<TABLE id="grid" border=1><tr><th>No</th><th>Ref</th><th>Name</th></tr>'), row("1"), short, row("2"), F.lit("</TABLE>"))
    return v.orgs.select(F.col("seq").alias("page_id"), F.concat(F.lit("<html><body><a href=x>y</a>"), table, F.lit("<table><tr><td>z</td></tr></table></body></html>")).alias("html"))


@query("table_rows")
def _table_rows(v: Views) -> DataFrame:
    return extract.table_rows(org_tables(v), extract.PORTAL_COLUMNS, "grid").select("page_id", "row_number", "serial_number", "reference_number", "name", "remarks")


@query("table_profile")
def _table_profile(v: Views) -> DataFrame:
    return extract.table_profile(org_tables(v))


@query("element_counts")
def _elements(v: Views) -> DataFrame:
    counts = extract.element_counts("html")
    return v.pages.select("page_id", *[counts[c].cast("long").alias(c) for c in ("links", "forms", "images", "items", "paragraphs")])


@query("json_ld_rows")
def _json_ld(v: Views) -> DataFrame:
    address = F.to_json(F.struct(F.struct(F.col("city").alias("streetAddress"), F.nullif(F.col("state"), F.lit("Unknown")).alias("addressRegion")).alias("address"), F.col("name").alias("name")))
    plain = F.to_json(F.struct(F.col("country").alias("address"), F.col("name").alias("name"), F.col("phone").alias("telephone")))
    block = F.when(F.col("seq") % 2 == 0, address).otherwise(plain)
    broken = F.when(F.col("seq") % 5 == 0, '<script type="application/ld+json">{oops</script>').otherwise("")
    html = F.concat(F.lit('<head><script type="application/ld+json">'), block, F.lit("</script>"), broken, F.lit("</head>"))
    return extract.json_ld_rows(v.orgs.select(F.col("seq").alias("page_id"), html.alias("html"))).select("page_id", "name", "address", "city", "state", "phone")


@query("directory_blocks")
def _blocks(v: Views) -> DataFrame:
    first = F.concat(
        F.lit('<div class="result big"><h3>'), F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("</h3><p>Address: "), F.col("country"), F.lit(" Road, Gotham, Zenda</p><p>Phone: 555-010-2345 67</p><p>Mail x@y.example</p><p>Full level 01/02/2020 and 01/02/2023</p><p>Certificate No: PEH/12</p><a href=\"http://a.example/\">site</a></div>")
    )
    second = F.concat(F.lit('<li class="listing"><strong>'), F.col("region"), F.lit(" House</strong><p>entry</p></li>"))
    html = F.concat(F.lit("<html>"), first, F.lit("<div class=other>no</div>"), second, F.lit("</html>"))
    rows = extract.directory_blocks(v.orgs.select(F.col("seq").alias("page_id"), html.alias("html")))
    return rows.select("page_id", "block_no", "name", "address", "city", "state", "phone", "email", "website", "accreditation_level", "valid_from", "valid_until", "certificate_number")


def prose(v: Views) -> DataFrame:
    """Sentences naming organisations."""
    said = F.concat(F.lit("Visited "), F.col("name"), F.lit(". Then 12 beds; "), F.col("region"), F.lit(" Trust. Dr. Ann Lee Clinic, ok"))
    return v.orgs.select(F.col("seq").alias("doc_id"), said.alias("text"))


@query("names_in_text")
def _names(v: Views) -> DataFrame:
    return extract.names_in_text(prose(v))


def registry_document(v: Views) -> DataFrame:
    """Registry document per organisation: a free line, a header, pipe rows."""
    free = F.concat(F.split("name", " ")[0], F.lit(" Care Pvt Ltd"))
    row = F.concat(F.lit("1 | "), F.col("name"), F.lit(" | Pune, MH | MC-"), (F.col("seq") % 9000 + 1000).cast("string"), F.lit(" | 01/02/2024 | Pathology"))
    odd = F.concat(F.lit("| "), F.col("region"), F.lit(" Centre | ISO 17025"))
    text = F.concat_ws("\n", free, F.lit("  "), F.lit("S.No | Organization | Place"), row, F.lit("page 3 of list"), odd)
    return v.orgs.select(F.col("seq").alias("doc_id"), text.alias("text"))


@query("document_rows")
def _documents(v: Views) -> DataFrame:
    return extract.document_rows(registry_document(v))


@query("laboratory_entries")
def _entries(v: Views) -> DataFrame:
    text = F.concat_ws(
        "\n", F.lit("intro"), F.concat(F.col("name"), F.lit(" Laboratory")), F.concat(F.lit("12 Long Way "), F.col("country")), F.lit("Suite 4"), F.concat(F.lit("555-010-"), F.lpad((F.col("seq") % 10000).cast("string"), 4, "0")),
        F.lit("Website"), F.lit(""), F.concat(F.col("region"), F.lit(" Pathology Unit")), F.lit(""), F.lit("after gap"),
    )
    return extract.laboratory_entries(v.orgs.select(F.col("seq").alias("doc_id"), text.alias("text"))).select("doc_id", "entry_no", "name", "address", "phone", "website")


@query("phrase_tags")
def _tags(v: Views) -> DataFrame:
    return extract.phrase_tags(v.documents, {"english": ["of the", "and the", "was "], "french": ["que ", " de la"], "german": [" und ", " der "]})


@query("public_tags")
def _public_tags(v: Views) -> DataFrame:
    said = F.concat(F.col("name"), F.lit(" is "), pick(["NABH accredited", "a top 10 place", "JCI Accredited with telemedicine", "plain"], F.col("seq")))
    texts = v.orgs.select(F.col("seq").alias("doc_id"), said.alias("text"))
    return extract.accreditation_tags(texts).union(extract.indicator_tags(texts))


@query("lexicon_sentiment")
def _sentiment(v: Views) -> DataFrame:
    rows = [("the", 0.5), ("of", -0.25), ("de", 0.75), ("und", -1.0), ("was", 0.1)]
    lexicon = small_table(v.spark, rows, word="string", polarity="double")
    return extract.lexicon_sentiment(v.documents, lexicon).select("doc_id", num("sentiment").alias("sentiment"), F.col("n_words").cast("long").alias("n_words"))
