"""Nested elements against Python's own HTML parser."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from meritgrid.operators import extract, markup


class Elements(HTMLParser):
    """Start, end and depth of the elements of one tag, as offsets in the page."""

    def __init__(self, tag, html):
        super().__init__()
        self.tag, self.html, self.open, self.found = tag, html, [], []
        self.lines = [0]
        for line in html.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(html)
        self.close()
        self.found += [(at, len(html), i + 1) for i, at in enumerate(self.open)]

    def at(self):
        line, offset = self.getpos()
        return self.lines[line - 1] + offset

    def handle_starttag(self, tag, attrs):
        if tag == self.tag:
            self.open.append(self.at())

    def handle_endtag(self, tag):
        if tag == self.tag and self.open:
            end = self.html.index(">", self.at()) + 1
            self.found.append((self.open[-1], end, len(self.open)))
            self.open.pop()


def page(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(4)):
        tag = rng.choice(["div", "table", "tr", "td", "p"])
        inner = page(rng, depth + 1) if depth < 4 else "x"
        out += f'<{tag} class="a b">t{rng.randrange(9)} {inner}' + (f"</{tag}>" if rng.random() < 0.9 else "") + "\ntail "
    return out + (f"</{rng.choice(['div', 'td'])}>" if rng.random() < 0.1 else "")


@pytest.mark.parametrize("tag", ["div", "table", "td"])
def test_elements_equal_the_parser(spark, tag):
    rng = random.Random(tag)
    pages = [f"start {page(rng)}" for _ in range(60)] + ["", "no tags", f"<{tag}>", f"</{tag}>", f"<{tag}>a</{tag}>b"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("p", markup.chunks("html"))
    spans = df.withColumn("s", markup.spans(F.col("p"), tag))
    texts = F.transform("s", lambda s: F.struct(markup.text_of(F.col("p"), s), s["depth"]))
    for r in spans.select("page_id", texts.alias("t")).collect():
        want = sorted(Elements(tag, pages[r.page_id]).found)
        assert [tuple(x) for x in r.t] == [(pages[r.page_id][a:b], d) for a, b, d in want], pages[r.page_id]


def frame(spark, html):
    return spark.createDataFrame([(1, html)], "page_id long, html string")


def test_a_table_inside_a_cell_is_a_table_of_its_own(spark):
    html = (
        "<table id='o'><tr><th>A</th><th>B</th></tr><tr><td>1 <table id=\"in\"><tr><td>in</td></tr><tr><td>x</td></tr>"
        "</table> tail</td><td>2</td></tr></table><!-- <table> --><table id=\"last\"><tr><td>z"
    )
    got = {r.table_no: (r.n_rows, r.headers) for r in extract.table_profile(frame(spark, html)).collect()}
    assert got == {0: (2, "A|B"), 1: (2, "in"), 2: (0, "")}
    rows = extract.table_rows(frame(spark, html), ["a", "b"]).collect()
    assert [(r.table_no, r.row_number, r.a, r.b) for r in rows] == [(0, 1, "1  tail", "2")]


def test_cards_keep_what_stands_behind_an_inner_block(spark):
    card = lambda i: (
        f'<div class="card"><div class="card-title"><b>House {i}</b></div><div><span>Address: {i} Road, Gotham, Zenda</span></div>'
        f"<p>Phone: 555-010-200{i} 67</p></div>"
    )
    html = f'<section class="results">{card(1)}<p>between</p>{card(2)}</section><li class="listing"><b>Plain House</b>'
    got = extract.directory_blocks(frame(spark, html)).orderBy("block_no").collect()
    assert [(r.name, r.city, r.phone) for r in got] == [
        ("House 1", "Gotham", "555-010-2001 67"), ("House 2", "Gotham", "555-010-2002 67"), ("Plain House", "Unknown", "")
    ]


def test_address_element_ends_at_its_own_depth(spark):
    html = '<p>x</p><div class="my address"><div>1 High</div><span>Street, Springfield</span>, Ohio</div>, no'
    r = extract.contact_details(frame(spark, html)).first()
    assert (r.address, r.city, r.state) == ("1 High Street, Springfield , Ohio", "Springfield", "Ohio")
    assert extract.contact_details(frame(spark, "<p>nothing</p>")).first().address == ""
    assert extract.contact_details(frame(spark, None)).first().address == ""
