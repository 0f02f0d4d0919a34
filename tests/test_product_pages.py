"""Product pages and their structured data: worked pages, and elements against a plain parser."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import linked_data, markup, product_pages


def ld(x):
    return f'<script type="application/ld+json">{x}</script>'


PRODUCT = ld('{"@type": "Product", "name": "Test", "sku": "12345"}')
PAGES = {
    1: f"<html><head>{PRODUCT}</head><body><nav aria-label='Breadcrumb'><ol><li><a href='/a'>Sortiment</a></li><li><a href='/b'>Medisinsk forbruk</a></li><li><a href='/c'>Sterilisering</a></li></ol></nav></body></html>",
    2: f'<html><head>{PRODUCT}</head><body><div class="breadcrumb-nav"><a href="/a">Sortiment</a>\n<a href="/b">Medisinsk</a> <a>›</a><a href="/c">Sterilisering</a></div></body></html>',
    3: f"""<html><head>{PRODUCT}</head><body><div id="accordionItem_specifications"><table><tr><td>Antall i pakningen</td><td>100 stk</td></tr><tr><td>Antall i transport-pakke</td><td>10</td></tr>
        <tr><td>Antall på pall</td><td>50</td></tr></table></div></body></html>""",
    4: f"<html><head>{PRODUCT}</head><body><table><tr><td>Antall pr pakning</td><td>200</td></tr></table></body></html>",
    5: ld('{"@type": "Product", "name": "Test Product", "description": "Short desc."}')
    + '<div id="accordionItem_descriptionAndDocuments"><p>This is a comprehensive product description with detailed information\n about the features.</p><ul><li>one</li><li> two </li></ul>loose</div>',
    6: ld('{"@type": "Product", "name": "Test Product", "description": "JSON-LD description text."}'),
    7: ld('{"@type": "Product", "description": "Good enough description text here."}') + '<h1> A <b>name</b> </h1><div id="accordionItem_descriptionAndDocuments"><p>Similar length description text.</p></div>',
    8: ld("{broken") + "<dl><dt>Farge:</dt><dd>blå</dd><dt>Size</dt><dd></dd><dt>Vekt</dt><dd>2 kg</dd><dt>lone</dt></dl><div class='tech-spec'><ul><li>Form: rund: flat</li><li>none</li></ul><span class='label'>Produsent</span><span class='value'>Acme</span></div>",
    9: '<meta name="description" content="A meta text of more than twenty characters"><p>Lev. art. nr: AB-12/3 og 50 stk per pakning, transportpakke: 12</p>',
    10: "<main><p>short</p>" + "".join(f"<p>paragraph {k} of a good thirty characters and more</p>" for k in range(5)) + "</main>",
    11: '<div class="Brand">  Maker&nbsp;&amp; Sons </div><table><tr><th>Farge</th><td>red</td></tr><tr><td>Farge</td><td>blue</td></tr><tr><td>one cell</td></tr></table>',
    12: None,
    13: "",
    14: '<div id="accordion-specification">Free text on it.<br>Second line   here</div><ol class="crumb"><li>A</li><li>B</li></ol>',
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(k, x, "n", 1) for k, x in PAGES.items()], "page_id long, html string, name string, pos int")
    return {r.page_id: r for r in product_pages.parsed(rows).collect()}


def test_one_row_for_each_page(parsed):
    assert sorted(parsed) == sorted(PAGES)
    assert parsed[12].name is None and parsed[13].description is None and parsed[12].image_url == "https://images.example/12.jpg"


def test_breadcrumbs(parsed):
    assert parsed[1].crumbs == ["Sortiment", "Medisinsk forbruk", "Sterilisering"] and parsed[1].category == "Sterilisering"
    assert parsed[2].crumbs == ["Sortiment", "Medisinsk", "Sterilisering"]
    assert parsed[14].crumbs == ["A", "B"] and parsed[3].crumbs is None


def test_packaging(parsed):
    assert parsed[3].packaging_info == "Antall i pakning: 100 stk; Antall i transportpakke: 10; Antall på pall: 50"
    assert (parsed[3].packaging_unit, parsed[3].transport_packaging) == ("100 stk", "10")
    assert "200" in parsed[4].packaging_info
    assert (parsed[9].packaging_info, parsed[9].packaging_unit, parsed[9].transport_packaging) == ("50 stk per pakning", "50 stk", "12 stk")
    assert parsed[6].packaging_info is None


def test_descriptions(parsed):
    assert parsed[5].description.split("\n")[-3:] == ["• one", "• two", "loose"] and "comprehensive" in parsed[5].description
    assert parsed[6].description == "JSON-LD description text."
    assert parsed[7].description == "Good enough description text here." and parsed[7].name == "Aname"
    assert parsed[9].description == "A meta text of more than twenty characters"
    assert parsed[10].description.split("\n") == [f"paragraph {k} of a good thirty characters and more" for k in range(3)]


def test_specifications_and_maker(parsed):
    assert [(x.key, x.value) for x in parsed[8].specs] == [("Farge", "blå"), ("Vekt", "2 kg"), ("Form", "rund: flat"), ("Produsent", "Acme")]
    assert parsed[8].manufacturer == "Acme" and parsed[8].specification.split("\n")[0] == "Farge: blå"
    assert [(x.key, x.value) for x in parsed[11].specs] == [("Farge", "blue")] and parsed[11].manufacturer == "Maker & Sons"
    assert parsed[9].mfr_number == "AB-12/3" and parsed[14].specification == "Free text on it.\nSecond line here"


def test_a_whole_page(spark):
    names = ["Sortiment", "Medisinsk forbruksmateriell", "Sterilisering autoklavering", "Steriliseringsposer flate", "Steriliseringspose flat"]
    trail = ", ".join(f'{{"@type": "ListItem", "position": {k}, "item": {{"name": "{x}"}}}}' for k, x in reversed(list(enumerate(names, 1))))
    cells = {"Materiale": "Papir/Plast", "Størrelse": "100x250mm", "Steriliseringsmetode": "Damp", "Antall i pakningen": "200 stk", "Antall i transport-pakke": "20", "Antall på pall": "100"}
    html = f"""<html><head>{ld('{"@type": "Product", "name": "Steriliseringspose flat 100x250mm", "brand": {"@type": "Brand", "name": "Steriking"}, "image": "https://x/1.jpg", "url": "https://x/p"}')}
        {ld('{"@type": "BreadcrumbList", "itemListElement": [' + trail + ']}')}</head><body><h1>Other</h1><div id="accordionItem_specifications"><table>{"".join(f"<tr><td>{k}</td><td>{v}</td></tr>" for k, v in cells.items())}</table></div></body></html>"""
    (p,) = product_pages.parsed(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert p.name == "Steriliseringspose flat 100x250mm" and p.manufacturer == "Steriking" and p.crumbs == names and p.category == names[-1]
    assert {x.key: x.value for x in p.specs} == cells and "200" in p.packaging_info and p.image_url == "https://x/1.jpg" and p.product_url == "https://x/p"


def test_linked_data_at_any_depth(spark):
    html = ld('[{"@type": "BreadcrumbList", "itemListElement": [{"position": 2, "name": "y"}, {"position": 1, "item": {"name": "x"}}, {"position": 3, "name": " "}, {"item": "http://u"}]}, {"@graph": [{"@type": ["List", "L"]}, [{"@type": "Deep"}]]}, 7]')
    deep = ld("[" * 30 + '{"@type": "Product", "name": "n", "offers": {"@type": "Offer", "price": 3.5}}' + "]" * 30)
    last = ld('{"@type": "Product", "name": "first", "brand": "B", "offers": {"price": 2}}') + ld("nothing") + ld('{"@type": "Product", "name": "second", "sku": 12}')
    pages = spark.createDataFrame([(1, html), (2, deep), (3, last), (4, None), (5, "<p>none</p>")], "page_id long, html string")
    found = linked_data.nodes(linked_data.scripts(pages)).select("page", "script", F.size("path").alias("depth"), "type").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 1, "BreadcrumbList"), (1, 0, 3, "List"), (1, 0, 4, "Deep"), (2, 0, 30, "Product"), (2, 0, 31, "Offer"), (3, 0, 0, "Product"), (3, 2, 0, "Product")]
    rows = {r.page: r for r in linked_data.products(pages).collect()}
    assert rows[1].crumbs == ["x", "y"] and rows.keys() == {1, 3}
    assert (rows[3].name, rows[3].sku, rows[3].brand, rows[3].price) == ("second", "12", "B", None)


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open, self.done, self.n = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.open.append([self.n, tag, ""])
        self.n += 1

    def handle_endtag(self, tag):
        at, name, text = self.open.pop()
        assert name == tag
        self.done.append((at, name, text))

    def handle_data(self, data):
        for x in self.open:
            x[2] += data.strip()


def test_elements_equal_a_plain_parser(spark):
    r = random.Random(4)

    def tree(depth):
        name = r.choice(["div", "p", "li", "td", "b"])
        inner = "".join(tree(depth - 1) if depth and r.random() < 0.7 else r.choice(["x ", " y", "z &amp; w", "\n", "é"]) for _ in range(r.randrange(4)))
        return f'<{name} class="a>b" id=q>{inner}</{name}>'.replace(' class="a>b"', ' class="ab"')

    rows = [(k, "<html>" + "".join(tree(5) for _ in range(3)) + "</html>") for k in range(40)]
    tokens = markup.stream(spark.createDataFrame(rows, "page_id long, html string"))
    found = markup.with_text(markup.elements(tokens), tokens).select("page", "pos", "name", "text").collect()
    for k, html in rows:
        plain = Plain()
        plain.feed(html)
        mine = sorted((x.pos, x.name, x.text) for x in found if x.page == k)
        assert [x[1:] for x in mine] == [x[1:] for x in sorted(plain.done)]


def test_pages_stay_in_their_rows(spark):
    html = '<html><body><div class="spec-list"><div/>Mål<ul><li>a: 1</li><li>b: 2</li></ul></div><table><tr><td>k</td><td>v<br>w</td></tr><tr><td>open'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "</p></p><p>x</p>")], "page_id long, html string")
    done = product_pages.pages_of(pages)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    got = {r.page: r for r in done.collect()}
    assert (got[1].text, got[1].raw, got[2].text, got[3].text) == ("Måla: 1b: 2kvwopen", "Måla: 1b: 2kv\nwopen", None, "x") and not got[2].regions
    assert [(r.name, r.text, [i.name for i in r.inner]) for r in got[1].regions] == [("div", "Måla: 1b: 2", ["div", "", "ul", "li", "li"]), ("tr", "kvw", ["td", "td"]), ("tr", "open", ["td"])]
    pairs = {r.page: [tuple(x) for x in r.x or []] for r in done.select("page", product_pages.last_values(product_pages.specifications()).alias("x")).collect()}
    assert pairs == {1: [("k", "vw"), ("a", "1"), ("b", "2")], 2: [], 3: []}
