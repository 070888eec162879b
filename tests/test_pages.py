"""Parsing and merging on small pages."""

import pytest

from pagewright.config import EngineConfig
from pagewright.functions import vocab
from pagewright.operators import parse
from pagewright.plans import extract

URL = "https://demo.example.test/p"
LD = '<script type="application/ld+json">%s</script>'
GARBAGE = [
    "", "\x02\ufffd", "<li>" * 4000, "<section>" * 2500 + "deep", "<tr>" * 500 + "<td>", "<a <b <c", LD % '{"@type":["Product",3],"name":{"@value":[]},"offers":7}', LD % "[1,", LD % '{"@type":"Product","offers":{"price":Infinity}}',
    '<meta property="og:price:amount" content="1e400">', '<meta property="og:image" content="//[">', "<i><div>y</i></div>", '<b id="price">--</b>', "<dl><dt>only", "<tr><th>Brand", LD % '"text"', LD % '{"@type":"Product","@id":"#a","isVariantOf":{"@id":"#a"},"brand":{"@id":"#a"}}',
]


def rows(spark, pages, config=EngineConfig()):
    df = spark.createDataFrame([(f"{URL}{i}", h) for i, h in enumerate(pages)], "url string, html string")
    return {r.url: r for r in extract.extract_pages(df, config).collect()}


def test_garbage_and_invariant(spark):
    got = rows(spark, [*GARBAGE, None])
    assert len(got) == len(GARBAGE) + 1
    for r in got.values():
        assert set(r.source_method) == set(r.confidence) == set(vocab.FIELDS)
        for f in vocab.FIELDS:
            value = r.price_text if f == "price" else r[f]
            assert (value is None) == (r.source_method[f] is None) == (r.confidence[f] is None)
    assert got[f"{URL}0"].warnings[0] == "No product data was found on this page."


def test_sources_and_clashes(spark):
    item = '{"@type":"Product","name":"A","sku":"S1","offers":{"price":"89.00","priceCurrency":"EUR"}}'
    og = '<meta property="og:title" content="B"><meta property="product:price:amount" content="%s"><meta property="product:price:currency" content="EUR">'
    bare = '{"@type":"Product","name":"A","offers":{"price":89}}'
    got = rows(
        spark,
        [
            f"<head>{LD % item}{og % '89'}</head>",
            f"<head>{LD % item}{og % '90'}</head>",
            f"<head>{LD % bare}{og % '89.0'}</head>",
            f"<head>{LD % bare}{og % '90'}</head>",
            LD % '{"@type":"Product","name":"P","offers":{"@type":"AggregateOffer","lowPrice":"10","highPrice":"20","priceCurrency":"USD"}}',
            LD % '{"@type":"Product","name":"One"}' + LD % '{"@type":"Product","name":"Two","offers":{"price":"5"}}' + LD % "{",
            LD % '{"@graph":[{"@id":"#b","name":"Brand"},{"@type":"Product","@id":"#p","name":"N","brand":{"@id":"#b"},"isRelatedTo":{"@type":"Product","name":"no"},"self":{"@id":"#p"}}]}',
            LD % '{"@type":"ProductGroup","name":"G","hasVariant":[{"@type":"Product","name":"V"}]}',
        ],
    )
    at = lambda i: got[f"{URL}{i}"]
    assert (at(0).name, at(0).price_text, at(0).confidence["price"]) == ("A", "89.00", "high")
    assert at(1).confidence["price"] == "medium" and any("price differs between sources: jsonld says 89.00, opengraph says 90" in w for w in at(1).warnings)
    assert at(2).currency == "EUR" and at(2).source_method["currency"] == "opengraph" and at(3).currency is None
    assert at(4).price_text == "10" and "Price is a range (10–20); the lowest price was used." in at(4).warnings and at(4).confidence["price"] == "medium"
    assert at(5).name == "Two" and at(5).confidence["name"] == "medium" and at(5).warnings[0].startswith("1 JSON-LD block(s)")
    assert at(6).brand == "Brand" and at(6).confidence["name"] == "high"
    assert any("product group" in w for w in at(7).warnings)


def test_rendering_counts_only_if_it_finds_more(spark):
    pages = ["<p>x</p>", "<h1>Same</h1>", "<p>y</p>"]
    answers = [(f"{URL}0", "<h1>Found</h1>", None), (f"{URL}1", "<h1>Other</h1>", None), (f"{URL}2", None, "timeout")]
    table = spark.createDataFrame(answers, "url string, html string, problem string")
    got = rows(spark, pages, EngineConfig(render_enabled=True, renderer=lambda wanted: table.join(wanted, "url")))
    assert got[f"{URL}0"].name == "Found" and got[f"{URL}1"].name == "Same"
    assert any("Rendering failed: timeout" in w for w in got[f"{URL}2"].warnings)


@pytest.mark.parametrize("html,field,value", [("<title>T</title><h1>H</h1>", "heading", "H"), ("<h1>a</h1><main><h1>b</h1></main>", "heading", "b"), ("<body><nav>n</nav><p>a<br>b</p><script>x</script></body>", "text", "a\nb")])
def test_record(html, field, value):
    assert parse.read_page(html, URL)[field] == value


def test_references_that_name_each_other():
    """Objects that all refer to each other end within the bound on places."""
    n = 40
    items = [{"@type": "Product" if i == 0 else "Thing", "@id": f"#{i}", "name": f"n{i}", "links": [{"@id": f"#{j}"} for j in range(n)]} for i in range(n)]
    by_id = {item["@id"]: item for item in items}
    got = parse.resolved(items[0], by_id)
    assert got["name"] == "n0" and got["links"][3]["name"] == "n3" and items[0]["links"][3] == {"@id": "#3"}
    assert parse.resolved([{"@id": "#1"}, 5, {"a": {"@id": "#nobody"}}], {"#1": {"@id": "#1", "name": "x"}}) == [{"@id": "#1", "name": "x"}, 5, {"a": {"@id": "#nobody"}}]


def test_a_page_without_address_has_no_product_of_its_own():
    two = '[{"@type":"Product","name":"A"},{"@type":"Product","name":"B","offers":{"price":"1"}}]'
    for url in ("", "https://demo.example.test/p"):
        record = parse.read_page(LD % two, url)
        assert (record["ld_choice"], record["ld_product"]["name"]) == ("offers", "B")


def test_pages_of_one_address(spark):
    """Two pages of one address: one request, each reply checked against its own text; one rendering."""
    pages = [(URL, "<p>The lamp costs 12 EUR and it is made of brass, nothing else.</p>"), (URL, "<p>The lamp costs 15 EUR and it is made of steel, nothing else.</p>")]
    seen = []

    def client(asked):
        seen.append(asked.count())
        return asked.selectExpr("url", "200 status", """'{"price": "12", "material": "steel"}' content""", "cast(null as string) problem")

    df = spark.createDataFrame(pages, "url string, html string")
    got = {r.material: r.price_text for r in extract.extract_pages(df, EngineConfig(llm_enabled=True, llm=client)).collect()}
    assert got == {None: "12", "steel": None} and seen == [1]
    config = EngineConfig(render_enabled=True, render_below_chars=500, renderer=lambda wanted: wanted.selectExpr("url", "'<h1>Lamp</h1>' html", "cast(null as string) problem"))
    assert [r.name for r in extract.extract_pages(df, config).collect()] == ["Lamp", "Lamp"]


def test_references_without_semicolon(spark, tmp_path):
    """Read as the HTML standard has it, but in the queries whose SQL leaves them as written."""
    import duckdb

    from pagewright.plans import catalog

    page = "<html><head><title>{0}</title></head><body><nav>n</nav><article><h1>{0}</h1><p>{0}<p>see﷐</article><footer>f</footer></body></html>"
    cut = ["A &amp; B&amp", "A&am", "A&", "A &quot", "&quot;A&quot; &amp", "A &amp B", "A&#38", "A &copy 1"]
    df = spark.createDataFrame([(i, f"{URL}{i}", page.format(c)) for i, c in enumerate(cut)], "page_id long, url string, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_title", "page_text", "page_products"):
        got = catalog.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert rows(spark, [page.format(cut[0])])[f"{URL}0"].name == "A & B&"
    link = parse.dom.Tree('<a href="?a=1&copy=2">x&amp</a><script>a&amp&lt;</script>', False)
    assert link.nodes[0].get("href") == "?a=1&copy=2" and [n.kids for n in link.nodes] == [["x&amp"], ["a&amp&lt;"]]
