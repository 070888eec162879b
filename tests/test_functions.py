"""Scalar functions on their decisive values."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import arrow
from pagewright.functions import scalars as S
from pagewright.operators import admission, gapfill, robots

PRICES = [
    ("5", "5"), ("17.05", "17.05"), ("EUR 4,2", "4.2"), ("2,450.75", "2450.75"), ("31.999,5", "31999.5"), ("CHF 3,140", "3140"), ("7 250,10 zł", "7250.10"),
    ("4.300.000", "4300000"), ("from $8.20 on", "8.20"), ("00", "0"), ("012.50", "12.50"), (" ", None), ("ask us", None), ("4.321", None), ("6,54321", None), (".", None), (None, None),
]


def column(spark, rows, fn):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string").orderBy("i").select(fn(F.col("v"))).collect()]


def test_prices(spark):
    assert column(spark, [p for p, _ in PRICES], S.price_text) == [w for _, w in PRICES]


def test_currencies(spark):
    rows = ["chf", "PLN", "30£", "€ 4.50", "was NOK 20", "9 Kč", "$3", "in ¥", "xyz", "SEKT", None]
    assert column(spark, rows, S.currency_from) == ["CHF", "PLN", "GBP", "EUR", "NOK", "CZK", None, None, None, None, None]
    assert column(spark, ["9 $", "CAD 9 $", "9 £", "none", None], S.has_ambiguous_symbol) == [True, False, False, False, False]


def test_availability(spark):
    rows = ["http://schema.org/OutOfStock", "instock", "PreOrder", "Just 1 left", "Dispatched on Monday", "", None]
    got = column(spark, rows, S.availability)
    assert got[:3] == ["out_of_stock", "in_stock", "preorder"] and got[4] == "Dispatched on Monday" and got[6] is None


def test_prices_beside_marks(spark):
    texts = ["GBP12.00", "EUR89 each", "12.00 gbp", "12.00gbp", "12 ZŁ", "EURO 12", "12 € 15", "USD 1 2", "3-5 days", "€ 1,50 or 2,50€"]
    got = column(spark, texts, S.prices_in_text)
    assert [[float(v) for v in row] for row in got] == [[12.0], [89.0], [12.0], [12.0], [12.0], [], [12.0], [12.0], [], [1.5, 2.5]]


def test_text_and_keys(spark):
    assert arrow.clean_text(" <b>a</b>&amp;b \n c") == "a &b c" and arrow.clean_text("  ") is None and arrow.clean_text({}) is None
    assert arrow.clean_text("one two three", 9).endswith("…")
    keys = column(spark, ["HTTPS://Shop.example:443/a#x", "https://shop.example/a", "https://shop.example", "https://shop.example/", "https://shop.example:8443/", "http://shop.example/?"], S.cache_key)
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[4] == "https://shop.example:8443/" and keys[5] == "http://shop.example/"
    assert column(spark, ["A", "h", "Z", "AA", "AZ", "", "1", "A1", "ABCD", None], S.column_number) == [1, 8, 26, 27, 52, None, None, None, None, None]
    assert arrow.absolute_url("https://a.test/x/", "../b") == "https://a.test/b" and arrow.absolute_url("https://a.test", "http://[::1") is None and arrow.absolute_url("https://a.test", "data:x") is None


@pytest.mark.parametrize(
    "ip,public",
    [("8.8.8.8", True), ("10.0.0.1", False), ("::ffff:127.0.0.1", False), ("64:ff9b::7f00:1", False), ("64:ff9b::808:808", True), ("64:ff9b:1::1", False), ("2002:7f00:1::", False), ("ff02::1", False), ("2606:4700::1111", True), ("x", False), (None, False)],
)
def test_public_addresses(ip, public):
    assert arrow.is_public_ip(ip) is public


def test_syntax_problems(spark):
    rows = ["", "   ", "ftp://x.test/", "http://", "http://u@x.test/", "http://x.test:notaport/", "http://x.test:70000/", "http://a b/", "http://[::1", "x" * 3000, "https://ok.test/a?b#c", "javascript:alert(1)", None]
    bad = [p is not None for p in column(spark, rows, admission.syntax_problem)]
    assert bad == [r != "https://ok.test/a?b#c" for r in rows]


def test_decoding():
    assert arrow.decode_body("é".encode("latin-1"), "text/html; charset=latin-1") == "é"
    assert arrow.decode_body(b"<meta charset=windows-1252>\x80", None).endswith("€")
    assert arrow.decode_body("é".encode(), "text/html; charset=nope") == "é" and arrow.decode_body(b"\xff", None) == "�"


ROBOTS = [
    ("User-agent: *\nDisallow: /", "/a", False), ("User-agent: *\nDisallow:", "/a", True), ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True),
    ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", True), ("User-agent: me\nDisallow: /x\n\nUser-agent: *\nDisallow: /", "/y", True), ("User-agent: *\nDisallow: /*.gif$", "/a.gif?x", True),
    ("User-agent: *\nDisallow: /*.gif$", "/a/b.gif", False), ("Disallow: /", "/a", True), ("# c\nUSER-AGENT: Me # us\nDISALLOW: /p # x", "/p1", False), ("User-agent: meow\nDisallow: /", "/a", True),
    ("User-agent: a\nUser-agent: me\nDisallow: /q", "/q", False), ("User-agent: me\nDisallow: /1\nSitemap: x\nUser-agent: me\nDisallow: /2", "/1", False), ("User-agent: *\nDisallow: /a.b", "/aXb", True),
]


def test_robots_patterns(spark):
    """The left-to-right search against a regular expression."""
    import random
    import re

    rng = random.Random(6)
    rows = [("".join(rng.choice("/ab*$") for _ in range(rng.randint(1, 7))), "/" + "".join(rng.choice("/ab$") for _ in range(rng.randint(0, 9)))) for _ in range(400)]
    rows += [("/" + "*a" * 40 + "$", "/" + "a" * 3000 + "b"), ("*", "/x"), ("/*$", "/x"), ("$", "/"), ("/é*ö", "/é日ö")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "i int, p string, t string")
    got = {r.i: r.m for r in df.select("i", robots.matches(F.col("p"), F.col("t")).alias("m")).collect()}
    for i, (p, t) in enumerate(rows):
        if p.count("*") < 40:
            rx = ".*".join(map(re.escape, (p[:-1] if p.endswith("$") else p).split("*"))) + (r"\Z" if p.endswith("$") else "")
            assert got[i] == bool(re.match(rx, t, re.S)), (p, t)
    assert got[400] is False


def test_robots(spark):
    table = spark.createDataFrame([(f"o{i}", 200, t) for i, (t, _, _) in enumerate(ROBOTS)] + [("s404", 404, ""), ("s500", 500, "")], "origin string, status int, text string")
    urls = spark.createDataFrame([(i, f"o{i}", p) for i, (_, p, _) in enumerate(ROBOTS)] + [(100, "s404", "/"), (101, "s500", "/"), (102, "none", "/")], "url int, origin string, path string")
    got = {r.url: r.allowed for r in robots.decide(urls, table, "Me").collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(ROBOTS)} | {100: True, 101: False, 102: False}


def test_answers():
    assert gapfill.read_answer('```json\n{"price": 1.5, "sku": 7, "name": null}\n```') == {"price": "1.5", "sku": "7"}
    assert gapfill.read_answer("[1]") is None and gapfill.read_answer("no") is None and gapfill.read_answer('{"name": 3}') is None
