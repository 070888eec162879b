"""Registered queries over the rules that take several steps: offers, page choice, fetching, robots memo, rendering, reports.

Inputs are built from table columns inside a query; the reference SQL states the expected values from the columns alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.operators import admission, reports
from pagewright.plans import extract, serve
from pagewright.plans.queries_pages import _made, _plain_rows, _price, _script, _t
from pagewright.sources import fetch

SHOP = "https://shop.example.test/p/"


def _case(*texts: str):
    """Part key modulo the number of texts picks one; $v stands for the price, $w for the price and one."""
    k, out = F.col("p_partkey") % len(texts), F.lit(None).cast("string")
    raised = (F.col("p_retailprice").cast("decimal(12,2)") + 1).cast("string")
    for i, text in enumerate(texts):
        out = F.when(k == i, F.replace(F.replace(F.lit(text), F.lit("$v"), _price()), F.lit("$w"), raised)).otherwise(out)
    return out


def offer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested aggregates, price specifications, offers without a price, product groups, broken blocks."""
    item = _case(
        '{"@type":"Product","offers":{"@type":"AggregateOffer","priceCurrency":"EUR","lowPrice":"$v","highPrice":"$w","offers":[{"price":"$w"},{"@type":"Offer","price":"$v"}]}}',
        '{"@type":"Product","offers":{"priceCurrency":"GBP","priceSpecification":[{"priceType":"https://schema.org/ListPrice","price":"1"},{"price":"$v","priceCurrency":"USD"}]}}',
        '{"@type":"Product","offers":[{"priceCurrency":"gbp","availability":{"@id":"https://schema.org/InStock"}},{"price":"on request"}]}',
        '{"@type":"ProductGroup","hasVariant":[{"@type":"Product","offers":{"price":"$v"}}]}',
        '{"@type":"Product","offers":{"@type":"AggregateOffer","lowPrice":"$v","priceCurrency":"EUR"}}</script><script type="application/ld+json">{"@type":',
        '{"@type":"Product","offers":{"@type":"AggregateOffer","lowPrice":"$v","highPrice":"$w","priceCurrency":"EUR"}}',
    )
    rows = extract.extract_pages(_made(spark, sf_dir, _script(item), F.lit("<p>" + "prose " * 50)), keep=("id",))
    note = F.array_join(F.filter("warnings", lambda w: ~w.startswith("LLM") & ~w.startswith("No ")), " | ")
    return rows.select("id", F.col("price_text").alias("price"), "currency", "availability", F.element_at("confidence", "price").alias("confidence"), note.alias("note"))


OFFER_FORMS = """
WITH p AS (SELECT p_partkey AS id, p_partkey % 6 AS k, CAST(p_retailprice AS DECIMAL(12,2)) AS v FROM part)
SELECT id, CASE WHEN k = 0 THEN CAST(v + 1 AS VARCHAR) WHEN k IN (1, 4, 5) THEN CAST(v AS VARCHAR) END AS price,
  CASE k WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 4 THEN 'EUR' WHEN 5 THEN 'EUR' END AS currency, CASE WHEN k = 2 THEN 'in_stock' END AS availability,
  CASE WHEN k IN (0, 5) THEN 'medium' WHEN k IN (1, 4) THEN 'high' END AS confidence,
  CASE k WHEN 0 THEN '3 offers with different prices (' || v || '–' || (v + 1) || '); the first offer was used.'
    WHEN 3 THEN 'This is a product group with variants; variant prices were not extracted.'
    WHEN 4 THEN '1 JSON-LD block(s) could not be parsed and were skipped.'
    WHEN 5 THEN 'Price is a range (' || v || '–' || (v + 1) || '); the lowest price was used.' ELSE '' END AS note FROM p"""


def page_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several products a page is about; addresses under a base element; pages without an address."""
    two = _case(
        '[{"@type":"Product","name":"First"},{"@type":"Product","name":"Here","url":"HTTPS://shop.example.test/p/KEY/#top"}]',
        '[{"@type":"Product","name":"First"},{"@type":"Product","name":"Offered","offers":{"price":"$v"}}]',
        '[{"@type":"Product","name":"First","image":"i.png"},{"@type":"Product","name":"Other","url":"https://shop.example.test/other"}]',
        '[{"@type":"Product","name":"First"},{"@type":"Product","name":"Offered","offers":{"price":"$v"}}]',
    )
    head = F.concat(F.lit('<base href="/shop/en/">'), _script(F.replace(two, F.lit("KEY"), F.col("p_partkey").cast("string"))))
    pages = _made(spark, sf_dir, head, F.lit("")).withColumn("url", F.when(F.col("id") % 4 == 3, F.when(F.col("id") % 8 == 3, F.lit(""))).otherwise(F.col("url")))
    rows = extract.extract_pages(pages, keep=("id",))
    note = F.get(F.filter("warnings", lambda w: w.contains("Product nodes")), F.lit(0))
    return rows.select("id", "name", "image_url", F.element_at("confidence", "name").alias("confidence"), note.alias("note"))


PAGE_CHOICE = """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Here' WHEN 2 THEN 'First' ELSE 'Offered' END AS name,
  CASE WHEN p_partkey % 4 = 2 THEN 'https://shop.example.test/shop/en/i.png' END AS image_url, CASE WHEN p_partkey % 4 = 0 THEN 'high' ELSE 'medium' END AS confidence,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 2 THEN '2 Product nodes found in JSON-LD; used the first one.' ELSE '2 Product nodes found in JSON-LD; used the first one with offers.' END AS note
FROM part"""


def glued_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices beside codes and symbols in any case, glued or not; two pages of one address, one request for both."""
    shown = _case("only GBP$v today", "$veur", "at $v zł.", "EURO $v", "$v gbp", "USD 7 $v", "cost 3 € $v")
    pages = _made(spark, sf_dir, F.lit(""), F.concat(F.lit("<p>The thing is "), shown, F.lit(", in three days or four.</p>")))
    address = F.concat(F.lit(SHOP), (F.col("id") - F.col("id") % 14 + F.col("id") % 7).cast("string"))
    pages = pages.withColumn("url", address)
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _price().alias("v"))

    def client(asked: DataFrame) -> DataFrame:
        first = pages.select("url", "id").join(parts, "id").groupBy("url").agg(F.min_by("v", "id").alias("v"))
        return asked.select("url").join(first, "url").select("url", F.lit(200).alias("status"), F.concat(F.lit('{"price":"'), "v", F.lit('"}')).alias("content"), F.lit(None).cast("string").alias("problem"))

    rows = extract.extract_pages(pages, EngineConfig(llm_enabled=True, llm=client), keep=("id",))
    return rows.select("id", F.col("price_text").alias("price"), F.size(F.filter("warnings", lambda w: w.startswith("LLM value for price was rejected"))).cast("bigint").alias("refused"))


GLUED_PRICES = """
WITH p AS (SELECT p_partkey AS id, p_partkey % 7 AS k, p_partkey - p_partkey % 14 + p_partkey % 7 AS a, CAST(p_retailprice AS DECIMAL(12,2)) AS v FROM part),
f AS (SELECT a, arg_min(v, id) AS told FROM p GROUP BY a)
SELECT id, CASE WHEN k NOT IN (3, 5, 6) AND told = v THEN CAST(v AS VARCHAR) END AS price, (CASE WHEN k NOT IN (3, 5, 6) AND told = v THEN 0 ELSE 1 END)::BIGINT AS refused
FROM p JOIN f USING (a)"""


def fetch_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from an archive: redirects, private targets, late and large answers; the transport gets what was admitted."""
    k = F.col("page_id") % 10
    place = lambda *parts: F.concat(F.lit("https://a.example.test/"), F.col("page_id").cast("string"), *map(F.lit, parts))
    pages = _t(spark, sf_dir, "pages").select("page_id")
    urls = pages.select(F.when(k == 9, place("/no/x")).otherwise(place()).alias("url"))
    kind = F.when(k == 3, F.lit("application/pdf")).otherwise(F.lit("text/html; charset=utf-8"))
    first = pages.select(
        place().alias("url"), F.when(k.isin(1, 2), 302).when(k == 4, 404).otherwise(200).alias("status"),
        F.when(k == 1, F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit("/next"))).when(k == 2, F.lit("http://10.0.0.9/")).alias("location"), kind.alias("content_type"),
        F.encode(F.when(k == 5, F.repeat(F.lit("x"), 500)).otherwise(F.concat(F.lit("<h1>"), F.col("page_id").cast("string"), F.lit("é"))), "UTF-8").alias("body"),
        F.when(k == 6, 16.0).when(k == 1, 14.0).otherwise(1.0).alias("seconds"), F.when(k == 7, 999).cast("bigint").alias("declared_length"),
    )
    more = pages.where(k == 1).select(
        place("/next").alias("url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"), F.lit("text/html").alias("content_type"),
        F.encode(F.lit("moved"), "UTF-8").alias("body"), F.when(F.col("page_id") % 20 == 1, 15.0).otherwise(17.0).alias("seconds"), F.lit(None).cast("bigint").alias("declared_length"),
    )
    archive = first.unionByName(more)
    dns = spark.createDataFrame([("a.example.test", ["93.184.216.34"])], "host string, ips array<string>")
    rules = spark.createDataFrame([("https://a.example.test", 200, "User-agent: *\nDisallow: /*/no/")], "origin string, status int, text string")

    def transport(targets: DataFrame) -> DataFrame:
        pinned = targets.where("ip = '93.184.216.34' and host_header = 'a.example.test' and max_bytes = 400")
        return archive.join(pinned.select(F.col("current").alias("url")), "url", "left_semi")

    config = EngineConfig(max_page_bytes=400, max_redirects=2, transport=transport)
    got = fetch.fetch(urls, None, dns, rules, config)
    return got.select("url", "final_url", "html", F.col("error.code").alias("code"), F.col("error.http_status").cast("bigint").alias("http_status"))


FETCH_FLOW = """
WITH p AS (SELECT page_id, page_id % 10 AS k, 'https://a.example.test/' || page_id AS u FROM pages),
c AS (SELECT *, CASE WHEN k = 1 AND page_id % 20 <> 1 THEN 'fetch_timeout' WHEN k = 2 THEN 'blocked_address' WHEN k = 3 THEN 'not_html' WHEN k = 4 THEN 'fetch_failed' WHEN k IN (5, 7) THEN 'page_too_large'
  WHEN k = 6 THEN 'fetch_timeout' WHEN k = 9 THEN 'blocked_by_robots' END AS code FROM p)
SELECT u || CASE WHEN k = 9 THEN '/no/x' ELSE '' END AS url, CASE k WHEN 1 THEN u || '/next' WHEN 2 THEN 'http://10.0.0.9/' WHEN 9 THEN u || '/no/x' ELSE u END AS final_url,
  CASE WHEN code IS NULL THEN CASE WHEN k = 1 THEN 'moved' ELSE '<h1>' || page_id || 'é' END END AS html, code,
  CASE code WHEN 'fetch_timeout' THEN 504 WHEN 'blocked_address' THEN 400 WHEN 'not_html' THEN 422 WHEN 'fetch_failed' THEN 502 WHEN 'page_too_large' THEN 422 WHEN 'blocked_by_robots' THEN 403 END::BIGINT AS http_status
FROM c"""


def robots_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt of origins: from the memo while it is young, else fetched; files that are too large allow nothing."""
    k, name = F.col("c_custkey") % 7, F.concat(F.lit("https://h"), F.col("c_custkey").cast("string"), F.lit(".example.test"))
    base = _t(spark, sf_dir, "customer").select("c_custkey", name.alias("origin"), k.alias("k"))
    memo = base.where("k < 2").select("origin", F.lit(200).alias("status"), F.lit("old").alias("text"), F.when(F.col("k") == 0, 6400.0).otherwise(6399.0).alias("fetched_at"))
    answers = base.where("k <> 6").select(
        F.concat("origin", F.lit("/robots.txt")).alias("url"), F.when(F.col("k") == 2, 301).when(F.col("k") == 3, 503).otherwise(200).alias("status"), F.lit("/x").alias("location"),
        F.lit("text/plain").alias("content_type"), F.encode(F.when(F.col("k") == 4, F.repeat(F.lit("#"), 90)).otherwise(F.lit("new")), "UTF-8").alias("body"),
    )
    dns = base.select(F.substring("origin", 9, 100).alias("host"), F.array(F.lit("93.184.216.34")).alias("ips"))
    got = fetch.load_robots(base.select("origin"), dns, 10_000.0, memo, answers, EngineConfig(max_robots_bytes=80))
    return got.select("origin", F.col("status").cast("bigint").alias("status"), "text", "fetched_at")


ROBOTS_MEMO = """
WITH b AS (SELECT 'https://h' || c_custkey || '.example.test' AS origin, c_custkey % 7 AS k FROM customer)
SELECT origin, (CASE k WHEN 2 THEN 404 WHEN 3 THEN 503 ELSE 200 END)::BIGINT AS status, CASE WHEN k = 0 THEN 'old' WHEN k IN (2, 3) THEN '' ELSE 'new' END AS text,
  (CASE WHEN k = 0 THEN 6400 ELSE 10000 END)::DOUBLE AS fetched_at FROM b WHERE k NOT IN (4, 6)"""


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-empty pages are rendered; the rendering counts if it fills more fields."""
    body = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("<h1>Whole</h1><p>"), F.repeat(F.lit("prose "), 50), F.lit("</p>"))).otherwise(F.lit("<h1>Poor</h1>"))
    pages = _made(spark, sf_dir, F.lit(""), body)
    k = F.element_at(F.split("url", "/"), -1).cast("bigint") % 4
    richer = F.when(k == 1, F.lit('<h1>Found</h1><meta name="description" content="more">')).when(k == 2, F.lit("<h1>Other</h1>"))
    config = EngineConfig(render_enabled=True, renderer=lambda wanted: wanted.select("url", richer.alias("html"), F.when(k == 3, F.lit("timeout")).alias("problem")))
    rows = extract.extract_pages(pages, config, keep=("id",))
    note = F.get(F.filter("warnings", lambda w: w.contains("ender")), F.lit(0))
    return rows.select("id", "name", "description", note.alias("note"))


RENDERED_PAGES = """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Whole' WHEN 1 THEN 'Found' ELSE 'Poor' END AS name, CASE WHEN p_partkey % 4 = 1 THEN 'more' END AS description,
  CASE p_partkey % 4 WHEN 1 THEN 'The page was rendered with JavaScript.' WHEN 2 THEN 'Rendering the page did not reveal more data.' WHEN 3 THEN 'Rendering failed: timeout' END AS note FROM part"""


def sheet_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes cells and highlights of a sheet: how many fields, which warnings, what is uncertain."""
    rows = _plain_rows(spark, sf_dir)
    unsure = F.transform_values("confidence", lambda f, c: F.when((f == "price") & (F.col("id") % 3 == 0), F.lit("low")).otherwise(c))
    rows = rows.withColumn("confidence", unsure).withColumn("warnings", F.slice("warnings", -1, 1))
    cells = reports.sheet_cells(rows, {"name": "A", "price": "b"}, "id", "Z")
    return cells.select("id", F.col("col").cast("bigint").alias("col"), "value", "background")


SHEET_NOTES = """
WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_name, CAST(p_retailprice AS DECIMAL(12,2)) AS v FROM part),
q AS (SELECT *, (k = 1 OR (k = 0 AND CAST(v AS DECIMAL(12,1)) <> v)) AS clash FROM p)
SELECT id, 1::BIGINT AS col, p_name AS value, NULL::VARCHAR AS background FROM q UNION ALL
SELECT id, 2, CAST(v AS VARCHAR), CASE WHEN id % 3 = 0 THEN '#ffff00' END FROM q UNION ALL
SELECT id, 26, concat_ws(' | ', '2 fields found', CASE WHEN k >= 2 THEN 'sku differs between sources: jsonld says AB, microdata says XY (jsonld was used).'
  WHEN clash THEN 'price differs between sources: jsonld says ' || v || ', opengraph says ' || CASE WHEN k = 1 THEN CAST(v + 1 AS VARCHAR) ELSE CAST(CAST(v AS DECIMAL(12,1)) AS VARCHAR) END || ' (jsonld was used).' END), NULL FROM q"""


def warning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.notes(_plain_rows(spark, sf_dir), "id").select("id", F.regexp_extract("note", r"^(\w+ \w+)", 1).alias("note"))


WARNING_ROWS = """
WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS k, CAST(p_retailprice AS DECIMAL(12,2)) AS v FROM part),
q AS (SELECT *, (k = 1 OR (k = 0 AND CAST(v AS DECIMAL(12,1)) <> v)) AS clash FROM p)
SELECT id, 'price differs' AS note FROM q WHERE clash UNION ALL SELECT id, 'sku differs' FROM q WHERE k >= 2 UNION ALL SELECT id, 'no warnings' FROM q WHERE NOT clash AND k < 2"""


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON form of a row, read back."""
    made = reports.as_json(_plain_rows(spark, sf_dir), "id")
    at = lambda path: F.get_json_object("json", f"$.{path}")
    return made.select(
        "id", at("name").alias("name"), at("price").alias("price"), at("source_method.price").alias("price_source"), at("confidence.sku").alias("sku_confidence"),
        F.col("json").contains('"availability":null').alias("states_nulls"), F.size(F.json_object_keys("json")).cast("bigint").alias("n_keys"),
    )


JSON_ROWS = """
SELECT p_partkey AS id, p_name AS name, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price, 'jsonld' AS price_source,
  CASE WHEN p_partkey % 4 >= 2 THEN 'medium' ELSE 'high' END AS sku_confidence, true AS states_nulls, 15::BIGINT AS n_keys FROM part"""


def sheet_edit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of an edit are processed."""
    lines = _t(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") == 2, F.lit("no address")).otherwise(F.concat(F.lit(" https://s.example.test/"), F.col("l_orderkey").cast("string")))
    edits = lines.select(F.col("l_orderkey").alias("edit_id"), F.col("l_linenumber").alias("row"), F.when(F.col("l_orderkey") % 5 == 0, 3).otherwise(2).alias("col"), F.when(F.col("l_orderkey") % 5 == 1, 2).otherwise(1).alias("n_cols"), value.alias("value"))
    return reports.sheet_edits(edits, 2, 2, 3).select(F.col("edit_id").cast("bigint").alias("edit_id"), F.col("row").cast("bigint").alias("row"))


SHEET_EDIT_ROWS = """
WITH u AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_orderkey % 5 > 1 AND l_linenumber > 2)
SELECT l_orderkey::BIGINT AS edit_id, l_linenumber::BIGINT AS "row" FROM u WHERE n <= 3"""


def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of requests, and who may send them."""
    k = F.col("s_suppkey") % 4
    url = F.when(k == 0, F.lit("")).when(k == 1, F.repeat(F.lit("x"), 2049)).when(k == 2, F.lit("https://a.test/"))
    given = F.when(k == 0, F.lit("open")).when(k == 1, F.lit("Open")).when(k == 2, F.lit(""))
    return _t(spark, sf_dir, "supplier").select(
        "s_suppkey", admission.request_error(url)["code"].alias("code"), reports.key_accepted(given, "open").alias("accepted"), reports.key_accepted(given, None).alias("accepted_without")
    )


REQUEST_CHECKS = """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 2 THEN 'invalid_request' END AS code, s_suppkey % 4 = 0 AS accepted, true AS accepted_without FROM supplier"""


def service_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), llm=True)


SERVICE_STATE = "SELECT 'ok' AS status, count(*) AS cached_pages, true AS llm, false AS rendering FROM customer"



def service_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests a page, 2,000 seconds apart, to sites that answer or don't, with keys that are right or wrong."""
    k = F.col("page_id") % 5
    pages = _t(spark, sf_dir, "pages").select("page_id")
    host = lambda n: F.concat(F.lit(n), F.col("page_id").cast("string"), F.lit(".example.test"))
    archive = pages.select(
        F.concat(F.lit("https://"), host("h"), F.lit("/a")).alias("url"), F.when(k == 0, 404).otherwise(200).alias("status"), F.lit(None).cast("string").alias("location"),
        F.lit("text/html").alias("content_type"), F.encode(F.concat(F.lit("<h1>N"), F.col("page_id").cast("string"), F.lit("</h1>")), "UTF-8").alias("body"),
    )
    each = pages.select("page_id", F.explode(F.array(*map(F.lit, range(3)))).alias("j"))
    spelled = F.when(F.col("j") == 1, F.concat(F.lit("HTTPS://"), host("H"), F.lit(":443/a#x"))).otherwise(F.concat(F.lit("https://"), host("h"), F.lit("/a")))
    requests = each.select(
        (F.col("page_id") * 3 + F.col("j")).alias("request_id"), F.when(k == 1, F.lit("")).otherwise(spelled).alias("url"), (F.col("j") * 2000.0).alias("at"),
        F.when(k == 2, F.lit("wrong")).otherwise(F.lit("right")).alias("key"),
    )
    dns = pages.select(host("h").alias("host"), F.array(F.lit("93.184.216.34")).alias("ips"))
    rules = pages.select(F.concat(F.lit("https://"), host("h")).alias("origin"), F.lit(404).alias("status"), F.lit("").alias("text"))
    got = serve.respond(requests, dns, rules, archive, EngineConfig(api_key="right", cache_entries=10**9))
    at = lambda path: F.get_json_object("body", f"$.{path}")
    return got.select("request_id", F.col("status").cast("bigint").alias("status"), "x_cache", "start", at("name").alias("name"), at("error").alias("error"))


SERVICE_RESPONSES = """
WITH r AS (SELECT page_id, page_id % 5 AS k, unnest([0, 1, 2]) AS j FROM pages)
SELECT page_id * 3 + j AS request_id, (CASE k WHEN 0 THEN 502 WHEN 1 THEN 422 WHEN 2 THEN 401 ELSE 200 END)::BIGINT AS status, CASE WHEN k > 2 THEN CASE WHEN j = 1 THEN 'HIT' ELSE 'MISS' END END AS x_cache,
  CASE WHEN k = 0 OR (k > 2 AND j <> 1) THEN j * 2000.0::DOUBLE END AS start, CASE WHEN k > 2 THEN 'N' || page_id END AS name,
  CASE k WHEN 0 THEN 'fetch_failed' WHEN 1 THEN 'invalid_request' WHEN 2 THEN 'unauthorized' END AS error FROM r"""

QUERIES = {
    "service_responses": (service_responses, SERVICE_RESPONSES),
    "offer_forms": (offer_forms, OFFER_FORMS), "page_choice": (page_choice, PAGE_CHOICE), "glued_prices": (glued_prices, GLUED_PRICES), "fetch_flow": (fetch_flow, FETCH_FLOW),
    "robots_memo": (robots_memo, ROBOTS_MEMO), "rendered_pages": (rendered_pages, RENDERED_PAGES), "sheet_notes": (sheet_notes, SHEET_NOTES), "warning_rows": (warning_rows, WARNING_ROWS),
    "json_rows": (json_rows, JSON_ROWS), "sheet_edit_rows": (sheet_edit_rows, SHEET_EDIT_ROWS), "request_checks": (request_checks, REQUEST_CHECKS), "service_state": (service_state, SERVICE_STATE),
}
