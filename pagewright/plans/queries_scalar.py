"""Registered queries over scalar functions, admission, robots and state, each with reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import arrow
from pagewright.functions import scalars as S
from pagewright.operators import admission, robots, state


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price in six spellings."""
    d = F.col("p_retailprice").cast("decimal(12,2)")
    us = F.format_number(d, 2)
    euro = F.translate(us, ",.", ".,")
    k = F.col("p_partkey") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("€ "), us))
        .when(k == 1, F.concat(euro, F.lit(" EUR")))
        .when(k == 2, F.concat(F.lit("Now only £"), F.format_number(F.floor(d), 0), F.lit("!")))
        .when(k == 3, F.concat(F.translate(us, ",.", " ,"), F.lit(" kr")))
        .when(k == 4, F.concat(F.lit("1."), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")))
        .otherwise(F.col("p_retailprice").cast("string"))
    )
    return _t(spark, sf_dir, "part").select("p_partkey", S.price(S.price_text(raw)).cast("decimal(18,4)").alias("price"))


PRICE_FORMATS = """
SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 2 THEN floor(CAST(p_retailprice AS DECIMAL(12,2))) WHEN 4 THEN NULL
  ELSE CAST(p_retailprice AS DECIMAL(12,2)) END AS DECIMAL(18,4)) AS price FROM part"""


def currency_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 8
    raw = (
        F.when(k == 0, F.lit("eur")).when(k == 1, F.lit("€89")).when(k == 2, F.lit("USD 12.00")).when(k == 3, F.lit("12 zł"))
        .when(k == 4, F.lit("$12")).when(k == 5, F.lit("the ABC of GBP")).when(k == 6, F.lit("USD $12.00"))
    )
    return _t(spark, sf_dir, "customer").select("c_custkey", S.currency_from(raw).alias("currency"), S.has_ambiguous_symbol(raw).alias("ambiguous"))


CURRENCY_SCAN = """
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'EUR' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'PLN' WHEN 5 THEN 'GBP' WHEN 6 THEN 'USD' END AS currency,
  c_custkey % 8 = 4 AS ambiguous FROM customer"""


def availability_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey") % 3
    raw = (
        F.when((s == "F") & (k == 0), F.lit("https://schema.org/InStock")).when((s == "F") & (k == 1), F.lit("Ready to ship"))
        .when(s == "F", F.lit("Only 3 left")).when((s == "O") & (k == 0), F.lit("http://schema.org/SoldOut"))
        .when((s == "O") & (k == 1), F.lit("Currently unavailable")).when(s == "O", F.lit("Available for pre-order"))
        .when(k == 0, F.lit("Ships in 2 weeks")).when(k == 1, F.lit("On back-order"))
    )
    return _t(spark, sf_dir, "orders").select("o_orderkey", S.availability(S.collapse(raw)).alias("state"))


AVAILABILITY_MAP = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'in_stock' WHEN 1 THEN 'in_stock' ELSE 'limited' END
  WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 3 WHEN 0 THEN 'out_of_stock' WHEN 1 THEN 'out_of_stock' ELSE 'preorder' END
  ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Ships in 2 weeks' WHEN 1 THEN 'backorder' END END AS state FROM orders"""


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" <b>"), F.col("s_name"), F.lit("</b>\n&amp;  No. "), (F.col("s_suppkey") % 10).cast("string"), F.lit("<br>&eacute;&#8217;s "))
    clean = arrow.clean_text_udf(raw)
    return _t(spark, sf_dir, "supplier").select("s_suppkey", clean.alias("text"), S.shorten(clean, 20).alias("short"), arrow.norm_text_udf(F.concat(F.lit("Ｆull  "), F.upper("s_name"))).alias("norm"))


CLEAN_TEXTS = """
SELECT s_suppkey, s_name || ' & No. ' || (s_suppkey % 10) || ' é’s' AS text, s_name || '…' AS short, 'full ' || lower(s_name) AS norm FROM supplier"""


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.col("url"), F.col("page_id") % 4
    host, rest = F.regexp_extract(u, r"^https?://([^/]*)", 1), F.regexp_extract(u, r"^https?://[^/]*(.*)$", 1)
    made = (
        F.when(k == 0, F.concat(F.lit("HTTPS://"), F.upper(host), F.lit(":443"), rest, F.lit("#x")))
        .when(k == 1, F.concat(F.lit("https://user:pw@"), host, F.lit(":8443"), rest))
        .when(k == 2, F.concat(F.lit("http://"), host, F.lit(":80")))
        .otherwise(u)
    )
    return _t(spark, sf_dir, "pages").select("page_id", S.cache_key(made).alias("cache_key"))


CACHE_KEYS = r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]*)', 1) AS h, regexp_extract(url, '^https?://[^/]*([^#]*)', 1) AS r FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://' || h || r WHEN 1 THEN 'https://' || h || ':8443' || r WHEN 2 THEN 'http://' || h || '/'
  ELSE regexp_replace(url, '#.*$', '') END AS cache_key FROM p"""


def url_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages").select("page_id", "url")
    k, u = F.col("page_id") % 10, F.col("url")
    host = F.regexp_extract(u, r"^https?://([^/]*)", 1)
    made = (
        F.when(k == 0, F.lit("")).when(k == 1, F.lit("ftp://example.com/x")).when(k == 2, F.concat(F.lit("https://u:p@"), host, F.lit("/")))
        .when(k == 3, F.lit("http://example.com:99999/")).when(k == 4, F.lit("http://exa mple.com/")).when(k == 5, F.lit("http:///nohost"))
        .when(k == 6, F.lit("http://127.0.0.1/admin")).when(k == 7, F.concat(F.lit("https://"), F.upper(host), F.lit(":8443/p?q=1"))).otherwise(u)
    )
    urls = pages.withColumn("url", made)
    base = _t(spark, sf_dir, "pages")
    hosts = base.select(F.regexp_extract("url", r"^https?://([^/]*)", 1).alias("host")).distinct()
    dns = hosts.select("host", F.when(F.col("host").startswith("m."), F.array(F.lit("93.184.216.34"), F.lit("10.0.0.7"))).otherwise(F.array(F.lit("93.184.216.34"))).alias("ips"))
    got = admission.admit(urls, dns)
    return got.select("page_id", F.col("error.code").alias("code"), F.col("error.http_status").cast("bigint").alias("http_status"), "host_header", F.col("port").cast("bigint").alias("port"), "ip")


URL_ADMISSION = r"""
WITH p AS (SELECT page_id, url, page_id % 10 AS k, regexp_extract(url, '^https?://([^/]*)', 1) AS h FROM pages),
c AS (SELECT *, CASE WHEN k <= 5 THEN 'invalid_url' WHEN k = 6 OR starts_with(h, 'm.') THEN 'blocked_address' END AS code FROM p)
SELECT page_id, code, CASE code WHEN 'invalid_url' THEN 422 WHEN 'blocked_address' THEN 400 END::BIGINT AS http_status,
  CASE WHEN code IS NULL THEN h || CASE WHEN k = 7 THEN ':8443' ELSE '' END END AS host_header,
  CASE WHEN code IS NULL THEN CASE WHEN k = 7 THEN 8443 WHEN starts_with(url, 'https') THEN 443 ELSE 80 END END::BIGINT AS port,
  CASE WHEN code IS NULL THEN '93.184.216.34' END AS ip FROM c"""


def ip_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    ip = F.concat_ws(".", *[x.cast("string") for x in ((k * 7) % 256, (k * 13) % 256, (k * 29) % 256, k % 256)])
    return _t(spark, sf_dir, "customer").select("c_custkey", admission.public_ipv4(ip).alias("by_range"), arrow.is_public_ip_udf(ip).alias("by_library"))


IP_PUBLIC = """
WITH p AS (SELECT c_custkey, (c_custkey * 7) % 256 AS a, (c_custkey * 13) % 256 AS b, (c_custkey * 29) % 256 AS c, c_custkey % 256 AS d FROM customer),
r AS (SELECT c_custkey, NOT (a = 0 OR a = 10 OR (a = 100 AND b BETWEEN 64 AND 127) OR a = 127 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
  OR (a = 192 AND b = 0 AND c = 0 AND d NOT IN (9, 10)) OR (a = 192 AND b = 0 AND c = 2) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19))
  OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224) AS ok FROM p)
SELECT c_custkey, ok AS by_range, ok AS by_library FROM r"""


def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    p = admission.target_of(F.col("url"))
    urls = pages.select("page_id", p["host"].alias("origin"), p["path"].alias("path"))
    origins = urls.select("origin").distinct()
    k = F.pmod(F.length("origin"), F.lit(4))
    text = F.lit(
        "User-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: nobody # both\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\n\n"
    )
    ours = F.concat(text, F.lit("User-agent: Pagewright\nDisallow: /de/\nAllow: /de/\nDisallow: /*?page=\nDisallow:\n"))
    table = origins.select("origin", F.when(k == 3, 503).when(k == 2, 404).otherwise(200).alias("status"), F.when(k == 0, text).otherwise(ours).alias("text"))
    return robots.decide(urls, table, "pagewright", ("page_id",)).select("page_id", "allowed")


ROBOTS_DECISION = r"""
WITH p AS (SELECT page_id, length(regexp_extract(url, '^https?://([^/?#]*)', 1)) % 4 AS k, regexp_replace(regexp_extract(url, '^https?://[^/]*(.*)$', 1), '#.*$', '') AS path FROM pages)
SELECT page_id, CASE k WHEN 3 THEN false WHEN 2 THEN true
  WHEN 0 THEN NOT ((regexp_matches(path, '\.html$') AND NOT starts_with(path, '/en/1')) OR (starts_with(path, '/en/') AND NOT starts_with(path, '/en/1') )
     OR (regexp_matches(path, '\.html$') AND length('/*.html$') > length('/en/1')))
  ELSE NOT contains(path, '?page=') END AS allowed FROM p"""


def rate_limit_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at"))
    return state.paced(e, "user_id", "at", 90000.0, "event_id").select("event_id", F.round(F.col("start") - F.col("at"), 3).alias("wait"))


RATE_LIMIT = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS t_at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, t_at, n, t_at AS start FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.t_at, e.n, greatest(e.t_at, r.start + 90000.0) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, round(start - t_at, 3) AS wait FROM r"""


def ttl_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at"), (F.col("event_type") != "error").alias("ok"))
    hits = state.ttl_cache(e, "user_id", "at", 3600.0 * 48, "ok")
    return hits.groupBy("user_id").agg(F.count("*").alias("requests"), F.sum(F.col("hit").cast("bigint")).alias("hits"))


TTL_CACHE = """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t_at, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
r AS (SELECT user_id, n, false AS hit, CASE WHEN ok THEN t_at END AS put FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, coalesce(e.t_at - r.put <= 172800.0, false),
    CASE WHEN coalesce(e.t_at - r.put <= 172800.0, false) THEN r.put WHEN e.ok THEN e.t_at END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, count(*) AS requests, sum(hit::BIGINT)::BIGINT AS hits FROM r GROUP BY user_id"""


def lru_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_type", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    at = e.withColumn("at", F.col("us") / 1000000.0)
    return state.lru_cache(at, "event_type", "user_id", "at", 1e12, 40).groupBy("event_type").agg(F.sum(F.col("hit").cast("bigint")).alias("hits"))


# A request hits if fewer than 40 other keys have been asked for since its last one (reuse distance).
LRU_CACHE = """
WITH e AS (SELECT event_type, user_id, ts, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS before FROM events),
d AS (SELECT a.event_type, a.user_id, a.ts, count(DISTINCT b.user_id) AS other FROM e a JOIN events b
  ON a.event_type = b.event_type AND b.ts > a.before AND b.ts < a.ts AND b.user_id <> a.user_id WHERE a.before IS NOT NULL GROUP BY ALL),
h AS (SELECT e.event_type, CASE WHEN e.before IS NOT NULL AND coalesce(d.other, 0) < 40 THEN 1 ELSE 0 END AS hit FROM e LEFT JOIN d
  ON e.event_type = d.event_type AND e.user_id = d.user_id AND e.ts = d.ts)
SELECT event_type, sum(hit)::BIGINT AS hits FROM h GROUP BY event_type"""


def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    letters = F.when(n < 5, F.lit("A1")).when(n < 10, F.concat(F.lit("A"), F.char(F.lit(65) + n))).otherwise(F.char(F.lit(97) + n))
    return _t(spark, sf_dir, "nation").select("n_nationkey", S.column_number(letters).cast("bigint").alias("col"))


COLUMN_LETTERS = "SELECT n_nationkey, (CASE WHEN n_nationkey < 5 THEN NULL WHEN n_nationkey < 10 THEN 27 + n_nationkey ELSE n_nationkey + 1 END)::BIGINT AS col FROM nation"


def decode_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    text = F.concat(F.col("s_name"), F.lit(" café"))
    body = F.when(k == 0, F.encode(text, "ISO-8859-1")).when(k == 1, F.encode(F.concat(F.lit('<meta charset="iso-8859-1">'), text), "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    header = F.when(k == 0, F.lit("text/html; charset=latin-1")).when(k == 2, F.lit("text/html; charset=no-such-codec"))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", arrow.decode_body_udf(body, header).alias("text"))


DECODE_BODIES = """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN '<meta charset="iso-8859-1">' ELSE '' END || s_name || ' café' AS text FROM supplier"""

QUERIES = {
    "price_formats": (price_formats, PRICE_FORMATS), "currency_scan": (currency_scan, CURRENCY_SCAN), "availability_map": (availability_map, AVAILABILITY_MAP),
    "clean_texts": (clean_texts, CLEAN_TEXTS), "cache_keys": (cache_keys, CACHE_KEYS), "url_admission": (url_admission, URL_ADMISSION),
    "ip_public": (ip_public, IP_PUBLIC), "robots_decision": (robots_decision, ROBOTS_DECISION), "rate_limit_schedule": (rate_limit_schedule, RATE_LIMIT),
    "ttl_cache_hits": (ttl_cache_hits, TTL_CACHE), "lru_cache_hits": (lru_cache_hits, LRU_CACHE), "column_letters": (column_letters, COLUMN_LETTERS),
    "decode_bodies": (decode_bodies, DECODE_BODIES),
}
