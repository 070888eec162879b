"""Pages from an archive of responses, under the rules of a live fetch; a transport may stand in for the archive.

archive(url, status, location, content_type, body binary): one row an address. Every hop is admitted and checked against
robots anew. Errors are row values. A transport is a callable DataFrame(current, ip, host_header, max_bytes) -> archive
rows for a live source: it sees admitted addresses only, is to connect to the very ip that was admitted, with the host
header (and server name) given, and may stop reading beyond max_bytes; its answers are written once, so that no request
is sent twice. Two more columns of archive rows are read where they exist: seconds, which the answer took, and
declared_length, the length that its header announced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.functions import arrow
from pagewright.operators import admission, robots
from pagewright.storage import written

REDIRECTS = (301, 302, 303, 307, 308)


def _checked(active: DataFrame, dns: DataFrame, rules: DataFrame, config: EngineConfig) -> DataFrame:
    """active(url, current, spent) with error of admission or robots, and the admitted target's ip and host_header."""
    admitted = admission.admit(active, dns, "current").withColumn("origin", F.concat("scheme", F.lit("://"), "host_header"))
    good = admitted.where("error is null")
    decided = robots.decide(good.select("url", "origin", "path"), rules, config.agent)
    why = F.when(F.col("reason") == "rule", F.lit("robots.txt forbids this page.")).otherwise(F.lit("robots.txt could not be read; the page counts as forbidden."))
    out = admitted.join(decided, "url", "left")
    err = F.coalesce(F.col("error"), F.when(~F.col("allowed"), admission.error("blocked_by_robots", why)))
    return out.select("url", "current", "spent", "ip", "host_header", err.alias("error"))


def _answers(good: DataFrame, archive: DataFrame | None, config: EngineConfig, max_bytes: int) -> DataFrame:
    """Archive rows of the admitted targets good(current, ip, host_header), with all optional columns."""
    if config.transport:
        targets = good.select("current", "ip", "host_header", F.lit(max_bytes).alias("max_bytes")).distinct()
        rows = written(config.transport(targets))
    else:
        rows = archive
    for name, kind in (("seconds", "double"), ("declared_length", "bigint")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.withColumnRenamed("url", "current")


def load_robots(origins: DataFrame, dns: DataFrame, now: float, memo: DataFrame | None = None, archive: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """origins(origin) to (origin, status, text, fetched_at): robots.txt of each, from a memo while it is young enough.

    memo: what an earlier call gave; rows older than robots_ttl are fetched anew. A redirect counts as no rules (404), a
    file over max_robots_bytes, an address that isn't admitted or a missing answer gives no row, which allows nothing."""
    wanted = origins.select("origin").distinct()
    if memo is None:
        memo = origins.sparkSession.createDataFrame([], "origin string, status int, text string, fetched_at double")
    young = memo.where(F.lit(now) - F.col("fetched_at") <= config.robots_ttl).join(wanted, "origin", "left_semi").groupBy("origin").agg(F.max_by(F.struct("status", "text", "fetched_at"), "fetched_at").alias("m"))
    young = young.select("origin", "m.status", "m.text", "m.fetched_at")
    old = wanted.join(young, "origin", "left_anti").withColumn("current", F.concat("origin", F.lit("/robots.txt")))
    good = admission.admit(old, dns, "current").where("error is null").select("origin", "current", "ip", "host_header")
    got = good.join(_answers(good, archive, config, config.max_robots_bytes), "current").where("status is not null")
    size = F.greatest(F.octet_length("body"), F.coalesce("declared_length", F.lit(0)))
    got = got.where(F.coalesce(size, F.lit(0)) <= config.max_robots_bytes)
    status = F.when(F.col("status").isin(*REDIRECTS), 404).otherwise(F.col("status")).cast("int")
    text = F.when(F.col("status") == 200, F.coalesce(arrow.decode_body_udf("body", "content_type"), F.lit(""))).otherwise(F.lit(""))
    return young.unionByName(got.select("origin", status.alias("status"), text.alias("text"), F.lit(now).alias("fetched_at")))


def fetch(urls: DataFrame, archive: DataFrame | None, dns: DataFrame, rules: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """urls(url), different ones, to (url, final_url, html, content_type, error)."""
    none = F.lit(None).cast(admission.ERROR)
    active = urls.select("url", F.trim("url").alias("current"), F.lit(0.0).alias("spent"))
    parts = []
    for hop in range(config.max_redirects + 1):
        checked = written(_checked(active, dns, rules, config))
        parts.append(checked.where("error is not null").select("url", F.col("current").alias("final_url"), F.lit(None).cast("string").alias("html"), F.lit(None).cast("string").alias("content_type"), "error"))
        good = checked.where("error is null")
        got = good.join(_answers(good, archive, config, config.max_page_bytes), "current", "left")
        got = got.withColumn("spent", F.col("spent") + F.coalesce("seconds", F.lit(0.0)))
        late = (F.col("seconds") > config.request_timeout) | (F.col("spent") > 2 * config.request_timeout)
        size, kind = F.greatest(F.octet_length("body"), "declared_length"), F.lower(F.coalesce("content_type", F.lit("")))
        moved = F.col("status").isin(*REDIRECTS) & F.col("location").isNotNull()
        err = (
            F.when(F.col("status").isNull(), admission.error("fetch_failed", "The page could not be fetched."))
            .when(late, admission.error("fetch_timeout", "The site took too long to respond."))
            .when(size > config.max_page_bytes, admission.error("page_too_large", f"The page is larger than {config.max_page_bytes} bytes."))
            .when(moved, none)
            .when(F.col("status") >= 400, admission.error("fetch_failed", F.concat(F.lit("The site answered with HTTP "), F.col("status").cast("string"), F.lit("."))))
            .when((kind != "") & ~kind.contains("html"), admission.error("not_html", F.concat(F.lit("The page is not HTML ("), kind, F.lit(")."))))
        )
        got = written(got.select("url", "current", "spent", "body", "content_type", moved.alias("moved"), arrow.absolute_url_udf("current", "location").alias("next"), F.col("location"), err.alias("error")))
        last = got.where("not coalesce(moved, false) or error is not null")
        parts.append(last.select("url", F.col("current").alias("final_url"), F.when(F.col("error").isNull(), arrow.decode_body_udf("body", "content_type")).alias("html"), "content_type", "error"))
        active = got.where("moved and error is null").select("url", F.coalesce("next", "location").alias("current"), "spent")
        if active.isEmpty():
            break
    else:
        parts.append(active.select("url", F.col("current").alias("final_url"), F.lit(None).cast("string").alias("html"), F.lit(None).cast("string").alias("content_type"), admission.error("fetch_failed", "Too many redirects.").alias("error")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_folder(spark, path: str, base_url: str) -> DataFrame:
    """Pages from HTML files: url is base_url and the file's name."""
    files = spark.read.text(path, wholetext=True).withColumn("name", F.substring_index(F.input_file_name(), "/", -1))
    return files.select(F.concat(F.lit(base_url), "name").alias("url"), F.col("value").alias("html"))
