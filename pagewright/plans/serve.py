"""Requests to responses: access, shape, result cache, paced fetching, extraction, status and JSON body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.functions import scalars as S
from pagewright.operators import admission, reports, state
from pagewright.plans import extract
from pagewright.sources import fetch
from pagewright.storage import written


def respond(requests: DataFrame, dns: DataFrame, rules: DataFrame, archive: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """requests(request_id, url, at seconds, key) to (request_id, status, x_cache, start, body).

    Each page is fetched and read once for all requests of its cache key. Results are held for cache_ttl seconds, the
    cache_entries least recently used ones, errors never; a hit has x_cache HIT, any other result MISS. start: when the
    request to the site goes out, min_interval after the one before it to the same host; null where none does."""
    r = requests.select("request_id", F.trim("url").alias("url"), F.col("at").cast("double").alias("at"), "key")
    denied = F.when(~reports.key_accepted(F.col("key"), config.api_key or None), admission.error("unauthorized", "Missing or wrong key."))
    r = written(r.withColumn("problem", F.coalesce(denied, admission.request_error(F.col("url")))).withColumn("page", F.coalesce(S.cache_key(F.col("url")), F.col("url"))))
    good = r.where("problem is null")
    asked = good.groupBy("page").agg(F.min_by("url", F.struct("at", "request_id")).alias("url"))
    got = written(fetch.fetch(asked.select("url").distinct(), archive, dns, rules, config))
    pages = got.where("error is null").select(F.col("final_url").alias("url"), "html", F.col("url").alias("asked"))
    bodies = reports.as_json(extract.extract_pages(pages, config, keep=("asked",)), "asked")
    results = asked.join(got.select("url", "error"), "url").join(bodies.withColumnRenamed("asked", "url"), "url", "left").select("page", "error", "json")
    done = written(good.join(results, "page", "left"))
    cached = state.lru_cache(done.withColumn("cache", F.lit("results")), "cache", "page", "at", config.cache_ttl, config.cache_entries, "request_id", F.col("error").isNull())
    # The cache's rows carry the order column, which names the request.
    done = done.join(cached.select(F.col("request_id"), "hit"), "request_id")
    out = done.where("not hit").withColumn("host", admission.target_of(F.col("url"))["host"]).where("host <> '' and (error is null or error.code not in ('invalid_url', 'blocked_address'))")
    starts = state.paced(out, "host", "at", config.min_interval, "request_id").select("request_id", "start")
    done = done.join(starts, "request_id", "left")
    none = F.lit(None)
    answered = done.select("request_id", "error", "json", F.when(F.col("error").isNull(), F.when(F.col("hit"), F.lit("HIT")).otherwise(F.lit("MISS"))).alias("x_cache"), "start")
    refused = r.where("problem is not null").select("request_id", F.col("problem").alias("error"), none.cast("string").alias("json"), none.cast("string").alias("x_cache"), none.cast("double").alias("start"))
    told = F.to_json(F.struct(F.col("error.code").alias("error"), F.col("error.message").alias("message")))
    return answered.unionByName(refused).select("request_id", F.coalesce("error.http_status", F.lit(200)).alias("status"), "x_cache", "start", F.when(F.col("error").isNull(), F.col("json")).otherwise(told).alias("body"))
