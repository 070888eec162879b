"""Pacing and result caches over tables of requests: the batch forms of keyed state."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paced(requests: DataFrame, host: str, arrival: str, interval: float, order: str | None = None) -> DataFrame:
    """requests with start: each request of a host waits until the interval after the start before it has passed.

    start(i) = max(arrival(i), start(i-1) + interval) in closed form: a running maximum over a sorted window."""
    if interval <= 0:
        return requests.withColumn("start", F.col(arrival))
    by = [arrival] + ([order] if order else [])
    n = F.row_number().over(Window.partitionBy(host).orderBy(*by))
    shifted = requests.withColumn("_n", n).withColumn("_d", F.col(arrival) - F.col("_n") * interval)
    top = F.max("_d").over(Window.partitionBy(host).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    return shifted.withColumn("start", top + F.col("_n") * interval).drop("_n", "_d")


def _scan(df: DataFrame, group: str, order: list[str], schema: str, run) -> DataFrame:
    """run over each partition's batches, groups together and in order; state is a group's own and bounded by run."""
    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def ttl_cache(requests: DataFrame, key: str, at: str, ttl: float, ok: str | None = None, order: str | None = None) -> DataFrame:
    """(key, at, hit): whether a result put at the last miss is still young enough; failed requests put nothing.

    Keys of any type that sorts, addresses say; a null key is a key. Requests of one time come by `order`, else successful first.
    A result of exactly ttl seconds still counts; a hit doesn't renew it. Rows of a key are read in order of time with
    one number of state, so a hot key needs no memory."""
    good = F.col(ok) if ok else F.lit(True)
    tie = F.col(order) if order else ~good
    slim = requests.select(F.col(key).alias("k"), F.col(at).cast("double").alias("t"), good.alias("g"), tie.alias("o"))

    def run(batches):
        last, put = object(), None
        for batch in batches:
            ks, ts, hits = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, t, g in zip(ks, ts, batch.column(2).to_pylist(), strict=True):
                if k != last:
                    last, put = k, None
                hit = ttl > 0 and put is not None and t - put <= ttl
                if not hit:
                    put = t if g else None
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.bool_())], names=["k", "t", "hit"])

    return _scan(slim, "k", ["t", "o"], f"k {slim.schema['k'].dataType.simpleString()}, t double, hit boolean", run).select(F.col("k").alias(key), F.col("t").alias(at), "hit")


def lru_cache(requests: DataFrame, cache: str, key: str, at: str, ttl: float, entries: int, order: str | None = None, ok: Column | None = None) -> DataFrame:
    """(cache, key, at, hit, and order if given) for caches of so many entries; state is one cache's entries.

    Requests of one time come by order; those that aren't ok put nothing."""
    by = ["t"] + (["o"] if order else [])
    slim = requests.select(
        F.col(cache).cast("string").alias("c"), F.col(key).cast("string").alias("k"), F.col(at).cast("double").alias("t"), (F.lit(True) if ok is None else ok).alias("g"), *([F.col(order).alias("o")] if order else [])
    )

    def run(batches):
        owner, held = object(), OrderedDict()
        for batch in batches:
            hits = []
            for c, k, t, good in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if c != owner:
                    owner, held = c, OrderedDict()
                hit = k in held and t - held[k] <= ttl
                if hit:
                    held.move_to_end(k)
                else:
                    held.pop(k, None)
                    if good and ttl > 0 and entries > 0:
                        held[k] = t
                        if len(held) > entries:
                            held.popitem(last=False)
                hits.append(hit)
            more = [batch.column(4)] if order else []
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(hits, pa.bool_()), *more], names=["c", "k", "t", "hit", *["o"] * len(more)])

    ddl = "c string, k string, t double, hit boolean" + (f", o {slim.schema['o'].dataType.simpleString()}" if order else "")
    return _scan(slim, "c", by, ddl, run).select(F.col("c").alias(cache), F.col("k").alias(key), F.col("t").alias(at), "hit", *([F.col("o").alias(order)] if order else []))
