"""Pacing, result caches and sheet edits over event streams: keyed state in place of sorted windows.

Input must carry event times; rows later than the watermark are dropped, and the state of a key that stays silent for
longer than its time to live goes with it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.config import EngineConfig
from pagewright.operators import reports


def paced_stream(requests: DataFrame, host: str = "host", arrival: str = "arrival", interval: float = EngineConfig.min_interval, late: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """requests(id, host, arrival timestamp) to (id, host, arrival, start): in each batch a host's requests go by time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["arrival", "id"])
        starts = []
        for at in rows["arrival"].astype("int64") / _unit(rows["arrival"]):
            last = at if last is None else max(at, last + interval)
            starts.append(last)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"id": rows["id"], "host": key[0], "arrival": rows["arrival"], "start": starts})

    slim = requests.select(F.col("id").cast("bigint").alias("id"), F.col(host).alias("host"), F.col(arrival).alias("arrival")).withWatermark("arrival", late)
    return slim.groupBy("host").applyInPandasWithState(run, "id bigint, host string, arrival timestamp, start double", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def ttl_cache_stream(requests: DataFrame, key: str = "key", at: str = "at", ttl: float = EngineConfig.cache_ttl, late: str = "1 minute") -> DataFrame:
    """requests(id, key, at timestamp, ok boolean) to (id, key, hit): as operators.state.ttl_cache, batch by batch."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        put = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        hits = []
        for now, ok in zip(rows["at"].astype("int64") / _unit(rows["at"]), rows["ok"], strict=True):
            hit = ttl > 0 and put is not None and now - put <= ttl
            if not hit:
                put = now if ok else None
            hits.append(hit)
        if put is None:
            if state.exists:
                state.remove()
        else:
            state.update((put,))
            state.setTimeoutTimestamp(max(int((put + ttl) * 1000), state.getCurrentWatermarkMs()) + 1000)
        yield pd.DataFrame({"id": rows["id"], "key": name[0], "hit": hits})

    slim = requests.select(F.col("id").cast("bigint").alias("id"), F.col(key).cast("string").alias("key"), F.col(at).alias("at"), "ok").withWatermark("at", late)
    return slim.groupBy("key").applyInPandasWithState(run, "id bigint, key string, hit boolean", "put double", "append", GroupStateTimeout.EventTimeTimeout)


def _unit(column: pd.Series) -> float:
    """Ticks a second of a timestamp column."""
    return {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}[getattr(column.dt, "unit", "ns")]


def sheet_stream(edits: DataFrame, process, url_column: int, checkpoint: str, first_row: int = EngineConfig.first_data_row, most: int = EngineConfig.sheet_rows_per_edit):
    """Start a query that hands each batch's accepted edits to process(DataFrame, batch id)."""
    return edits.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: process(reports.sheet_edits(df, url_column, first_row, most), n)).start()
