"""Pacing and caches against plain simulations."""

import random
from collections import Counter

from pagewright.operators import state


def test_pacing(spark):
    random.seed(1)
    rows = [(i, f"h{random.randint(0, 3)}", round(random.random() * 20, 2)) for i in range(80)]
    got = {r.i: r.start for r in state.paced(spark.createDataFrame(rows, "i int, host string, at double"), "host", "at", 1.0, "i").collect()}
    last = {}
    for i, h, at in sorted(rows, key=lambda r: (r[2], r[0])):
        last[h] = max(at, last[h] + 1.0) if h in last else at
        assert abs(got[i] - last[h]) < 1e-9


def test_ttl_edges(spark):
    rows = [(1, 0.0, True), (1, 60.0, True), (1, 60.5, True), (1, 121.0, True), (2, 5.0, False), (2, 6.0, True), (2, 7.0, True)]
    got = sorted(tuple(r) for r in state.ttl_cache(spark.createDataFrame(rows, "k long, t double, ok boolean"), "k", "t", 60.0, "ok").collect())
    assert [g[2] for g in got] == [False, True, False, False, False, False, True]


def test_ttl_keys_and_ties(spark):
    """Keys are addresses; of requests at one time the order column decides, else those that succeed come first."""
    rows = [("https://a/", 0.0, False, 2), ("https://a/", 0.0, True, 1), ("https://b/", 1.0, True, 1), (None, 2.0, True, 1), (None, 3.0, True, 1)]
    df = spark.createDataFrame(rows, "url string, t double, ok boolean, n int")
    for order in ("n", None):
        got = Counter((r.url, r.t, r.hit) for r in state.ttl_cache(df, "url", "t", 60.0, "ok", order).collect())
        assert got == Counter([("https://a/", 0.0, False), ("https://a/", 0.0, True), ("https://b/", 1.0, False), (None, 2.0, False), (None, 3.0, True)])


def test_lru(spark):
    rows = [("c", k, float(i)) for i, k in enumerate("abacab")]
    got = sorted((r.t, r.hit) for r in state.lru_cache(spark.createDataFrame(rows, "c string, k string, t double"), "c", "k", "t", 100.0, 2).collect())
    assert [h for _, h in got] == [False, False, True, False, True, False]
