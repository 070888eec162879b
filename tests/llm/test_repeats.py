"""Repeated passages: ranks piece by piece, and where ranks of several documents meet."""

import random
from collections import Counter

import numpy as np
from pagewright.llm import suffix_dedup
from pagewright.llm.common import settings


def test_ranks_by_pieces(monkeypatch):
    """Ranks don't depend on the place, across the borders of pieces too, and take three hashed pairs a position, not six."""
    rng = random.Random(8)
    text = bytes(rng.choice(b"abc") for _ in range(40_000)) * 2 + b"a" * 70
    work, pair = [], suffix_dedup._pair
    monkeypatch.setattr(suffix_dedup, "_pair", lambda a, b: (work.append(len(b)), pair(a, b))[1])
    half, whole = suffix_dedup.ranks(np.frombuffer(text, np.uint8), True)
    assert sum(work) < 3.1 * len(text)
    for size, got in ((25, half), (50, whole)):
        name = {}
        assert len(got) == len(text) - size + 1
        assert all(name.setdefault(text[i : i + size], r) == r for i, r in enumerate(got.tolist())) and len(set(name.values())) == len(name)
    least = suffix_dedup._least(half)
    assert least.tolist() == np.lib.stride_tricks.sliding_window_view(half, 26).min(axis=1).tolist()


def test_suffix_by_small_batches(spark):
    """Ranks that go on over many batches, in one document only and in several, with copies in one stretch."""
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdef ") for _ in range(80)) for _ in range(6)]
    docs = [(i, rng.choice(passages) * rng.randint(1, 3) + rng.choice(passages)[rng.randint(0, 40) :]) for i in range(120)] + [(3, passages[0] * 40)] * 30
    first = {}
    for k, t in sorted(docs):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], k)
    want = Counter()
    for k, t in docs:
        want[k, sum(any(first[t[j : j + 50]] < k for j in range(max(0, i - 49), min(i, len(t) - 50) + 1)) for i in range(len(t)))] += 1
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "3"}):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), with_text=False).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == want
