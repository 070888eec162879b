"""Label propagation of operator 6: its rounds, not the start, bring groups together."""

from collections import Counter

import pytest
from pagewright.llm import sharding
from pyspark.sql import functions as F

SHARES = [50] * 8


def linked(spark, texts):
    base = sharding.stored(sharding.documents_base(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"))
    return base, sharding.stored(sharding.equal_text_members(base))


def shards_by_text(base, labels):
    out = {}
    for r in base.join(labels.select("uid", "shard"), "uid").collect():
        out.setdefault(r.h, Counter())[r.shard] += 1
    return out


def test_rounds_gather_groups(spark):
    """Groups start scattered, and each ends as a whole where most of its rows began, as long as there is room."""
    base, members = linked(spark, [f"text {i // 5}" for i in range(100)] + [f"alone {i}" for i in range(300)])
    own = members.join(base.select("uid", "c"), "uid")
    start = shards_by_text(base, sharding.starting_labels(own, SHARES))
    labels, dealt = sharding.propagate(base, members, SHARES)
    end = shards_by_text(base, labels)
    assert len(start) == len(end) == 20 and not dealt
    assert sum(len(c) > 1 for c in start.values()) > 15 and all(len(c) == 1 for c in end.values())
    assert all(start[h][next(iter(c))] == max(start[h].values()) for h, c in end.items())


def test_large_groups_before_small(spark):
    """No row is free: groups of 30 and of 20 rows go whole into shards of 50, though small ones ask for the same room."""
    texts = [f"thirty {i // 30}" for i in range(150)] + [f"twenty {i // 20}" for i in range(100)] + [f"pair {i // 2}" for i in range(150)]
    done = sharding.assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    home = {}
    for r in done.collect():
        home.setdefault(texts[r.doc_id], Counter())[r.shard] += 1
    assert set(sum(home.values(), Counter()).values()) == {50}
    assert all(len(c) == 1 for t, c in home.items() if t.startswith(("thirty", "twenty")))
    assert sum(len(c) > 1 for c in home.values()) == 0


def test_a_text_beyond_a_share(spark):
    """A text of 120 rows takes three shards of 50, and no other group is cut."""
    texts = ["same"] * 120 + [f"four {i // 4}" for i in range(120)] + [f"alone {i}" for i in range(160)]
    done = sharding.assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    home = {}
    for r in done.collect():
        home.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(home["same"]) == 3 and all(len(h) == 1 for t, h in home.items() if t != "same")
