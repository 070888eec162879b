"""Line dedup of the query and the pipeline stage: short lines and long near copies."""

import random

from conftest import SF
from pyspark.sql import functions as F
from test_operators import brute_groups, edit_distance, mutated, words

from pagewright.llm import line_dedup


def test_short_lines_by_exact_copies(spark):
    docs = [(1, "Les.\n\nAnd ornd.\nLes."), (2, "  Les. \n\nLess.\nAnd ornd."), (3, "\n \nLes"), (None, "Les")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.filter_lines(df).collect()}
    assert got == {1: "Les.\n\nAnd ornd.", 2: "\nLess.", 3: "\n ", None: "Les"}


def test_query_leaves_no_exact_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = set()
    for r in line_dedup.filter_lines(docs).orderBy("doc_id").collect():
        lines = [x for line in (r.text or "").split("\n") if (x := line.strip(" \t\r\x0b\x0c"))]
        assert len(set(lines)) == len(lines) and seen.isdisjoint(lines)
        seen.update(lines)
    removed = line_dedup.op8_line_dedup(spark, SF).agg({"n_removed": "sum"}).first()[0]
    assert removed > 0


def near_words(a, b):
    """Two edits of whole words, in lines that both have LONG_WORDS or more."""
    a, b = a.split(" "), b.split(" ")
    return min(len(a), len(b)) >= line_dedup.LONG_WORDS and abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2


def test_long_lines_by_words(spark):
    rng = random.Random(31)
    lines = []
    for n in (19, 20, 21, 40, 80, 130):
        base = words(rng, n).split()
        lines.append(" ".join(base))
        for k in range(5):
            copy = list(base)
            for _ in range(1 + k % 3):
                i = rng.randrange(len(copy))
                rng.choice([lambda c=copy, i=i: c.pop(i), lambda c=copy, i=i: c.insert(i, "new"), lambda c=copy, i=i: c.__setitem__(i, f"replaced{rng.randint(0, 999)}")])()
            lines.append(" ".join(copy))
    short = lambda x: len(x.split(" ")) < line_dedup.LONG_WORDS
    comp = brute_groups(list(enumerate(lines)), lambda a, b: near_words(a, b) or (short(a) and short(b) and abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2))
    assert 3 < len(set(comp)) < len(lines) - 3
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.filter_lines(df, by_words=True).collect() if r.text}
    assert got == {i for i, c in enumerate(comp) if i == c}


def test_hot_segments_of_words(spark, monkeypatch):
    rng = random.Random(43)
    head, tail = "one two three four five six seven".split(), "ten eleven twelve thirteen fourteen fifteen sixteen seventeen".split()
    lines = {" ".join([*head, *(rng.choice("abc") for _ in range(rng.randint(6, 9))), *tail]) for _ in range(60)}
    lines = sorted(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    want = {(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and near_words(a, b)}
    for most in (2, 1000):
        monkeypatch.setattr(line_dedup, "HOT_KEY", most)
        got = {(min(r), max(r)) for r in line_dedup.near_line_links(df, 2, line_dedup.WORDS).collect()}
        assert got == want and want


def test_hot_segments(spark, monkeypatch):
    """Keys that many lines share, split once or more, against brute force."""
    rng = random.Random(41)
    heads, tails = ["Posted by the user ", "Written by a friend "], [" on the board, today", " in the forum."]
    lines = set()
    for _ in range(60):
        line = rng.choice(heads) + "".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) + rng.choice(tails)
        lines |= {line, mutated(rng, line, 2)}
    lines = sorted(x for x in lines if len(x) >= line_dedup.MIN_CHARS and x == x.strip())
    df = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    want = {(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2}
    for most in (2, 10, 1000):
        monkeypatch.setattr(line_dedup, "HOT_KEY", most)
        got = {(min(r), max(r)) for r in line_dedup.near_line_links(df).collect()}
        assert got == want and want


def test_a_segment_of_very_many_lines(spark):
    """Different lines that share a segment aren't compared each with each."""
    n = 60_000
    name = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 30)
    lines = spark.range(n).select(F.col("id").alias("h"), F.concat(F.lit("Posted by user "), name).alias("line"))
    live = line_dedup._live(line_dedup._entries(lines, 2, line_dedup.CHARACTERS))
    assert live.groupBy("key").count().agg(F.max("count")).first()[0] == n
    spread = line_dedup._spread(live, lines, 2, line_dedup.CHARACTERS).groupBy("key").count().agg(F.max("count"), F.sum(F.col("count") * F.col("count"))).first()
    assert (spread[0] or 0) <= line_dedup.HOT_KEY and (spread[1] or 0) < 40 * n
    assert line_dedup.near_line_links(lines).count() == 0
