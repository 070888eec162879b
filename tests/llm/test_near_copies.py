"""The pipeline's near-duplicate stage against brute force over 5-word shingle sets."""

import random
from collections import Counter

from conftest import SF
from pyspark.sql import functions as F
from test_operators import brute_groups, table, words

import corpus_pipeline
from pagewright.llm import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def test_edited_copies(spark):
    rng = random.Random(21)
    rows = [(None, "no key"), (90, None), (91, " \n"), (92, "A b"), (93, "a  B")]
    for d in range(12):
        base = words(rng, rng.randint(50, 120)).split()
        rows.append((d, " ".join(base)))
        for k in range(4):  # copies with a few replaced words, on both sides of 0.8
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            rows.append((100 + 10 * d + k, " ".join(copy)))
    sets = [(k, shingles(t)) for k, t in rows]
    comp = brute_groups(sets, near)
    want = Counter(k for (k, _), c in zip(sets, comp, strict=True) if k is None or k == c)
    assert 15 < sum(want.values()) < len(rows) - 15
    df = table(spark, rows)
    got = corpus_pipeline.near_duplicates(spark, df, SF)
    assert got.columns == df.columns and Counter(r.doc_id for r in got.collect()) == want


def test_common_shingles_come_last(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "COMMON", 2)
    rng = random.Random(22)
    shared = words(rng, 40)
    rows = [(i, f"{shared} {words(rng, rng.randint(0, 14))}") for i in range(30)]
    sets = [(k, shingles(t)) for k, t in rows]
    want = Counter(k for (k, _), c in zip(sets, brute_groups(sets, near), strict=True) if k == c)
    assert Counter(r.doc_id for r in near_copies.keep_one(table(spark, rows)).collect()) == want
    assert near_copies.keep_one(table(spark, [])).count() == 0


def test_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    want = Counter(k for (k, _), c in zip(sets, brute_groups(sets, near), strict=True) if k == c)
    assert Counter(r.doc_id for r in near_copies.keep_one(docs).select(F.col("doc_id")).collect()) == want


def test_simhash_comes_first(spark, monkeypatch):
    """What two fingerprints link needs no other way; pairs they name wrongly don't pass; the others are found without them."""
    rng = random.Random(23)
    base = words(rng, 400).split()
    near_rows = [(i, " ".join(base[:399] + [f"new{i}"])) for i in range(6)]
    seen = []
    links_of = near_copies.fingerprint_links
    monkeypatch.setattr(near_copies, "fingerprint_links", lambda fps: seen.append(fps.count()) or links_of(fps))
    df = table(spark, near_rows + [(9, words(rng, 60))])
    assert [r.doc_id for r in near_copies.keep_one(df).orderBy("doc_id").collect()] == [0, 9] and seen and seen[0] > 1
    a, b = (shingle for shingle in (near_copies.shingle_set(t.encode()) for _, t in near_rows[:2]))
    bits = lambda x: sum((int(v) & (1 << 64) - 1) << 64 * k for k, v in enumerate(near_copies.parities(x)))
    apart = len(set(a.tolist()) ^ set(b.tolist()))
    assert 0 < (bits(a) ^ bits(b)).bit_count() <= apart


def test_common_passage(spark):
    """Texts that share one passage and little else are grouped as brute force has it; the parity filter drops no pair."""
    rng = random.Random(24)
    passage = words(rng, 60)
    rows = [(i, f"{passage} {words(rng, 14)}") for i in range(120)]
    sets = [(k, shingles(t)) for k, t in rows]
    want = Counter(k for (k, _), c in zip(sets, brute_groups(sets, near), strict=True) if k == c)
    assert Counter(r.doc_id for r in near_copies.keep_one(table(spark, rows)).collect()) == want
