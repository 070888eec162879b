"""The corpus pipeline against brute force, stage by stage and both ways, on the smallest tables."""

import random
import re
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import decontaminate, line_dedup, quality
from pagewright.llm.common import stored

NAMES = ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]


@pytest.fixture(scope="module")
def seen(spark):
    """Each stage's input and output."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        out[name] = (before, docs)
    return out


def split_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_columns_and_order(spark, seen):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert all(seen[n][1].columns == columns for n in NAMES[:-1])


def good(text):
    """The rules of the filtering policy."""
    w = split_words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if split_words(x)]
    chars, marks, bangs = sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), (text or "").count("!")
    bad = [
        100 * len(again) > 50 * len(w), w and 10 * marks > 3 * len(w), w and 10 * bangs > 5 * len(w), chars > 16 * len(w), chars < 2 * len(w),
        len(lines) > 4 and 100 * (len(lines) - len(set(lines))) > 50 * len(lines), not w,
    ]
    return not any(bad)


def test_quality_rules(spark, seen):
    before, after = seen["quality_rules"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = Counter(r for r in rows if good(r[1]))
    assert Counter((r.doc_id, r.text) for r in after.collect()) == want and 0 < sum(want.values()) < len(rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean = quality.filter_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    kept = {r.doc_id for r in clean.collect()}
    share = lambda q: sum(k in kept for k, v in labels.items() if v == q) / sum(v == q for v in labels.values())
    assert share(1) >= 0.99 and share(0) < 0.1


def edits_at_most(a, b, k):
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > k:
            return False
        row = new
    return row[-1] <= k


def shingles(text, size=5):
    w = split_words(text.lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def test_line_dedup(spark, seen):
    before, after = seen["line_dedup"]
    docs = before.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()
    places = sorted((r.doc_id, r.th, i, line.strip(" \t\r\x0b\x0c")) for r in docs for i, line in enumerate((r.text or "").split("\n")))
    first = {}
    for p in places:
        if p[3]:
            first.setdefault(p[3], p[:3])
    lines = sorted((x for x in first if len(x) >= line_dedup.MIN_CHARS), key=len)
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    letters = {x: Counter(x) for x in lines}
    apart = lambda a, b: sum(((a - b) | (b - a)).values())
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            near = False
            if len(b) - len(a) <= line_dedup.EDITS and apart(letters[a], letters[b]) <= 2 * line_dedup.EDITS:
                near = edits_at_most(a, b, line_dedup.EDITS)
            if near:
                root[find(a)] = find(b)
    keep = {}
    for x, p in first.items():
        keep[find(x)] = min(p, keep.get(find(x), p))
    want = Counter()
    for r in docs:
        kept = [line for i, line in enumerate((r.text or "").split("\n")) if not (t := line.strip(" \t\r\x0b\x0c")) or keep[find(t)] == (r.doc_id, r.th, i)]
        want[(r.doc_id, "\n".join(kept))] += 1
    got = [(r.doc_id, r.text, r.n_chars) for r in after.collect()]
    assert Counter(g[:2] for g in got) == want and all(n == len(t) for _, t, n in got)


def test_near_duplicates(seen):
    before, after = seen["simhash_near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    sets = []
    for _, t in rows:
        w = split_words((t or "").lower())
        sets.append(shingles(t or "") if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 9 * len(a & b) >= 4 * (len(a) + len(b))):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter(row for i, row in enumerate(rows) if least[find(i)] == row[0])


def test_decontamination(spark, seen):
    before, after = seen["benchmark_decontamination"]
    items = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [x for x in items if len(x.split()) >= decontaminate.LEAST_WORDS]

    def quotes(item, text):
        """Without a piece that stands unchanged, there are more errors than the budget."""
        k = len(item) // 20
        if not any(p in text for _, p in decontaminate.pieces(item, k)):
            return False
        split = [decontaminate.splits_word(text, j) for j in range(len(text) + 1)]
        row = [int(x) for x in split]
        for i, x in enumerate(item, 1):
            new = [i + split[0]]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y), i + split[j]))
            row = new
        return min(r + s for r, s in zip(row, split, strict=True)) <= k

    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = Counter(row for row in rows if not any(quotes(i, decontaminate.normalised(row[1] or "")) for i in items))
    assert Counter((r.doc_id, r.text) for r in after.collect()) == want and sum(want.values()) < len(rows)


def test_sentencepiece(spark, seen):
    import sentencepiece

    from pagewright.llm import sentencepiece_codec, token_counts

    lib = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path(sentencepiece_codec.MODEL_FILE))
    before, after = seen["sentencepiece"]
    want = Counter((r.doc_id, tuple(lib.encode(r.text or ""))) for r in before.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) == want and after.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_stages_on_odd_rows(spark):
    """Nulls, repeated and missing ids, empty tables, and extra columns of names that the stages use."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 99)) for _ in range(60))
    rows = [(1, text), (1, text), (1, text + " and more"), (None, text), (2, None), (3, ""), (4, "one"), (None, None), (5, text.upper())]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "l", "h", "k") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int, ledger string, _hit string, n_lines string")
    for start in (df, df.limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF))
            if name != NAMES[-1]:
                assert docs.columns == df.columns and docs.schema["n_chars"].dataType == df.schema["n_chars"].dataType
        assert sorted(docs.columns) == ["doc_id", "ids", "n_tokens", "round_trip"]
        # Equal lines stay at their first place alone, by id (null ids first), and texts left empty are copies of each
        # other; the text with two more words is no near line, but it is a near copy, and so is the upper-case one.
        assert {(r.doc_id, r.n_tokens > 0) for r in docs.collect()} == ({(None, True), (1, False), (1, True), (4, True)} if start is df else set())
