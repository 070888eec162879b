"""Quality rules as a bitmask ledger, in DataFrame functions only.

measure() evaluates every rule once a text: the ledger holds the measurements and one bigint with a bit for each rule
that fails. A policy is a named mask of rules; verdicts, comparisons of policies and ablations need the ledger alone.

Cases: null, empty and blank texts have no words and fail too_few_words; texts of any length stay in their row (nothing
is exploded, so one long text or a hot source makes no hot task); repeated rows stay; an empty table gives an empty
ledger; extra columns, those with names of measurements too, are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import WORD_CLASS, fenced, fresh, words

#: Rules by bit, never renumbered: name and the condition under which a text fails, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_words > 0 and 10 * n_symbols > 3 * n_words"),
    ("bangs", "n_words > 0 and 10 * n_bangs > 5 * n_words"),
    ("long_words", "word_chars > 16 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("duplicate_lines", "n_lines > 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("no_words", "n_words = 0"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = ("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of what counts: a text is kept if it fails none of these rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {
    "base-1": Policy("base-1", BASE),
    "full-1": Policy("full-1", tuple(name for name, _ in RULES)),
    # For filtering: a short text isn't a bad one.
    "clean-1": Policy("clean-1", tuple(name for name, _ in RULES if name != "too_few_words")),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")


def _lost(text: Column, chars: str) -> Column:
    """How many of these characters a text has."""
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0)).cast("bigint")


def measure(docs: DataFrame, text: str = "text", into: str = "ledger") -> DataFrame:
    """docs with one more column, a struct of the measurements and fail_bits (bit by place in RULES).

    It is called `into`, with an underscore before it as long as docs has a column of that name."""
    into = fresh(docs, into)
    t, w, ln, win, srt = (fresh(docs, n) for n in ("_t", "_w", "_l", "_win", "_sorted"))
    own = docs.columns
    at = lambda arr, i: F.get(F.col(arr), i)
    df = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumns({w: words(F.col(t)), ln: F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(WORD_CLASS))})
    # Windows of three words by hash, which finds texts that may repeat one.
    df = df.withColumn(
        win,
        F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(at(w, i), at(w, i + 1), at(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Only texts with a repeated window are sorted.
    df = df.withColumn(
        srt,
        F.when(
            F.size(F.array_distinct(win)) < F.size(win),
            F.sort_array(F.transform(F.col(win), lambda h, i: F.struct(h.alias("h"), F.hash(at(w, i), at(w, i + 1), at(w, i + 2)).alias("g"), i.alias("i")))),
        ),
    )
    # Windows are equal if two hashes of them are, 96 bits together.
    same = lambda x, i: (at(srt, i).h == x.h) & (at(srt, i).g == x.g) & (at(srt, i).i != x.i)
    starts = F.filter(
        F.col(srt),
        lambda x, i: F.coalesce(F.when(i > 0, same(x, i - 1)), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))
    values = {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.length(F.array_join(F.col(w), "")).cast("bigint"),
        "n_symbols": _lost(F.col(t), "#*$%&|<>"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("bigint"),
        "n_repeat_words": F.when(F.col(srt).isNull(), F.lit(0)).otherwise(covered).cast("bigint"),
        "n_lines": F.size(ln).cast("bigint"),
        "n_bangs": _lost(F.col(t), "!"),
    }
    m = fresh(docs, "_m")
    df = df.select(*own, F.struct(*[values[k].alias(k) for k in MEASURES]).alias(m))
    bits = F.lit(0).cast("bigint")
    for name, fails in RULES:
        for k in MEASURES:
            fails = _qualified(fails, k, f"`{m}`.`{k}`")
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name]).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return df.select(*own, F.struct(*[F.col(m)[k].alias(k) for k in MEASURES], bits.alias("fail_bits")).alias(into))


def _qualified(condition: str, name: str, path: str) -> str:
    import re

    return re.sub(rf"(?<![\w`.]){name}(?![\w`])", path.replace("\\", r"\\"), condition)


def kept(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def ablations(ledger: DataFrame, policy: Policy, bits: str = "fail_bits") -> DataFrame:
    """For each rule of a policy: texts it fails, texts that it alone rejects, texts kept without it."""
    masked = ledger.select(F.col(bits).bitwiseAND(F.lit(policy.mask).cast("bigint")).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("bigint").alias("bit")) for r in policy.rules])
    by = masked.select("b", "n", F.explode(rules).alias("r")).select("b", "n", "r.rule", "r.bit")
    has = F.col("b").bitwiseAND(F.col("bit")) != 0
    return by.groupBy("rule", "bit").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("b") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when(F.col("b").isin(0) | (F.col("b") == F.col("bit")), F.col("n")).otherwise(0)).alias("kept_without"),
    )


def compare_policies(ledger: DataFrame, policies: list[Policy], bits: str = "fail_bits") -> DataFrame:
    """Texts kept under each policy, from one pass over the ledger."""
    one = ledger.groupBy(bits).agg(F.count("*").alias("n"))
    table = F.array(*[F.struct(F.lit(p.version).alias("version"), F.lit(p.mask).cast("bigint").alias("mask")) for p in policies])
    return (
        one.select(bits, "n", F.explode(table).alias("p"))
        .groupBy("p.version")
        .agg(F.sum(F.when(F.col(bits).bitwiseAND(F.col("p.mask")) == 0, F.col("n")).otherwise(0)).alias("kept"), F.sum("n").alias("n"))
    )


def filter_quality(docs: DataFrame, policy: Policy = POLICIES["clean-1"], text: str = "text") -> DataFrame:
    """The rows of docs that fail no rule of the policy, with the columns of docs."""
    into = fresh(docs, "ledger")
    return fenced(measure(docs, text, into), kept(F.col(into).fail_bits, policy)).select(*docs.columns)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = measure(docs)
    bits = F.col("ledger.fail_bits")
    return m.select(
        "doc_id",
        *[F.col(f"ledger.{k}").alias(k) for k in MEASURES[:5]],
        (~kept(bits, POLICIES["base-1"])).alias("base_failed"),
        kept(bits, POLICIES["full-1"]).alias("kept"),
        bits.alias("fail_bits"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, t, w, l, CASE WHEN len(w) >= 3 THEN
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS g FROM w),
x AS (SELECT row_number() OVER () AS rid, * FROM g),
p AS (SELECT rid, unnest(g) AS s, generate_subscripts(g, 1) AS i FROM x),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM p),
v AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM x LEFT JOIN v USING (rid)),
b AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
        + 4 * (n_words > 0 AND 10 * n_symbols > 3 * n_words)::BIGINT + 8 * (n_words > 0 AND 10 * n_bangs > 5 * n_words)::BIGINT
        + 16 * (word_chars > 16 * n_words)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT
        + 64 * (n_lines > 4 AND 100 * n_dup_lines > 50 * n_lines)::BIGINT + 128 * (n_words = 0)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  fail_bits = 0 AS kept, fail_bits FROM b
"""


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of the full policy does over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ablations(measure(docs).select("ledger.fail_bits"), POLICIES["full-1"])


QUALITY_ABLATIONS_SQL = f"""
WITH l AS (SELECT fail_bits FROM ({OP4_SQL}) q),
r AS (SELECT * FROM (VALUES {", ".join(f"('{name}', {bit}::BIGINT)" for name, bit in BIT.items())}) v(rule, bit))
SELECT rule, bit, (count(*) FILTER ((fail_bits & bit) <> 0))::BIGINT AS failed, (count(*) FILTER (fail_bits = bit))::BIGINT AS only_this,
  (count(*) FILTER (fail_bits = 0 OR fail_bits = bit))::BIGINT AS kept_without FROM l, r GROUP BY rule, bit
"""
