"""Near-duplicate lines by segment partition, in DataFrame functions only.

Two lines are near copies at EDITS edits or fewer: edits of characters or, with `by_words`, of whole words in lines of
LONG_WORDS words and more. (By words, the query costs 1156 CPU seconds a GB, by characters a third of it; so it isn't the
default.) A line's symbols are split into EDITS + 1 segments of nearly equal length, one of which any near copy of the
same length or longer holds unchanged at a nearby place. Every line is indexed
by (length, segment number, segment hash); it probes the indexes of its own and the next EDITS shorter lengths at the few
places where a segment can stand (multi-match-aware bounds). Candidates among lines of characters must agree in the counts
of some frequent letters within the budget; then a banded bit-parallel edit distance (the band in one 64-bit word, one
step a symbol) verifies them. Verified pairs are linked into classes, and of each class only the first occurrence stays.

Cases: lines of fewer than MIN_CHARS characters after trimming have no near copies but exact ones, which all lines have;
by words, a long and a short line are no near copies, and words end at single spaces; blank lines are always kept; null texts stay null
and have no lines; the order of occurrences is (id, text hash, line), null ids first; rows with equal id and text count as
one document and get the same result; an empty table gives an empty result; extra columns are carried through unchanged.

Hot keys: a very frequent line gives index entries at one place only. A segment that more than HOT_KEY different lines
share (of one length, "Posted by ..." say) is taken out of them, and what is left is split and looked up in the same way,
SPLITS times at most; pairs that can't match are dropped inside the join of candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import fenced, fresh, stored
from pagewright.llm.components import connected_components

EDITS = 2
MIN_CHARS = 24
# Frequent letters of the Latin script, whose counts bound the edit distance from below.
LETTERS = ("enatirosu", "dlhcmpgb ")
HOT_SHARE = 10_000
HOT_KEY, SPLITS = 2_000, 4
BROADCAST_ROWS = 1_000_000
LONG_WORDS = 20
_TRIM = " \t\r\x0b\x0c"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


@dataclass(frozen=True)
class Symbols:
    """What a line is made of: its symbols in a form in which a part is cheap to find, and as an array."""

    packed: Callable[[Column], Column]
    size: Callable[[Column], Column]
    part: Callable[[Column, Column, Column], Column]  # of so many symbols from a place (from 0)
    listed: Callable[[Column], Column]


#: Four bytes a character, in which a place is found without counting characters.
CHARACTERS = Symbols(
    lambda line: F.encode(line, "UTF-32"), lambda x: (F.octet_length(x) / 4).cast("int"), lambda x, at, n: F.substring(x, 4 * at + 1, 4 * n), lambda line: F.split(line, "")
)
#: A hash a word; words themselves are compared in the end.
WORDS = Symbols(
    lambda line: F.transform(F.split(line, " "), lambda w: F.hash(w)), lambda x: F.size(x), lambda x, at, n: F.slice(x, at + 1, n), lambda line: F.split(line, " ")
)


def n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def probe_shifts(i: int, delta: int, edits: int) -> list[int]:
    """Places, against the segment's own, where segment i (from 0) of a line shorter by delta can stand."""
    return [s for s in range(-edits, edits + delta + 1) if abs(s) <= i and abs(s - delta) <= edits - i]


def _places(edits: int) -> Column:
    """All (delta, segment, shift) of index and probe entries."""
    table = [(delta, i, s) for delta in range(edits + 1) for i in range(edits + 1) for s in probe_shifts(i, delta, edits)]
    return F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in table])


def _segment(x: Column, p: Column, length: Column, edits: int, unit: Symbols) -> tuple[Column, Column, Column]:
    """Place and size of a segment of lines of that length, moved by the entry's shift, and what x has there. Segment i of m covers length * i // m to length * (i + 1) // m."""
    m = edits + 1
    start = F.floor(length * p["i"] / m).cast("int")
    size = F.floor(length * (p["i"] + 1) / m).cast("int") - start
    at = (start + p["s"]).cast("int")
    return at, size, unit.part(x, at, size)


def _entries(lines: DataFrame, edits: int, unit: Symbols) -> DataFrame:
    """lines(h, line) to (h, key, own), all index and probe entries.

    The places are exploded and each key is plain generated code: a higher-order function would be interpreted."""
    packed = lines.select("h", unit.packed(F.col("line")).alias("x"))
    each = packed.select("h", "x", F.explode(_places(edits)).alias("p"))
    length = unit.size(F.col("x")) - F.col("p.d")
    key = F.xxhash64(_segment(F.col("x"), F.col("p"), length, edits, unit)[2], length.cast("bigint"), F.col("p.i"))
    return each.select("h", key.alias("key"), ((F.col("p.d") == 0) & (F.col("p.s") == 0)).alias("own"))


def _split(rows: DataFrame, edits: int, unit: Symbols) -> DataFrame:
    """rows(h, own, d, rest, up), a line or what is left of it, to (h, own, d, key, rest): its entries below the key up.

    own: of the line that is indexed; d: how much longer the line is than those it is compared with. rest: without the
    entry's segment. If two lines are near by a segment that both hold, so are their rests."""
    each = rows.select("h", "own", "d", "rest", "up", F.explode(_places(edits)).alias("p")).where("p.d = d")
    rest, p = F.col("rest"), F.col("p")
    at, size, part = _segment(rest, p, unit.size(rest) - F.col("d"), edits, unit)
    left = F.concat(unit.part(rest, F.lit(0), at), unit.part(rest, at + size, unit.size(rest) - at - size))
    return each.select("h", "d", F.xxhash64(part, F.col("up"), F.col("p.i")).alias("key"), (F.col("own") & (F.col("p.s") == 0)).alias("own"), left.alias("rest"))


def _live(entries: DataFrame) -> DataFrame:
    """entries(h, key, own) to (key, h, own) of the keys that can give a candidate: two different lines share it, one of them as its own segment."""
    here = Window.partitionBy("key")
    met = entries.withColumns({"lo": F.min("h").over(here), "hi": F.max("h").over(here), "indexed": F.max("own").over(here)})
    return stored(met.where("lo <> hi and indexed").groupBy("key", "h").agg(F.max("own").alias("own")))


def _spread(live: DataFrame, lines: DataFrame, edits: int, unit: Symbols) -> DataFrame:
    """live with the keys of more than HOT_KEY lines split by a segment of what is left of their lines, SPLITS times at most."""
    rows = None
    for _ in range(SPLITS):
        hot = stored(live.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY).select("key"))
        if hot.isEmpty():
            break
        if rows is None:
            some = lines.join(live.join(hot, "key", "left_semi").select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
            rows = some.select("h", unit.packed(F.col("line")).alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("d"))
            rows = rows.select("h", "rest", "d", (F.col("d") == 0).alias("own"), (unit.size(F.col("rest")) - F.col("d")).cast("bigint").alias("up"))
        below = _split(rows, edits, unit).join(hot, "key").where(unit.size(F.col("rest")) - F.col("d") > edits)
        rows = stored(below.select("h", "rest", "d", "own", F.col("key").alias("up")).distinct())
        # Keys that leave too little of their lines to be split (the same for all lines of a key) stay as they are.
        ended = live.join(hot, "key", "left_semi").join(rows.select(F.col("up").alias("key"), "h").distinct(), ["key", "h"], "left_anti")
        live = stored(live.join(hot, "key", "left_anti").unionByName(ended).unionByName(_live(_split(rows, edits, unit))))
    return live


def banded_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two array columns of characters whose sizes differ by edits at most; edits + 1 if it is larger.

    Bit-parallel in a band of 2 * edits + 1 diagonals: bit d of a word stands for row j - edits + d of column j. Each
    step compares one character of b with the band's characters of a and moves the band down by one row."""
    width = 2 * edits + 1
    top, mask = 1 << (width - 1), (1 << width) - 1
    big = lambda v: F.lit(v).cast("bigint")
    n, m = F.size(a), F.size(b)

    def step(acc: Column, j: Column) -> Column:  # j from 1
        c = F.get(b, j - 1)
        eq = big(0)
        for d in range(width):
            at = j - edits + d - 1  # place in a, from 0
            eq = eq.bitwiseOR(F.when((at >= 0) & (F.get(a, at) == c), big(1 << d)).otherwise(big(0)))
        return F.struct(acc.vp.alias("vp"), acc.vn.alias("vn"), acc.score.alias("score"), eq.alias("eq"), j.alias("j"))

    def advance(s: Column) -> Column:
        d0 = ((s.eq.bitwiseAND(s.vp) + s.vp).bitwiseXOR(s.vp)).bitwiseOR(s.eq).bitwiseOR(s.vn).bitwiseAND(big(mask))
        hp = s.vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(s.vp))).bitwiseAND(big(mask))
        hn = d0.bitwiseAND(s.vp)
        x = F.shiftright(d0, 1)
        vn = hp.bitwiseAND(x)
        vp = hn.bitwiseOR(F.bitwise_not(hp.bitwiseOR(x))).bitwiseAND(big(mask))
        return F.struct(vp.alias("vp"), vn.alias("vn"), d0.alias("d0"), hp.alias("hp"), hn.alias("hn"), s.score.alias("score"), s.j.alias("j"))

    def count(s: Column) -> Column:
        # Down the lowest diagonal until the last row of a, then along that row.
        diagonal = F.when(s.d0.bitwiseAND(big(top)) == 0, 1).otherwise(0)
        place = n - s.j + edits
        bit = F.get(F.array(*[big(1 << d) for d in range(width)]), place)
        row = F.when(s.hp.bitwiseAND(bit) != 0, 1).when(s.hn.bitwiseAND(bit) != 0, -1).otherwise(0)
        return F.struct(s.vp.alias("vp"), s.vn.alias("vn"), (s.score + F.when(s.j + edits <= n, diagonal).otherwise(row)).alias("score"))

    lift = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731  binds a value to a name
    # The last row takes 2 * edits steps at most, each by one: beyond three times the budget nothing can bring the score back.
    go_on = lambda acc, j: F.when(acc.score > 3 * edits, acc).otherwise(lift(lift(step(acc, j), advance), count))
    start = F.struct(big(mask ^ ((1 << edits) - 1)).alias("vp"), big(0).alias("vn"), F.least(n, F.lit(edits)).alias("score"))
    end = F.aggregate(F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")), start, go_on)
    score = F.when(m == 0, n).otherwise(end.score)
    return F.least(score, F.lit(edits + 1))


def _letters(line: Column, letters: str) -> Column:
    """Counts of letters, 127 at most each (which keeps the bound), seven bits a letter."""
    count = lambda c: F.least(F.length(line) - F.length(F.replace(line, c, F.lit(""))), F.lit(127)).cast("bigint")
    return F.aggregate(F.array(*map(F.lit, letters)), F.lit(0).cast("bigint"), lambda acc, c: acc * 128 + count(c))


def _apart(a: str, b: str) -> Column:
    """Sum of the differences of two packed counts."""
    part = lambda c, k: F.shiftright(c, 7 * k).bitwiseAND(F.lit(127).cast("bigint"))
    return sum((F.abs(part(F.col(a), k) - part(F.col(b), k)) for k in range(9)), F.lit(0))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, pos, line): lines that aren't blank, trimmed."""
    df = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.posexplode(split_lines(F.col(text).cast("string"))).alias("pos", "raw"))
    return df.select("key", "th", "pos", F.btrim("raw", F.lit(_TRIM)).alias("line")).where(F.length("line") >= 1)


def near_line_links(lines: DataFrame, edits: int = EDITS, unit: Symbols = CHARACTERS) -> DataFrame:
    """lines(h, line), which may repeat, to links (src, dst) of the hashes of lines within so many edits of symbols."""
    live = _spread(_live(_entries(lines, edits, unit)), lines, edits, unit)
    wanted = stored(live.select("h").distinct())
    # So many hashes may be sent to all tasks, which then shuffle no other line; more of them are joined.
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = stored(lines.join(few, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")))
    line = F.col("line")
    # Edits of words don't bound the letters' counts.
    counts = [_letters(line, part) if unit is CHARACTERS else F.lit(0).cast("bigint") for part in LETTERS]
    facts = texts.select("h", (F.length(line) if unit is CHARACTERS else n_words(line)).alias("n"), *[c.alias(f"c{k}") for k, c in enumerate(counts)])
    known = stored(live.join(facts, "h"))
    side = lambda x: [F.col("h").alias(f"h{x}"), F.col("n").alias(f"n{x}"), F.col("c0").alias(f"c0{x}"), F.col("c1").alias(f"c1{x}")]
    a = known.where("own").select("key", *side("a"))
    b = known.select("key", *side("b"))
    apart = _apart("c0a", "c0b") + _apart("c1a", "c1b")
    near = (F.col("nb") - F.col("na")).between(0, edits) & (apart <= 2 * edits) & ((F.col("na") < F.col("nb")) | (F.col("ha") < F.col("hb")))
    pairs = stored(a.join(b, (a.key == b.key) & near).select("ha", "hb").where("ha <> hb").distinct())
    two = (
        pairs.join(texts.select(F.col("h").alias("ha"), F.col("line").alias("la")), "ha")
        .join(texts.select(F.col("h").alias("hb"), F.col("line").alias("lb")), "hb")
        .withColumns({"xa": unit.listed(F.col("la")), "xb": unit.listed(F.col("lb"))})
    )
    return fenced(two, banded_distance(F.col("xa"), F.col("xb"), edits) <= edits).select(F.col("ha").alias("src"), F.col("hb").alias("dst"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, by_words: bool = False) -> DataFrame:
    """(key, th, drop array<int>): for each document with some, the lines that a line before them repeats."""
    lines = _lines(docs, key, text).withColumn("h", F.xxhash64("line"))
    place = F.struct("key", "th", "pos")
    placed = stored(lines.select("h", "key", "th", "pos"))
    once = placed.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # Lines with more than 1 / HOT_SHARE of all places, HOT_SHARE at most, give entries at their first place alone.
    hot = stored(once.where(F.col("n") * HOT_SHARE > placed.count()).select(F.col("h").alias("hot"), "first"))
    some = lines.where(F.length("line") >= MIN_CHARS).join(F.broadcast(hot), lines.h == hot.hot, "left").where(F.col("hot").isNull() | place.eqNullSafe(F.col("first")))
    some = some.select("h", "line")
    if by_words:
        long = n_words(F.col("line")) >= LONG_WORDS
        links = near_line_links(some.where(~long), edits, CHARACTERS).union(near_line_links(some.where(long), edits, WORDS))
    else:
        links = near_line_links(some, edits, CHARACTERS)
    roots = connected_components(links)
    classed = once.join(roots, once.h == roots.node, "left").select("h", F.coalesce("root", "h").alias("root"), F.col("root").isNotNull().alias("linked"), "first", "n")
    least = classed.where("linked").groupBy("root").agg(F.min("first").alias("least"))
    keep = classed.join(least, "root", "left").where("linked or n > 1").select("h", F.coalesce("least", "first").alias("keep"))
    gone = placed.join(keep, "h").where(F.struct("key", "th", "pos") != F.col("keep"))
    return gone.groupBy("key", "th").agg(F.collect_set("pos").alias("drop"))


def _without_repeats(docs: DataFrame, key: str, text: str, edits: int, by_words: bool) -> tuple[DataFrame, str]:
    """docs with repeated lines taken out of the text, and one more column of the name given: the places of those lines, else null."""
    drop = repeated_lines(docs, key, text, edits, by_words).select(F.col("key").alias(k := fresh(docs, "_k")), F.col("th").alias(t := fresh(docs, "_t")), F.col("drop").alias(d := fresh(docs, "_d")))
    joined = docs.join(drop, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(t)), "left")
    p = fresh(docs, "_p")
    joined = joined.withColumn(p, F.when(F.col(d).isNotNull(), split_lines(F.col(text).cast("string"))))
    places = F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(d))
    left = F.array_join(F.transform(places, lambda i: F.get(F.col(p), i)), "\n")
    return joined.select(*[F.when(F.col(d).isNull(), F.col(text)).otherwise(left).alias(c) if c == text else F.col(c) for c in docs.columns], d), d


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, by_words: bool = False) -> DataFrame:
    """docs with repeated lines taken out of the text, and n_lines and n_removed as two more columns (with an underscore before a name that docs has)."""
    count = F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    counted = docs.withColumn(fresh(docs, "n_lines"), count.cast("bigint"))
    out, d = _without_repeats(counted, key, text, edits, by_words)
    return out.withColumn(fresh(docs, "n_removed"), F.coalesce(F.size(d), F.lit(0)).cast("bigint")).drop(d)


def filter_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", by_words: bool = False) -> DataFrame:
    """docs with repeated lines taken out; same rows, same columns, whatever these are called."""
    out, d = _without_repeats(docs, key, text, EDITS, by_words)
    return out.drop(d)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.crc32("text").alias("text_crc32"), F.length("text").cast("bigint").alias("n_chars"))
