"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased (A-Z) and their white space runs become one space. An item of n characters may be quoted with
k = n // CHARS_PER_ERROR edits; it is split into k + 1 pieces, one of which any such quotation holds unchanged. One
automaton finds all exact piece hits of a text; each hit opens a window of the text where the item could stand, and
Myers' bit-parallel distance, in integers as wide as the item, decides. A quotation that begins or ends within a word of
the text (between two letters or digits) has one more edit for it, so that short items match whole words alone.

Cases: null, empty and blank texts match nothing, nor does an item without a word; repeated items and rows each count;
null and repeated ids stay, and ids keep their type; texts are searched whole at any length; an empty table on either
side gives an empty result; extra columns are not looked at. The items go to the workers in blocks of BLOCK_BYTES at
most (one longer item is a block of its own), one pass over the texts a block; the driver holds one block at a time. Dropping is decided
row by row, on its text; items of fewer than LEAST_WORDS words are found but don't condemn a text.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import fresh, small_batches, stored

CHARS_PER_ERROR = 20
BLOCK_BYTES = 16 << 20
LEAST_WORDS = 3


def normalised(text: str) -> str:
    return b" ".join(text.encode("utf-8", "replace").lower().split()).decode()


def budget(item: str, chars_per_error: int = CHARS_PER_ERROR) -> int:
    return len(item) // chars_per_error


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Least edit distance of a pattern to any part of a text."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.ones = (1 << self.m) - 1
        self.top = 1 << (self.m - 1)
        self.peq: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.peq[c] |= 1 << i
        self.peq.default_factory = None

    def ends(self, text: str, k: int, anchored: bool = False) -> list[tuple[int, int]]:
        """(errors, end) of all ends of parts of the text with k errors at most; anchored: of parts that begin where the text does."""
        ones, top, peq, first = self.ones, self.top, self.peq, int(anchored)
        pv, mv, score, out = ones, 0, self.m, []
        for j, c in enumerate(text, 1):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & ones)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1) | first
            mh <<= 1
            pv = (mh | ~(xv | ph)) & ones
            mv = ph & xv & ones
            if score <= k:
                out.append((score, j))
        return out

    def search(self, text: str, k: int) -> tuple[int, int] | None:
        """(errors, end) of the first best match with k errors at most."""
        return min(self.ends(text, k), default=None)


def splits_word(text: str, at: int) -> bool:
    """Whether a place of a text is between two letters or digits."""
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


class Matcher:
    def __init__(self, items: list[tuple[int, str]], chars_per_error: int = CHARS_PER_ERROR):
        self.items = []
        at = defaultdict(list)
        for item_id, raw in items:
            if not (text := normalised(raw or "")):
                continue
            k = budget(text, chars_per_error)
            for start, piece in pieces(text, k):
                at[piece].append((len(self.items), start))
            self.items.append((item_id, text, k, Myers(text), Myers(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def matches(self, raw: str) -> list[tuple[int, int, int, int]]:
        """(item, errors, start, stop) of the best match of each item, places in the normalised text."""
        if not self.items or not (text := normalised(raw)):
            return []
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for end, (n, places) in self.automaton.iter(text):
            for i, start in places:
                _, item, k, _, _ = self.items[i]
                first = end - n + 1 - start  # where the item would begin without edits
                low, high = max(0, first - k), min(len(text), first + len(item) + k)
                own = windows[i]
                if own and low <= own[-1][1]:  # hits come in order of their ends, so that windows of one passage meet
                    own[-1][0], own[-1][1] = min(low, own[-1][0]), max(high, own[-1][1])
                else:
                    own.append([low, high])
        out = []
        for i, own in windows.items():
            best = None
            for low, high in own:
                best = min(filter(None, (best, self._best(i, text, low, high))), default=None)
                if best and not best[0]:
                    break
            if best:
                out.append((self.items[i][0], *best))
        return out

    def _best(self, i: int, text: str, low: int, high: int) -> tuple[int, int, int] | None:
        """(errors, start, stop) of the first best quotation of an item within a window."""
        _, item, k, myers, reverse = self.items[i]
        best = None
        for score, end in sorted(myers.ends(text[low:high], k)):
            if best and score >= best[0]:
                break
            stop = low + end
            right = score + splits_word(text, stop)
            if right > k or (best and right >= best[0]):
                continue
            # Where the parts begin that end here, from the item read backwards.
            back = text[max(0, stop - len(item) - k) : stop][::-1]
            for errors, n in reverse.ends(back, k, True):
                total = errors + splits_word(text, stop - n) + (right - score)
                if total <= k and (best is None or (total, stop - n, stop) < best):
                    best = (total, stop - n, stop)
        return best


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """items(item, s) in blocks of bounded size, fetched one partition at a time."""
    held, n = [], 0
    for item_id, raw in items.toLocalIterator():
        size = 64 + len(raw or "")
        if held and n + size > block_bytes:
            yield held
            held, n = [], 0
        held.append((item_id, raw))
        n += size
    if held:
        yield held


def benchmark_matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    chars_per_error: int = CHARS_PER_ERROR, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """key, item_key, errors, start, stop: one row for each text and item that it quotes, places in the normalised text."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("s"))
    wanted = items.select(F.col(item_key).alias("item"), F.col(item_text).cast("string").alias("s"))
    ddl = f"key {slim.schema['key'].dataType.simpleString()}, item {wanted.schema['item'].dataType.simpleString()}, errors int, start bigint, stop bigint"

    def matches_of(block: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(pickle.dumps(block))
        kinds = [pa.int32(), pa.int64(), pa.int64()]

        def run(batches):
            matcher = Matcher(pickle.loads(sent.value), chars_per_error)
            for batch in batches:
                found = [(at, *m) for at, t in enumerate(batch.column(1)) if t.is_valid for m in matcher.matches(t.as_py())]
                at, item, *places = zip(*found, strict=True) if found else [[]] * 5
                keys = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(item, kind_of_item), *map(pa.array, places, kinds)], names=["key", "item", "errors", "start", "stop"])

        return slim.mapInArrow(run, ddl)

    from pyspark.sql.pandas.types import to_arrow_type

    kind_of_item = to_arrow_type(wanted.schema["item"].dataType)
    blocks = _blocks(wanted, block_bytes)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        out = spark.createDataFrame([], ddl)
    elif following is None:
        out = matches_of(block)
    else:  # one pass after the other
        out = stored(matches_of(block))
        while following is not None:
            out, following = out.unionByName(stored(matches_of(following))), next(blocks, None)
    return out.select(F.col("key").alias(key), F.col("item").alias(item_key), "errors", "start", "stop")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs that quote no item of least_words words or more, with the columns of docs."""
    long = items.where(F.size(F.split(F.trim(F.col(item_text).cast("string")), r"\s+")) >= least_words).select(F.monotonically_increasing_id().alias("n"), F.col(item_text).alias("s"))
    named = docs.select(F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).alias("t"))
    hit = benchmark_matches(named, long, "th", "t", "n", "s").select(F.col("th").alias(name := fresh(docs, "hit"))).distinct()
    return docs.join(hit, F.xxhash64(F.col(text).cast("string")) == F.col(name), "left_anti")


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
