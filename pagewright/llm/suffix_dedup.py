"""Repeated passages by prefix doubling over synchronised positions, a reduced form of a distributed suffix array.

A rank of a position at a length stands for the string of that length that starts there. Doubling joins the ranks of
two positions at a growing offset into the rank at the sum: 8, 16, 25 and at last 50 bytes, the threshold. Up to 8 bytes
a string is its own rank.
Full prefix doubling keeps one (rank, rank) row a position at each length; one such row a byte is some 30 times the
input before the first sort. So ranks are named by 64-bit hashes of rank pairs instead of places in one global order: a document
computes its own rank pairs, and Spark sorts or groups equal ones where two documents have to meet. Positions drop out as soon
as their rank is found in one document only:

1. at 25 bytes, for synchronised positions alone: any 50-byte string holds 26 strings of 25 bytes, and the least rank
   among them depends on the string only. Runs of neighbouring 50-byte strings with the same least rank are one item.
   Ranks are sorted and compared with their neighbours; those that two documents share go back to their documents.
2. runs whose rank is shared go on with the rank of the whole run (both its outer 50-byte ranks and its length): a run
   that stands in an earlier document as it is goes altogether.
3. first runs whose 25-byte rank has different surroundings elsewhere go on to the ranks of each 50-byte string.

Equal strings get equal ranks, so nothing is missed. A wrong match needs two 64-bit ranks to collide at once, or, for
rows of one id, 32 bits of their texts' hashes. All selection is by equi-joins, whatever the table's size.

Cases: a null text is empty; a null id neither loses bytes nor takes them from others; rows with equal ids don't take
from each other; texts of any length are read in blocks that overlap; an empty table gives an empty result; extra
columns are not looked at. Grouping is by partial aggregation and skew-split joins, a document's lists are its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import discard, settings, small_batches, stored

THRESHOLD = 50
HALF = 25
BLOCK = 1 << 18
PIECE = 1 << 14  # positions that are ranked at once, so that the steps between stay in a core's cache
LONGEST_RUN = 50
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_S31, _S33, _S29, _S32 = np.uint64(31), np.uint64(33), np.uint64(29), np.uint64(32)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of a rank pair."""
    x = b * _C2
    y = x >> _S33
    x <<= _S31
    x |= y
    np.multiply(a, _C1, out=y)
    x += y
    np.right_shift(x, _S29, out=y)
    x ^= y
    x *= _C3
    np.right_shift(x, _S32, out=y)
    x ^= y
    return x


def ranks(data: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Ranks at HALF bytes and, if last, at THRESHOLD bytes, of all positions of data that have so many."""
    half = np.empty(max(0, len(data) - HALF + 1), np.uint64)
    for k in range(0, len(half), PIECE):
        piece = data[k : k + PIECE + HALF - 1]
        eight = np.ndarray((len(piece) - 7,), "<u8", piece, strides=(1,)).copy()  # the bytes themselves, as a number
        r = _pair(eight[:-8], eight[8:])
        half[k : k + PIECE] = _pair(r[:-9], r[9:])  # 16 bytes here and 16 bytes at offset 9
    if not last:
        return half, None
    whole = np.empty(max(0, len(half) - HALF), np.uint64)
    for k in range(0, len(whole), PIECE):
        end = min(k + PIECE, len(whole))
        whole[k:end] = _pair(half[k:end], half[k + HALF : end + HALF])
    return half, whole


def _least(half: np.ndarray) -> np.ndarray:
    """The least of the 26 ranks inside each string of THRESHOLD bytes."""
    least = np.empty(max(0, len(half) - HALF), np.uint64)
    for k in range(0, len(least), PIECE):
        m = half[k : k + PIECE + HALF]
        for offset in (1, 2, 4, 8):
            m = np.minimum(m[:-offset], m[offset:])
        np.minimum(m[:-10], m[10:], out=least[k : k + PIECE])
    return least


class Runs:
    """Runs of a stretch of several documents: least rank, document, first place and number of strings."""

    def __init__(self, parts: list[tuple[int, int, int, bytes]], last: bool, lists: list[np.ndarray]):
        self.listed = lists[0] if len(lists) == 1 else np.sort(np.concatenate([np.empty(0, np.int64), *lists]))
        data = np.frombuffer(b"".join(p[3] for p in parts), dtype=np.uint8)
        sizes = np.array([len(p[3]) for p in parts])
        ends = np.cumsum(sizes)
        self.empty = len(data) < THRESHOLD
        if self.empty:
            return
        half, self.whole = ranks(data, last)
        least = _least(half)
        fits = np.ones(len(data), dtype=bool)
        for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
            fits[max(0, end - min(size, THRESHOLD - 1)) : end] = False
        at = np.flatnonzero(fits[: len(least)])
        self.empty = not len(at)
        if self.empty:
            return
        part = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[at]
        least = least[at]
        new = np.flatnonzero((least[1:] != least[:-1]) | (part[1:] != part[:-1])) + 1
        new = np.concatenate(([0], new))
        count = np.diff(np.concatenate((new, [len(at)])))
        if count.max() > LONGEST_RUN:  # so that the two outer ranks of a run cover it
            more = -(-count // LONGEST_RUN)
            k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            new, count = np.repeat(new, more) + k * LONGEST_RUN, np.minimum(np.repeat(count, more) - k * LONGEST_RUN, LONGEST_RUN)
        self.at, self.count, self.rank = at[new], count, least[new]
        owner = part[new]
        self.doc = np.array([p[0] for p in parts], dtype=np.int64)[owner]
        self.row = np.array([p[1] for p in parts], dtype=np.int64)[owner]
        base = np.array([p[2] for p in parts], dtype=np.int64) - (ends - sizes)
        self.start = self.at + base[owner]

    def is_listed(self) -> np.ndarray:
        rank = self.rank.view(np.int64)
        at = np.searchsorted(self.listed, rank)
        return (at < len(self.listed)) & (self.listed[np.minimum(at, len(self.listed) - 1)] == rank) if len(self.listed) else np.zeros(len(rank), bool)

    def around(self) -> np.ndarray:
        """Rank of the whole run."""
        return _pair(self.whole[self.at], self.whole[self.at + self.count - 1]) + self.count.astype(np.uint64) * _C1


def _stretches(batches, last: bool) -> Iterator[Runs]:
    """Batches of (key, row, bytes) as runs, a bounded number of bytes at a time; long texts in blocks that overlap.

    A fourth column, lists of ranks, goes along: whether a rank is listed doesn't depend on the document."""
    parts, lists, held = [], [], 0
    for batch in batches:
        ranks_of = _lists(batch.column(3)) if batch.num_columns > 3 else None
        for i, (key, row, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
            text = raw.as_py() if key is not None and raw.is_valid else b""
            for start in range(0, max(0, len(text) - THRESHOLD + 1), BLOCK):
                piece = text[start : start + BLOCK + THRESHOLD - 1]
                parts.append((key, row, start, piece))
                if ranks_of is not None:
                    lists.append(ranks_of[i])
                held += len(piece)
                if held >= BLOCK:
                    if not (runs := Runs(parts, last, lists)).empty:
                        yield runs
                    parts, lists, held = [], [], 0
    if parts and not (runs := Runs(parts, last, lists)).empty:
        yield runs


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of lists of bigint, none of them null, each in rising order."""
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy())))
    values = column.flatten().to_numpy()
    return [np.sort(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _strings(batches, most: int = 8192) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of (key, row, bytes, places) to (doc, row, start, rank) of each string of THRESHOLD bytes in the runs at these places."""
    for batch in batches:
        docs, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        raw = batch.column(2).cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], "<i8")[raw.offset :]
        data = np.frombuffer(raw.buffers()[2], np.uint8)
        places = batch.column(3).flatten().to_numpy()
        owner = np.repeat(np.arange(len(docs)), pc.list_value_length(batch.column(3)).to_numpy())
        for low in range(0, len(places), most):
            mine = owner[low : low + most]
            start, count = places[low : low + most] >> 6, places[low : low + most] & 63
            # The runs' bytes one after the other; each run's strings begin at its first `count` bytes.
            size = count + THRESHOLD - 1
            first = np.cumsum(size) - size
            whole = ranks(data[np.repeat(ends[mine] + start - first, size) + np.arange(size.sum())], True)[1]
            run = np.repeat(np.arange(len(mine)), count)
            at = np.arange(len(run)) + (first - (np.cumsum(count) - count))[run]
            yield docs[mine][run], rows[mine][run], (start - first)[run] + at, whole[at]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _rows(columns: list, schema: pa.Schema, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([_signed(c[k : k + most]) for c in columns], schema=schema)


def _schema(*names: str) -> tuple[pa.Schema, str]:
    return pa.schema([(n, pa.int64()) for n in names]), ", ".join(f"{n} bigint" for n in names)


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, row (32 bits of the text's hash, by which rows of one id are told apart), both in one number, and the text's bytes."""
    raw = F.col(text).cast("binary")
    row = F.xxhash64(raw).bitwiseAND(F.lit((1 << 32) - 1))
    return docs.select(F.col(key).cast("bigint").alias("key"), row.alias("row"), F.xxhash64(F.col(key).cast("bigint"), row).alias("node"), raw.alias("raw")).where("key is not null and raw is not null")


def _with_lists(slim: DataFrame, lists: DataFrame) -> DataFrame:
    """The texts that lists(of, a) names, each beside its list. Texts that it doesn't name are left out."""
    return slim.join(lists, slim.node == lists.of).select("key", "row", "raw", "a")


def _gathered(rows: DataFrame, column: str) -> DataFrame:
    """rows(node, ...) to (of, a), the list of a column's values for each node, stored. Lists are short: no sort before it has to be."""
    with settings(rows.sparkSession, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000"}):
        return stored(rows.select(F.col("node").alias("of"), column).repartition("of").groupBy("of").agg(F.collect_list(column).alias("a")))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row, start, n): bytes that 50-byte strings of earlier documents cover; spans may overlap.

    row is a hash of the text: rows with equal ids are told apart by it."""
    small_batches(docs.sparkSession)
    slim = _slim(docs, key, text)

    schema1, ddl1 = _schema("rank", "node", "known")

    def first(batches):
        for runs in _stretches(batches, False):
            # runs.row is the node here
            order = np.argsort(runs.rank)
            rank, node = runs.rank[order], runs.row[order]
            same = rank[1:] == rank[:-1]
            again = np.concatenate((same, [False])) | np.concatenate(([False], same))
            yield from _rows([rank[~again], node[~again], np.zeros(len(rank) - again.sum(), np.int64)], schema1)
            rank, node = rank[again], node[again]
            if not len(rank):
                continue
            order = np.lexsort((node, rank))
            rank, node = rank[order], node[order]
            new = np.concatenate(([True], (rank[1:] != rank[:-1]) | (node[1:] != node[:-1])))
            rank, node = rank[new], node[new]
            begins = np.concatenate(([True], rank[1:] != rank[:-1]))
            ends = np.concatenate((begins[1:], [True]))
            # A rank that two documents of this stretch share needs no more proof: all its rows are known, and two of
            # them, whatever their number, stand for the stretch where ranks meet.
            known = ~(begins & ends)
            asked = begins | ends
            yield from _rows([rank[asked], node[asked], np.zeros(asked.sum(), np.int64)], schema1)
            yield from _rows([rank[known], node[known], np.ones(known.sum(), np.int64)], schema1)

    schema_met, ddl_met = _schema("rank", "node")

    def meet(batches):
        """Of rows in the order of their ranks: those whose rank another node has as well, and the known ones."""
        # The last rank so far may go on: one row of it, or its least and greatest node, and whether they were given.
        rank, node, given = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, node = np.concatenate((rank, batch.column(0).to_numpy())), np.concatenate((node, batch.column(1).to_numpy()))
            known = np.concatenate((np.zeros(len(given), bool), batch.column(2).to_numpy() == 1))
            given = np.concatenate((given, np.zeros(batch.num_rows, bool)))
            begin = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
            shared = np.minimum.reduceat(node, begin) < np.maximum.reduceat(node, begin)
            keep = (np.repeat(shared, np.diff(np.concatenate((begin, [len(rank)])))) | known) & ~given
            yield from _rows([rank[keep], node[keep]], schema_met)
            given |= keep
            tail = node[begin[-1] :]
            held = begin[-1] + (np.array([tail.argmin(), tail.argmax()]) if shared[-1] else given[begin[-1] :].argmax(keepdims=True))
            rank, node, given = rank[held], node[held], given[held]

    # 25 bytes: ranks in one document only drop out; the others go back to their documents. Known rows are spread by node.
    half = slim.select("key", "node", "raw").mapInArrow(first, ddl1).repartition("rank", F.when(F.col("known") == 1, F.col("node")))
    mine = _gathered(half.sortWithinPartitions("rank").mapInArrow(meet, ddl_met), "rank")

    schema2, ddl2 = _schema("rank", "around", "doc", "row", "place")

    def second(batches):
        for runs in _stretches(batches, True):
            keep = runs.is_listed()
            around = runs.around()
            yield from _rows([runs.rank[keep], around[keep], runs.doc[keep], runs.row[keep], (runs.start * 64 + runs.count)[keep]], schema2)

    # Whole runs: one that an earlier document has, too, goes altogether. Of ranks with different surroundings in
    # different documents, the first runs are compared string by string.
    runs = stored(_with_lists(slim, mine).mapInArrow(second, ddl2))
    discard(mine)
    least = stored(runs.groupBy("rank", "around").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")))
    mixed = least.groupBy("rank").agg(F.min("around").alias("a"), F.max("around").alias("b"), F.min("lo").alias("least"), F.max("lo").alias("most")).where("a <> b and least < most")
    marked = least.join(mixed.select("rank", F.lit(True).alias("mixed")), "rank", "left").where("mixed or lo < hi")
    found = runs.join(marked, ["rank", "around"]).where("doc > lo or mixed")
    found = stored(found.select("doc", "row", "place", (F.col("doc") > F.col("lo")).alias("whole")))
    discard(runs)
    discard(least)
    whole = found.where("whole").select("doc", "row", F.shiftright("place", 6).alias("start"), (F.col("place") % 64 + THRESHOLD - 1).alias("n"))
    places = _gathered(found.where("not whole").withColumn("node", F.xxhash64("doc", "row")), "place")

    schema3, ddl3 = _schema("string", "doc", "place")

    def third(batches):
        for doc, row, start, string in _strings(batches):
            yield from _rows([string, doc, (row << 31) | start], schema3)

    strings = stored(_with_lists(slim, places).mapInArrow(third, ddl3))
    discard(places)
    first_at = stored(strings.groupBy("string").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("string", "lo"))
    later = strings.join(first_at, "string").where("doc > lo")
    single = stored(later.select("doc", F.shiftrightunsigned("place", 31).alias("row"), F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).alias("start"), F.lit(THRESHOLD).cast("bigint").alias("n")))
    discard(strings)
    discard(first_at)
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes) of every row."""
    spans = repeated_spans(docs, key, text)
    with settings(docs.sparkSession, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000"}):
        spans = stored(spans.groupBy("doc", F.col("row").alias("own")).agg(F.collect_list("start").alias("a"), F.collect_list("n").alias("n")))
    raw = F.col(text).cast("binary")
    own = docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(raw).bitwiseAND(F.lit((1 << 32) - 1)).alias("row"), raw.alias("raw"))
    joined = own.join(spans, (own.key == spans.doc) & (own.row == spans.own), "left").select("key", "raw", "a", "n")
    fields = [("k", pa.int64()), ("b", pa.int64()), ("r", pa.int64()), ("s", pa.int64()), ("h", pa.string())] + [("kept", pa.binary())] * with_text
    schema = pa.schema(fields)

    def finish(batches):
        for batch in batches:
            out = []
            for k, raw, a, n in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = raw.as_py() if raw.is_valid else b""
                removed = spans = 0
                kept = data
                if a.is_valid:
                    start = a.values.to_numpy()
                    edge = np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(edge, start, 1)
                    np.subtract.at(edge, start + n.values.to_numpy(), 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                out.append((k.as_py(), len(data), removed, spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    ddl = "k bigint, b bigint, r bigint, s bigint, h string" + ", kept binary" * with_text
    done = joined.mapInArrow(finish, ddl)
    return done.select(
        F.col("k").alias(key), F.col("b").alias("n_bytes"), F.col("r").alias("n_removed"), F.col("s").alias("n_spans"), F.col("h").alias("kept_sha256"),
        *["kept"] * with_text,
    )


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
