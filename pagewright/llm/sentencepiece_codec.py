"""SentencePiece encoding and decoding by a lattice of pieces.

A text becomes units: a run of word marks with what follows it, or a line break; no piece of more than one character
crosses such a border, so that units are encoded each for itself. A unit's lattice has an edge for each substring, of bounded
length, that the piece table holds; the edges are grouped by unit and folded into the unit's pieces.

viterbi_units() does this relationally, for a table of units of a unigram model: substrings are exploded, equi-joined to
the piece table (broadcast: a model has MAX_PIECES pieces at most), grouped by unit and folded by Viterbi in a
higher-order aggregate. The public vocabulary at hand is a merge (BPE) model, for which Viterbi over its scores doesn't
give the library's result; there the fold merges the best-scored adjacent pair, which is an edge of the lattice, until
none is left, with a heap. encode() takes whole texts and does all of it in the task that read them, nothing is shuffled
or written: the join is a look-up in the worker's copy of the piece table, and units that a worker has seen are kept, in
a table of bounded size. (Exploded and joined by the engine, the units of a task cost over three times the time limit.)
Characters without a piece become byte pieces.

Cases: null and empty texts have no pieces; white space is kept as it is; repeated rows stay, null and repeated keys
too, and a key keeps its type; a unit of any length is folded in one way, in n log n steps; an empty table gives an empty
result; extra columns are not looked at. Decoding turns ids back into text, byte pieces included; it restores every text
but a literal U+2581, which the library, too, gives back as a space.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import small_batches
from pagewright.llm.token_counts import tokenizer_path

MODEL_FILE = "piece_bpe_32k.model"
MARK = "▁"
MAX_PIECES = 1_000_000
STRETCH = 64
#: A worker keeps so many different units, or so many of their characters, at a time.
KEPT_UNITS, KEPT_CHARS = 1_000_000, 24 << 20
_UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Pieces:
    """A piece table: (piece, id, score) of normal pieces, ids of the byte pieces, and each id's bytes."""

    rows: tuple[tuple[str, int, float], ...]
    bytes_from: int
    by_id: tuple[bytes, ...]

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.rows), default=1)


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if len(sp) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    rows, by_id, first = [], [], None
    for i in range(len(sp)):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            first = i if first is None else first
            by_id.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            by_id.append(b"")
        else:
            rows.append((piece, i, float(sp.get_score(i))))
            by_id.append(piece.replace(MARK, " ").encode())
    if first is None:
        raise ValueError("a model without byte pieces")
    for piece, _, _ in rows:
        if MARK in piece.lstrip(MARK) or ("\n" in piece and len(piece) > 1):
            raise ValueError(f"piece {piece!r} crosses a border of units")
    return Pieces(tuple(rows), first, tuple(by_id))


def merged(unit: str, table: dict[str, tuple[int, float]]) -> list[int]:
    """Borders of a unit's symbols after all merges: least loss first, then leftmost. table: (id, loss) by substring.

    Of the lattice, only edges that join two symbols are looked up."""
    n = len(unit)
    end = list(range(1, n + 2))  # of the symbol that starts here; 0 once it is merged into another
    before = list(range(-1, n))  # start of the symbol before
    got, push = table.get, heapq.heappush
    heap = [(f[1], i, i + 2) for i in range(n - 1) if (f := got(unit[i : i + 2]))]
    heapq.heapify(heap)
    while heap:
        _, i, k = heapq.heappop(heap)
        j = end[i]
        if j >= k or not j or end[j] != k:  # the pair has changed since it was pushed
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
            e = end[k]
            if f := got(unit[i:e]):
                push(heap, (f[1], i, e))
        h = before[i]
        if h >= 0 and (f := got(unit[h:k])):
            push(heap, (f[1], h, k))
    borders, i = [0], 0
    while i < n:
        i = end[i]
        borders.append(i)
    return borders


def best_path(unit: str, table: dict[str, tuple[int, float]], longest: int) -> list[int]:
    """Borders of the path of least loss through a unit's lattice; a character without a piece costs UNKNOWN_PENALTY above the greatest."""
    n = len(unit)
    into = [[(f[1], s) for s in range(max(0, e - longest), e) if (f := table.get(unit[s:e]))] for e in range(n + 1)]
    high = max((loss for edges in into for loss, _ in edges), default=0.0) + UNKNOWN_PENALTY
    total, back = [0.0] * (n + 1), [0] * (n + 1)
    for e in range(1, n + 1):
        options = into[e]
        if all(s != e - 1 for _, s in options):
            options = [*options, (high, e - 1)]
        total[e], last = min((total[s] + loss, -s) for loss, s in options)
        back[e] = -last
    borders = [n]
    while borders[-1]:
        borders.append(back[borders[-1]])
    return borders[::-1]


class Codes(dict):
    """unit -> its ids as bytes of int32, filled as units are asked for."""

    def __init__(self, pieces: Pieces, kind: str):
        super().__init__()
        self.pieces, self.kind, self.longest = pieces, kind, pieces.longest
        self.table = {piece: (i, -score) for piece, i, score in pieces.rows}
        self.chars = 0
        self.lossy: set[str] = set()  # units that don't come back from their ids

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= KEPT_UNITS or self.chars > KEPT_CHARS:
            self.clear()
            self.lossy.clear()
            self.chars = 0
        ids = self.ids(unit)
        if b"".join(map(self.pieces.by_id.__getitem__, ids)) != unit.replace(MARK, " ").encode():
            self.lossy.add(unit)
        self[unit] = found = array("i", ids).tobytes()
        self.chars += len(unit)
        return found

    def ids(self, unit: str) -> list[int]:
        got = self.table.get
        cut = merged(unit, self.table) if self.kind == "bpe" else best_path(unit, self.table, self.longest)
        out = []
        for a, b in zip(cut, cut[1:], strict=False):
            if found := got(unit[a:b]):
                out.append(found[0])
            else:
                out += [self.pieces.bytes_from + x for x in unit[a:b].encode()]
        return out


@lru_cache(maxsize=2)
def _codes(path: str, kind: str) -> Codes:
    return Codes(load_pieces(path), kind)


def _encoded(batch: pa.RecordBatch, codes: Codes, most: int = 256) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, most):
        part = batch.slice(a, most)
        lists, ok = [], []
        for s in part.column(1).to_pylist():
            found = _UNITS.findall(MARK + s.replace(" ", MARK)) if s else []
            lists.append(b"".join(map(codes.__getitem__, found)))
            ok.append(not s or (MARK not in s and (not codes.lossy or codes.lossy.isdisjoint(found))))
        sizes = np.array([len(x) // 4 for x in lists], dtype=np.int64)
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        values = pa.array(np.frombuffer(b"".join(lists), dtype="<i4"), pa.int32())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.ListArray.from_arrays(ends, values), pa.array(ok, pa.bool_())], names=["k", "n", "ids", "ok"])


def decode_ids(ids: list[int] | np.ndarray, by_id: tuple[bytes, ...]) -> str:
    """Text of a list of ids, without the first word mark."""
    raw = b"".join(map(by_id.__getitem__, ids))
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, kind: str = "bpe") -> DataFrame:
    """key, n_tokens, ids, round_trip of every row. round_trip: decoding the ids gives the text again.

    kind: bpe for merge models, unigram for models that Viterbi decodes."""
    path = path or tokenizer_path(MODEL_FILE)
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches):
        codes = _codes(path, kind)
        for batch in batches:
            yield from _encoded(batch, codes)

    done = slim.mapInArrow(run, f"k {slim.schema['k'].dataType.simpleString()}, n bigint, ids array<int>, ok boolean")
    return done.select(F.col("k").alias(key), F.col("n").alias("n_tokens"), "ids", F.col("ok").alias("round_trip"))


def decode(encoded: DataFrame, ids: str = "ids", into: str = "text", path: str | None = None) -> DataFrame:
    """encoded with one more column, the text of its ids (null for null)."""
    path = path or tokenizer_path(MODEL_FILE)
    by_id = encoded.sparkSession.sparkContext.broadcast(load_pieces(path).by_id)

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        return pa.array([None if v is None else decode_ids(v, by_id.value) for v in lists.to_pylist()], pa.string())

    return encoded.withColumn(into, text_of(F.col(ids)))


def lattice(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """rows with a column chunk to one row for each place s and length l of a chunk whose substring is a piece, or one character.

    New columns: s, l, id and score (null without a piece). The places of a chunk are its first STRETCH."""
    table = rows.sparkSession.createDataFrame(list(pieces.rows), "piece string, id int, score double")
    n = F.length("chunk")
    starts = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.least(n, F.lit(STRETCH)) - 1)))
    subs = starts.withColumn("l", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("s")))))
    subs = subs.withColumn("sub", F.substring("chunk", F.col("s") + 1, F.col("l")))
    return subs.join(F.broadcast(table), F.col("sub") == F.col("piece"), "left").where("id is not null or l = 1").drop("sub", "piece")


def fold_viterbi(unit: Column, edges: Column) -> Column:
    """Borders of the best-scored path; a character without a piece costs UNKNOWN_PENALTY below the least score."""
    n = F.length(unit)
    low = F.coalesce(F.array_min(F.transform(edges, lambda x: x.score)), F.lit(0.0)) - UNKNOWN_PENALTY

    def step(acc: Column, e: Column) -> Column:
        here = F.transform(
            F.filter(edges, lambda x: x.s + x.l == e), lambda x: F.struct((F.get(acc, x.s).score + x.score).alias("score"), x.s.alias("back"))
        )
        # An unknown character is a path of its own only where no piece ends it.
        alone = F.struct((F.get(acc, e - 1).score + low).alias("score"), (e - 1).alias("back"))
        known = F.exists(edges, lambda x: (x.s == e - 1) & (x.l == 1))
        all_here = F.when(known, here).otherwise(F.concat(here, F.array(alone)))
        return F.concat(acc, F.array(F.array_max(all_here)))

    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("back")))
    best = F.aggregate(F.sequence(F.lit(1), n), zero, step)
    return F.get(
        F.transform(
            F.array(best),
            lambda path: F.aggregate(
                F.sequence(F.lit(1), n),
                F.array(n),
                lambda acc, _: F.when(F.get(acc, F.lit(0)) > 0, F.concat(F.array(F.get(path, F.get(acc, F.lit(0))).back), acc)).otherwise(acc),
            ),
        ),
        0,
    )


def _bytes_of(char: Column, first: int) -> Column:
    """Ids of the byte pieces of a character."""
    digits = F.hex(char.cast("binary"))
    return F.transform(F.sequence(F.lit(1), F.octet_length(char)), lambda k: F.conv(F.substring(digits, 2 * k - 1, F.lit(2)), 16, 10).cast("int") + first)


def viterbi_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """units(unit), different ones, to (unit, ids) of a unigram model: the lattice, grouped by unit, in a higher-order fold."""
    n = F.length("unit")
    parts = units.where(n > 0).select("unit", F.explode(F.sequence(F.lit(0), n - 1, F.lit(STRETCH))).alias("base"))
    parts = parts.withColumn("chunk", F.substring("unit", F.col("base") + 1, F.lit(STRETCH + pieces.longest - 1)))
    found = lattice(parts, pieces).withColumn("edge", F.when(F.col("id").isNotNull(), F.struct((F.col("base") + F.col("s")).alias("s"), "l", "score", "id")))
    lat = found.groupBy("unit").agg(F.collect_list("edge").alias("edges"))
    lat = lat.withColumn("b", fold_viterbi(F.col("unit"), F.col("edges")))

    def code(i: Column) -> Column:
        s, e = F.get("b", i), F.get("b", i + 1)
        known = F.filter("edges", lambda x: (x.s == s) & (x.s + x.l == e))
        return F.when(F.size(known) > 0, F.array(F.get(known, F.lit(0)).id)).otherwise(_bytes_of(F.substring("unit", s + 1, F.lit(1)), pieces.bytes_from))

    return lat.select("unit", F.flatten(F.transform(F.sequence(F.lit(0), F.size("b") - 2), code)).alias("ids"))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
