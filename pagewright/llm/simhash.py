"""SimHash near-duplicates by multi-index hashing.

Fingerprint: 64 majority bits over the XXH64 (seed 42) of a text's word shingles, repeats included. Linking: a
fingerprint is two 32-bit segments; it enumerates the Hamming ball of radius 1 within each segment and puts itself into
the table at every such address, the other segment kept. An address is thus a segment's neighbour together with the
whole other segment, and not the segment alone: all fingerprints that share one segment would be one key, and their
pairs grow with its square. Two fingerprints meet at an address if and only if they differ in two bits or fewer, so that
the matches fetched there are complete, an address holds 65 fingerprints at most, and a group of any size costs 65 rows
for each different fingerprint. Each match is checked by its complete distance to the least fingerprint at the address;
these links keep every component.

Cases: null and empty texts (or white space only) have fingerprint 0 and are linked like any other; fewer words than a
shingle give one shingle; repeated rows stay repeated rows; a null doc_id keeps its row and never names a component
unless all of it is null; ids keep their type; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import fresh, small_batches, stored
from pagewright.llm.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_WORDS_AT_ONCE = 65536
_HASHES_AT_ONCE = 400_000


def shingle_hashes(raw: bytes, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a lower-cased text, in blocks of bounded size."""
    rest, carried = raw.lower(), []
    first = True
    while True:
        found = rest.split(None, _WORDS_AT_ONCE)
        rest = found.pop() if len(found) > _WORDS_AT_ONCE else b""
        found = carried + found
        if len(found) < size:
            if first and found and not rest.strip():
                yield np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], dtype=np.uint64)
            if not rest:
                return
            carried = found
            continue
        joined = map(b" ".join, zip(*(found[k:] for k in range(size)), strict=False))
        n = len(found) - size + 1
        yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED, n)), dtype=np.uint64, count=n)
        first, carried = False, found[len(found) - size + 1 :] if size > 1 else []
        if not rest:
            return


def _histograms(hashes: list[np.ndarray], owner: list[int], n: int) -> np.ndarray:
    """Set bits by document: (n, 64), bit 0 first."""
    h = np.concatenate(hashes).astype("<u8")
    base = np.repeat(np.array(owner, dtype=np.int64) * 256, [len(x) for x in hashes])
    by_byte = h.view(np.uint8).reshape(-1, 8)
    out = np.empty((n, 64))
    for k in range(8):
        out[:, 8 * k : 8 * k + 8] = np.bincount(base + by_byte[:, k], minlength=n * 256).reshape(n, 256) @ _BITS
    return out


def fingerprints_of(texts: list[bytes | None], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprints as uint64."""
    return fingerprints_from([shingle_hashes(raw or b"", size) for raw in texts])


def fingerprints_from(blocks_of: list[Iterable[np.ndarray]]) -> np.ndarray:
    """Fingerprints as uint64, from each text's hashes in blocks."""
    counts, totals = np.zeros((len(blocks_of), 64)), np.zeros(len(blocks_of))
    held: list[np.ndarray] = []
    owner: list[int] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if held:
            low, high = owner[0], owner[-1] + 1
            counts[low:high] += _histograms(held, [o - low for o in owner], high - low)
            held.clear()
            owner.clear()
            waiting = 0

    for i, blocks in enumerate(blocks_of):
        for block in blocks:
            held.append(block)
            owner.append(i)
            totals[i] += len(block)
            waiting += len(block)
            if waiting >= _HASHES_AT_ONCE or i - owner[0] >= 400:
                flush()
    flush()
    bits = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp bigint) of every row; key keeps its type."""

    def run(batches):
        for batch in batches:
            got = fingerprints_of(batch.column(1).to_pylist(), shingle_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["key", "fp"])

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("raw"))
    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, fp bigint")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """fps(fp), different values, to links (src, dst) between fingerprints at MAX_DISTANCE or less."""
    from pyspark.sql import Window

    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint") for b in range(64)])
    table = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("address"))
    met = table.withColumn("hub", F.min("fp").over(Window.partitionBy("address")))
    return (
        met.where("fp <> hub")
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= MAX_DISTANCE)
        .select(F.col("fp").alias("src"), F.col("hub").alias("dst"))
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: key, fingerprint (16 hexadecimal digits), component_id (least key reachable)."""
    marked = stored(fingerprint(docs, key, text, shingle_words))
    nodes = stored(marked.groupBy("fp").agg(F.min("key").alias("least")))
    roots = connected_components(fingerprint_links(nodes.select("fp")))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = placed.join(ids, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of docs whose key is the least of its component; a repeated key keeps its rows, rows without key stay."""
    found = near_duplicates(docs, key, text, shingle_words)
    name = fresh(docs, "kept_key")
    kept = found.where(F.col(key) == F.col("component_id")).select(F.col(key).alias(name)).distinct()
    return docs.where(F.col(key).isNotNull()).join(kept, F.col(key) == F.col(name), "left_semi").unionByName(docs.where(F.col(key).isNull()))


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
