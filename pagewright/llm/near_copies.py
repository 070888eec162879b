"""Near copies by SimHash, completed: all groups of texts whose shingle sets have a Jaccard similarity of 4/5 or more.

A set is the XXH64 (seed 42) of a lower-cased text's shingles of SHINGLE_WORDS words. Texts with the same set are one
node. A node's fingerprint is the SimHash of its set; fingerprints at two bits or fewer are found by multi-index hashing
(`simhash.fingerprint_links`), and the pairs they name are verified by their whole sets. What SimHash links needs no other
way; sets at 4/5 can differ in more bits, though, and nodes still apart go on as follows. In a fixed order of the hashes, the first n - ceil(4n/5) + t of a set's n hashes are its prefix, t = n / SHARE; the
prefixes of two sets at 4/5 or more have at least as many hashes in common as the lesser t says, so other pairs can't
match, nor can pairs in which too few hashes follow the first one they share, nor those whose parity maps (BITS bits, each
hash of a set turns one over) differ in more bits than sets at 4/5 have different hashes. Pairs that may, with sizes
within 4/5, are verified by their whole sets.

Groups are needed, not pairs. At first one node of each hash meets all others there, the one with the fewest hashes before
it, then another, STARS times as long as that finds anything; then only nodes that still are in different groups meet pair
by pair, which misses none. So a large group of near copies costs rows in proportion to its size.

The order is by hash, but hashes at more than COMMON nodes come last, MAX_COMMON of them at most, so that passages many
texts share seldom make candidates; any order gives the same groups.

Cases: null, empty and blank texts have the empty set and are copies of each other; fewer words than a shingle give one
shingle; repeated rows stay repeated rows; a null doc_id keeps its row, links others, and names no group; ids keep their
type; an empty table gives an empty result; extra columns are carried through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import discard, fresh, small_batches, stored
from pagewright.llm.components import connected_components
from pagewright.llm.simhash import SEED, fingerprint_links, fingerprints_from, shingle_hashes

SHINGLE_WORDS = 5
COMMON, MAX_COMMON = 50, 100_000
STARS, SHARE = 2, 20
BITS = 256
_PARITIES = [f"p{k}" for k in range(BITS // 64)]


def shingle_set(raw: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Different shingle hashes of a text in rising order, int64."""
    blocks = list(shingle_hashes(raw or b"", size))
    return np.unique(np.concatenate(blocks).view(np.int64)) if blocks else np.empty(0, np.int64)


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    n = len(hashes)
    if len(common):
        late = np.isin(hashes, common, assume_unique=True)
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: n - (4 * n + 4) // 5 + max(1, n // SHARE)]


def parities(hashes: np.ndarray) -> np.ndarray:
    """BITS bits as int64, each turned over once for each hash that has its number: maps of two sets differ in no more bits than the sets in hashes."""
    odd = np.bincount(hashes & (BITS - 1), minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def _sets(texts: DataFrame, size: int, common: np.ndarray, whole: bool, marks: bool = False) -> DataFrame:
    """texts(key, th, raw) to (key, th, sid, n, hashes): the set's name, its size, and its prefix or all of it; with marks, also fp and p0, p1 ...: its fingerprint and parities."""
    fields = "sid bigint, n int, hashes array<bigint>" + ", fp bigint" * marks + "".join(f", {p} bigint" for p in _PARITIES) * marks

    def run(batches):
        for batch in batches:
            got = [shingle_set(raw, size) for raw in batch.column(2).to_pylist()]
            sid = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in got], np.uint64).view(np.int64)
            shown = got if whole else [prefix(x, common) for x in got]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in shown])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*shown, np.empty(0, np.int64)])))
            columns = [pa.array(sid), pa.array([len(x) for x in got], pa.int32()), lists]
            if marks:
                maps = np.array([parities(x) for x in got], np.int64).reshape(len(got), len(_PARITIES))
                columns += [pa.array(fingerprints_from([[x] if len(x) else [] for x in got]).view(np.int64)), *(pa.array(maps[:, k]) for k in range(len(_PARITIES)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["key", "th", *(f.split()[0] for f in fields.split(", "))])

    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, th bigint, {fields}")


def near_copy_links(texts: DataFrame, size: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """texts(key, th, raw) to (key, sid) of each row and the links (src, dst) between the names of near sets."""
    none = np.empty(0, np.int64)
    marked = stored(_sets(texts, size, none, False))
    seen = marked.groupBy("sid").agg(F.first("hashes").alias("h")).select(F.explode("h").alias("at")).groupBy("at").count().where(F.col("count") > COMMON)
    often = seen.orderBy(F.col("count").desc(), "at").limit(MAX_COMMON).toPandas()["at"].to_numpy(np.int64)
    discard(marked)
    marked = stored(_sets(texts, size, often, False, True))
    mine = ["n", "hashes", "fp", *_PARITIES]
    nodes = marked.groupBy("sid").agg(F.min(F.struct("th", "key")).alias("one"), *[F.first(c).alias(c) for c in mine])
    nodes = stored(nodes.select("sid", F.col("one.th").alias("th"), F.col("one.key").alias("key"), *mine))
    named = stored(marked.select("key", "sid"))
    discard(marked)
    met = nodes.select("sid", "n", *_PARITIES, F.posexplode("hashes").alias("place", "at"))
    shared = stored(met.groupBy("at").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("at"))
    live = stored(met.join(shared, "at", "left_semi").withColumn("root", F.col("sid")))
    discard(shared)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (src, dst) whose whole sets have a similarity of 4/5 or more."""
        pairs = stored(pairs)
        ends = pairs.select(F.col("src").alias("sid")).union(pairs.select("dst")).distinct()
        # One row's key and text: copies of one text don't meet in a task.
        wanted = ends.join(nodes, "sid").select(F.col("th").alias("own_th"), F.col("key").alias("own_key"))
        rows = texts.join(wanted, (F.col("th") == F.col("own_th")) & F.col("key").eqNullSafe(F.col("own_key")), "left_semi")
        sets = stored(_sets(rows.select("key", "th", "raw").dropDuplicates(["th"]), size, none, True).select("sid", "hashes"))
        two = pairs.join(sets.select(F.col("sid").alias("src"), F.col("hashes").alias("xa")), "src").join(sets.select(F.col("sid").alias("dst"), F.col("hashes").alias("xb")), "dst")
        # 9 * common >= 4 * (na + nb) is common / (na + nb - common) >= 4/5.
        out = stored(two.where(F.size(F.array_intersect("xa", "xb")) * 9 >= (F.size("xa") + F.size("xb")) * 4).select("src", "dst"))
        discard(pairs)
        discard(sets)
        return out

    def by_fingerprints() -> DataFrame:
        """Pairs whose fingerprints differ in two bits or fewer: nodes with the first of their fingerprint, and these with each other."""
        first = stored(nodes.groupBy("fp").agg(F.min("sid").alias("sid")))
        same = nodes.select("sid", "fp").join(first.withColumnRenamed("sid", "dst"), "fp").where("sid <> dst").select(F.col("sid").alias("src"), "dst")
        met_at = fingerprint_links(first.select("fp")).distinct().withColumnsRenamed({"src": "fa", "dst": "fb"})
        met_at = met_at.join(first.withColumnsRenamed({"fp": "fa", "sid": "src"}), "fa").join(first.withColumnsRenamed({"fp": "fb", "sid": "dst"}), "fb")
        return same.union(met_at.select("src", "dst"))

    def by_stars(number: int) -> DataFrame:
        """Pairs of one node of each hash with the others; of a pair that shares less than it should, the last round decides."""
        order = F.xxhash64("sid", F.lit(number)) if number else F.col("place")
        hub = live.groupBy("at").agg(F.min(F.struct(order.alias("order"), "sid", "n", "root", "place", *_PARITIES)).alias("hub"))
        both = live.join(hub.select("at", *[F.col("hub")[c].alias(f"{c}b") for c in seen_of]), "at").where("sid <> sidb and root <> rootb").where(sized & enough & alike)
        met_at = both.groupBy(F.least("sid", "sidb").alias("src"), F.greatest("sid", "sidb").alias("dst")).agg(F.count("*").alias("c"), F.first(F.least("n", "nb")).alias("m"))
        return met_at.where(f"2 * {SHARE} * c >= m").select("src", "dst")

    def by_pairs() -> DataFrame:
        """All pairs that may match. At the first hash that two sets share, as many hashes as they need follow in both."""
        other = live.select("at", *[F.col(c).alias(f"{c}b") for c in seen_of])
        both = stored(live.join(other, "at").where((F.col("sid") < F.col("sidb")) & (F.col("root") != F.col("rootb")) & sized & enough & alike).select(F.col("sid").alias("src"), F.col("sidb").alias("dst")).distinct())
        side = lambda x: nodes.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("hashes").alias(f"h_{x}"))
        two = both.join(side("src"), "src").join(side("dst"), "dst")
        return two.where(F.size(F.array_intersect("h_src", "h_dst")) >= F.greatest(F.floor(F.least("n_src", "n_dst") / SHARE), F.lit(1))).select("src", "dst")

    seen_of = ["sid", "n", "root", "place", *_PARITIES]
    sized = F.least("n", "nb") * 5 >= F.greatest("n", "nb") * 4
    # Of the first hash that two sets share: all that they have in common follows in both.
    enough = 9 * F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("placeb")) >= 4 * (F.col("n") + F.col("nb"))
    different = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}b"))) for p in _PARITIES), F.lit(0))
    alike = 9 * different <= F.col("n") + F.col("nb")
    links, number = verified(by_fingerprints()), 0
    live = _apart(live, links)
    while not live.isEmpty():
        found = verified(by_stars(number) if number < STARS else by_pairs())
        links = links.unionByName(found)
        if number >= STARS:
            break
        number = number + 1 if not found.isEmpty() else STARS
        live = _apart(live, links)
    return named, links


def _apart(live: DataFrame, links: DataFrame) -> DataFrame:
    """live with the roots that links give, without the keys whose nodes all have one root."""
    roots = connected_components(links)
    rooted = live.drop("root").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rooted = stored(rooted)
    mixed = rooted.groupBy("at").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("at")
    return stored(rooted.join(mixed, "at", "left_semi"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of docs whose key is the least of its group of near copies; a repeated key keeps its rows, rows without key stay."""
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("raw"))
    named, links = near_copy_links(slim, size)
    roots = connected_components(links)
    placed = named.join(roots, F.col("sid") == F.col("node"), "left").select("key", F.coalesce("root", "sid").alias("root"))
    placed = stored(placed)
    least = placed.groupBy("root").agg(F.min("key").alias("least"))
    name = fresh(docs, "kept_key")
    kept = placed.join(least, "root").where("key = least").select(F.col("key").alias(name)).distinct()
    return docs.where(F.col(key).isNotNull()).join(kept, F.col(key) == F.col(name), "left_semi").unionByName(docs.where(F.col(key).isNull()))
