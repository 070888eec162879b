"""Balanced label propagation onto shards, in DataFrame functions only.

Linked documents share a hyperedge (by default: equal texts). A document's largest hyperedge is its group. Every linked
document starts on a shard by its own hash, so groups start scattered, and propagation brings them together. In each
round every hyperedge counts its members by shard, a group adds the counts of its members' hyperedges and asks for the
shard with the most neighbours among those with room for all of it; shards grant what fits, larger groups before smaller
ones, and a granted group moves there and holds its room. Where a group is refused, smaller size classes wait for the
next round, so that they don't take its room. Groups of a class that fit nowhere as a whole, fewer than there are shards,
are dealt out over as few shards as hold them. Where hyperedges overlap, rounds of single documents follow, as long as
they lower the number of cut edges (members outside of the shard where most of their hyperedge is): each asks for the
shard with the most neighbours, and requests are granted up to the shard's quota. Unlinked documents fill what room is
left, by hash. Last, law `rows`: shards that stand over their exact share give up rows, unlinked ones first, then those
of dealt groups, then whole groups one after the other, to those under it, so that counts differ by one at most. Slots
are gapless: ranks within small buckets plus the buckets' offsets, so that no task holds a shard.

Everything is dealt by hashes of ids and texts and not by places in files: the same rows give the same result however
they are stored. Joins on hyperedges with more than 1 / BIG of all members broadcast the hyperedge's few numbers; no
other key is frequent.

Cases: a null text counts as empty (size 1, checksum 0) and equals an empty one; repeated rows and ids are rows of their
own; a key keeps its type; a group of any size is spread over tasks and, beyond a shard's share, over shards; an empty
table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import stored

SHARDS = 8
BIG = 8192
MIN_BUCKETS, ROWS_A_BUCKET, LEAST_LARGE = 64, 20_000, 1_000
_GRANTS, _PARTS = 1024, 1 << 20
CLASSES = 4  # of group sizes up to a shard's share, each down to an eighth of the one before; the last has all smaller ones


def documents_base(docs: DataFrame, key: str, text: str) -> DataFrame:
    """uid (a row's own number, for joins alone), key, size, crc, the hash h of the text and c of key and text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), (F.octet_length(t) + 1).cast("bigint").alias("size"),
        F.crc32(t).alias("crc"), F.xxhash64(t).alias("h"), F.xxhash64(F.col(key), t).alias("c"),
    )


def equal_text_members(base: DataFrame) -> DataFrame:
    """(uid, edge) of all rows whose text another row has, too. edge: hash, checksum and size together."""
    edge = F.struct("h", "crc", "size").alias("edge")
    # Written first: a join of two plain exchanges can be split where one text has many rows.
    many = stored(base.groupBy(edge).agg(F.count("*").alias("n")).where("n > 1").select("edge"))
    return base.select("uid", edge).join(many, "edge").select("uid", "edge")


def _by_edge(members: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """members(edge, hot, ...) joined with facts(edge, ...): those of the few hot edges are broadcast."""
    hot = members.where("hot").select("edge").distinct()
    few = facts.join(F.broadcast(hot), "edge", "left_semi")
    return members.where("hot").join(F.broadcast(few), "edge", how).unionByName(members.where("not hot").join(facts, "edge", how))


def _sized(members: DataFrame) -> DataFrame:
    """members(uid, edge) with the edge's size and whether it has more than 1 / BIG of all members."""
    total = members.count()
    sizes = members.groupBy("edge").agg(F.count("*").alias("size"))
    hot = stored(sizes.where(F.col("size") * BIG > total))
    rest = members.join(F.broadcast(hot.select("edge")), "edge", "left_anti").join(sizes.where(F.col("size") * BIG <= total), "edge")
    return stored(members.join(F.broadcast(hot), "edge").withColumn("hot", F.lit(True)).unionByName(rest.withColumn("hot", F.lit(False))))


def _pick(place: Column, weights: list[int]) -> Column:
    """A shard for a hash: pmod(place) dealt in proportion to the weights."""
    total, at, out = max(1, sum(weights)), 0, F.lit(len(weights) - 1)
    bounds = []
    for w in weights:
        at += w
        bounds.append(at * _PARTS // total)
    for s in reversed(range(len(weights))):
        out = F.when(F.pmod(place, F.lit(_PARTS)) < bounds[s], F.lit(s)).otherwise(out)
    return out.cast("int")


def _places(groups: list, room: list[int]) -> list[tuple]:
    """Deals groups (edge, n), largest first, into the room, which it lowers: (edge, low, high, to) by the numbers of a group's rows."""
    out = []
    for edge, n in groups:
        low = 0
        while low < n:
            s = max(range(len(room)), key=lambda i: (room[i], -i))
            take = max(1, min(n - low, room[s]))
            out.append((edge, low, low + take, s))
            room[s] -= take
            low += take
    return out


def _dealt(labels: DataFrame, groups: list, room: list[int]) -> DataFrame:
    """labels with the groups (edge, n) dealt out into the room, which it lowers."""
    edge = labels.schema["edge"].dataType.simpleString()
    parts = labels.sparkSession.createDataFrame(_places(groups, room), f"of {edge}, low long, high long, to int")
    names = F.broadcast(parts.select(F.col("of").alias("edge")).distinct())
    buckets = max(MIN_BUCKETS, sum(n for _, n in groups) // ROWS_A_BUCKET)
    rows = labels.join(names, "edge").select("uid", "edge", "c", F.pmod(F.xxhash64("c", F.lit(7)), F.lit(buckets)).alias("bucket"))
    sizes = rows.groupBy("edge", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("edge", "bucket", (F.sum("n").over(Window.partitionBy("edge").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("edge", "bucket").orderBy("c")) - 1  # rows that tie are equal
    rows = rows.withColumn("within", within).join(before, ["edge", "bucket"]).withColumn("at", F.col("before") + F.col("within"))
    to = rows.join(F.broadcast(parts), (rows.edge == parts.of) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select("uid", "to")
    return stored(labels.join(to, "uid", "left").withColumn("shard", F.coalesce("to", "shard")).select(labels.columns))


def starting_labels(own: DataFrame, shares: list[int]) -> DataFrame:
    """own(uid, c, ...), a row for each linked document, with shard: each on its own, by hash."""
    return own.withColumn("shard", _pick(F.xxhash64("c", F.lit(11)), shares))


def _asks(ties: DataFrame, votes: DataFrame, room: list[int], number: int) -> DataFrame:
    """(group, n, kind, to, won): the shard with the most neighbours among those with room for the group, null if there is
    none, and whether it fits there with those before it, larger classes first: the first of a shard always does."""
    rooms = F.array(*(F.lit(r).cast("bigint") for r in room))
    shards = F.array(*map(F.lit, range(len(room))))
    pulls = (
        _by_edge(ties, votes.select("edge", "shard", F.col("n").alias("members"))).groupBy("group", "n", "kind", "shard").agg(F.sum(F.col("w") * F.col("members")).alias("pull"))
        .groupBy("group", "n", "kind").agg(F.map_from_entries(F.collect_list(F.struct("shard", "pull"))).alias("pulls"))
    )
    fit = F.filter(shards, lambda s: F.element_at(rooms, s + 1) >= F.col("n"))
    # Ties go by hash, so that they don't all ask for one shard.
    best = F.array_max(F.transform(fit, lambda s: F.struct(F.coalesce(F.try_element_at("pulls", s), F.lit(0)).alias("pull"), F.xxhash64("group", s, F.lit(number)).alias("h"), s.alias("to"))))
    # Running sums within small buckets plus the buckets' offsets, so that no task holds a shard.
    level = (F.col("kind") + 1) * 64 + 63 - F.floor(F.log2("n"))
    asks = pulls.select("group", "n", "kind", best["to"].alias("to"), F.xxhash64("group", F.lit(number)).alias("h")).withColumn("bucket", level * _GRANTS + F.pmod("h", F.lit(_GRANTS)))
    sizes = asks.groupBy("to", "bucket").agg(F.sum("n").alias("all"))
    before = sizes.select(F.col("to").alias("t"), F.col("bucket").alias("b"), (F.sum("all").over(Window.partitionBy("to").orderBy("bucket")) - F.col("all")).alias("before"))
    order = Window.partitionBy("to", "bucket").orderBy(F.desc("n"), "h", "group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = asks.withColumn("within", F.sum("n").over(order)).join(before, (F.col("to") == F.col("t")) & (F.col("bucket") == F.col("b")), "left")
    won = F.coalesce(F.col("before") + F.col("within") <= F.element_at(rooms, F.col("to") + 1), F.lit(False))
    return running.select("group", "n", "kind", "to", won.alias("won"))


def gather(own: DataFrame, members: DataFrame, shares: list[int]) -> tuple[DataFrame, list]:
    """(uid, shard) after the rounds that bring groups together, and the groups that no shard had room for as a whole."""
    room, size = list(shares), max(shares)
    kind = F.when(F.col("n") > size, -1).otherwise(sum((F.col("n") * 8**k <= size).cast("int") for k in range(1, CLASSES)))
    groups = own.groupBy("edge").agg(F.count("*").alias("n")).select(F.col("edge").alias("group"), "n", kind.alias("kind"))
    # Which hyperedges a group's documents are on, and how often.
    between = members.join(own.select("uid", F.col("edge").alias("group")), "uid").groupBy("group", "edge", "hot").agg(F.count("*").alias("w"))
    ties = stored(between.join(groups, "group"))
    labels = stored(starting_labels(own, shares))
    number, dealt = 0, []
    while True:
        asks = stored(_asks(ties, _votes(labels, members), room, number))
        seen = asks.groupBy("kind", "to", "won").agg(F.count("*").alias("groups"), F.sum("n").alias("n")).collect()  # a few rows a shard
        refused = [r["kind"] for r in seen if not r["won"]]
        last = min(refused, default=CLASSES)
        granted = [r for r in seen if r["won"] and r["kind"] <= last]
        if granted:
            for r in granted:
                room[r["to"]] -= r["n"]
            gone = asks.where("won").where(F.col("kind") <= last)
            labels = _moved(labels, gone.select(F.col("group").alias("edge"), "to"))
        elif refused:
            # No shard has room for any of this class: each is larger than any room and together they fit, so they are fewer than shards.
            gone = asks.where(F.col("kind") == last)
            left = [(r["group"], r["n"]) for r in gone.orderBy(F.desc("n"), F.xxhash64("group"), "group").collect()]
            labels = _dealt(labels, left, room)
            dealt += [edge for edge, _ in left]
        if not refused:
            return labels.select("uid", "shard"), dealt
        ties = stored(ties.join(gone.select("group"), "group", "left_anti"))
        number += 1


def _moved(labels: DataFrame, granted: DataFrame) -> DataFrame:
    """labels with the groups of granted(edge, to) on their shards."""
    return stored(_by_edge(labels, granted, "left").withColumn("shard", F.coalesce("to", "shard")).drop("to").select(labels.columns))


def _round(labels: DataFrame, members: DataFrame, votes: DataFrame, own: DataFrame, shards: int, quota: int, number: int) -> DataFrame:
    """labels(uid, shard) after one round of granted moves."""
    asked = (
        _by_edge(members, votes).groupBy("uid", "shard").agg(F.sum("n").alias("n"))
        .groupBy("uid").agg(F.max(F.struct("n", (-F.col("shard")).alias("minus"))).alias("best"))
        .select("uid", (-F.col("best.minus")).alias("to"))
    )
    # Requests come in buckets by group, so that a group is granted as a whole; those of large ones are spread.
    spread = F.when(F.col("size") * _GRANTS > quota, F.xxhash64("c", F.lit(number))).otherwise(F.xxhash64("edge", F.lit(number)))
    moves = stored(asked.join(labels, "uid").where("shard <> to").join(own, "uid").select("uid", "to", "shard", F.pmod(spread, F.lit(_GRANTS)).alias("bucket")))
    have = labels.groupBy("shard").agg(F.count("*").alias("have")).select(F.col("shard").alias("to"), "have")
    running = F.sum("n").over(Window.partitionBy("to").orderBy("bucket"))  # at most shards x _GRANTS rows
    granted = (
        moves.groupBy("to", "bucket").agg(F.count("*").alias("n"))
        .withColumn("running", running)
        .join(have, "to", "left")
        .where(F.col("running") <= quota - F.coalesce("have", F.lit(0)))
        .select("to", "bucket")
    )
    won = moves.join(F.broadcast(granted), ["to", "bucket"]).select("uid", "to")  # at most shards x _GRANTS rows
    return stored(labels.join(won, "uid", "left").select("uid", F.coalesce("to", "shard").alias("shard")))


def _votes(labels: DataFrame, members: DataFrame) -> DataFrame:
    """(edge, shard, n)"""
    return stored(members.join(labels.select("uid", "shard"), "uid").groupBy("edge", "shard").agg(F.count("*").alias("n")))


def _cut(votes: DataFrame) -> int:
    """The number of members outside of the shard where most of their edge is."""
    return votes.groupBy("edge").agg((F.sum("n") - F.max("n")).alias("cut")).agg(F.sum("cut")).first()[0] or 0


def propagate(base: DataFrame, members: DataFrame, shares: list[int]) -> tuple[DataFrame, list]:
    """(uid, shard, edge, group size) of the linked rows, after as many rounds as lower the number of cut edges, and the dealt groups."""
    members = _sized(members)
    own = members.groupBy("uid").agg(F.max(F.struct("size", "edge", "hot")).alias("g")).select("uid", *(F.col(f"g.{c}").alias(c) for c in ("size", "edge", "hot")))
    own = stored(own.join(base.select("uid", "c"), "uid"))
    labels, dealt = gather(own, members, shares)
    votes = _votes(labels, members)
    cut, number = _cut(votes), 0
    while cut:
        moved = _round(labels, members, votes, own, len(shares), max(shares), number)
        votes = _votes(moved, members)
        left = _cut(votes)
        if left >= cut:
            break
        labels, cut, number = moved, left, number + 1
    return labels.join(own.select("uid", "edge", "size"), "uid"), dealt


def _buckets(n: int, shards: int) -> int:
    return max(MIN_BUCKETS, n // (shards * ROWS_A_BUCKET))


def _ranked(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """rows(shard, zone, eh, c, key, uid) with rank: gapless from 0 in each shard, by zone, then by hash."""
    buckets = _buckets(n, shards)
    rows = rows.withColumn("bucket", F.col("zone") * buckets + F.pmod(F.col("eh"), F.lit(buckets)))
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    # Rows that tie in all of these are equal.
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("eh", "c", "key", "crc", "size", "h")) - 1
    return rows.withColumn("within", within).join(before, ["shard", "bucket"]).withColumn("rank", (F.col("before") + F.col("within")).cast("bigint"))


def assign_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, links: DataFrame | None = None
) -> DataFrame:
    """One row per row of docs: key, size, text_crc32, law, shard, slot, grown_shard.

    links: (key, edge) rows that put documents on shared hyperedges; by default equal texts are linked."""
    base = stored(documents_base(docs, key, text))
    n = base.count()
    share = [n // shards + (s < n % shards) for s in range(shards)]
    if links is None:
        members = equal_text_members(base)
    else:
        own = links.select(F.col(links.columns[0]).alias("key"), F.col(links.columns[1]).alias("edge")).distinct()
        members = base.select("uid", "key").join(own, "key").select("uid", "edge")
    labels, dealt = propagate(base, stored(members), share)
    parts = F.broadcast(docs.sparkSession.createDataFrame([(e,) for e in dealt], f"edge {members.schema['edge'].dataType.simpleString()}"))
    labels = stored(labels.join(parts.withColumn("dealt", F.lit(True)), "edge", "left"))
    taken = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    free = _pick(F.xxhash64("c"), [max(0, share[s] - taken.get(s, 0)) for s in range(shards)])
    # Groups that would make a bucket of their own are spread over buckets.
    large = F.col("g.size") > max(LEAST_LARGE, 2 * n // (shards * _buckets(n, shards)))
    mine = labels.select("uid", F.col("shard").alias("got"), F.struct("edge", "size", F.coalesce("dealt", F.lit(False)).alias("dealt")).alias("g"))
    rows = base.join(mine, "uid", "left").select(
        "uid", "key", "size", "crc", "h", "c", F.coalesce("got", free).alias("shard"),
        F.when(F.col("g").isNull(), 3).when(F.col("g.dealt"), 2).when(large, 0).otherwise(1).alias("zone"),
        F.when(F.col("g").isNull() | F.col("g.dealt") | large, F.xxhash64("c", F.lit(3))).otherwise(F.xxhash64("g.edge", F.lit(5))).alias("eh"),
    )
    rows = stored(rows)
    counts = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    have = [counts.get(s, 0) for s in range(shards)]
    ranked = _ranked(rows, n, shards)
    # Rows beyond a shard's share are numbered through all shards and fill the gaps of the others in turn.
    offset, fill, at = [], [], 0
    for s in range(shards):
        offset.append(at)
        at += max(0, have[s] - share[s])
    at = 0
    for s in range(shards):
        if have[s] < share[s]:
            fill.append((at, at + share[s] - have[s], s))
            at = fill[-1][1]
    limit = F.element_at(F.array(*map(F.lit, share)), F.col("shard") + 1)
    extra = F.element_at(F.array(*map(F.lit, offset)), F.col("shard") + 1) + F.col("rank") - limit
    new_shard, new_slot = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for low, high, s in fill:
        inside = (F.col("extra") >= low) & (F.col("extra") < high)
        new_shard = F.when(inside, F.lit(s)).otherwise(new_shard)
        new_slot = F.when(inside, F.col("extra") - low + have[s]).otherwise(new_slot)
    ranked = ranked.withColumn("extra", F.when(F.col("rank") >= limit, extra))
    return ranked.select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.coalesce(new_shard, "shard").cast("int").alias("shard"), F.coalesce(new_slot, "rank").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
