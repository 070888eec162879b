"""Connected components by alternating large-star and small-star rounds, all in Spark joins.

Cases: null ends, loops and repeated edges change nothing; an empty table has no components; each round's table is
deleted when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import discard, stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _stars(both: DataFrame, keep_self: bool) -> DataFrame:
    """both(u, v): neighbours. Each u hands its least neighbour m (or itself) to its neighbours."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if keep_self:  # small star: u itself is linked to m, too
        out = joined.select(F.col("v").alias("a"), "m").union(least.select(F.col("u").alias("a"), "m"))
    else:  # large star: only larger neighbours move
        out = joined.where("v > u").select(F.col("v").alias("a"), "m")
    return out.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(src, dst) of any orderable type to (node, root): root is the least node reachable.

    Null ends and loops are ignored; nodes without an edge aren't returned. The number of rounds grows with the
    logarithm of the longest chain. A hub's rows are spread by partial aggregation and skew-split joins; nothing is
    collected but two numbers a round."""
    now = stored(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        large = _stars(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), False)
        small = _stars(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), True)
        before, now = now, stored(small)
        discard(before)
        was, mark = mark, _mark(now)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
