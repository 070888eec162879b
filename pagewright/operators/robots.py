"""robots.txt: rules of the groups that name us (else of all agents), longest match wins, ties allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import scalars as S


def rules(robots: DataFrame, agent: str) -> DataFrame:
    """robots(origin, status, text) to (origin, allow, pattern) of those origins that answered 200."""
    lines = robots.where("status = 200").select("origin", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("pos", "raw"))
    bare = F.trim(F.regexp_replace("raw", "(?s)#.*$", ""))
    pairs = lines.select("origin", "pos", bare.alias("line")).where(F.col("line").contains(":"))
    pairs = pairs.select("origin", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("name"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    order = Window.partitionBy("origin").orderBy("pos")
    names = F.col("name") == "user-agent"
    begins = names & ~F.coalesce(F.lag(names).over(order), F.lit(False))
    grouped = pairs.withColumn("begins", begins).withColumn("group", F.sum(F.col("begins").cast("int")).over(order))
    agents = grouped.where(names).select("origin", "group", F.lower("value").alias("agent"))
    per_group = agents.groupBy("origin", "group").agg(F.max(F.when(F.col("agent") == agent.lower(), 2).when(F.col("agent") == "*", 1).otherwise(0)).alias("rank"))
    best = per_group.groupBy("origin").agg(F.max("rank").alias("best")).where("best > 0")
    chosen = per_group.join(best, "origin").where("rank = best").select("origin", "group")
    own = grouped.where(F.col("name").isin("allow", "disallow") & (F.col("value") != "") & (F.col("group") > 0))
    return own.join(chosen, ["origin", "group"], "left_semi").select("origin", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"))


def matches(pattern: Column, path: Column) -> Column:
    """Prefix match with * for anything and a final $ for the end.

    The pieces between stars are looked for from left to right, each behind the one before it: no step back is ever
    needed, and hostile patterns cost one pass over the path a piece."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)

    def behind(at: Column, piece: Column) -> Column:
        found = F.position(piece, path, at + 1)
        return F.when((at < 0) | (piece == ""), at).when(found > 0, found - 1 + F.length(piece)).otherwise(F.lit(-1))

    def fits(pieces: Column) -> Column:
        head, last, n = F.get(pieces, F.lit(0)), F.element_at(pieces, -1), F.size(pieces)
        middle = F.slice(pieces, 2, F.greatest(F.when(anchored, n - 2).otherwise(n - 1), F.lit(0)))
        at = F.aggregate(middle, F.when(path.startswith(head), F.length(head)).otherwise(F.lit(-1)), behind)
        ends = path.endswith(last) & (F.length(path) - F.length(last) >= at)
        return F.when(anchored & (n == 1), path == head).when(anchored, (at >= 0) & ends).otherwise(at >= 0)

    return S.let(F.split(body, r"\*"), fits)


def decide(urls: DataFrame, robots: DataFrame, agent: str, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """urls(keys, origin, path) to (keys, allowed, reason). An origin without a robots row allows nothing."""
    own = rules(robots, agent)
    hit = urls.join(own, "origin").where(matches(F.col("pattern"), F.col("path")))
    best = hit.groupBy(*keys).agg(F.max(F.struct(F.length("pattern").alias("n"), "allow")).alias("best"))
    state = robots.select("origin", "status")
    out = urls.join(state, "origin", "left").join(best, list(keys), "left")
    allowed = (
        F.when(F.col("status") == 200, F.coalesce("best.allow", F.lit(True)))
        .when(F.col("status").between(400, 499), F.lit(True))
        .otherwise(F.lit(False))
    )
    reason = F.when(allowed, F.lit(None)).when(F.col("status") == 200, F.lit("rule")).otherwise(F.lit("unreachable"))
    return out.select(*keys, allowed.alias("allowed"), reason.cast("string").alias("reason"))
