"""URL verdicts: listed rules first, then a path-template tree for each host.

Tree: the segments of a path are nodes under their host, at any depth. A segment with a digit is a wildcard at once; a
parent whose children are many and rare gets one wildcard child instead. Pages that a rule decides label their
templates. The branches of a host (its first segments) are compared by their shape, that is by how their pages spread
over the templates below them: a branch whose spread agrees with that of the host's blocked pages (cosine, less the
branch's sampling error) is merged with them and takes their labels, template by template; the same with the allowed
pages, or both. A template is rejected when its labels' purity, smoothed towards that of the pool it was merged
with, and that towards PRIOR, reaches REJECT. So unlabelled look-alikes of blocked branches are blocked; branches like
neither keep their own labels, and without labels the prior, which allows them.

Cases: a null url or one without :// has empty host and path and no rule, and is allowed unless blocked pages without host
outweigh it; a host may hold any share of the pages, for all groups are sums with partial aggregation, and the join back
is one row for each template; repeated urls and rows stay; an empty table gives an empty result; extra columns are not
looked at. The rule list is a literal of the plan: keep it under MAX_RULES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import ascii_lower, stored

RULES: tuple[tuple[str, str], ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MAX_RULES = 1000
MANY_CHILDREN, ROWS_A_CHILD = 16, 4
ALIKE, SAMPLING = 0.8, 0.5
ALPHA, PRIOR, REJECT = 4.0, 0.1, 0.6


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equal rules the first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1]))[::-1]:
        name, slash, rest = rule.partition("/")
        fits = (host == name) | host.endswith(f".{name}")
        if slash:
            fits = fits & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def lexical_segments(path: Column) -> Column:
    """Segments of a path; those with a digit as {}."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda s: F.when(s.rlike("[0-9]"), F.lit("{}")).otherwise(s))


def _nodes(seg: Column) -> Column:
    """For each segment: its place, the name of the path above it (a chain of hashes) and itself."""
    start = F.struct(F.lit(0).cast("bigint").alias("up"), F.array().cast("array<struct<d:int,up:bigint,child:string>>").alias("out"))
    step = lambda acc, s: F.struct(
        F.xxhash64(acc.up, s).alias("up"), F.concat(acc.out, F.array(F.struct((F.size(acc.out) + 1).alias("d"), acc.up.alias("up"), s.alias("child")))).alias("out")
    )
    return F.aggregate(seg, start, step, lambda acc: acc.out)


def templates(tree: DataFrame) -> DataFrame:
    """tree(host, seg, n, ...), one row for each (host, seg), with tpl: seg with a wildcard at the children of wide parents."""
    nodes = tree.select("host", "seg", "n", F.explode(_nodes(F.col("seg"))).alias("e")).select("host", "seg", "n", "e.d", "e.up", "e.child")
    fan = nodes.groupBy("host", "d", "up", "child").agg(F.sum("n").alias("n")).groupBy("host", "d", "up").agg(F.count("*").alias("kids"), F.sum("n").alias("rows"))
    wide = fan.where((F.col("kids") >= MANY_CHILDREN) & (F.col("rows") < ROWS_A_CHILD * F.col("kids"))).select("host", "d", "up")
    places = nodes.join(wide, ["host", "d", "up"]).groupBy("host", "seg").agg(F.collect_list("d").alias("wild"))
    wild = lambda s, i: F.when(F.array_contains("wild", i + 1), F.lit("{}")).otherwise(s)
    return tree.join(places, ["host", "seg"], "left").withColumn("tpl", F.when(F.col("wild").isNull(), F.col("seg")).otherwise(F.transform("seg", wild))).drop("wild")


def template_verdicts(marked: DataFrame) -> DataFrame:
    """marked(host, seg, label) to one row for each (host, seg): the template it falls under and the verdict."""
    n = lambda v: F.sum(F.when(F.col("label") == v, 1).otherwise(0)).alias(f"n_{v}")
    tree = stored(marked.groupBy("host", "seg").agg(F.count("*").alias("n"), n("allow"), n("block")))
    tree = stored(templates(tree).withColumns({"branch": F.get("tpl", F.lit(0)), "shape": F.slice("tpl", 2, F.size("tpl"))}))
    cells = tree.groupBy("host", "branch", "shape").agg(F.sum("n").alias("n"), F.sum("n_block").alias("b"), F.sum("n_allow").alias("a"))
    pool = cells.groupBy("host", "shape").agg(F.sum("b").alias("pb"), F.sum("a").alias("pa"))
    square = lambda c: F.sum(F.col(c) * F.col(c)).cast("double")
    whole = pool.groupBy("host").agg(F.sum("pb").alias("hb"), F.sum("pa").alias("ha"), square("pb").alias("bb"), square("pa").alias("aa"))
    both = cells.join(pool, ["host", "shape"])
    dot = lambda c: F.sum(F.col("n") * F.col(c)).cast("double")
    spread = both.groupBy("host", "branch").agg(F.sum("n").alias("rows"), square("n").alias("nn"), dot("pb").alias("nb"), dot("pa").alias("na")).join(whole, "host")
    bound = F.lit(ALIKE) - F.lit(SAMPLING) / F.sqrt("rows")
    alike = lambda x, y: F.coalesce(F.when(F.col(y) > 0, F.col(x) / F.sqrt(F.col("nn") * F.col(y)) >= bound), F.lit(False))
    like = spread.select("host", "branch", alike("nb", "bb").alias("like_block"), alike("na", "aa").alias("like_allow"), "hb", "ha")
    judged = both.join(like, ["host", "branch"])
    any_like = F.col("like_block") | F.col("like_allow")
    taken = lambda flag, pooled, own: F.when(any_like, F.when(F.col(flag), F.col(pooled)).otherwise(F.lit(0))).otherwise(F.col(own))
    b, a = taken("like_block", "pb", "b"), taken("like_allow", "pa", "a")
    up = lambda flag, c: F.when(F.col(flag), F.col(c)).otherwise(F.lit(0))
    prior = (up("like_block", "hb") + F.lit(ALPHA * PRIOR)) / (up("like_block", "hb") + up("like_allow", "ha") + F.lit(ALPHA))
    purity = (b + F.lit(ALPHA) * prior) / (b + a + F.lit(ALPHA))
    judged = judged.select("host", "branch", "shape", any_like.alias("merged"), F.when(purity >= REJECT, F.lit("block")).otherwise(F.lit("allow")).alias("tree_verdict"))
    return tree.join(judged, ["host", "branch", "shape"]).select("host", "seg", F.concat(F.lit("/"), F.array_join("tpl", "/")).alias("template"), "merged", "tree_verdict")


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """key, host, path, rule, verdict, template of every row."""
    df = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"))
    df = df.select("k", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    df = df.withColumns({"hit": matching_rule(F.col("host"), F.col("path"), rules), "seg": lexical_segments(F.col("path"))})
    tree = template_verdicts(df.select("host", "seg", F.col("hit.verdict").alias("label")))
    return df.join(tree, ["host", "seg"], "left").select(
        F.col("k").alias(key), "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", "tree_verdict", F.lit("allow")).alias("verdict"), "template",
    )


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("template")


OP9_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
  list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '{{}}' ELSE s END) AS seg FROM p),
m AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS label FROM r),
t0 AS (SELECT host, seg, count(*) AS n, count(*) FILTER (label = 'allow') AS n_allow, count(*) FILTER (label = 'block') AS n_block FROM m GROUP BY host, seg),
e AS (SELECT host, seg, n, d, list_slice(seg, 1, d - 1) AS up, seg[d] AS child FROM (SELECT *, unnest(range(1, len(seg) + 1)) AS d FROM t0)),
f AS (SELECT host, d, up, count(DISTINCT child) AS kids, sum(n) AS nrows FROM e GROUP BY ALL),
w AS (SELECT host, seg, list(d) AS wild FROM e JOIN f USING (host, d, up) WHERE kids >= {MANY_CHILDREN} AND nrows < {ROWS_A_CHILD} * kids GROUP BY host, seg),
t1 AS (SELECT t0.*, CASE WHEN wild IS NULL THEN t0.seg ELSE list_transform(t0.seg, lambda s, i: CASE WHEN list_contains(wild, i) THEN '{{}}' ELSE s END) END AS tpl
  FROM t0 LEFT JOIN w ON t0.host = w.host AND t0.seg = w.seg),
t AS (SELECT *, tpl[1] AS branch, list_slice(tpl, 2, len(tpl)) AS shape FROM t1),
c AS (SELECT host, branch, shape, sum(n) AS n, sum(n_block) AS b, sum(n_allow) AS a FROM t GROUP BY ALL),
o AS (SELECT host, shape, sum(b) AS pb, sum(a) AS pa FROM c GROUP BY ALL),
h AS (SELECT host, sum(pb) AS hb, sum(pa) AS ha, sum(pb * pb)::DOUBLE AS bb, sum(pa * pa)::DOUBLE AS aa FROM o GROUP BY ALL),
x AS (SELECT host, branch, sum(n) AS nrows, sum(n * n)::DOUBLE AS nn, sum(n * pb)::DOUBLE AS nb, sum(n * pa)::DOUBLE AS na FROM c JOIN o USING (host, shape) GROUP BY ALL),
k AS (SELECT host, branch, hb, ha, coalesce(CASE WHEN bb > 0 THEN nb / sqrt(nn * bb) >= {ALIKE}::DOUBLE - {SAMPLING}::DOUBLE / sqrt(nrows::DOUBLE) END, false) AS lb,
  coalesce(CASE WHEN aa > 0 THEN na / sqrt(nn * aa) >= {ALIKE}::DOUBLE - {SAMPLING}::DOUBLE / sqrt(nrows::DOUBLE) END, false) AS la FROM x JOIN h USING (host)),
y AS (SELECT host, branch, shape, CASE WHEN lb OR la THEN CASE WHEN lb THEN pb ELSE 0 END ELSE b END::DOUBLE AS b, CASE WHEN lb OR la THEN CASE WHEN la THEN pa ELSE 0 END ELSE a END::DOUBLE AS a,
  (CASE WHEN lb THEN hb ELSE 0 END::DOUBLE + {ALPHA * PRIOR}::DOUBLE) / (CASE WHEN lb THEN hb ELSE 0 END::DOUBLE + CASE WHEN la THEN ha ELSE 0 END::DOUBLE + {ALPHA}::DOUBLE) AS prior
  FROM c JOIN o USING (host, shape) JOIN k USING (host, branch)),
v AS (SELECT host, branch, shape, CASE WHEN (b + {ALPHA}::DOUBLE * prior) / (b + a + {ALPHA}::DOUBLE) >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END AS tv FROM y)
SELECT page_id, m.host, path, rule, coalesce(label, tv) AS verdict FROM m
  JOIN t ON m.host = t.host AND m.seg = t.seg JOIN v ON t.host = v.host AND t.branch = v.branch AND t.shape = v.shape
"""
