"""Pages to product rows: parse, candidates, merge, optional gap filling and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.operators import candidates, gapfill, merge, parse
from pagewright.storage import written

HINT = "The page has almost no text without JavaScript; enable rendering to read it."


def _batches(df: DataFrame) -> None:
    """Whole pages in small Arrow batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= 256:
        df.sparkSession.conf.set(name, "256")


def merged_pages(pages: DataFrame, config: EngineConfig = EngineConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page with the chosen candidates (f_<field>), notes, text and n_filled."""
    _batches(pages)
    df = merge.merged(candidates.with_candidates(parse.parse_pages(pages, keep=keep, unended=config.unended_references)))
    df = gapfill.fill_gaps(df, config)
    return df.withColumn("n_filled", merge.n_filled())


def extract_pages(pages: DataFrame, config: EngineConfig = EngineConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """pages(url, html, keep...) to product rows."""
    df = merged_pages(pages, config, keep)
    poor = F.length("text") < config.render_below_chars
    if config.render_enabled and config.renderer is not None:
        return _rendered(df, config, keep)
    rows = merge.product_rows(df, *dict.fromkeys(["url", *keep]), "n_filled", "text")
    hint = F.when(poor & (F.col("n_filled") == 0), F.array(F.lit(HINT))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("warnings", F.concat("warnings", hint)).drop("n_filled", "text")


def _rendered(df: DataFrame, config: EngineConfig, keep: tuple[str, ...]) -> DataFrame:
    """Near-empty pages are rendered and read again; the rendering counts if it fills more fields.

    The static rows are written once, for they are both asked and answered. Each address is rendered once, for all its rows."""
    names = list(dict.fromkeys(["url", *keep]))
    static = written(merge.product_rows(df, *names, "n_filled", (F.length("text") < config.render_below_chars).alias("poor")))
    wanted = static.where("poor").select("url").distinct()
    again = written(config.renderer(wanted)).dropDuplicates(["url"])  # (url, html, problem)
    ok = merged_pages(again.where("html is not null").select("url", "html"), config)
    dynamic = merge.product_rows(ok, "url", "n_filled")
    values = [c for c in dynamic.columns if c not in ("url", "n_filled", "warnings")]
    side = dynamic.select(F.col("url").alias("r_url"), F.struct(*values).alias("r"), F.col("n_filled").alias("r_filled"), F.col("warnings").alias("r_warnings"))
    problem = again.select(F.col("url").alias("p_url"), "problem")
    joined = static.join(side, static.url == side.r_url, "left").join(problem, static.url == problem.p_url, "left")
    better = F.col("poor") & F.coalesce(F.col("r_filled") > F.col("n_filled"), F.lit(False))
    told = (
        F.when(better, F.concat("r_warnings", F.array(F.lit("The page was rendered with JavaScript."))))
        .when(F.col("poor") & F.col("problem").isNotNull(), F.concat("warnings", F.array(F.concat(F.lit("Rendering failed: "), F.col("problem")))))
        .when(F.col("poor"), F.concat("warnings", F.array(F.lit("Rendering the page did not reveal more data."))))
        .otherwise(F.col("warnings"))
    )
    return joined.select(*names, *[F.when(better, F.col("r")[v]).otherwise(F.col(v)).alias(v) for v in values], told.alias("warnings"))
