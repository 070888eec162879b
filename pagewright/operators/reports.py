"""Reports and spreadsheet cells from product rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import scalars as S
from pagewright.functions import vocab

SHOWN = {"name": 34, "brand": 12, "price_text": 10, "currency": 8, "availability": 14}
HIGHLIGHT = "#ffff00"


def counts(rows: DataFrame) -> DataFrame:
    """rows with n_filled, sources (joined by +) and n_low."""
    found = F.filter(F.map_values("source_method"), lambda v: v.isNotNull())
    return rows.withColumns(
        {
            "n_filled": F.size(found).cast("bigint"),
            "sources": F.array_join(F.array_sort(F.array_distinct(found)), "+"),
            "n_low": F.size(F.filter(F.map_values("confidence"), lambda c: c == "low")).cast("bigint"),
        }
    )


def by_source(rows: DataFrame) -> DataFrame:
    """Fields found by source, most first."""
    return rows.select(F.explode(F.map_values("source_method")).alias("method")).where("method is not null").groupBy("method").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "method")


def table(rows: DataFrame, key: str = "url") -> DataFrame:
    """(key, line): a fixed-width report line for each row."""
    df = counts(rows)
    cells = [S.cell(F.col(c), w) for c, w in SHOWN.items()] + [F.concat(F.col("n_filled").cast("string"), F.lit("/12")), F.col("sources")]
    return df.select(key, F.concat_ws(" ", *cells).alias("line"))


def notes(rows: DataFrame, key: str = "url") -> DataFrame:
    """(key, note): a row for each warning, or one that says there is none."""
    return rows.select(key, F.explode_outer("warnings").alias("note")).withColumn("note", F.coalesce("note", F.lit("no warnings")))


def as_json(rows: DataFrame, *keys: str) -> DataFrame:
    """One JSON object per row: price as text, nulls written."""
    inner = F.struct(*[F.col("price_text").alias("price") if f == "price" else F.col(f) for f in vocab.FIELDS], "source_method", "confidence", "warnings")
    return rows.select(*keys, F.to_json(inner, {"ignoreNullFields": "false"}).alias("json"))


def health(rows: DataFrame, cached: DataFrame | None = None, llm: bool = False, rendering: bool = False) -> DataFrame:
    """One row: how many results are held and what is switched on; no secrets."""
    held = (cached if cached is not None else rows).agg(F.count("*").alias("cached_pages"))
    return held.select(F.lit("ok").alias("status"), "cached_pages", F.lit(llm).alias("llm"), F.lit(rendering).alias("rendering"))


def key_accepted(given: Column, wanted: str | None) -> Column:
    """Access check by digest, so that time doesn't tell how much of a key is right."""
    return F.lit(True) if not wanted else F.coalesce(F.sha2(given, 256) == F.sha2(F.lit(wanted), 256), F.lit(False))


def sheet_cells(rows: DataFrame, columns: dict[str, str], row: str = "row", notes_column: str | None = None) -> DataFrame:
    """(row, col, value, formula, background) for each mapped field of each row; empty cells are written to clear them."""
    made = []
    for field, letters in columns.items():
        text = F.col("price_text" if field == "price" else field)
        is_link = text.rlike(r"(?i)^https?://\S+$") & ~text.contains('"')
        formula = F.when(is_link, F.concat(F.lit('=IMAGE("'), text, F.lit('")'))) if field == "image_url" else F.lit(None).cast("string")
        value = F.when(formula.isNull(), text)
        low = F.try_element_at(F.col("confidence"), F.lit(field)) == "low"
        made.append(F.struct(S.column_number(F.lit(letters)).alias("col"), value.alias("value"), formula.alias("formula"), F.when(text.isNotNull() & low, F.lit(HIGHLIGHT)).alias("background")))
    if notes_column:
        shown = sum((F.when(F.col("price_text" if f == "price" else f).isNotNull(), 1).otherwise(0) for f in columns), F.lit(0))
        text = F.array_join(F.concat(F.array(F.concat(shown.cast("string"), F.lit(" fields found"))), F.col("warnings")), " | ")
        none = F.lit(None).cast("string")
        made.append(F.struct(S.column_number(F.lit(notes_column)).alias("col"), text.alias("value"), none.alias("formula"), none.alias("background")))
    return rows.select(row, F.explode(F.array(*made)).alias("c")).select(row, "c.*")


def sheet_edits(edits: DataFrame, url_column: int, first_row: int = 2, most: int = 10) -> DataFrame:
    """edits(edit_id, row, col, n_cols, value) to those rows that are to be processed: one column, data rows, addresses, so many an edit."""
    from pyspark.sql import Window

    usable = edits.where((F.col("col") == url_column) & (F.col("n_cols") == 1) & (F.col("row") >= first_row) & F.trim("value").rlike(r"(?i)^https?://\S+$"))
    place = F.row_number().over(Window.partitionBy("edit_id").orderBy("row"))
    return usable.withColumn("place", place).where(F.col("place") <= most).drop("place")
