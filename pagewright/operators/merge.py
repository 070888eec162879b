"""Merge of candidates: first layer wins, currencies are borrowed only on agreement, disagreements are reported.

Works on an array of candidates in each row, so that merging needs no shuffle; from_long() brings candidates in long
form into that shape with one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import scalars as S
from pagewright.functions import vocab
from pagewright.operators.candidates import CANDIDATE

COMPARED = ("price", "currency", "sku")


def from_long(cands: DataFrame, key: str = "url") -> DataFrame:
    """(key, rank, seq, field, method, value, confidence) rows to (key, cands), in order of rank and seq."""
    item = F.struct("rank", "seq", F.struct("field", "method", "rank", "value", "confidence").cast(CANDIDATE).alias("c"))
    usable = cands.where("value is not null and value <> ''")
    return usable.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.c).alias("cands"))


def first_of(cands: Column, field: str) -> Column:
    return F.get(F.filter(cands, lambda c: c.field == field), F.lit(0))


def _same(field: str, a: Column, b: Column) -> Column:
    return S.price(a) == S.price(b) if field == "price" else F.lower(F.upper(a)) == F.lower(F.upper(b))


def pick(cands: Column, field: str) -> Column:
    """The candidate that a field takes."""
    if field != "currency":
        return first_of(cands, field)
    price = first_of(cands, "price")
    allowed = F.filter(
        cands,
        lambda c: (c.field == "currency")
        & (
            price.isNull()
            | (c.method == price.method)
            | F.exists(_firsts(cands, "price"), lambda p: (p.method == c.method) & F.coalesce(_same("price", p.value, price.value), F.lit(False)))
        ),
    )
    return F.get(allowed, F.lit(0))


def _firsts(cands: Column, field: str) -> Column:
    """First candidate of a field in each layer."""
    own = F.filter(cands, lambda c: c.field == field)
    return F.filter(own, lambda c, i: (i == 0) | (F.get(own, i - 1).method != c.method))


def clash(cands: Column, chosen: Column, field: str) -> Column:
    """The first structured layer's candidate that says something else."""
    other = F.filter(
        _firsts(cands, field),
        lambda c: c.method.isin(*vocab.STRUCTURED) & (c.method != chosen.method) & ~F.coalesce(_same(field, c.value, chosen.value), F.lit(False)),
    )
    return F.when(chosen.isNotNull(), F.get(other, F.lit(0)))


def merged(df: DataFrame, cands: str = "cands", notes: str = "notes") -> DataFrame:
    """df with a struct column for each field (value, method, confidence) and the notes of disagreements added."""
    df = df.withColumns({f"f_{f}": pick(F.col(cands), f) for f in vocab.FIELDS})
    df = df.withColumns({f"x_{f}": clash(F.col(cands), F.col(f"f_{f}"), f) for f in COMPARED})
    told = []
    for f in COMPARED:
        a, b = F.col(f"f_{f}"), F.col(f"x_{f}")
        told.append(F.when(b.isNotNull(), F.concat(F.lit(f"{f} differs between sources: "), a.method, F.lit(" says "), a.value, F.lit(", "), b.method, F.lit(" says "), b.value, F.lit(" ("), a.method, F.lit(" was used)."))))
    lowered = {
        f"f_{f}": F.when(
            F.col(f"x_{f}").isNotNull() & (F.col(f"f_{f}.confidence") == "high"), F.col(f"f_{f}").withField("confidence", F.lit("medium"))
        ).otherwise(F.col(f"f_{f}"))
        for f in COMPARED
    }
    df = df.withColumn(notes, F.concat(F.col(notes), F.array_compact(F.array(*told))))
    return df.withColumns(lowered).drop(*[f"x_{f}" for f in COMPARED])


def gaps() -> Column:
    """Fields still missing that free text could fill, in order."""
    return F.array_compact(F.array(*[F.when(F.col(f"f_{f}").isNull(), F.lit(f)) for f in vocab.GAP_FIELDS]))


def overlay(df: DataFrame, filled: str = "filled") -> DataFrame:
    """Fill absent fields from a map of verified values."""
    made = {}
    for f in vocab.GAP_FIELDS:
        value = F.try_element_at(F.col(filled), F.lit(f))
        new = F.struct(F.lit(f).alias("field"), F.lit("llm").alias("method"), F.lit(vocab.METHODS.index("llm")).alias("rank"), value.alias("value"), F.lit("low").alias("confidence")).cast(CANDIDATE)
        made[f"f_{f}"] = F.coalesce(F.col(f"f_{f}"), F.when(value.isNotNull(), new))
    return df.withColumns(made)


def summary_notes(notes: str = "notes") -> Column:
    """Notes with what is missing altogether: nothing at all comes first, a missing name or price last."""
    nothing = ~_any_found()
    missing = [F.when(~nothing & F.col(f"f_{f}").isNull(), F.lit(f"No {f} was found on the page.")) for f in ("name", "price")]
    head = F.when(nothing, F.lit("No product data was found on this page."))
    return F.array_distinct(F.array_compact(F.concat(F.array(head), F.col(notes), F.array(*missing))))


def _any_found() -> Column:
    return F.coalesce(*[F.col(f"f_{f}.field") for f in vocab.FIELDS]).isNotNull()


def n_filled() -> Column:
    return sum((F.when(F.col(f"f_{f}").isNotNull(), 1).otherwise(0) for f in vocab.FIELDS), F.lit(0))


def product_rows(df: DataFrame, *keep: str, notes: str = "notes") -> DataFrame:
    """Typed product rows: a column a field, maps of source and confidence, warnings."""
    keys = F.array(*map(F.lit, vocab.FIELDS))
    value = {f: F.col(f"f_{f}.value") for f in vocab.FIELDS}
    cols = []
    for f in vocab.FIELDS:
        if f == "price":
            cols += [value[f].alias("price_text"), S.price(value[f]).alias("price")]
        else:
            cols.append(value[f].alias(f))
    return df.select(
        *keep,
        *cols,
        F.map_from_arrays(keys, F.array(*[F.col(f"f_{f}.method") for f in vocab.FIELDS])).alias("source_method"),
        F.map_from_arrays(keys, F.array(*[F.col(f"f_{f}.confidence") for f in vocab.FIELDS])).alias("confidence"),
        summary_notes(notes).alias("warnings"),
    )
