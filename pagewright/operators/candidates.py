"""Candidates for each field from parsed pages, as Catalyst expressions: an array in each row, no shuffle.

A candidate is struct<field, method, rank, value, confidence>; rank is the layer's place, and within a layer only the
first candidate of a field counts. Warnings come as array<string> in layer order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import arrow, vocab
from pagewright.functions import scalars as S

RANK = {m: i for i, m in enumerate(vocab.METHODS)}
CANDIDATE = "struct<field:string,method:string,rank:int,value:string,confidence:string>"
# Labels of specification rows, by field.
LABELS = (
    (r"^(product |overall |item )?(dimensions?|measurements?)( \(.*\))?$", "dimensions"),
    (r"^colou?rs?$", "colour"),
    (r"^(surface )?finish$", "finish"),
    (r"^(main |frame |primary )?materials?$", "material"),
    (r"^(sku|item code|article (number|no\.?)|item (number|no\.?))$", "sku"),
    (r"^brand$", "brand"),
)
# Cells that say nothing.
BLANK_VALUES = ("", "-", "—", "n/a", "na", "none", "tbc", "tba")


def candidate(field: str, method: str, value: Column, confidence: Column | str) -> Column:
    conf = F.lit(confidence) if isinstance(confidence, str) else confidence
    made = F.struct(F.lit(field).alias("field"), F.lit(method).alias("method"), F.lit(RANK[method]).alias("rank"), value.alias("value"), conf.alias("confidence"))
    return F.when(value.isNotNull() & (value != ""), made)


def _set(*candidates: Column) -> Column:
    return F.array_compact(F.array(*candidates)).cast(f"array<{CANDIDATE}>")



def offer_facts(offers: Column) -> Column:
    """What an item's offers say: struct(price, currency, is_range, high, n, lo, hi, any_currency, stock, stocks)."""

    def one(o: Column) -> Column:
        specs = F.filter(F.transform(o.specs, lambda s: F.struct(S.price_text(s.price).alias("p"), F.coalesce(s.currency, o.currency).alias("c"))), lambda s: s.p.isNotNull())
        p, low, spec = S.price_text(o.price), S.price_text(o.low), F.get(specs, F.lit(0))
        return F.struct(
            F.coalesce(p, low, spec.p).alias("p"),
            F.when(p.isNotNull() | low.isNotNull(), o.currency).otherwise(spec.c).alias("c"),
            (p.isNull() & low.isNotNull() & o.is_range).alias("range"),
            S.price_text(o.high).alias("high"),
        )

    def facts(priced: Column) -> Column:
        values = F.transform(priced, lambda x: S.price(x.p))
        by_value = F.array_sort(F.transform(priced, lambda x: F.struct(S.price(x.p).alias("v"), x.p.alias("p"))))
        first = F.get(priced, F.lit(0))
        stocks = F.filter(F.transform(offers, lambda o: S.availability(S.collapse(o.availability))), lambda s: s.isNotNull())
        return F.struct(
            first.p.alias("price"),
            S.currency_from(first.c).alias("currency"),
            F.coalesce(first["range"], F.lit(False)).alias("is_range"),
            first.high.alias("high"),
            F.size(priced).alias("n"),
            F.size(F.array_distinct(values)).alias("n_values"),
            F.get(by_value, F.lit(0)).p.alias("lo"),
            F.get(by_value, F.size(by_value) - 1).p.alias("hi"),
            F.get(F.transform(F.filter(offers, lambda o: o.currency.isNotNull()), lambda o: S.currency_from(o.currency)), F.lit(0)).alias("any_currency"),
            F.get(stocks, F.lit(0)).alias("stock"),
            F.array_sort(F.array_distinct(stocks)).alias("stocks"),
        )

    return S.let(F.filter(F.transform(offers, one), lambda x: x.p.isNotNull()), facts)


def item_layer(item: Column, facts: Column, method: str, base: Column) -> tuple[Column, Column]:
    """(candidates, warnings) of a schema.org item with its offer_facts, at a base confidence."""
    several = facts.is_range | (facts.n_values > 1)
    price_conf = F.when(several, S.lower_confidence(base)).otherwise(base)
    conflict = F.size(facts.stocks) > 1
    plain = [candidate(f, method, item[f], base) for f in ("name", "brand", "sku", "description", "image_url", "colour", "material", "finish", "dimensions")]
    found = _set(
        *plain,
        candidate("price", method, facts.price, price_conf),
        candidate("currency", method, F.when(facts.price.isNotNull(), facts.currency).otherwise(facts.any_currency), F.when(facts.price.isNotNull(), price_conf).otherwise(base)),
        candidate("availability", method, facts.stock, F.when(conflict, S.lower_confidence(base)).otherwise(base)),
    )
    warnings = F.array_compact(
        F.array(
            F.when(facts.is_range, F.concat(F.lit("Price is a range ("), facts.price, F.lit("–"), F.coalesce(facts.high, F.lit("None")), F.lit("); the lowest price was used."))).when(
                facts.n_values > 1,
                F.concat(facts.n.cast("string"), F.lit(" offers with different prices ("), facts.lo, F.lit("–"), facts.hi, F.lit("); the first offer was used.")),
            ),
            F.when(conflict, F.concat(F.lit("Offers disagree on availability ("), F.array_join(facts.stocks, ", "), F.lit("); the first was used."))),
            F.when(item.group_of_variants & (F.size(item.offers) == 0), F.lit("This is a product group with variants; variant prices were not extracted.")),
        )
    )
    none = F.array().cast("array<string>")
    return F.when(item.isNotNull(), found).otherwise(_set()), F.when(item.isNotNull(), warnings).otherwise(none)


def linked_layer(df: DataFrame) -> tuple[Column, Column]:
    """JSON-LD."""
    several = (F.col("ld_products") > 1) & (F.col("ld_choice") != "page")
    found, warnings = item_layer(F.col("ld_product"), F.col("ld_facts"), "jsonld", F.when(several, F.lit("medium")).otherwise(F.lit("high")))
    what = F.when(F.col("ld_choice") == "offers", F.lit("first one with offers")).otherwise(F.lit("first one"))
    own = F.array_compact(
        F.array(
            F.when(F.col("invalid_blocks") > 0, F.concat(F.col("invalid_blocks").cast("string"), F.lit(" JSON-LD block(s) could not be parsed and were skipped."))),
            F.when(several, F.concat(F.col("ld_products").cast("string"), F.lit(" Product nodes found in JSON-LD; used the "), what, F.lit("."))),
        )
    )
    return found, F.concat(own, warnings)


def meta_layer(df: DataFrame) -> tuple[Column, Column]:
    """Open Graph and product meta elements; needs og_image, the image address resolved."""
    pairs = F.map_from_entries(F.col("meta"))
    first = lambda *keys: F.coalesce(*[F.try_element_at(pairs, F.lit(k)) for k in keys])
    price = S.price_text(first("product:price:amount", "og:price:amount"))
    m = "medium"
    found = _set(
        candidate("name", "opengraph", F.col("og_name"), m),
        candidate("description", "opengraph", S.shorten(F.col("og_description"), 2000), m),
        candidate("image_url", "opengraph", F.col("og_image"), m),
        candidate("brand", "opengraph", S.collapse(first("product:brand", "og:brand")), m),
        candidate("sku", "opengraph", S.collapse(first("product:retailer_item_id")), m),
        candidate("colour", "opengraph", S.collapse(first("product:color")), m),
        candidate("material", "opengraph", S.collapse(first("product:material")), m),
        candidate("availability", "opengraph", S.availability(S.collapse(first("product:availability", "og:availability"))), m),
        candidate("price", "opengraph", price, m),
        candidate("currency", "opengraph", F.when(price.isNotNull(), S.currency_from(first("product:price:currency", "og:price:currency"))), m),
    )
    return found, F.array().cast("array<string>")


def embedded_layer(df: DataFrame) -> tuple[Column, Column]:
    """Microdata, or RDFa Lite where there is none."""
    several = F.col("item_products") > 1
    found, warnings = item_layer(F.col("item_product"), F.col("item_facts"), "microdata", F.when(several, F.lit("medium")).otherwise(F.lit("high")))
    own = F.array_compact(F.array(F.when(several, F.concat(F.col("item_products").cast("string"), F.lit(" Product items found in "), F.col("item_syntax"), F.lit(" markup; used the first one.")))))
    return found, F.concat(own, warnings)


def label_field(label: Column, value: Column) -> Column:
    """Field that a specification row is about; null for none."""
    key = F.lower(F.trim(F.regexp_replace(F.trim(label), ":+$", "")))
    field = F.coalesce(*[F.when(key.rlike(pattern), F.lit(name)) for pattern, name in LABELS], F.when((key == "size") & value.rlike(r"(?i)\d+(\.\d+)?\s*(x|×|by)\s*\d+"), F.lit("dimensions")))
    return F.when(~F.lower(value).isin(*BLANK_VALUES), field)


def price_place(prices: Column) -> Column:
    """The first place that shows the current price."""
    fits = lambda p: ~p.struck & (F.length(p.text) <= 60) & p.raw.rlike(r"(?U)\d") & S.price_text(p.raw).isNotNull()
    return F.get(F.filter(prices, fits), F.lit(0))


def html_layer(df: DataFrame) -> tuple[Column, Column]:
    """Plain markup: heading, description, price and stock places, image, specification rows."""
    place = F.col("place")
    currency = F.coalesce(S.currency_from(place.text), S.currency_from(place.currency))
    states = F.filter(F.transform("stocks", lambda s: S.availability(s)), lambda s: s.isin(*vocab.STOCK_STATES))
    rows = F.filter(
        F.transform("specs", lambda s: F.struct(label_field(s.label, F.coalesce(s.value, F.lit(""))).alias("field"), s.value.alias("value"))),
        lambda s: s.field.isNotNull(),
    )
    specs = F.transform(
        rows,
        lambda s: F.struct(s.field.alias("field"), F.lit("html").alias("method"), F.lit(RANK["html"]).alias("rank"), s.value.alias("value"), F.lit("medium").alias("confidence")),
    ).cast(f"array<{CANDIDATE}>")
    found = _set(
        candidate("name", "html", F.col("heading"), "low"),
        candidate("description", "html", F.col("description"), "low"),
        candidate("price", "html", S.price_text(place.raw), "low"),
        candidate("currency", "html", currency, "low"),
        candidate("availability", "html", F.get(states, F.lit(0)), "low"),
        candidate("image_url", "html", F.col("image"), "low"),
    )
    vague = F.when(
        place.isNotNull() & currency.isNull() & S.has_ambiguous_symbol(place.text),
        F.concat(F.lit("Found the price '"), place.text, F.lit("', but its currency symbol is ambiguous; currency left empty.")),
    )
    return F.concat(found, specs), F.array_compact(F.array(vague))


LAYERS = (linked_layer, meta_layer, embedded_layer, html_layer)


def with_candidates(parsed: DataFrame, layers=LAYERS) -> DataFrame:
    """parsed with cands and notes, those of all layers in order. A layer is DataFrame -> (candidates, warnings)."""
    pairs = F.map_from_entries(F.col("meta"))
    first = lambda *keys: F.coalesce(*[F.try_element_at(pairs, F.lit(k)) for k in keys])
    df = parsed.withColumns(
        {
            "og_name": arrow.clean_text_udf(first("og:title")),
            "og_description": arrow.clean_text_udf(first("og:description")),
            "og_image": arrow.absolute_url_udf(F.col("base_url"), first("og:image:secure_url", "og:image", "og:image:url")),
        }
    )
    df = df.withColumns({"ld_facts": offer_facts(F.col("ld_product.offers")), "item_facts": offer_facts(F.col("item_product.offers")), "place": price_place(F.col("prices"))})
    made = [layer(df) for layer in layers]
    return df.withColumns({"cands": F.concat(*[c for c, _ in made]), "notes": F.concat(*[w for _, w in made])})
