"""schema.org items, whatever syntax they are written in, as one plain record (see PRODUCT in operators.parse)."""

from __future__ import annotations

import re

from pagewright.functions import vocab
from pagewright.functions.arrow import absolute_url, clean_text

# Price types that name another price than the one to pay.
LIST_PRICE = re.compile(r"list|strikethrough|msrp|rrp|retail", re.I)


def many(value) -> list:
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def kinds(item: dict) -> set[str]:
    """Lower-case type names without vocabulary or prefix."""
    return {re.split("[/:]", str(v))[-1].lower() for v in many(item.get("@type")) if v}


def is_product(item: dict) -> bool:
    return not kinds(item).isdisjoint(vocab.PRODUCT_TYPES)


def texts_of(value):
    """All usable texts of a value: plain ones, and those of value or name objects."""
    for one in many(value):
        if isinstance(one, dict):
            key = next((k for k in ("@value", "name", "value") if k in one), None)
            one = one[key] if key else None
        if not isinstance(one, bool | dict | list) and (text := clean_text(one)):
            yield text


def first_text(value) -> str | None:
    return next(texts_of(value), None)


def all_texts(value) -> str | None:
    return ", ".join(dict.fromkeys(texts_of(value))) or None


def extra_property(item: dict, pattern: str) -> str | None:
    named = (p for p in many(item.get("additionalProperty")) if isinstance(p, dict))
    found = (first_text(p.get("value")) for p in named if re.search(pattern, first_text(p.get("name")) or "", re.I))
    return next(filter(None, found), None)


def quantity(value) -> str | None:
    if not isinstance(value, dict):
        return first_text(value)
    number = first_text(value["value"] if "value" in value else value.get("@value"))
    code = value.get("unitCode")
    unit = first_text(value.get("unitText")) or vocab.UNITS.get(str(code or "").upper()) or first_text(code)
    return f"{number} {unit or ''}".strip() if number else None


def size(item: dict) -> str | None:
    sides = ((mark, quantity(item.get(side))) for mark, side in zip("WHD", ("width", "height", "depth"), strict=True))
    return extra_property(item, r"dimension|measurement") or " × ".join(f"{mark} {q}" for mark, q in sides if q) or None


def flat_offers(item: dict) -> list[dict]:
    """Offers in document order: inner ones before the aggregate that holds them, currency handed down."""
    out: list[dict] = []
    stack = [("open", o, None) for o in reversed(many(item.get("offers")))]
    while stack:
        what, offer, currency = stack.pop()
        if not isinstance(offer, dict):
            continue
        if what == "emit":
            out.append({**offer, "priceCurrency": currency})
            continue
        currency = offer.get("priceCurrency") or currency
        inner = many(offer.get("offers"))
        if not inner or "aggregateoffer" in kinds(offer):
            stack.append(("emit", offer, currency))
        stack.extend(("open", o, currency) for o in reversed(inner))
    return out


def offer_record(offer: dict) -> dict:
    low, high = offer.get("lowPrice"), offer.get("highPrice")
    specs = (s for s in many(offer.get("priceSpecification")) if isinstance(s, dict) and not LIST_PRICE.search(str(s.get("priceType") or "")))
    stock = next(filter(None, (first_text(v["@id"] if isinstance(v, dict) and "@id" in v else v) for v in many(offer.get("availability")))), None)
    return {
        "price": first_text(offer.get("price")),
        "low": first_text(low),
        "high": first_text(high),
        "is_range": high is not None and high != low,
        "specs": [{"price": first_text(s.get("price")), "currency": first_text(s.get("priceCurrency"))} for s in specs],
        "currency": first_text(offer.get("priceCurrency")),
        "availability": stock if offer.get("availability") else None,
    }


def product_record(item: dict, base: str) -> dict:
    def image():
        for one in many(item.get("image")):
            link = (one.get("url") or one.get("contentUrl")) if isinstance(one, dict) else one
            if isinstance(link, str) and (full := absolute_url(base, link)):
                return full
        return None

    return {
        "name": first_text(item.get("name")),
        "brand": first_text(item.get("brand")),
        "sku": first_text(item.get("sku")),
        "description": clean_text(first_text(item.get("description")), 2000),
        "image_url": image(),
        "colour": all_texts(item["color"] if "color" in item else item.get("colour")) or extra_property(item, r"^colou?r"),
        "material": all_texts(item.get("material")) or extra_property(item, r"^material"),
        "finish": extra_property(item, r"finish"),
        "dimensions": size(item),
        "group_of_variants": "productgroup" in kinds(item) and bool(item.get("hasVariant")),
        "offers": [offer_record(o) for o in flat_offers(item)],
    }
