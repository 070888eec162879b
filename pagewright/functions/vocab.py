"""Fixed values of the product vocabulary: field names, currencies, stock wording, units."""

from __future__ import annotations

#: Output fields, in merge order.
FIELDS = ("name", "brand", "sku", "price", "currency", "availability", "description", "image_url", "dimensions", "colour", "finish", "material")
GAP_FIELDS = tuple(f for f in FIELDS if f != "image_url")
METHODS = ("jsonld", "opengraph", "microdata", "html", "llm")
STRUCTURED = ("jsonld", "opengraph", "microdata")
CONFIDENCES = ("high", "medium", "low")

# Currency codes that count beside a number.
ISO_CODES = (
    "USD EUR GBP CAD AUD NZD CHF JPY CNY INR SEK NOK DKK PLN CZK HUF RON BGN TRY BRL MXN ZAR "
    "AED SAR ILS KRW SGD HKD THB IDR MYR PHP VND RUB UAH NGN KES EGP ARS CLP COP PEN"
).split()
# Symbols of one currency only, in order of precedence.
SYMBOLS = {
    "€": "EUR", "£": "GBP", "₹": "INR", "₩": "KRW", "₽": "RUB", "₺": "TRY",
    "₦": "NGN", "₪": "ILS", "₫": "VND", "₴": "UAH", "zł": "PLN", "Kč": "CZK",
}
AMBIGUOUS = ("$", "¥")

# Schema.org availability names.
AVAILABILITY = {
    "instock": "in_stock", "onlineonly": "in_stock", "instoreonly": "in_stock",
    "outofstock": "out_of_stock", "soldout": "out_of_stock",
    "preorder": "preorder", "presale": "preorder",
    "backorder": "backorder",
    "limitedavailability": "limited",
    "discontinued": "discontinued",
}
# Shop wording, tried in this order.
AVAILABILITY_WORDING = (
    (r"\b(out of stock|sold out|unavailable|not available)\b", "out_of_stock"),
    (r"\b(pre-?order|available (for|to) pre-?order)\b", "preorder"),
    (r"\b(back-?order)\b", "backorder"),
    (r"\b(low stock|only \d+ left|limited (stock|availability))\b", "limited"),
    (r"\b(in stock|available now|ready to ship|in-stock)\b", "in_stock"),
)
STOCK_STATES = ("in_stock", "out_of_stock", "preorder", "backorder", "limited", "discontinued")
# UN/CEFACT length units.
UNITS = {"CMT": "cm", "MMT": "mm", "MTR": "m", "INH": "in", "FOT": "ft", "YRD": "yd"}
PRODUCT_TYPES = ("product", "productgroup", "individualproduct", "productmodel")
