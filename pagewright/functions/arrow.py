"""Scalar functions that Spark has no expression for, as plain Python and as Arrow UDFs."""

from __future__ import annotations

import html
import ipaddress
import re
import unicodedata
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = re.compile(r"\s+")
_MARKUP = re.compile(r"<[^>]+>")
_UNENDED = re.compile("&(?=#?[A-Za-z0-9]+(?![A-Za-z0-9;]))")
_META_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_HEADER_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
CHARSET_WINDOW = 4096
_NAT64, _NAT64_LOCAL = ipaddress.ip_network("64:ff9b::/96"), ipaddress.ip_network("64:ff9b:1::/48")


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def mask_unended(text: str, mask: str) -> str:
    """text with mask for the & of each character reference that has no semicolon."""
    return _UNENDED.sub(mask, text)


def clean_text(value: object, limit: int | None = None, unended: bool = True) -> str | None:
    """Markup out, character references decoded, white space collapsed; nothing left is None.

    unended: also references without a semicolon, as the HTML standard does; otherwise these stay as written."""
    if value is None or isinstance(value, dict | list):
        return None
    text = _MARKUP.sub(" ", str(value))
    text = squeeze(html.unescape(text if unended else mask_unended(text, "&amp;")))
    if limit and len(text) > limit:
        kept, _, _ = text[:limit].rpartition(" ")
        text = (kept or text[:limit]).rstrip(" ,;:-") + "…"
    return text or None


def norm_text(text: str | None) -> str | None:
    """Comparable form: compatibility characters and case folded, white space collapsed."""
    return None if text is None else squeeze(unicodedata.normalize("NFKC", text).casefold())


def absolute_url(base: str | None, href: str | None) -> str | None:
    """href against base, if that gives an http(s) address with a host."""
    if not href or not (link := href.strip()):
        return None
    try:
        full = urljoin(base or "", link)
        parts = urlsplit(full)
    except ValueError:
        return None
    return full if parts.netloc and parts.scheme in {"http", "https"} else None


def is_public_ip(text: str | None) -> bool:
    """Whether an address is globally reachable, embedded IPv4 addresses included."""
    try:
        ip = ipaddress.ip_address((text or "").partition("%")[0])
    except ValueError:
        return False
    while ip.version == 6:
        inner = ip.ipv4_mapped or ip.sixtofour or (ip.teredo[1] if ip.teredo else None)
        if inner is None and ip in _NAT64:
            inner = ipaddress.ip_address(int(ip) & 0xFFFFFFFF)
        if inner is None:
            break
        ip = inner
    if ip.version == 6 and ip in _NAT64_LOCAL:
        return False
    return ip.is_global and not ip.is_multicast


def decode_body(body: bytes | None, content_type: str | None) -> str | None:
    """Text of a response: charset of the header, else of a meta element near the top, else UTF-8."""
    if body is None:
        return None
    named = _HEADER_CHARSET.search(content_type or "")
    name = named[1] if named else None
    if name is None and (found := _META_CHARSET.search(body[:CHARSET_WINDOW])):
        name = found[1].decode("ascii", "replace")
    try:
        return body.decode(name or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _each(fn, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    return pa.array([fn(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], kind)


@F.arrow_udf(T.StringType())
def clean_text_udf(value: pa.Array) -> pa.Array:
    return _each(clean_text, pa.string(), value)


@F.arrow_udf(T.StringType())
def norm_text_udf(value: pa.Array) -> pa.Array:
    return _each(norm_text, pa.string(), value)


@F.arrow_udf(T.StringType())
def absolute_url_udf(base: pa.Array, href: pa.Array) -> pa.Array:
    return _each(absolute_url, pa.string(), base, href)


@F.arrow_udf(T.BooleanType())
def is_public_ip_udf(value: pa.Array) -> pa.Array:
    return _each(is_public_ip, pa.bool_(), value)


@F.arrow_udf(T.StringType())
def decode_body_udf(body: pa.Array, content_type: pa.Array) -> pa.Array:
    return _each(decode_body, pa.string(), body, content_type)


def register(spark) -> None:
    """Make the functions available to SQL text."""
    for name, fn in (("pw_clean_text", clean_text_udf), ("pw_norm_text", norm_text_udf), ("pw_absolute_url", absolute_url_udf), ("pw_is_public_ip", is_public_ip_udf), ("pw_decode_body", decode_body_udf)):
        spark.udf.register(name, fn)
