"""Scalar functions as Catalyst expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import vocab

PRICE = "decimal(38,10)"
_NUMBER = "(?U)\\d[\\d.,  ' ]*\\d|\\d"


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def price_text(raw: Column) -> Column:
    """Canonical text of the first number in a string, scale kept; null where its separators could mean two things."""

    def one_kind(num: Column, plain: Column) -> Column:
        return let(
            F.regexp_extract(num, r"^(.*)[.,][^.,]*$", 1),
            lambda head: let(
                F.length(num) - F.length(head) - 1,
                lambda tail: F.when(tail <= 2, F.translate(num, ",", "."))
                .when((tail == 3) & num.contains(",") & F.length(head).between(1, 3) & (head != "0"), plain),
            ),
        )

    def read(num: Column) -> Column:
        plain = F.translate(num, ".,", "")
        seps = F.length(num) - F.length(plain)
        both = num.contains(".") & num.contains(",")
        point_last = num.rlike(r"\.[^.,]*$")
        return (
            F.when(both, F.when(point_last, F.translate(num, ",", "")).otherwise(F.translate(num, ",.", ".")))
            .when(seps == 0, num)
            .when(seps > 1, plain)
            .otherwise(one_kind(num, plain))
        )

    num = F.translate(F.regexp_extract(raw, _NUMBER, 0), "\u00a0\u202f' ", "")
    return let(let(num, read), lambda v: F.when(v.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.regexp_replace(v, r"^0+(?=[0-9])", "")))


def price(text: Column) -> Column:
    return text.try_cast(PRICE)


def currency_from(raw: Column) -> Column:
    """An ISO code or a symbol of one currency found in the text."""
    codes = F.array(*map(F.lit, vocab.ISO_CODES))

    def read(s: Column) -> Column:
        whole = F.when(s.rlike("^[A-Za-z]{3}$") & F.array_contains(codes, F.upper(s)), F.upper(s))
        named = F.get(F.filter(F.regexp_extract_all(s, F.lit(r"(?U)\b([A-Z]{3})\b"), F.lit(1)), lambda c: F.array_contains(codes, c)), F.lit(0))
        return F.coalesce(whole, named, *[F.when(s.contains(sym), F.lit(code)) for sym, code in vocab.SYMBOLS.items()])

    return let(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), read)


def has_ambiguous_symbol(raw: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (raw.contains(s) for s in vocab.AMBIGUOUS)) & currency_from(raw).isNull(), F.lit(False))


def collapse(raw: Column) -> Column:
    """White space runs become one space; empty becomes null."""
    out = F.regexp_replace(F.regexp_replace(raw, r"(?U)\s+", " "), "^ | $", "")
    return F.when(out != "", out)


def shorten(text: Column, limit: int) -> Column:
    """At most limit characters: the last partial word and trailing punctuation go, an ellipsis comes."""
    cut = F.substring(text, 1, limit)
    word = F.when(cut.contains(" "), F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)).otherwise(cut)
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(word, "[ ,;:-]+$", ""), F.lit("…"))).otherwise(text)


def availability(clean: Column) -> Column:
    """Vocabulary word for cleaned wording or a schema.org address; unknown wording stays as it is."""
    table = F.create_map(*[F.lit(x) for pair in vocab.AVAILABILITY.items() for x in pair])

    def read(text: Column) -> Column:
        key = F.regexp_replace(F.lower(F.substring_index(text, "/", -1)), "[^a-z]", "")
        worded = [F.when(text.rlike(f"(?iU){pattern}"), F.lit(value)) for pattern, value in vocab.AVAILABILITY_WORDING]
        return F.coalesce(F.try_element_at(table, key), *worded, text)

    return let(shorten(clean, 120), read)


def lower_confidence(value: Column) -> Column:
    return F.when(value == "high", F.lit("medium")).when(value.isNotNull(), F.lit("low"))


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, user, host, port (text), path, query of an address with an authority; null where there is none."""
    at = lambda k: F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^:/?#\[\]]*)(:[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$", k)
    return {"scheme": F.lower(at(1)), "user": at(2), "host": F.lower(at(3)), "port": F.substring(at(4), 2, 10), "path": at(5), "query": at(6)}


def cache_key(url: Column) -> Column:
    """One key for the spellings of an address: case of scheme and host, default port, user, fragment, empty path."""
    p = url_parts(url)
    default = F.when(p["scheme"] == "https", F.lit("443")).otherwise(F.lit("80"))
    host = F.regexp_replace(p["host"], r"[\[\]]", "")
    port = F.when((p["port"] == "") | (p["port"] == default), F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))
    path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
    query = F.when(p["query"] == "?", F.lit("")).otherwise(p["query"])
    return F.concat(p["scheme"], F.lit("://"), host, port, path, query)


def column_number(letters: Column) -> Column:
    """Spreadsheet column: A is 1, AA is 27; null unless one to three letters."""
    value = F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, c: acc * 26 + (F.ascii(c) - 64))
    return F.when(letters.rlike("^[A-Za-z]{1,3}$"), value)


def cell(value: Column, width: int) -> Column:
    """Report cell of fixed width: a dash for null, an ellipsis for what doesn't fit."""
    text = F.coalesce(value, F.lit("–"))
    return F.rpad(F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text), width, " ")


def in_text(needle: Column, text: Column, strict: bool = False) -> Column:
    """Whether the needle stands in the text as a whole token; strict: not beside a hyphen or slash either."""
    edge = r"\w/-" if strict else r"\w"
    quoted = F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(needle == "", F.lit(False)).otherwise(F.rlike(text, F.concat(F.lit(f"(?U)(?<![{edge}])"), quoted, F.lit(f"(?![{edge}])"))))


def prices_in_text(text: Column) -> Column:
    """Canonical prices that stand beside a currency symbol or code, in any case; a mark serves one number, read from the left."""
    symbols = "|".join(f"\\Q{s}\\E" for s in [*vocab.SYMBOLS, *vocab.AMBIGUOUS])
    mark = f"(?:{symbols}|(?<![A-Za-z])(?:{'|'.join(vocab.ISO_CODES)})(?![A-Za-z]))"
    num = "\\d(?:[\\d.,  ' ]*\\d)?"
    both = F.lit(f"(?iU){mark}\\s?({num})|({num})\\s?{mark}")
    found = F.concat(F.regexp_extract_all(text, both, F.lit(1)), F.regexp_extract_all(text, both, F.lit(2)))
    return F.array_distinct(F.filter(F.transform(found, lambda n: price(price_text(n))), lambda p: p.isNotNull()))
