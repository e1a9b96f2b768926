"""Scalar expressions shared by the operators. All are built-in column expressions, so plans stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters a token is made of. Long-vowel and iteration marks, accented and full-width letters split.
TOKEN = "[一-龥ぁ-んァ-ンa-zA-Z0-9]+"
#: White space that a strip removes, Unicode's included.
_BLANK = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def col(c: Column | str) -> Column:
    """A column by name, or itself."""
    return F.col(c) if isinstance(c, str) else c


def truthy(c: Column | str) -> Column:
    """The text, or NULL where it is NULL or empty."""
    return F.nullif(col(c), F.lit(""))


def first_truthy(*columns: Column | str, default: str | None = None) -> Column:
    """The first text that is neither NULL nor empty (``a or b``)."""
    return F.coalesce(*map(truthy, columns), *([] if default is None else [F.lit(default)])) if len(columns) > 1 or default is not None else truthy(columns[0])


def path(c: Column | str, default: object = None) -> Column:
    """A nested field with a default; any NULL on the way gives the default."""
    return F.coalesce(col(c), F.lit(default)) if default is not None else col(c)


def first_of(array: Column | str, *fields: str, default: object = None) -> Column:
    """A field of an array's first element; an empty or NULL array gives the default and raises nothing."""
    value = F.get(col(array), 0)
    for f in fields:
        value = value[f]
    return path(value, default)


def whole_amount(c: Column | str, default: int = 0) -> Column:
    """A number cut to an integer toward zero; NULL and text that is no number give the default."""
    return F.coalesce(col(c).try_cast("double").try_cast("bigint"), F.lit(default))


def prefix(c: Column | str, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(col(c), 1, n)


def clipped(c: Column | str, n: int, tail: str = "...") -> Column:
    """The first ``n`` code points and the tail, which follows even where nothing was cut; NULL stays NULL."""
    return F.concat(prefix(c, n), F.lit(tail))


def clamp(c: Column | str, low: float, high: float) -> Column:
    """The value kept within bounds; NULL stays NULL."""
    value = col(c)
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))


def int_option(c: Column | str, default: int, low: int, high: int) -> Column:
    """An integer option given as text: the default where it is missing, empty or no integer, else clamped."""
    raw = F.trim(truthy(c))
    number = F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("bigint"))
    return F.when(number.isNull(), F.lit(default)).otherwise(clamp(number, low, high)).cast("int")


def contains_any(c: Column | str, words: Iterable[str]) -> Column:
    """Whether the text holds one of the words, as written; NULL holds none."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(col(c), F.lit(w))
    return F.coalesce(found, F.lit(False))


def matches(c: Column | str, pattern: str) -> Column:
    """Whether a pattern is found in the text; NULL matches nothing."""
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def tokens(c: Column | str) -> Column:
    """All tokens of the text, in order; none for NULL."""
    return F.coalesce(F.regexp_extract_all(col(c), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def token_set(c: Column | str) -> Column:
    """The distinct tokens of the text."""
    return F.array_distinct(tokens(c))


def overlap(a: Column | str, b: Column | str) -> Column:
    """How many distinct tokens two texts share."""
    return F.size(F.array_intersect(tokens(a), tokens(b)))


def percent_encoded(c: Column | str) -> Column:
    """The text with every byte but unreserved characters percent-encoded: ``url_encode`` with three repairs."""
    encoded = F.url_encode(col(c))
    for mark, form in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(mark), F.lit(form))
    return encoded


def referral(c: Column | str, base: str, site: str, partner: str, domain: str) -> Column:
    """A referral URL around the URL, unless it leads through the referral domain already or an identity is missing."""
    url = col(c)
    if not site or not partner:
        return url
    made = F.concat(F.lit(f"{base}?sid={site}&pid={partner}&vc_url="), percent_encoded(url))
    return F.when(F.contains(url, F.lit(domain)), url).otherwise(made)


def after_last(c: Column | str, mark: str) -> Column:
    """What follows the last mark; the whole text where there is none."""
    return F.element_at(F.split(col(c), F.lit("\\Q" + mark + "\\E")), -1)


def stripped(c: Column | str) -> Column:
    """The text without white space at its ends, Unicode's included."""
    return F.regexp_replace(col(c), f"^[{_BLANK}]++|(?<![{_BLANK}])[{_BLANK}]++$", "")


def stem(c: Column | str) -> Column:
    """A file name without its folder and last extension."""
    name = after_last(c, "/")
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def heading_from_name(c: Column | str) -> Column:
    """A hyphenated name as a title."""
    return F.initcap(F.replace(col(c), F.lit("-"), F.lit(" ")))


def secure(c: Column | str) -> Column:
    """A plain-text web address made secure; an empty or other address stays."""
    return F.when(F.startswith(col(c), F.lit("http://")), F.replace(col(c), F.lit("http://"), F.lit("https://"))).otherwise(col(c))


def traffic_number(c: Column | str) -> Column:
    """The number in a text such as ``50,000+``; NULL where there is none."""
    return F.regexp_replace(col(c), "[^0-9]", "").try_cast("bigint")


def offset_time(ts: Column | str, zone_offset: str = "+09:00") -> Column:
    """A timestamp without a zone as ISO text with a literal offset."""
    return F.concat(F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone_offset))


def text(c: Column | str) -> Column:
    """A value as text, empty for NULL, so that it can stand in a concatenation."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def page_of(place: Column | str, size: int = 10) -> Column:
    """The page, from 1, on which the row with this place, from 1, stands."""
    return (F.floor((col(place) - 1) / size) + 1).cast("int")


def map_value(c: Column | str, key: Column | str, default: object = None) -> Column:
    """A map's value, or the default where the key is missing or NULL stands under it."""
    return path(F.try_element_at(col(c), col(key) if isinstance(key, Column) else F.lit(key)), default)
