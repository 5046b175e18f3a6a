"""Expressions that bring single values into a standard form; each gives null for what it doesn't understand."""

from __future__ import annotations

import zlib
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Shapes of dates, times and addresses.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,3})?)?(?:Z|[+-]\d{2}:?\d{2})$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
#: Units after a number, currency codes, and the codes of symbols in the order they are looked for.
UNITS = {"thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "billion": 1e9, "b": 1e9, "trillion": 1e12, "t": 1e12}
CODES = ("USD", "EUR", "GBP", "INR", "JPY", "CAD", "AUD", "CNY")
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "¥": "JPY"}
#: Characters that a number may have with any unit and stay within a double.
SHORT = 280
#: Names that differ from those of the Java library, and codes that it lacks: reserved, regional and former ones.
RENAMED = {
    "AC": "Ascension Island", "AN": "Curaçao", "BU": "Myanmar (Burma)", "CP": "Clipperton Island", "CQ": "Sark", "CS": "Serbia", "DD": "Germany", "DG": "Diego Garcia", "DY": "Benin", "EA": "Ceuta & Melilla", "EU": "European Union",
    "EZ": "Eurozone", "FX": "France", "HV": "Burkina Faso", "IC": "Canary Islands", "NH": "Vanuatu", "QO": "Outlying Oceania", "RH": "Zimbabwe", "SU": "Russia", "TA": "Tristan da Cunha", "TP": "Timor-Leste", "TR": "Türkiye",
    "UK": "United Kingdom", "UN": "United Nations", "VD": "Vietnam", "XA": "Pseudo-Accents", "XB": "Pseudo-Bidi", "XK": "Kosovo", "YD": "Yemen", "YU": "Serbia", "ZR": "Congo - Kinshasa",
}


@lru_cache
def countries() -> dict[str, str]:
    """English names of all ISO 3166-1 alpha-2 regions, territories included, by the locale data of the session's Java."""
    locale = SparkSession.active()._jvm.java.util.Locale
    return {code: locale("", code).getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()} | RENAMED


def iso_date(c: Column) -> Column:
    """An ISO date that exists as it is; an ISO time with a zone in UTC with milliseconds."""
    day = F.when(c.try_cast("date").isNotNull(), c)
    with_seconds = F.regexp_replace(c, r"T(\d{2}:\d{2})(Z|[+-])", "T$1:00$2")
    at = F.try_to_timestamp(F.regexp_replace(with_seconds, r"([+-]\d{2})(\d{2})$", "$1:$2"))
    return F.when(c.rlike(ISO_DATE), day).when(c.rlike(ISO_TIME), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def is_date(c: Column, with_time: bool = False) -> Column:
    """Whether a text is a valid ISO date, or time."""
    if with_time:
        return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}T") & F.try_to_timestamp(c).isNotNull(), F.lit(False))
    return F.coalesce(c.rlike(ISO_DATE) & c.try_cast("date").isNotNull(), F.lit(False))


def phone(c: Column) -> Column:
    """7 to 15 digits, with a leading plus if there was one."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(F.length(digits).between(7, 15), F.concat(F.when(F.trim(c).startswith("+"), "+").otherwise(""), digits))


def _lookup(keys, values) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(v) for v in values]))


def number(c: Column) -> Column:
    """The one number in a text, times its unit; null beyond what a double can hold.

    What is kept of a text converts only if it is a plain number. A unit is looked for where a
    letter that begins one follows a digit, and only long texts can pass a double's range.
    """
    found = F.lower(F.regexp_extract(c, r"(?i)\d[\d,]*(?:\.\d+)?\s*(thousand|million|billion|trillion|k|m|b|t)\b", 1))
    times = F.when(c.rlike(r"[\d,]\s*[kmbtKMBT]"), F.coalesce(F.try_element_at(_lookup(UNITS, UNITS.values()), found), F.lit(1.0))).otherwise(1.0)
    value = F.regexp_replace(c, r"[^0-9.+-]+", "").try_cast("double") * times
    return F.when(F.length(c) <= SHORT, value).when(F.abs(value) < float("inf"), value)


def plain_number(n: Column) -> Column:
    """Shortest text of a number: without a fraction if it is integral."""
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("decimal(20,0)").cast("string")).otherwise(n.cast("string"))


def currency_code(c: Column) -> Column:
    """A named code, else that of the first known symbol."""
    named = F.upper(F.regexp_extract(c, r"(?i)\b(" + "|".join(CODES) + r")\b", 1))
    symbol = F.lit(None).cast("string")
    for sign, code in reversed(SYMBOLS.items()):
        symbol = F.when(c.contains(sign), code).otherwise(symbol)
    return F.coalesce(F.when(named != "", named), symbol)


def currency(c: Column) -> Column:
    """Code and amount."""
    return F.concat_ws(" ", currency_code(c), F.when(number(c).isNotNull(), plain_number(number(c))))


def _found(pairs: dict[str, str], key: Column, buckets: int = 256) -> Column:
    """A key's value, null if it has none: an array of small maps by checksum, as a look-up in a map reads all its keys."""
    held: list[dict[str, str]] = [{} for _ in range(buckets)]
    for k, v in pairs.items():
        held[zlib.crc32(k.encode()) % buckets][k] = v
    tables = F.array(*[_lookup(h, h.values()) if h else F.create_map().cast("map<string,string>") for h in held])
    return F.try_element_at(F.get(tables, (F.crc32(key.cast("binary")) % buckets).cast("int")), key)


def country(c: Column) -> Column:
    """English name of a country's code or name; other texts as they are."""
    folded, names = F.lower(F.regexp_replace(F.trim(c), r"[.]", "")), countries()
    by_code, by_name = {k.lower(): v for k, v in names.items()}, {v.lower(): v for v in names.values()}
    return F.coalesce(_found(by_name | by_code, folded), F.trim(c))


def is_country(c: Column) -> Column:
    known = [k.lower() for k in countries()] + [v.lower() for v in countries().values()]
    return F.coalesce(F.lower(F.trim(c)).isin(*known), F.lit(False))


def rounded(c: Column, places: int = 4) -> Column:
    """Half up, as the score columns are stored."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
