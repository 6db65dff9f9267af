"""Column functions that several plans share. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def module_band(score: Column) -> Column:
    """Risk level of one module's score."""
    return F.when(score >= 0.75, "Critical").when(score >= 0.5, "High").when(score >= 0.25, "Medium").otherwise("Low")


def fused_band(score: Column, critical: float = 0.85, high: float = 0.40, medium: float = 0.20) -> Column:
    """Risk level of a fused score."""
    return F.when(score >= critical, "Critical").when(score >= high, "High").when(score >= medium, "Medium").otherwise("Low")


def url_host(url: Column) -> Column:
    """Host of a URL, or the text itself where it is none."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def extension(name: Column) -> Column:
    """File extension in lower case without its dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^.\\/]*)$", 1))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, with 1e-8 added to the denominator."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-8))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit values."""
    return F.bit_count(a.bitwiseXOR(b))


def hex_bits(h: Column) -> Column:
    """A 64-bit value from 16 hex digits; base -10 keeps values of 2^63 and more."""
    return F.conv(h, 16, -10).cast("long")


def mod_11_10(digits: Column) -> Column:
    """Whether 11 digits carry a right check digit by ISO 7064 MOD 11,10."""

    def rest(r: Column, i: Column) -> Column:
        t = (r + F.substring(digits, i, F.lit(1)).cast("int")) % 10
        return (F.when(t == 0, 10).otherwise(t) * 2) % 11

    r = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(10), rest)
    check = F.when(11 - r == 10, 0).otherwise(11 - r)
    return check == F.substring(digits, F.lit(11), F.lit(1)).cast("int")


def mod_97_iban(iban: Column, country_digits: str = "1727") -> Column:
    """Whether a 21-character IBAN of a country (its letters as digits) has right check digits."""
    number = F.concat(F.substring(iban, F.lit(5), F.lit(17)), F.lit(country_digits), F.substring(iban, F.lit(3), F.lit(2)))
    return F.coalesce(number.try_cast("decimal(38,0)") % 97 == 1, F.lit(False))


def amount(text: Column) -> Column:
    """A money amount: the last separator is the decimal one; null if it isn't a number above 0."""
    comma, dot = F.length(text) - F.instr(F.reverse(text), ","), F.length(text) - F.instr(F.reverse(text), ".")
    has = lambda s: F.instr(text, s) > 0
    continental = has(",") & (~has(".") | (comma > dot))
    plain = F.when(continental, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit("")))
    value = plain.try_cast("double")
    return F.when(value > 0, value)


def mask(text: Column, first: int, stars: int, last: int) -> Column:
    return F.concat(F.substring(text, 1, first), F.lit("*" * stars), F.right(text, F.lit(last)))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
