"""Dates in the forms that files and texts carry, as Column functions. Times without a zone are taken as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of EXIF dates, tried in this order.
EXIF_FORMS = ["yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[XXX][XX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss[XXX][XX]", "yyyy:MM:dd HH:mm:ss[XXX][XX]"]
PDF_FORMS = ["yyyyMMddHHmmss", "yyyyMMddHHmm", "yyyyMMdd"]
ISO_FORMS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd"]


def _first(text: Column, forms: list[str]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))


def exif_date(text: Column) -> Column:
    """The first 26 characters as a timestamp, in one of six forms; null if none fits."""
    return _first(F.substring(F.trim(text), 1, 26), EXIF_FORMS)


def pdf_date(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS, with or without D: and with minutes or days as the last part; the zone is dropped."""
    return _first(F.element_at(F.split(F.regexp_replace(F.trim(text), "^D:", ""), "[+\\-Z]"), 1), PDF_FORMS)


def xmp_date(text: Column) -> Column:
    """An ISO date without its zone. (Cutting at each hyphen, which leaves the year alone, would make every such date null.)"""
    return _first(F.regexp_replace(F.trim(text), "(Z|[+\\-][0-9]{2}:?[0-9]{2})$", ""), ISO_FORMS)


def text_dates(text: Column) -> Column:
    """The dates d.m.yyyy or d/m/yyyy of a text from 2000 to 2030, in order; those that no calendar has are left out."""
    pattern = "\\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}\\b"
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.try_to_timestamp(F.translate(s, "/", "."), F.lit("d.M.yyyy")))
    return F.filter(found, lambda t: t.isNotNull() & F.year(t).between(2000, 2030))


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6


def temporal_anomaly(dates: Column, created: Column) -> Column:
    """Risk of the first date that is over a day later (.60) or over a year earlier (.25) than a file's creation, in whole days; null if none is."""
    days = lambda t: F.floor(_seconds(t, created) / 86400)
    risks = F.transform(dates, lambda t: F.when(days(t) > 1, 0.60).when(days(t) < -365, 0.25))
    return F.try_element_at(F.filter(risks, lambda r: r.isNotNull()), F.lit(1))


def date_findings(original: Column, modified: Column, created: Column, xmp: Column, now: Column) -> Column:
    """Rules that a file's dates break: modified before the original, created at another second, XMP a day late, a date to come."""
    late = _seconds(xmp, F.coalesce(original, modified)) > 24 * 3600
    future = F.greatest(original, modified, created, xmp) > now
    rules = {"modified_before_original": modified < original, "created_differs": F.abs(_seconds(created, original)) > 1, "xmp_late": late, "future": future}
    return F.array_compact(F.array(*(F.when(F.coalesce(on, F.lit(False)), F.lit(name)) for name, on in rules.items())))


#: The risk of each finding of dates.
DATE_RISKS = {"modified_before_original": 0.30, "created_differs": 0.15, "xmp_late": 0.10, "future": 0.40}
