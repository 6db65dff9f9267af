"""Contents of documents: fiscal codes, tax lines and dates, on texts that are made from keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import dates
from claimlens.functions.columns import amount
from claimlens.plans.texts import invoice_checks
from claimlens.sources.tables import table

#: The patterns of fiscal codes, invoices, amounts and tax lines.
JIR = "(?i)\\b([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\\b"
ZKI = "(?i)\\b([0-9a-f]{32})\\b"
INVOICE = "(?i)\\b(ra[cč]un|faktura|r-[0-9]|ra[cč]un\\s*br|invoice)\\b"
AMOUNT = "([0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2})"
VAT = "(?i)\\b(?:PDV|VAT|porez)\\s*(?:\\(?\\s*([0-9]{1,2})\\s*%\\s*\\)?)"


def fiscal_finding(text: Column) -> Column:
    """Code and risk of a document's fiscal codes: both are there, one alone, or none on an invoice; null else."""
    jir, zki = text.rlike(JIR), text.rlike(ZKI)
    finding = lambda code, risk: F.struct(F.lit(code).alias("code"), F.lit(risk).alias("risk"))
    return F.when(jir & zki, finding("valid", -0.05)).when(jir | zki, finding("incomplete", 0.50)).when(text.rlike(INVOICE), finding("missing", 0.35))


def vat_inconsistent(text: Column, total: Column) -> Column:
    """Whether the first amount below the total on the tax lines is over 5 % off what the first stated rate (5 to 30 %) gives; null without one."""
    rate = F.nullif(F.regexp_extract(text, VAT, 1), F.lit("")).cast("int") / 100.0
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(VAT))
    found = F.flatten(F.transform(lines, lambda s: F.transform(F.regexp_extract_all(s, F.lit(AMOUNT), F.lit(1)), lambda a: amount(a))))
    stated = F.try_element_at(F.filter(found, lambda a: a < total), F.lit(1))
    expected = total / (1 + rate) * rate
    return F.when(rate.between(0.05, 0.30), F.abs(stated - expected) / F.greatest(expected, F.lit(0.01)) > 0.05)


def fiscal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    h = F.md5(k.cast("string"))
    uuid = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Račun br. 7\nJIR: "), uuid, F.lit("\nZKI: "), h)).when(k % 5 == 1, F.concat(F.lit("Racun, JIR "), F.upper(uuid)))
        .when(k % 5 == 2, F.concat(F.lit("ZKI:"), F.upper(h))).when(k % 5 == 3, F.lit("Faktura bez kodova")).otherwise(F.concat(F.lit("tekst bez "), h, F.lit("0")))
    )
    rows = table(spark, sf_dir, "customer").select(fiscal_finding(text).alias("f"))
    return rows.groupBy(F.col("f.code").alias("code"), F.col("f.risk").alias("risk")).agg(F.count("*").alias("n"))


def vat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices whose tax is right, 2 % off or 10 % off by key, and some whose rate is out of bounds."""
    k = F.col("c_custkey")
    net = (k % 7 + 1) * 100
    vat = net / 4 * F.when(k % 3 == 0, 1.1).when(k % 3 == 1, 1.02).otherwise(1.0)
    money = lambda x: F.replace(F.format_string("%.2f", x), F.lit("."), F.lit(","))
    rate = F.when(k % 11 == 0, "3").otherwise("25")
    text = F.concat(F.lit("Usluga "), money(net.cast("double")), F.lit("\nPDV ("), rate, F.lit("%): "), money(vat), F.lit("\nUkupno "), money(net * 1.25), F.lit(" EUR"))
    docs = table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text"))
    checked = docs.join(invoice_checks(docs).select("doc_id", "total"), "doc_id")
    return checked.select("doc_id", "total", vat_inconsistent(F.col("text"), F.col("total")).alias("inconsistent"))


def text_date_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in texts against the file's creation at noon of 10 January 2024."""
    k = F.col("c_custkey")
    said = F.element_at(F.array(*map(F.lit, ["12.01.2024", "5.1.2024, 15/01/2024 i 1.1.2020", "1.1.2022", "31.02.2024, 01.01.1999"])), (k % 4 + 1).cast("int"))
    created = dates.pdf_date(F.lit("D:20240110120000+01'00'"))
    risk = dates.temporal_anomaly(dates.text_dates(F.concat(F.lit("Datum: "), said)), created)
    return table(spark, sf_dir, "customer").select((k % 4).alias("kind"), risk.alias("risk")).groupBy("kind", "risk").agg(F.count("*").alias("n"))


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times that are written in ten forms and read again: how many are read, and how many are the time itself."""
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    write = lambda form, behind="": F.concat(F.date_format(ts, form), F.lit(behind))
    k = F.col("event_id") % 10
    exif = [write("yyyy:MM:dd HH:mm:ss"), write("yyyy-MM-dd'T'HH:mm:ss"), write("yyyy-MM-dd'T'HH:mm:ss", "+00:00"), write("yyyy-MM-dd HH:mm:ss", "+0000"), write("yyyy:MM:dd HH:mm", ":xx")]
    text = exif[4]
    for i in range(4):
        text = F.when(k == i, exif[i]).otherwise(text)
    pdf = F.when(k == 5, write("'D:'yyyyMMddHHmmss", "+02'00'")).when(k == 6, write("yyyyMMddHHmmss", "Z")).otherwise(write("'D:'yyyyMMddHHmm"))
    xmp = F.when(k == 8, write("yyyy-MM-dd'T'HH:mm:ss", "+02:00")).otherwise(write("yyyy-MM-dd"))
    got = F.when(k < 5, dates.exif_date(text)).when(k < 8, dates.pdf_date(pdf)).otherwise(dates.xmp_date(xmp))
    right = got == F.when(k == 7, F.date_trunc("minute", ts)).when(k == 9, F.date_trunc("day", ts)).otherwise(ts)
    return table(spark, sf_dir, "events").groupBy(k.alias("form")).agg(F.count("*").alias("n"), F.count(got).alias("n_read"), F.count_if(right).alias("n_right"))


def file_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the dates of files, and their summed risk, against the first of 1998."""
    k = F.col("o_orderkey")
    original = F.col("o_orderdate").cast("timestamp")
    after = lambda n, unit: original + F.make_interval(**{unit: n.cast("int")})
    found = dates.date_findings(original, after(k % 3 - 1, "hours"), F.timestamp_micros(F.unix_micros(original) + (k % 4) * 1_000_000), after(k % 5 * 12, "hours"), F.lit("1998-01-01").cast("timestamp"))
    rows = table(spark, sf_dir, "orders").select(found.alias("f"))
    risk = F.aggregate(F.transform("f", lambda x: F.coalesce(*(F.when(x == n, F.lit(r)) for n, r in dates.DATE_RISKS.items()))), F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy(F.array_join("f", ",").alias("findings"), F.round(risk, 2).alias("risk")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (fiscal_codes, vat_lines, text_date_anomalies, date_forms, file_dates)}

ORACLES = {
    "fiscal_codes": "SELECT ['valid', 'incomplete', 'incomplete', 'missing', NULL][c_custkey % 5 + 1] AS code, [-0.05, 0.5, 0.5, 0.35, NULL][c_custkey % 5 + 1]::DOUBLE AS risk, count(*) AS n FROM customer GROUP BY 1, 2",
    "vat_lines": "SELECT c_custkey AS doc_id, (c_custkey % 7 + 1) * 125.0::DOUBLE AS total, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 3 = 0 END AS inconsistent FROM customer",
    "text_date_anomalies": "SELECT c_custkey % 4 AS kind, [NULL, 0.6, 0.25, NULL][c_custkey % 4 + 1]::DOUBLE AS risk, count(*) AS n FROM customer GROUP BY 1, 2",
    "date_forms": "SELECT event_id % 10 AS form, count(*) AS n, count(*) FILTER (event_id % 10 <> 4) AS n_read, count(*) FILTER (event_id % 10 <> 4) AS n_right FROM events GROUP BY 1",
    "file_dates": """
        WITH d AS (SELECT o_orderkey AS k, o_orderdate::TIMESTAMP AS o FROM orders),
        f AS (SELECT k, k % 3 = 0 AS m, k % 4 > 1 AS c, k % 5 > 2 AS x, greatest(o, o + INTERVAL 1 HOUR * (k % 3 - 1), o + INTERVAL 1 SECOND * (k % 4), o + INTERVAL 12 HOUR * (k % 5)) > TIMESTAMP '1998-01-01' AS u FROM d)
        SELECT concat_ws(',', CASE WHEN m THEN 'modified_before_original' END, CASE WHEN c THEN 'created_differs' END, CASE WHEN x THEN 'xmp_late' END, CASE WHEN u THEN 'future' END) AS findings,
               round(0.30 * m::INT + 0.15 * c::INT + 0.10 * x::INT + 0.40 * u::INT, 2)::DOUBLE AS risk, count(*) AS n FROM f GROUP BY 1, 2""",
}
