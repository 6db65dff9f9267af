"""Text forensics on documents, identifiers on keys, and invoice arithmetic on lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import textrules as tr
from claimlens.functions.columns import amount, mask, mod_11_10, mod_97_iban
from claimlens.sources.tables import table


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, repetition, ttr and cv of each text; a null text counts as empty."""
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", tr.word_statistics(t).alias("s"), tr.sentence_length_cv(t).alias("cv")).select("doc_id", "s.repetition", "s.ttr", "cv")


def text_ngram_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", tr.word_statistics(F.col("text")).alias("s"))
    return s.select("doc_id", F.round("s.repetition", 8).alias("repetition"))


def text_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tr.words(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("w")).select("doc_id", F.round(tr.type_token_ratio(F.col("w")), 8).alias("ttr"))


def text_sentence_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(table(spark, sf_dir, "documents")).select("doc_id", "cv")


def text_stat_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistical score of long enough texts without sentence lengths, discounted as there is no classifier, and its band."""
    t = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("text")).where(tr.long_enough(F.col("text")))
    rows = docs.select("doc_id", tr.word_statistics(F.col("text")).alias("w"))
    s = tr.combined(tr.statistical_score(F.col("w.repetition"), F.col("w.ttr")), F.lit(None).cast("double"))
    return rows.select("doc_id", F.round(s, 7).alias("score")).withColumn("band", tr.text_band(F.col("score")))


def text_full_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistical score of long enough texts by all three signals, sentence lengths included, discounted as there is no classifier."""
    t = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("text")).where(tr.long_enough(F.col("text")))
    rows = text_statistics(docs)
    s = tr.combined(tr.statistical_score(F.col("repetition"), F.col("ttr"), F.col("cv")), F.lit(None).cast("double"))
    return rows.select("doc_id", F.round("cv", 6).alias("cv"), F.round(s, 6).alias("score")).withColumn("band", tr.text_band(F.col("score")))


def identifier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of texts that name a customer's number and, for most, an account; the check digits of some are off by one."""
    k = F.col("c_custkey")
    number = F.lpad((k * 7919 + 104729).cast("string"), 11, "0")
    account = F.lpad((k * 7919).cast("string"), 17, "0")
    right = 98 - (F.concat(account, F.lit("172700")).cast("decimal(38,0)") % 97).cast("int")
    check = F.lpad(F.when(k % 3 > 0, right).otherwise(right % 97 + 1).cast("string"), 2, "0")
    text = F.concat(F.col("c_name"), F.lit(" id "), F.when(k % 7 > 0, number).otherwise("none"), F.lit(", account "), F.when(k % 5 > 0, F.concat(F.when(k % 2 == 0, "hr").otherwise("HR"), check, account)).otherwise("none"), F.lit("; "), number)
    rows = table(spark, sf_dir, "customer").select("c_custkey", tr.identifier_findings(text).alias("f"))
    return rows.select("c_custkey", F.array_join(F.transform("f", lambda x: x["code"]), ",").alias("codes"), F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x["risk"]), 2).alias("total"))


def text_language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").groupBy("lang", tr.likely_english(t).alias("english"), tr.long_enough(t).alias("long_enough")).agg(F.count("*").alias("n"))


def word_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document, and the characters of the first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tr.words(F.coalesce("text", F.lit(""))).alias("w"))
    c = docs.select("doc_id", tr.word_chunks(F.col("w")).alias("c"))
    return c.select("doc_id", F.size("c").alias("n_chunks"), F.coalesce(F.length(F.try_element_at("c", F.lit(1))), F.lit(0)).alias("first_chars"))


def id_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad((F.col("c_custkey") * 7919 + 104729).cast("string"), 11, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", mod_11_10(digits).alias("valid"), mask(digits, 3, 6, 2).alias("masked"))


def iban_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IBANs of keys with check digits that are right where the key is even, and off by one elsewhere."""
    account = F.lpad((F.col("c_custkey") * 7919).cast("string"), 17, "0")
    right = 98 - (F.concat(account, F.lit("172700")).cast("decimal(38,0)") % 97).cast("int")
    check = F.when(F.col("c_custkey") % 2 == 0, right).otherwise(right % 97 + 1)
    iban = F.concat(F.lit("HR"), F.lpad(check.cast("string"), 2, "0"), account)
    return table(spark, sf_dir, "customer").select("c_custkey", mod_97_iban(iban).alias("valid"), mask(iban, 6, 11, 4).alias("masked"))


def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts that are written in one of four ways and read again."""
    cents = (F.col("l_extendedprice") * 100).cast("long")
    whole, rest = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = lambda s: F.when(F.length(whole) > 3, F.concat(F.left(whole, F.length(whole) - 3), F.lit(s), F.right(whole, F.lit(3)))).otherwise(whole)
    k = F.col("l_linenumber") % 4
    text = F.when(k == 0, F.concat(grouped("."), F.lit(","), rest)).when(k == 1, F.concat(grouped(","), F.lit("."), rest)).when(k == 2, F.concat(whole, F.lit(","), rest)).otherwise(F.concat(whole, F.lit("."), rest))
    rows = table(spark, sf_dir, "lineitem").select(k.alias("form"), amount(text).alias("value"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).cast("double").alias("total"))


def math_flags(df: DataFrame, items: str, total: Column) -> DataFrame:
    """df with n_items, deviation, and risk: .75 over 5 %, .50 over 1 %, null below or with fewer than three items."""
    kept = F.filter(items, lambda x: (x >= 0.01) & (x < total))
    d = F.try_divide(F.abs(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) - total), total)
    df = df.withColumns({"n_items": F.size(kept), "deviation": F.round(d, 8)})
    return df.withColumn("risk", F.when(F.col("n_items") >= 3, F.when(F.col("deviation") > 0.05, 0.75).when(F.col("deviation") > 0.01, 0.50)))


def math_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against stated totals: lines are the items, and the total is off by 0, 2 or 10 % as the key says."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("items"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum"))
    off = F.element_at(F.array(F.lit(1.0), F.lit(1.02), F.lit(1.10)), (F.col("l_orderkey") % 3 + 1).cast("int"))
    out = math_flags(g.withColumn("total", F.col("sum") * off), "items", F.col("total"))
    return out.groupBy((F.col("l_orderkey") % 3).alias("kind"), "risk").agg(F.count("*").alias("n"), F.sum("n_items").alias("items"))


def vat_consistency(net: Column, vat: Column, rate: Column) -> Column:
    """Whether a stated tax is off by over 5 % from what the rate gives for the gross amount."""
    expected = net / (1 + rate) * rate
    return F.when((rate >= 0.05) & (rate <= 0.30), F.abs(vat - expected) / expected > 0.05)


def invoice_checks(docs: DataFrame) -> DataFrame:
    """total, n_items, deviation and risk of invoice texts (doc_id, text).

    The total is the last amount on the last line with a total keyword, if it is above 1; items are the amounts of the
    lines before it that have no such keyword.
    """
    pattern = F.lit("([0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2})")
    # Words that mark a line of totals.
    keyword = "(?i)\\b(ukupno|total|za\\s*platiti|iznos|sveukupno|suma|grand\\s*total|subtotal)\\b"
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n"),
        lambda s, i: F.struct(i.alias("i"), s.rlike(keyword).alias("total"), F.filter(F.transform(F.regexp_extract_all(s, pattern, F.lit(1)), lambda a: amount(a)), lambda a: a.isNotNull()).alias("amounts")),
    )
    df = docs.select("doc_id", lines.alias("lines"))
    last = F.element_at(F.filter("lines", lambda s: s["total"] & (F.size(s["amounts"]) > 0) & (F.try_element_at(s["amounts"], F.lit(-1)) > 1)), -1)
    has = F.exists("lines", lambda s: s["total"] & (F.size(s["amounts"]) > 0) & (F.try_element_at(s["amounts"], F.lit(-1)) > 1))
    df = df.withColumn("last", F.when(has, last))
    items = F.flatten(F.transform(F.filter("lines", lambda s: ~s["total"] & (s["i"] < F.col("last")["i"])), lambda s: s["amounts"]))
    df = df.withColumns({"total": F.element_at(F.col("last")["amounts"], -1), "items": items})
    return math_flags(df, "items", F.col("total")).select("doc_id", "total", "n_items", "deviation", "risk")


def hidden_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invisible and format characters in texts to which some are added by key; of each five added, a byte order mark and a direction mark don't count."""
    bad = F.repeat(F.lit("\u200b\ufeff\u202e\u00ad\u200e"), (F.col("doc_id") % 5).cast("int"))
    t = F.concat(F.coalesce("text", F.lit("")), bad)
    return table(spark, sf_dir, "documents").select("doc_id", tr.hidden_characters(t).alias("n_hidden"))


def homoglyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of mixed script in texts to which look-alikes are added by key."""
    bad = F.repeat(F.lit("а"), (F.col("doc_id") % 5).cast("int"))
    t = F.concat(F.coalesce("text", F.lit("")), bad)
    return table(spark, sf_dir, "documents").select("doc_id", tr.mixed_script_lines(t).alias("n_lines"))


def url_file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by scheme and by what their URL's query says: the first matching rule of a fixed order."""
    u = F.coalesce("url", F.lit(""))
    kind = F.when(u.rlike("utm_"), "campaign").when(u.rlike("[?&]page="), "paged").when(u.rlike("[?]"), "other query").otherwise("plain")
    return table(spark, sf_dir, "pages").groupBy(F.substring_index(u, ":", 1).alias("scheme"), kind.alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        text_ngram_repetition, text_ttr, text_sentence_cv, text_stat_score, text_full_score, identifier_checks, text_language_gate, word_chunk_counts, id_checksum, iban_checksum, amount_parse, math_consistency,
        hidden_chars, homoglyph_lines, url_file_rules,
    )
}

_W = r"WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\x0B\f\r]+') AS w FROM documents)"
_G = r""", g AS (SELECT doc_id, t, w, CASE WHEN len(w) >= 4 THEN (len(w) - 3 - len(list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]))) / (len(w) - 3) ELSE 0 END AS r,
    CASE WHEN len(w) > 50 THEN len(list_distinct(w)) / len(w) END AS ttr FROM d)"""
_M = ", ".join(f"'{w}'" for w in tr.ENGLISH)

#: Whether the 11 digits of a column carry a right check digit: the rest after ten digits, then the check.
_CHECKED = "list_reduce(list_prepend(10, [ascii(d) - 48 for d in string_split({d}[1:10], '')]), lambda r, x: (CASE WHEN (r + x) % 10 = 0 THEN 10 ELSE (r + x) % 10 END * 2) % 11)"

ORACLES = {
    "identifier_checks": f"""
        WITH n AS (SELECT c_custkey AS k, lpad((c_custkey * 7919 + 104729)::VARCHAR, 11, '0') AS d FROM customer),
        c AS (SELECT k, (CASE WHEN 11 - {_CHECKED.format(d="d")} = 10 THEN 0 ELSE (11 - {_CHECKED.format(d="d")}) % 11 END) = (ascii(d[11]) - 48) AS good, k % 5 > 0 AND k % 3 = 0 AS bad FROM n)
        SELECT k AS c_custkey, CASE WHEN NOT good AND bad THEN 'CONTENT_INVALID_OIB,CONTENT_INVALID_IBAN' WHEN NOT good THEN 'CONTENT_INVALID_OIB' WHEN bad THEN 'CONTENT_INVALID_IBAN' ELSE 'CONTENT_VALID_IDENTIFIERS' END AS codes,
               CASE WHEN NOT good AND bad THEN 1.50 WHEN NOT good OR bad THEN 0.75 ELSE -0.10 END::DOUBLE AS total FROM c""",
    "text_ngram_repetition": _W + _G + " SELECT doc_id, round(r, 8) AS repetition FROM g",
    "text_ttr": _W + _G + " SELECT doc_id, round(ttr, 8) AS ttr FROM g",
    "text_stat_score": _W + _G + """, s AS (SELECT doc_id, round(0.85 * (0.20 * greatest(0, least(1, r / 0.05)) + coalesce(0.15 / (1 + exp(15 * (ttr - 0.42))), 0)) / (0.20 + CASE WHEN ttr IS NULL THEN 0 ELSE 0.15 END), 7) AS score FROM g WHERE length(trim(t, ' ')) >= 300)
        SELECT doc_id, score, CASE WHEN score > 0.70 THEN 'high' WHEN score > 0.45 THEN 'medium' WHEN score > 0.25 THEN 'low' END AS band FROM s""",
    "text_language_gate": _W + rf"""
        SELECT lang, len(list_intersect(regexp_extract_all(lower(t), '[^ \t\n\x0B\f\r]+'), [{_M}])) >= 4 AS english, length(trim(t, ' ')) >= 300 AS long_enough, count(*) AS n FROM d GROUP BY ALL""",
    "word_chunk_counts": _W + """, c AS (SELECT doc_id, list_filter([array_to_string(w[i+1:i+500], ' ') for i in range(0, greatest(len(w), 1), 372)], lambda x: length(x) > 50) AS c FROM d)
        SELECT doc_id, len(c)::INT AS n_chunks, coalesce(length(c[1]), 0)::INT AS first_chars FROM c""",
    "id_checksum": """
        WITH d AS (SELECT c_custkey, lpad((c_custkey * 7919 + 104729)::VARCHAR, 11, '0') AS o FROM customer),
        r AS (SELECT c_custkey, o, list_reduce(list_prepend(10, [substr(o, i, 1)::INT for i in range(1, 11)]), lambda r, x: (CASE WHEN (r + x) % 10 = 0 THEN 10 ELSE (r + x) % 10 END * 2) % 11) AS r FROM d)
        SELECT c_custkey, CASE WHEN 11 - r = 10 THEN 0 ELSE 11 - r END = substr(o, 11, 1)::INT AS valid, left(o, 3) || '******' || right(o, 2) AS masked FROM r""",
    "iban_checksum": """
        WITH a AS (SELECT c_custkey, lpad((c_custkey * 7919)::VARCHAR, 17, '0') AS a FROM customer), r AS (SELECT c_custkey, a, 98 - ((a || '172700')::HUGEINT % 97)::INT AS r FROM a),
        i AS (SELECT c_custkey, 'HR' || lpad((CASE WHEN c_custkey % 2 = 0 THEN r ELSE r % 97 + 1 END)::VARCHAR, 2, '0') || a AS i FROM r)
        SELECT c_custkey, (substr(i, 5, 17) || '1727' || substr(i, 3, 2))::HUGEINT % 97 = 1 AS valid, left(i, 6) || '***********' || right(i, 4) AS masked FROM i""",
    "amount_parse": "SELECT l_linenumber % 4 AS form, count(*) AS n, round(sum(trunc(l_extendedprice * 100) / 100), 2)::DOUBLE AS total FROM lineitem GROUP BY 1",
    "math_consistency": """
        WITH g AS (SELECT l_orderkey, list(l_extendedprice) AS i, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE * [1.0, 1.02, 1.10][l_orderkey % 3 + 1] AS total FROM lineitem GROUP BY l_orderkey),
        k AS (SELECT l_orderkey, total, list_filter(i, lambda x: x >= 0.01 AND x < total) AS i FROM g),
        r AS (SELECT l_orderkey % 3 AS kind, len(i) AS n_items, round(abs(coalesce(list_sum(i), 0) - total) / total, 8) AS d FROM k)
        SELECT kind, CASE WHEN n_items >= 3 THEN CASE WHEN d > 0.05 THEN 0.75 WHEN d > 0.01 THEN 0.50 END END::DOUBLE AS risk, count(*) AS n, sum(n_items)::BIGINT AS items FROM r GROUP BY ALL""",
    "hidden_chars": r"SELECT doc_id, (3 * (doc_id % 5) + len(regexp_extract_all(coalesce(text, ''), '\p{Cf}')) - len(regexp_extract_all(coalesce(text, ''), '[\x{FEFF}\x{200E}\x{200F}]')))::INT AS n_hidden FROM documents",
    "homoglyph_lines": """
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, '') || repeat('а', (doc_id % 5)::INT), chr(10))) AS s FROM documents),
        c AS (SELECT doc_id, len(regexp_extract_all(s, '[АВСЕНКМОРТХаеорсух]')) AS h, len(regexp_extract_all(s, '[A-z]')) AS a FROM l)
        SELECT doc_id, (count(*) FILTER (h >= 3 AND a > 2 * h))::INT AS n_lines FROM c GROUP BY 1""",
    "url_file_rules": """
        SELECT split_part(coalesce(url, ''), ':', 1) AS scheme, CASE WHEN contains(url, 'utm_') THEN 'campaign' WHEN regexp_matches(url, '[?&]page=') THEN 'paged' WHEN contains(url, '?') THEN 'other query' ELSE 'plain' END AS kind, count(*) AS n FROM pages GROUP BY ALL""",
}
