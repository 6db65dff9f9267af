"""Text rules as Column functions: words, repetition, hidden and look-alike characters, identifiers and amounts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.columns import mod_11_10, mod_97_iban, sigmoid

#: Words that mark English text.
ENGLISH = (
    "the and is in to of a for that it with as was on are be this have from or an by not but at which they has"
).split()

#: Invisible and direction-changing code points.
INVISIBLE = "200B 200C 200D 200E 200F FEFF 202A 202B 202C 202D 202E 2066 2067 2068 2069"

#: Of these, the ones that don't count.
HARMLESS = "FEFF 200E 200F"

#: Cyrillic letters that look like Latin ones.
HOMOGLYPHS = "0410 0412 0421 0415 041D 041A 041C 041E 0420 0422 0425 0430 0435 043E 0440 0441 0443 0445"

#: Numbers of 11 digits that are no identifiers.
TRIVIAL = ["01234567890", "12345678901", "00000000000"]

_WORD = re.compile(r"[^ \t\n\x0B\f\r]+")
_CLASS = lambda codes: "[" + "".join(f"\\x{{{c}}}" for c in codes.split()) + "]"


def words(text: Column) -> Column:
    """Words in lower case, split at ASCII white space; empty array without any."""
    return F.filter(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def long_enough(text: Column, least: int = 300) -> Column:
    return F.length(F.trim(text)) >= least


def likely_english(text: Column, first: int | None = None) -> Column:
    """Four or more marker words in the text, or among its first characters."""
    head = text if first is None else F.substring(text, 1, first)
    return F.size(F.array_intersect(words(head), F.array(*map(F.lit, ENGLISH)))) >= 4


def word_statistics(text: Column, n: int = 4) -> Column:
    """repetition, the share of n-grams of words that repeat an earlier one (0 for fewer than n words), and ttr, the share of distinct
    words (null for 50 words or fewer), of each whole text; a null text has no words.

    An Arrow batch function: the JVM's array functions are interpreted per element, and take ten times as long.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            w = _WORD.findall(t or "")
            grams = len(w) - n + 1
            rows.append(((grams - len(set(zip(*(w[i:] for i in range(n)))))) / grams if grams > 0 else 0.0, len(set(w)) / len(w) if len(w) > 50 else None))
        return pd.DataFrame(rows, columns=["repetition", "ttr"], dtype="float64")

    kind = T.StructType([T.StructField("repetition", T.DoubleType()), T.StructField("ttr", T.DoubleType())])
    return F.pandas_udf(run, kind)(F.lower(text))


def type_token_ratio(w: Column, first: int | None = None) -> Column:
    """Share of distinct words, of all or of the first ones; null for 50 words or fewer."""
    head = w if first is None else F.slice(w, 1, first)
    return F.when(F.size(w) > 50, F.size(F.array_distinct(head)) / F.size(head))


def sentences(text: Column) -> Column:
    """Sentences of over 10 characters: cut behind . ! ? before a capital, and at blank lines."""
    parts = F.flatten(F.transform(F.split(text, "(?<=[.!?])\\s+(?=[A-Z\\u0100-\\u024F])"), lambda s: F.split(s, "\\n\\n")))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 10)


def sentence_length_cv(text: Column) -> Column:
    """Deviation of sentence lengths in words over their mean; null for fewer than five sentences. One pass over the sentences."""
    n = F.transform(sentences(text), lambda s: F.size(words(s)).cast("double"))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    add = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"))
    spread = lambda a: F.sqrt(F.greatest(F.lit(0.0), a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"])))
    return F.aggregate(n, zero, add, lambda a: F.when(a["n"] >= 5, F.try_divide(spread(a), a["s"] / a["n"])))


def statistical_score(repetition: Column, ttr: Column, cv: Column | None = None) -> Column:
    """Weighted mean of the signals that are there: repetition .20, words .15, sentence lengths .10."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), repetition / 0.05))
    signals = [(r, 0.20), (sigmoid(-15 * (ttr - 0.42)), 0.15)] + ([(sigmoid(-8 * (cv - 0.4)), 0.10)] if cv is not None else [])
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in signals), F.lit(0.0))
    return total / sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in signals), F.lit(0.0))


def combined(stat: Column, classifier: Column) -> Column:
    """Statistics and a classifier's score as one; two high ones support each other."""
    both = 0.40 * stat + 0.60 * classifier
    agreed = F.when((stat > 0.55) & (classifier > 0.55), F.greatest(both, 0.95 * F.greatest(stat, classifier))).otherwise(both)
    return F.when(stat.isNull(), classifier).when(classifier.isNull(), 0.85 * stat).otherwise(agreed)


def text_band(score: Column) -> Column:
    return F.when(score > 0.70, "high").when(score > 0.45, "medium").when(score > 0.25, "low")


def hidden_characters(text: Column) -> Column:
    """Invisible and format characters (category Cf), but for the byte order mark and the two direction marks that plain texts have too."""
    return F.regexp_count(text, F.lit("[\\p{Cf}" + _CLASS(INVISIBLE)[1:-1] + "&&[^" + _CLASS(HARMLESS)[1:-1] + "]]"))


def homoglyphs(line: Column) -> Column:
    return F.regexp_count(line, F.lit(_CLASS(HOMOGLYPHS)))


def latin(line: Column) -> Column:
    """Characters from A to z, the six signs between Z and a included."""
    return F.regexp_count(line, F.lit("[A-z]"))


def mixed_script_lines(text: Column) -> Column:
    """Lines of three look-alikes or more among more than twice as many Latin characters."""
    return F.size(F.filter(F.split(text, "\n"), lambda s: (homoglyphs(s) >= 3) & (latin(s) > 2 * homoglyphs(s))))


def identifiers(text: Column) -> Column:
    """Distinct runs of 11 digits that may be identifiers."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("\\b([0-9]{11})\\b"), F.lit(1)))
    return F.filter(found, lambda s: (F.size(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))) > 1) & ~s.isin(*TRIVIAL))


def invalid_identifiers(text: Column) -> Column:
    return F.filter(identifiers(text), lambda s: ~mod_11_10(s))


def invalid_ibans(text: Column) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)\\b(HR[0-9]{19})\\b"), F.lit(1)), lambda s: F.upper(s)))
    return F.filter(found, lambda s: ~mod_97_iban(s))


def identifier_findings(text: Column) -> Column:
    """Codes and risks: numbers or accounts whose check digits are wrong, .75 each; trust of -.10 where there are some and all are right."""
    ids, accounts = identifiers(text), F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)\\b(HR[0-9]{19})\\b"), F.lit(1)))
    bad_ids, bad_accounts = F.size(invalid_identifiers(text)) > 0, F.size(invalid_ibans(text)) > 0
    of = lambda code, risk: F.struct(F.lit(code).alias("code"), F.lit(risk).alias("risk"))
    some = F.size(ids) + F.size(accounts) > 0
    return F.array_compact(
        F.array(F.when(bad_ids, of("CONTENT_INVALID_OIB", 0.75)), F.when(bad_accounts, of("CONTENT_INVALID_IBAN", 0.75)), F.when(some & ~bad_ids & ~bad_accounts, of("CONTENT_VALID_IDENTIFIERS", -0.10)))
    )


def word_chunks(w: Column, size: int = 500, stride: int = 372, most: int | None = None, least_chars: int = 50) -> Column:
    """Overlapping chunks of all words as texts, those of more than least_chars characters; with most, the first ones only."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(stride))
    chunks = F.filter(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " ")), lambda c: F.length(c) > least_chars)
    return chunks if most is None else F.slice(chunks, 1, most)
