"""Column functions, text rules, pair joins, readers and streams on small cases."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from claimlens.functions import columns as c
from claimlens.functions import textrules as tr
from claimlens.operators import ordered, pairs
from claimlens.plans import texts
from claimlens.sources import readers
from claimlens.sources.scratch import scratch
from claimlens.streaming import audit as stream


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def check_digit(first10):
    r = 10
    for d in first10:
        r = (r + int(d)) % 10 or 10
        r = r * 2 % 11
    return str((11 - r) % 10)


def test_checksums(spark):
    r = random.Random(1)
    good = ["".join(r.choice("0123456789") for _ in range(10)) for _ in range(50)]
    good = [g + check_digit(g) for g in good]
    bad = [g[:10] + str((int(g[10]) + 1) % 10) for g in good]
    got = [x[0] for x in values(spark, [(g,) for g in good + bad], "s string", c.mod_11_10(F.col("s")))]
    assert got == [True] * 50 + [False] * 50
    account = "10010051863000160"
    right = 98 - int(account + "172700") % 97
    ibans = [(f"HR{right:02d}{account}",), (f"HR{right % 97 + 1:02d}{account}",), ("HRxx" + account,)]
    assert [x[0] for x in values(spark, ibans, "s string", c.mod_97_iban(F.col("s")))] == [True, False, False]


def test_amounts(spark):
    rows = [("1.234,56",), ("1,234.56",), ("12,50",), ("12.50",), ("0,00",), ("x",), (None,)]
    assert [x[0] for x in values(spark, rows, "s string", c.amount(F.col("s")))] == [1234.56, 1234.56, 12.5, 12.5, None, None, None]


def test_percentiles(spark):
    for n in (1, 4, 5, 10, 101):
        df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
        qs = {f"q{p}": p for p in (0.0, 0.5, 0.9, 0.99)}
        nearest, rounded = ordered.ranks_of(df, ["g"], "v", qs, nearest=True).first(), ordered.ranks_of(df, ["g"], "v", qs).first()
        for k, p in qs.items():
            assert (nearest[k], rounded[k]) == (float(min(int(n * p), n - 1)), float(round(p * (n - 1))))
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", None), ("b", None)], "g string, v double")
    assert [tuple(r) for r in ordered.ranks_of(rows, ["g"], "v", {"m": 0.5}).collect()] == [("a", 1.0)]


def test_small_functions(spark):
    rows = [("https://a.example/x.JPG?q=1", "photo.JPG"), ("not a url", "none"), (None, None)]
    got = values(spark, rows, "u string, n string", c.url_host(F.col("u")), c.extension(F.col("n")))
    assert got == [("a.example", "jpg"), ("not a url", ""), (None, None)]
    got = values(spark, [("ffffffffffffffff", "0000000000000000"), ("00000000000000ff", "000000000000000f")], "a string, b string", c.hamming(c.hex_bits(F.col("a")), c.hex_bits(F.col("b"))))
    assert [x[0] for x in got] == [64, 4]


def test_text_rules(spark):
    zero, mixed = "a​‍﻿b", "аео latin letters\nplain"
    rows = [(zero,), (mixed,), ("the cat is on a mat and it was by that",), ("",)]
    got = values(spark, rows, "t string", tr.hidden_characters(F.col("t")), tr.mixed_script_lines(F.col("t")), tr.likely_english(F.col("t")), tr.word_statistics(F.col("t"))["repetition"])
    assert got == [(2, 0, False, 0.0), (0, 1, False, 0.0), (0, 0, True, 0.0), (0, 0, False, 0.0)]
    text = "One short sentence here. Another one follows it now! Is a third one long enough? Yes it is quite so. And here is the fifth of them all."
    n = [4, 5, 6, 5, 8]
    mean = sum(n) / 5
    want = (sum((x - mean) ** 2 for x in n) / 5) ** 0.5 / mean
    assert values(spark, [(text,)], "t string", tr.sentence_length_cv(F.col("t")))[0][0] == pytest.approx(want)
    ids = "11111111111 12345678901 " + "1234567890" + check_digit("1234567890") + " 99999999990"
    assert values(spark, [(ids,)], "t string", F.size(tr.identifiers(F.col("t"))), F.size(tr.invalid_identifiers(F.col("t"))))[0][0] == 2


def test_invoices(spark):
    good = "Invoice\nA 10,00\nB 20,00\nC 30,00\nTotal 60,00"
    off = good.replace("60,00", "70,00")
    little = good.replace("60,00", "61,00")
    rows = [(1, good), (2, off), (3, little), (4, "A 1,00\nTotal 5,00"), (5, None), (6, "Total 9,00\nA 1,00\nB 1,00\nC 1,00\nTotal 3,05")]
    got = {r.doc_id: (r.total, r.n_items, r.risk) for r in texts.invoice_checks(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1] == (60.0, 3, None) and got[2] == (70.0, 3, 0.75) and got[3] == (61.0, 3, 0.5)
    assert got[4] == (5.0, 1, None) and got[5][2] is None and got[6][2] == 0.5


def test_banded_pairs_are_all_pairs(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    hashes = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, 11))) for b in base for _ in range(4)]
    hashes = list(dict.fromkeys(hashes))
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    want = {(i, j) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= 8}
    got = [(x.key_i, x.key_j) for x in pairs.banded_hash_pairs(spark.createDataFrame(rows + [(999, rows[0][1])], "key int, h long"), "key", "h").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_greedy_dedup(spark):
    rows = [("a", 1, 0), ("a", 2, 1), ("a", 3, (1 << 20) - 1), ("b", 1, 0), ("b", 2, None), ("a", 4, -1)]
    got = sorted((x.g, x.i) for x in pairs.greedy_dedup(spark.createDataFrame(rows, "g string, i int, h long"), "g", "i", "h").collect())
    assert got == [("a", 1), ("a", 3), ("a", 4), ("b", 1), ("b", 2)]


def test_readers(spark, tmp_path):
    p = tmp_path / "rows.jsonl"
    p.write_text('{"id":"1","ground_truth":"authentic","modules":{"m":{"risk_score":0.5}}}\n\n{broken\n{"id":"2","ground_truth":"manipulated"}\n{"id":"3","ground_truth":"other"}\n')
    good, left = readers.labelled_rows(spark, str(p), {"manipulated": "ai_generated"})
    assert sorted((r.id, r.ground_truth) for r in good.collect()) == [("1", "authentic"), ("2", "ai_generated")]
    assert sorted(r.reason for r in left.collect()) == ["broken", "label"]
    t = tmp_path / "rows.tsv"
    t.write_text('1\t\t{"a":1}\n2\tx\n3\ty\t{bad\n')
    assert [(r.a, r.b) for r in readers.tsv_rows(spark, str(t), ["a", "b", "j"], "j").collect()] == [("1", None)]
    m = tmp_path / "labels.csv"
    m.write_text("filename,label\nf1,a\nf2,b\nf1,c\n")
    assert sorted((r.filename, r.label) for r in readers.label_map(spark, str(m)).collect()) == [("f1", "c"), ("f2", "b")]


def test_files(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>Hello</w:t></w:p><w:ins><w:p><w:t>there</w:t></w:p></w:ins></w:d>')
        z.writestr("word/vbaProject.bin", "x")
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 /JS /JavaScript %%EOF %%EOF")
    (tmp_path / "labels.csv").write_text("x")
    names = sorted(r.name for r in readers.listing(spark, str(tmp_path), ["docx", "pdf", "csv"], ["labels.csv"]).collect())
    assert names == ["a.docx", "b.docx", "c.pdf"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(str(tmp_path))
    got = {r.path[-6:]: (r.text, r.findings) for r in readers.office_text(files).collect()}
    assert got["a.docx"][0].split() == ["Hello", "there"] and got["a.docx"][1] == ["macro", "tracked_change"] and got["b.docx"][1] == ["unreadable"]
    pdf = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(tmp_path))
    n = pdf.select(readers.triage(F.col("content"), F.col("path")).alias("t"), *(v.alias(k) for k, v in readers.pdf_counts(F.col("content")).items())).first()
    assert (n.t, n["js"], n["javascript"], n["eof"]) == ("pdf", 1, 1, 2)


def test_ingest_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select 1L event_id, timestamp_ntz'2024-01-01 00:00:00' ts, 2L user_id, 'view' event_type, 1.0D value, '{}' props").write.parquet(str(src))
    out = scratch(spark, "ingest")
    for _ in range(2):
        stream.ingest(stream.feed(spark, str(src), "*.parquet"), f"{out}/t", f"{out}/s").awaitTermination()
    assert spark.read.parquet(f"{out}/t").count() == 1


def test_sentences_split_before_capitals_only(spark):
    """By the reference's class A-Z and U+0100-U+024F: before Š and Ȁ, not before é or É."""
    rows = [("Prva recenica je ovo. Šesta recenica je ovo. Ȁnother sentence it is.",), ("Une phrase assez longue. État de la chose ici. état de la chose.",)]
    assert [len(x[0]) for x in values(spark, rows, "t string", tr.sentences(F.col("t")))] == [3, 1]


def test_format_characters_count(spark):
    rows = [("a\u00adb\u2060c\u200b",), ("\ufeff\u200e\u200f",), ("\u202e\u2066x",)]
    assert [x[0] for x in values(spark, rows, "t string", tr.hidden_characters(F.col("t")))] == [3, 0, 2]


def test_dates(spark):
    from claimlens.functions import dates

    rows = [("2024:01:15 10:30:00",), ("2024-01-15T10:30:00+02:00",), (" 2024-01-15 10:30:00 ",), ("15.1.2024",), (None,)]
    got = values(spark, rows, "t string", F.date_format(dates.exif_date(F.col("t")), "yyyy-MM-dd HH:mm:ss"))
    assert [x[0] for x in got] == ["2024-01-15 10:30:00", "2024-01-15 08:30:00", "2024-01-15 10:30:00", None, None]
    rows = [("D:20240115103000+01'00'",), ("202401151030Z",), ("D:20240115",), ("D:2024",), ("",)]
    got = values(spark, rows, "t string", F.date_format(dates.pdf_date(F.col("t")), "yyyy-MM-dd HH:mm:ss"))
    assert [x[0] for x in got] == ["2024-01-15 10:30:00", "2024-01-15 10:30:00", "2024-01-15 00:00:00", None, None]
    got = values(spark, [("2024-01-15T10:30:00+02:00",), ("2024-01-15T10:30Z",), ("2024-01-15",)], "t string", F.date_format(dates.xmp_date(F.col("t")), "yyyy-MM-dd HH:mm:ss"))
    assert [x[0] for x in got] == ["2024-01-15 10:30:00", "2024-01-15 10:30:00", "2024-01-15 00:00:00"]
    got = values(spark, [("od 1.2.2024 do 31/12/2023, ne 31.02.2024 ni 1.1.1999",)], "t string", F.transform(dates.text_dates(F.col("t")), lambda d: F.date_format(d, "yyyy-MM-dd")))
    assert got[0][0] == ["2024-02-01", "2023-12-31"]


def test_bands_hold_all_near_values():
    """Of eleven blocks of bits eight differences leave three untouched."""
    from math import comb

    assert comb(11, 3) == 165


def test_writers(spark, tmp_path):
    from claimlens.sources import writers

    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    writers.write_rows(df, f"{tmp_path}/j")
    writers.write_rows(df, f"{tmp_path}/c", "csv")
    assert sorted((r.i, r.t) for r in spark.read.json(f"{tmp_path}/j").collect()) == [(1, "a"), (2, None)]
    assert sorted((r.i, r.t) for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()) == [("1", "a"), ("2", None)]
    with pytest.raises(ValueError):
        writers.write_rows(df, f"{tmp_path}/x", "xml")
    writers.save_weights(spark, f"{tmp_path}/w", ["a", "b"], [0.5, -1], 2)
    assert writers.load_weights(spark, f"{tmp_path}/w", ["a", "b"]) == ([0.5, -1.0], 2.0)
    with pytest.raises(ValueError):
        writers.load_weights(spark, f"{tmp_path}/w", ["b", "a"])


def test_marks_and_degrees(spark):
    from claimlens.plans import metadata as m

    got = values(spark, [(" Čćšž Đđ É ",), ("é",)], "t string", m.without_marks(F.col("t")))
    assert [x[0] for x in got] == ["ccsz đđ e", "e"]
    got = values(spark, [("[48, 51, 24]", "N"), ("[48/1, 51/2, 0]", "w"), ("[48]", "N"), ("[a, 1]", "N")], "t string, r string", m.dms_to_decimal(F.col("t"), F.col("r")))
    assert got[0][0] == pytest.approx(48.856666667) and got[1][0] == pytest.approx(-48.425) and got[2][0] is None and got[3][0] is None
