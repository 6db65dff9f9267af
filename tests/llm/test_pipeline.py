"""The pipeline's stages on planted documents: each decision takes effect, and clean documents stay."""

import random

import corpus_pipeline as cp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = {i: prose(r.randrange(80, 300)) for i in range(120)}
    for i in range(120, 160):
        w = prose(120).split()
        w[40:40] = ["idiot", "scum", "moron", "idiot"]
        texts[i] = " ".join(w)
    texts |= {200: texts[0], 201: texts[0], 202: texts[1].replace(texts[1].split()[30], "zzz", 1), 300: "too short", 301: "", 302: None, 303: (prose(12) + " ") * 20, 304: prose(5000)}
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(120 <= i < 160)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen.append({x.doc_id for x in docs.select("doc_id").collect()})
    assert seen[0] == set(texts) - {300, 301, 302, 303}
    assert len(seen[1] & set(range(120, 160))) <= 4 and len(seen[1] & set(range(120))) >= 112
    assert seen[2] == seen[1] - {200, 201} - ({202} if 1 in seen[1] else set())
    out = cp.run(spark, d).collect()
    assert {x.doc_id for x in out} == seen[2]
    assert all(x.bin_tokens <= 2048 for x in out)
    assert sum(x.piece_tokens for x in out if x.doc_id == 304) > 5000 if 304 in seen[2] else True


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    w = [f"w{i}" for i in range(80)]
    near = lambda *k: " ".join([*w[:-1], *k])
    other, third = " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(5, near("a")), (5, other), (5, near("b")), (9, near("c")), (None, near("d")), (None, third), (None, third + " x"), (7, ""), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], DOCS + ", root string")
    kept = sorted(((x.doc_id, x.text) for x in cp.near_duplicate_stage(spark, docs, "").collect()), key=str)
    one = [x for x in kept if x[0] == 5 and x[1].startswith("w0")]
    assert len(one) == 1 and one[0][1] in (near("a"), near("b"))
    thirds = [x for x in kept if x[0] is None]
    assert len(thirds) == 1 and thirds[0][1] in (third, third + " x")
    assert [x for x in kept if x not in one + thirds] == sorted([(5, other), (7, ""), (8, None), (8, None)], key=str)
    again = cp.near_duplicate_stage(spark, docs.repartition(5, "text"), "").collect()
    assert sorted(((x.doc_id, x.text) for x in again), key=str) == kept
