"""Small rules by hand: half floats, bands, devices, training rows, first rows, searches."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.plans import details as d
from claimlens.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_half_floats(spark):
    values = [0.0, -0.0, 1.0, -2.5, 65504.0, 6e-8, 6.1e-5, 0.333, float("inf"), -float("inf"), float("nan")]
    rows = [(base64.b64encode(np.array(values, "<f2").tobytes()).decode(),), ("",), ("AAA=",), ("not base64!",), (None,), (base64.b64encode(np.arange(65536, dtype="<u2").tobytes()).decode(),)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(d.half_floats(F.col("t"))).collect()]
    np.testing.assert_array_equal(np.array(got[0]), np.array(values, "<f2").astype(float))
    assert got[1:5] == [[], [0.0], None, None]
    np.testing.assert_array_equal(np.array(got[5]), np.arange(65536, dtype="<u2").view("<f2").astype(float))


def test_half_precision_of_embeddings(spark):
    held = {r.vec_id: np.array(r.embedding, "<f2").astype(float) for r in table(spark, SF, "embeddings").collect()}
    got = d.half_precision(spark, SF).collect()
    assert len(got) == len(held)
    for r in got:
        v = held[r.vec_id]
        assert r.n == len(v) and abs(r.total - v.sum()) < 1e-5 and abs(r.largest - v.max()) < 1e-6


def test_page_bands(spark):
    rows = [(-1.0,), (0.0999,), (0.10,), (0.40,), (0.65,), (0.85,), (7.0,), (float("nan"),), (float("inf"),), (None,)]
    got = [r.b.band for r in spark.createDataFrame(rows, "s double").select(d.page_band(F.col("s")).alias("b")).collect()]
    assert got == ["very_low", "very_low", "low", "raised", "high", "critical", "critical", "very_low", "very_low", "very_low"]


@pytest.mark.parametrize(
    "tags, code",
    [
        ({"Make": "Canon", "Model": "R5", "Software": "Adobe Photoshop"}, "META_DEVICE_SOFTWARE_MISMATCH"),
        ({"Make": "Canon", "Software": "Snapseed 2"}, None),
        ({"Make": "Acme", "Software": "Adobe Photoshop"}, None),
        ({"A": "1", "B": "2", "C": "3", "Make": " "}, "META_DEVICE_STRIPPED"),
        ({"A": "1", "B": "2", "C": "3"}, None),
        ({}, None),
    ],
)
def test_devices(spark, tags, code):
    f = spark.createDataFrame([(tags,)], "t map<string,string>").select(d.device_finding(F.col("t")).alias("f")).first().f
    assert (f and f.code) == code


def test_training_rows(spark):
    rows = [
        ('{"overall_risk_score":0.5,"overallRiskScore":0.9,"modules":[{"moduleName":"a","riskScore":0.2,"findings":[{"code":"c","riskScore":0.3}]},{"module_name":"a","risk_score":0.4},{"risk_score":1},{"module_name":"b"}]}',),
        ("{broken",), (None,), ("{}",),
    ]
    got = [r.r for r in spark.createDataFrame(rows, "t string").select(d.training_row(F.col("t")).alias("r")).collect()]
    assert got[0].overall == 0.5 and [(m.name, m.risk_score, len(m.findings)) for m in got[0].modules] == [("a", 0.4, 0), ("b", 0.0, 0)]
    assert [(g.overall, g.modules) for g in got[1:]] == [(0.0, [])] * 3


def test_first_of_each_and_search(spark):
    df = spark.createDataFrame([("a", 2, "x", None), ("a", 1, "y", "/p"), (None, 5, "z", "/q")], "k string, o int, session_id string, path string").withColumn("ts", F.expr("timestamp_ntz'2024-01-01'"))
    assert sorted((r.k or "", r.o, r.session_id) for r in d.first_of_each(df, ["k"], ["o"]).collect()) == [("", 5, "z"), ("a", 1, "y")]
    assert d.audit_search(df, contains="/").count() == 2 and d.audit_search(df, contains="", session_id="").count() == 3 and d.audit_search(df, session_id="x", start="2024-01-01 00:00:00", end="2024-01-01 00:00:00").count() == 1


def test_full_text_score(spark):
    """All three signals in plain Python over whole documents."""
    import math
    import re

    from claimlens.plans import texts

    got = {r.doc_id: r for r in texts.text_full_score(spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    checked = 0
    for i, text in docs.items():
        if i not in got:
            assert len(text) < 300
            continue
        sentences = [s.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-ZĀ-ɏ])", text, flags=re.A) for s in p.split("\n\n")]
        n = [len(s.split()) for s in sentences if len(s.strip(" ")) > 10]
        cv = None
        if len(n) >= 5:
            mean = sum(n) / len(n)
            cv = math.sqrt(sum((x - mean) ** 2 for x in n) / len(n)) / mean
        w = re.findall(r"[^ \t\n\x0b\f\r]+", text.lower())
        grams = [tuple(w[k : k + 4]) for k in range(len(w) - 3)]
        signals = [(max(0, min(1, (len(grams) - len(set(grams))) / len(grams) / 0.05)) if grams else 0.0, 0.20)]
        signals += [(sigmoid(-15 * (len(set(w)) / len(w) - 0.42)), 0.15)] if len(w) > 50 else []
        signals += [(sigmoid(-8 * (cv - 0.4)), 0.10)] if cv is not None else []
        score = 0.85 * sum(s * x for s, x in signals) / sum(x for _, x in signals)
        assert (got[i].cv is None) == (cv is None) and abs(got[i].score - score) < 1e-5, i
        checked += 1
    assert checked > 50


def test_identifier_findings(spark):
    from claimlens.functions import textrules as tr

    rows = [("id 69435151530 ok",), ("id 69435151531",), ("HR1210010051863000160 and 69435151530",), ("hr1310010051863000160",), ("11111111111",), ("none",), ("",)]
    got = [[(f.code.removeprefix("CONTENT_"), f.risk) for f in r.f] for r in spark.createDataFrame(rows, "t string").select(tr.identifier_findings(F.col("t")).alias("f")).collect()]
    valid = [("VALID_IDENTIFIERS", -0.10)]
    assert got == [valid, [("INVALID_OIB", 0.75)], valid, [("INVALID_IBAN", 0.75)], [], [], []]


def test_codes_and_json_of_dtos(spark):
    from claimlens.operators import dtos

    rows = [(0, '[{"ruleName":"a","triggered":true}]'), (1, "[]"), (2, "{broken"), (9, '{"ruleName":"a"}'), (None, None), (-1, "")]
    df = spark.createDataFrame(rows, "c int, j string")
    kind = dtos.INSPECTION_JSON["decision_trace_json"][1]
    got = df.select(dtos.name_of(F.col("c"), ["x", "y"]).alias("n"), dtos.parsed(F.col("j"), kind, True).alias("e"), dtos.parsed(F.col("j"), kind, False).alias("p")).collect()
    assert [r.n for r in got] == ["x", "y", "2", "9", None, "-1"]
    assert [len(r.e) for r in got] == [1, 0, 0, 0, 0, 0] and [r.p is None for r in got] == [False, False, True, True, True, True]


def test_dto_children_are_structs_in_order(spark):
    from claimlens.operators import dtos
    from claimlens.plans.dtos import ENTITIES, entity_frame

    frames = [entity_frame(spark, SF, n) for n in ENTITIES]
    out = dtos.inspection_dto(*frames)
    assert len(out.columns) == 60
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == frames[0].count()
    one = next(r for r in rows.values() if {f.sort_order for f in r.file_forensic_results} == {8, 9})
    places = [f.sort_order for f in one.file_forensic_results]
    assert places == sorted(places) and one.forensic_result == one.file_forensic_results[0]
    assert all([d.id for d in r.damages] == sorted(d.id for d in r.damages) for r in rows.values())
    alone = dtos.inspection_dto(frames[0], *(f.limit(0) for f in frames[1:])).first()
    assert (alone.damages, alone.file_forensic_results, alone.forensic_result, alone.owner_email) == ([], [], None, None)


def test_dtos_are_shaped_before_they_move(spark):
    """Children of all kinds take one shuffle and are text by then; an order's fields are made in more tasks than its file has splits."""
    from claimlens.operators import dtos
    from claimlens.plans.dtos import ENTITIES, entity_frame, flat, inspection_dtos_whole

    plan = inspection_dtos_whole(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(inspection_id") == 1 and "partial_collect_list" not in plan.split("Exchange hashpartitioning(inspection_id")[1]
    assert table(spark, SF, "orders").rdd.getNumPartitions() == 1 < entity_frame(spark, SF, "inspections").rdd.getNumPartitions()
    frames = [entity_frame(spark, SF, n).where(F.col(k) < 40) for n, k in zip(ENTITIES, ["id", "id", *["inspection_id"] * 4])]
    frames = [frames[0].withColumn("user_id", F.when(F.col("id") % 3 > 0, F.col("id") % 50)), *(f.unionAll(f.limit(5)) for f in frames[1:])]  # rows that are there twice; users that aren't
    rows = dtos.inspection_dto(*frames)
    want = rows.select("id", *(flat(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema if f.name != "id"))
    got = dtos.inspection_dto(*frames, shape=flat)
    got = got.select(want.columns[0], *(flat(F.col(f.name), f.dataType).alias(f.name) for f in got.schema if f.name != "id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 40


def test_inspections_without_a_user_are_dealt_out(spark):
    """They are rows of many join keys, not of one that a single task would get."""
    from claimlens.operators import dtos
    from claimlens.plans.dtos import ENTITIES, entity_frame

    frames = [entity_frame(spark, SF, n) for n in ENTITIES]
    frames[0] = frames[0].withColumn("user_id", F.when(F.col("id") < 0, F.col("id")))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dtos.inspection_dto(*frames)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(user_id" not in plan and "Exchange hashpartitioning(_key" in plan
        assert out.where("owner_email is null and owner_full_name is null").count() == frames[0].count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_texts_that_are_no_json(spark):
    from claimlens.operators import dtos

    texts = ['{"outcome":"x"}', ' { "outcome":"x"}', '{\n\t"outcome":"x"}', "{}", "{ }", "{'outcome':'x'}", "{outcome:1}", '{"outcome":', "{broken", '\n{"outcome":"x"}', '{"outcome":"x","outcome":"y"}', "[]", "{", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(dtos.parsed(F.col("t"), dtos.INSPECTION_JSON["agent_decision_json"][1], False).alias("p")).collect()
    assert [r.p and (r.p.outcome or "-") for r in got] == ["x", "x", "x", "-", "-"] + [None] * 10


def test_software_rules_are_dealt_out(spark):
    """A part's rules are much work for few bytes: a file of one split isn't one task."""
    from claimlens.plans import metadata

    assert table(spark, SF, "part").rdd.getNumPartitions() == 1 < metadata.editing_software(spark, SF).rdd.getNumPartitions()


def test_reports_are_parsed_once(spark):
    plan = d.training_rows(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("jsontostructs") == 1


def test_rows_move_and_texts_stay(spark):
    """What is moved is the rows that children and inspections are made of, in a number of tasks that keeps the texts in memory; the results are those of the entities."""
    import re

    from claimlens.operators import dtos
    from claimlens.plans.dtos import ENTITIES, entity_frame, flat, inspection_dtos_whole

    held = dtos.ROWS
    dtos.ROWS = 500
    try:
        out = inspection_dtos_whole(spark, SF)
    finally:
        dtos.ROWS = held
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [line + "\n" + below for line, below in zip(plan.split("\n"), plan.split("\n")[1:]) if "Exchange hashpartitioning" in line]
    assert len(moved) >= 2 and not any(re.search("concat_ws|from_json|repair_method|image_url", x) for x in moved)
    assert f", {-(-table(spark, SF, 'lineitem').count() // 500)}), REPARTITION_BY_NUM" in plan
    want = dtos.inspection_dto(*(entity_frame(spark, SF, n) for n in ENTITIES), shape=flat)
    want = want.select("id", *(flat(F.col(f.name), f.dataType).alias(f.name) for f in want.schema if f.name != "id"))
    assert out.columns == want.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
