"""Fusion, decisions, roll-ups and enforcement on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from claimlens.config import CALIBRATED, DEFAULT, FINDING_MODULES, finding_threshold
from claimlens.operators import decisions, fusion

V, A, N = fusion.PROVENANCE_VALID, fusion.AI_TOOL, fusion.AI_FILENAME
CASES = [
    ("dampened", {"clip": 0.13, "organika": 0.0, "dino": 0.58, "pixel": 0.22}, [], 0.178453, 18, "Low", (0.8215, 0.1071, 0.0714)),
    ("single family", {"clip": 0.1, "organika": 0.05, "dino": 0.9, "pixel": 0.1}, [], 0.176667, 18, "Low", (0.8233, 0.106, 0.0707)),
    ("extreme", {"clip": 0.05, "organika": 0.0, "pixel": 0.1, "dino": 0.95}, [], 0.153333, 15, "Low", (0.8467, 0.092, 0.0613)),
    ("borderline pixel", {"clip": 0.08, "organika": 0.0, "pixel": 0.29, "dino": 0.67, "modification": 0.15}, [], 0.217227, 22, "Medium", (0.7828, 0.1303, 0.0869)),
    ("consensus", {"clip": 0.55, "organika": 0.5, "pixel": 0.45, "dino": 0.3}, [], 0.75, 75, "High", (0.25, 0.75, 0.0)),
    ("all zero", {"clip": 0.0, "organika": 0.0, "dino": 0.0, "pixel": 0.0}, [], 0.0, 0, "Low", (1.0, 0.0, 0.0)),
    ("clip, two confirm", {"clip": 0.74, "organika": 0.39, "pixel": 0.33, "community": 0.04, "dino": 0.5}, [], 0.92, 92, "Critical", (0.08, 0.92, 0.0)),
    ("clip, one confirms", {"clip": 0.74, "organika": 0.1, "pixel": 0.3, "dino": 0.1}, [], 0.85, 85, "Critical", (0.15, 0.85, 0.0)),
    ("clip alone", {"clip": 0.6, "organika": 0.05, "pixel": 0.1, "dino": 0.05}, [], 0.2, 20, "Medium", (0.8, 0.12, 0.08)),
    ("tool", {"clip": 0.1, "organika": 0.0, "pixel": 0.1, "dino": 0.0}, [A], 0.9, 90, "Critical", (0.1, 0.9, 0.0)),
    ("valid", {"clip": 0.42, "organika": 0.42, "pixel": 0.42, "dino": 0.42}, [V], 0.21, 21, "Medium", (0.79, 0.126, 0.084)),
    ("name and detector", {"clip": 0.3, "organika": 0.0, "pixel": 0.1, "dino": 0.0}, [N], 0.75, 75, "High", (0.25, 0.75, 0.0)),
    ("name alone", {"clip": 0.1, "organika": 0.0, "pixel": 0.1, "dino": 0.0}, [N], 0.19, 19, "Low", (0.81, 0.114, 0.076)),
    ("one tamper", {"mesorch": 0.8, "clip": 0.0, "organika": 0.0}, [], 0.68, 68, "High", (0.32, 0.0, 0.68)),
    ("two tamper", {"mesorch": 0.6, "modification": 0.7, "clip": 0.0, "organika": 0.0}, [], 0.6, 60, "High", (0.4, 0.36, 0.24)),
    ("text", {"text": 0.62, "content": 0.75}, [], 0.75, 75, "High", (0.25, 0.525, 0.225)),
]


def test_fusion_cases(spark):
    df = spark.createDataFrame([(n, s, c) for n, s, c, *_ in CASES], "name string, scores map<string,double>, codes array<string>")
    got = {r.name: r for r in fusion.fused(df).collect()}
    for name, _, _, overall, score, level, probabilities in CASES:
        r = got[name]
        assert r.overall == pytest.approx(overall, abs=1e-4), name
        assert (r.score100, r.level) == (score, level), name
        assert (r.p_authentic, r.p_ai, r.p_tampered) == pytest.approx(probabilities, abs=2e-4), name


def test_fusion_without_modules_and_with_meta(spark):
    df = spark.createDataFrame([("none", {}, [], None), ("mid", {"mesorch": 0.8, "clip": 0.0}, [], 0.0)], "name string, scores map<string,double>, codes array<string>, meta double")
    got = {r.name: r for r in fusion.fused(df, meta=F.col("meta")).collect()}
    assert (got["none"].overall, got["none"].score100, got["none"].level, got["none"].p_ai) == (0.0, 0, "Low", None)
    assert got["mid"].overall == pytest.approx(0.7 * 0.68)


def test_profiles_and_overrides():
    assert (CALIBRATED.fusion.risk_high, CALIBRATED.fusion.risk_critical, CALIBRATED.fusion.boost_moderate_floor, CALIBRATED.fusion.swin_min) == (0.34, 0.85, 0.55, 0.60)
    assert (DEFAULT.enforcement.upload_high, DEFAULT.base_risk.medium, DEFAULT.verdict.forged_risk, DEFAULT.module_damage["content_validation"]) == (0.30, 0.25, 0.85, 0.40)
    with pytest.warns(UserWarning):
        assert DEFAULT.overridden({"fusion": {"nonsense": 1}, "_metadata": {"x": 1}}) == DEFAULT
    with pytest.warns(UserWarning):
        assert DEFAULT.overridden({"nowhere": {"x": 1}}) == DEFAULT
    changed = DEFAULT.overridden({"fusion": {"risk_high": "0.5", "boost_strong_min_high": "3"}, "module_damage": {"own_module": "0.2", "clip_ai_detection": 0.6}})
    assert (changed.fusion.risk_high, changed.fusion.boost_strong_min_high, changed.module_damage["own_module"], changed.module_damage["clip_ai_detection"]) == (0.5, 3, 0.2, 0.6)
    assert DEFAULT.fusion.risk_high == 0.40
    assert [finding_threshold("clip", u, changed) for u in (False, True)] == [0.6, 0.5]


def test_thresholds_act_on_the_fused_score(spark):
    """By hand: clip and pixel of .47 confirm each other under the default profile and not where a high detector needs .50."""
    df = spark.createDataFrame([({"clip": 0.47, "pixel": 0.47, "organika": 0.2}, [])], "scores map<string,double>, codes array<string>")
    score = lambda p: fusion.fused(df, profile=p).first().overall
    plain = (0.47 * 0.20 + 0.47 * 0.10 + 0.2 * 0.25) / 0.55
    assert score(DEFAULT) == pytest.approx(0.75)  # two high, none low, pixel confirms
    assert score(DEFAULT.overridden({"fusion": {"detector_high": 0.50}})) == pytest.approx(plain)
    assert score(DEFAULT.overridden({"fusion": {"boost_strong_min_high": 3}})) == pytest.approx(0.65)
    assert score(DEFAULT.overridden({"fusion": {"boost_strong_floor": 0.8}})) == pytest.approx(0.8)
    assert score(CALIBRATED) == pytest.approx(plain)


def test_finding_table_by_hand(spark):
    assert [(m, finding_threshold(m, False), finding_threshold(m, True), *row[2:]) for m, row in FINDING_MODULES.items()] == [
        ("ai_generation", 0.50, 0.40, "Severe", "Critical"), ("clip", 0.45, 0.35, "Moderate", "Severe"), ("vae", 0.45, 0.35, "Moderate", "Severe"), ("deep_modification", 0.50, 0.40, "Moderate", "Severe"),
        ("modification", 0.45, 0.35, "Moderate", "Moderate"), ("text", 0.45, 0.35, "Moderate", "Severe"), ("content", 0.40, 0.30, "Severe", "Critical"),
    ]


@pytest.mark.parametrize(
    "severity, safety, cause, risk, upload, expected",
    [
        ("Minor", "Safe", "AI generiranje", 0.70, False, ("Critical", "Critical", "AI generiranje", False)),
        ("Minor", "Safe", "AI generiranje", 0.45, False, ("Severe", "Critical", "AI generiranje", False)),
        ("Minor", "Safe", "AI generiranje", 0.25, False, ("Moderate", "Warning", "AI generiranje", False)),
        ("Minor", "Safe", "Osvjetljenje", 0.45, False, ("Moderate", "Warning", "Osvjetljenje", False)),
        ("Moderate", "Safe", "Osvjetljenje", 0.70, False, ("Severe", "Warning", "Osvjetljenje", False)),
        ("Minor", "Safe", "Autentično", 0.45, False, ("Moderate", "Warning", "Metadata anomalija", True)),
        ("Minor", "Safe", "Autentično", 0.55, True, ("Severe", "Warning", "Metadata anomalija", True)),
        ("Minor", "Safe", "Autentično", 0.25, False, ("Minor", "Safe", "Autentično", False)),
        ("Minor", "Safe", None, 0.10, True, ("Minor", "Safe", None, False)),
    ],
)
def test_enforcement(spark, severity, safety, cause, risk, upload, expected):
    df = spark.createDataFrame([(severity, safety, cause, risk, upload)], "severity string, safety string, cause string, risk double, upload boolean")
    x = df.select(decisions.enforced(*(F.col(c) for c in df.columns)).alias("x")).first().x
    assert (x.severity, x.safety, x.cause, x.remark != "") == expected


def test_risk_falls_back_to_the_modules(spark):
    df = spark.createDataFrame([(None, [0.2, None, 0.6]), (0.0, [0.3]), (0.1, [0.9]), (None, [None]), (0.0, None)], "overall double, modules array<double>")
    assert [r[0] for r in df.select(decisions.effective_risk(F.col("overall"), F.col("modules"))).collect()] == [0.6, 0.3, 0.1, 0.0, 0.0]


DECISIONS = [
    (dict(fraud=0.9), "Escalate"),
    (dict(ai=0.8), "Escalate"),
    (dict(ai=0.5, spec=0.4), "Escalate"),
    (dict(fraud=0.5), "HumanReview"),
    (dict(fraud=0.2), "HumanReview"),
    (dict(fraud=0.05), "AutoApprove"),
    (dict(fraud=0.05, n_findings=6), "AutoApprove"),
    (dict(fraud=0.2, source="Upload"), "HumanReview"),
    (dict(has_severe=True), "HumanReview"),
    (dict(has_safety=True), "Escalate"),
    (dict(), "AutoApprove"),
    (dict(cnn=0.5), "HumanReview"),
]


def test_decisions(spark):
    names = ["fraud", "ai", "spec", "cnn", "n_findings", "has_critical", "has_severe", "has_safety", "source"]
    rows = [(i, *(case.get(n) for n in names)) for i, (case, _) in enumerate(DECISIONS)]
    df = spark.createDataFrame(rows, "i int, fraud double, ai double, spec double, cnn double, n_findings int, has_critical boolean, has_severe boolean, has_safety boolean, source string")
    got = {r.i: r.outcome for r in decisions.decided(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(DECISIONS)}


def test_rollups(spark):
    df = spark.createDataFrame([(1, [0.5, 0.4, -0.1]), (2, []), (3, [0.9, 0.6, 0.3, 0.2]), (4, [-0.2])], "i int, r array<double>")
    got = {x.i: (x.m, x.d) for x in df.select("i", fusion.module_rollup(F.col("r")).alias("m"), fusion.document_rollup(F.col("r")).alias("d")).collect()}
    assert got[1] == pytest.approx((0.4, 0.55 * 0.5 + 0.30 * 0.45 + 0.15 / 3 - 0.1))
    assert got[2] == (0.0, 0.0) and got[4] == (0.0, 0.0)
    assert got[3] == pytest.approx((0.9, 0.55 * 0.9 + 0.30 * 0.6 + 0.15 * 2 / 3))


def test_urgency_is_raised_only_from_below(spark):
    df = spark.createDataFrame([(None, 0.7), ("Low", 0.5), ("Medium", 0.9), (None, 0.1)], "u string, r double")
    assert [x[0] for x in df.select(decisions.escalated_urgency(F.col("u"), F.col("r"))).collect()] == ["Critical", "High", "Medium", None]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, truth string, clip double, pixel double, mesorch double")


def test_area_under_the_curve(spark):
    from claimlens.plans.calibration import auc

    one = [(i, "authentic", 0.1 * i, 0.0, 0.0) for i in range(4)]
    assert auc(labels_of(spark, one)).first().auc == 0.5
    # Scores .9 (AI), .8 (other), .7 (AI), .1 (other): points (0, .5), (.5, .5), (.5, 1), (1, 1); the areas add up to .25 + .5.
    rows = [(1, "ai_generated", 0.9, 0, 0), (2, "authentic", 0.8, 0, 0), (3, "ai_generated", 0.7, 0, 0), (4, "tampered", 0.1, 0, 0)]
    assert auc(labels_of(spark, [(a, b, c, float(d), float(e)) for a, b, c, d, e in rows])).first().auc == 0.75


def test_derived_thresholds(spark):
    from claimlens.plans.calibration import overrides

    # Authentic maxima .01 to .10 and pixel as much: all percentiles are under their bounds. The best threshold is the first that parts the classes: .15.
    rows = [(i, "authentic", 0.01 * i, 0.01 * i, 0.0) for i in range(1, 11)] + [(20, "ai_generated", 0.9, 0.9, 0.9)]
    r = overrides(labels_of(spark, rows)).first()
    assert (r.p75_top, r.p90_top, r.p95_pixel) == (0.08, 0.09, 0.1)
    assert (r.cnn_dampening_threshold, r.independent_confirm, r.detector_high, r.risk_medium, r.risk_high) == (0.20, 0.20, 0.40, 0.15, 0.30)
    # Maxima .50 to .95: the percentile 75 is element round(.75 * 9) = 7, .85; percentile 90 is element 8, .90, bounded to .50.
    rows = [(i, "authentic", 0.50 + 0.05 * i, 0.3, 0.0) for i in range(10)] + [(20, "ai_generated", 0.6, 0.0, 0.0)]
    r = overrides(labels_of(spark, rows)).first()
    assert (r.cnn_dampening_threshold, r.independent_confirm, r.detector_high) == (0.85, 0.30, 0.50)


def test_coverage(spark):
    from claimlens.plans.calibration import coverage

    rows = [("a", 0.5), ("a", 0.0), ("a", None), ("a", None), ("b", None), ("b", None), ("b", 0.2)]
    got = {r.module: r for r in coverage(spark.createDataFrame(rows, "module string, score double"), "module", "score", F.lit(4)).collect()}
    assert (got["a"].present, got["a"].nonzero, got["a"].mean, got["a"].stdev, got["a"].missing) == (2, 1, 0.25, 0.25, False)
    assert (got["b"].present, got["b"].nonzero, got["b"].missing) == (1, 1, True)


def test_subsampled_thresholds(spark):
    from claimlens.plans.calibration import ghost

    rows = [(i, "authentic", 0.05 * (i % 10), 0.0, 0.0) for i in range(50)] + [(100 + i, "ai_generated", 0.5 + 0.04 * (i % 10), 0.0, 0.0) for i in range(30)]
    whole = {r.t: r for r in ghost(labels_of(spark, rows), samples=3, share=1.0).collect()}
    # The samples are all rows: the classes are parted at 46 to 50 hundredths, where kappa is 1.
    assert [t for t, r in whole.items() if r.optimal] == [46] and whole[50].median == whole[50].p5 == 1.0
    # At 0 all are predicted: 30 of 80 are right, and so much is expected by chance.
    assert whole[0].median == 0.0
    some = {r.t: r for r in ghost(labels_of(spark, rows), samples=20).collect()}
    assert len(some) == 101 and all(r.p5 <= r.median <= r.p95 for r in some.values())
    assert [tuple(r) for r in ghost(labels_of(spark, rows), samples=20).orderBy("t").collect()] == [tuple(some[t]) for t in range(101)]


def test_balanced_sample_counts(spark):
    from claimlens.plans.calibration import balanced_sample, labelled

    sf = "/root/testdata/sf0.01"
    there = {r.truth: r["count"] for r in labelled(spark, sf).groupBy("truth").count().collect()}
    got = {r.truth: r["count"] for r in balanced_sample(spark, sf).groupBy("truth").count().collect()}
    assert got == {t: min(n, 50 if t == "authentic" else 25) for t, n in there.items()}
