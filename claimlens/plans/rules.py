"""Fusion, decisions, roll-ups and meta features over module scores that are made from order keys.

Scores are integer arithmetic on keys, which every engine computes alike: score m of key k is ((k * a + b) % 1000) / 1000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.config import CALIBRATED, DEFAULT, FINDING_MODULES, FRAUD_CAUSES, Profile, finding_threshold
from claimlens.operators import decisions, fusion
from claimlens.sources.tables import table

#: Made scores: multiplier, offset, and the remainder of the key by 7 at which the module is absent.
MADE = {"clip": (37, 11, 1), "organika": (53, 7, 2), "pixel": (71, 29, 9), "community": (97, 3, 3), "dino": (31, 17, 4), "ai_generation": (83, 5, 5), "modification": (59, 13, 9), "mesorch": (67, 23, 6), "deep_modification": (43, 19, 0), "text": (29, 31, 1), "content": (61, 37, 2), "vae": (47, 41, 5)}


def made(m: str, k: Column) -> Column:
    a, b, gone = MADE[m]
    # The scores are pushed towards 0, so that every band of the rules has rows.
    return F.when(k % 7 != gone, F.round(F.pow(((k * a + b) % 1000) / 1000.0, F.lit(2.0)), 6))


def made_sql(m: str, k: str = "o_orderkey") -> str:
    a, b, gone = MADE[m]
    return f"CASE WHEN {k} % 7 <> {gone} THEN round(pow((({k} * {a} + {b}) % 1000) / 1000.0, 2.0), 6) END"


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    scores = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, MADE)), F.array(*(made(m, k) for m in MADE))), lambda n, v: v.isNotNull())
    codes = F.array_compact(F.array(F.when(k % 17 == 0, fusion.PROVENANCE_VALID), F.when(k % 19 == 0, fusion.AI_TOOL), F.when(k % 13 == 0, fusion.AI_FILENAME)))
    return table(spark, sf_dir, "orders").select("o_orderkey", scores.alias("scores"), codes.alias("codes"))


def fuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.fused(scored_orders(spark, sf_dir))
    return out.select("o_orderkey", F.round("overall", 9).alias("overall"), "score100", "level")


def fuse_scores_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores under the calibrated profile: dampening, confirmation, boosts and bands all change."""
    out = fusion.fused(scored_orders(spark, sf_dir), profile=CALIBRATED)
    return out.select("o_orderkey", F.round("overall", 9).alias("overall"), "score100", "level")


def verdict_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.fused(scored_orders(spark, sf_dir))
    return out.select("o_orderkey", "p_authentic", "p_ai", "p_tampered")


def decision_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_findings"), F.bool_or(F.col("l_quantity") >= 49).alias("has_critical"), F.bool_or(F.col("l_tax") >= 0.08).alias("has_severe"), F.bool_or(F.col("l_discount") > 0.099).alias("has_safety"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", made("modification", k).alias("fraud"), made("ai_generation", k).alias("ai"), made("pixel", k).alias("spec"), made("deep_modification", k).alias("cnn"), F.when(k % 2 == 0, "Upload").otherwise("Camera").alias("source")
    )
    out = decisions.decided(rows.join(lines, F.col("l_orderkey") == k, "left"))
    return out.select("o_orderkey", F.array_join("trace", ",").alias("trace"), "outcome")


def deterministic_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, urgency, and how many modules reach their thresholds, which are lower for uploads."""
    k = F.col("o_orderkey")
    risk = F.coalesce(made("modification", k), F.lit(0.0))
    fires = F.lit(0)
    for m in FINDING_MODULES:
        fires = fires + F.coalesce(made(m, k) >= F.when(k % 2 == 0, finding_threshold(m, True)).otherwise(finding_threshold(m, False)), F.lit(False)).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", decisions.verdict(risk).alias("verdict"), decisions.urgency(risk).alias("urgency"), fires.alias("n_findings"))


#: Causes of the made findings: fraud, authentic in two spellings, and others.
CAUSES = ["AI generiranje", "Autentično", "Osvjetljenje", "Sumnjiva tekstura", " AUTHENTIC "]


def severity_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after enforcement; where the overall risk is missing or 0, the largest of three modules' risks stands for it."""
    k = F.col("l_orderkey")
    of = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", of(["Minor", "Moderate", "Severe", "Critical"], F.col("l_linenumber") % 4).alias("severity"), of(["Safe", "Warning", "Critical"], F.col("l_partkey") % 3).alias("safety"),
        of(CAUSES, F.col("l_suppkey") % len(CAUSES)).alias("cause"), of(["Low", "Medium", "High"], F.col("l_partkey") % 3).alias("urgency"),
        decisions.effective_risk(F.when(k % 5 > 0, made("pixel", k)), F.array(made("clip", k), made("mesorch", k), made("text", k))).alias("risk"), (k % 2 == 0).alias("upload"),
    )
    new = decisions.enforced(F.col("severity"), F.col("safety"), F.col("cause"), F.col("risk"), F.col("upload"))
    out = rows.withColumns({"new": new, "new_urgency": decisions.enforced_urgency(F.col("urgency"), F.col("risk"), F.col("upload"))})
    return out.groupBy("cause", "severity", "safety", F.col("new.severity").alias("new_severity"), F.col("new.safety").alias("new_safety"), F.col("new.cause").alias("new_cause"), (F.col("new.remark") != "").alias("remarked"), "new_urgency").agg(F.count("*").alias("n"))


def inspection_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of an inspection: that of its worst file and the group's modifier, at most 1; the level is that file's, not recomputed."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    risk = F.coalesce(made("pixel", k), F.lit(0.0))
    level = F.when(risk >= 0.85, "Critical").when(risk >= 0.40, "High").when(risk >= 0.20, "Medium").otherwise("Low")
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(risk).alias("top"), F.max_by(level, risk).alias("level"), F.count("*").alias("n"))
    modifier = F.when(F.col("n") >= 2, fusion.group_modifier(F.col("top"), F.col("n").cast("double"))).otherwise(0.0)
    return g.select("l_orderkey", F.round(F.least(F.col("top") + modifier, F.lit(1.0)), 3).alias("risk"), "level")


def module_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module and document roll-ups of each inspection's finding risks, negative ones being trust."""
    risk = F.col("l_discount") * 8 - F.col("l_tax") * 4
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.round(risk, 6)).alias("risks"))
    return g.select("l_orderkey", F.round(fusion.module_rollup(F.col("risks")), 4).alias("module_risk"), F.round(fusion.document_rollup(F.col("risks")), 4).alias("document_risk"))


def disagreement_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    values = F.array(*(made(m, k) for m in ("clip", "organika", "pixel", "community", "dino", "ai_generation")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(fusion.disagreement(values), 5).alias("disagreement"), F.round(fusion.uncertainty(F.array_compact(values)), 5).alias("uncertainty"))


def label_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    truth = F.element_at(F.array(*map(F.lit, ["authentic", "ai_generated", "tampered"])), (k % 3 + 1).cast("int"))
    n = lambda ms, t: sum((F.coalesce(made(m, k) >= t, F.lit(False)).cast("int") for m in ms), F.lit(0))
    advice = decisions.label_suggestion(F.col("truth"), F.col("risk"), F.col("ai_high"), F.col("tamper_high"))
    rows = table(spark, sf_dir, "orders").select(truth.alias("truth"), F.coalesce(made("content", k), F.lit(0.0)).alias("risk"), n(["dino", "community", "clip", "organika", "pixel"], 0.50).alias("ai_high"), n(["modification", "mesorch"], 0.40).alias("tamper_high"))
    return rows.groupBy("truth", advice.alias("suggestion")).agg(F.count("*").alias("n"))


def label_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose score contradicts their label: authentic at .65 or more, AI under .20."""
    k = F.col("o_orderkey")
    score = F.coalesce(made("clip", k), F.lit(0.0))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 2 == 0, "authentic").otherwise("ai_generated").alias("truth"), score.alias("score"))
    return rows.where("(truth = 'authentic' and score >= 0.65) or (truth = 'ai_generated' and score < 0.20)").groupBy("truth").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


#: The modules of the meta features, in their order, by the names used here.
META_MODULES = ["clip", "dino", "organika", "pixel", "safe", "bfree", "rine", "modification", "mesorch", "prnu", "metadata", "document", "office", "text", "content"]


def meta_features(risks: Column, confidences: Column, counts: Column) -> Column:
    """165 features from maps of modules: risk, mean confidence and findings (ten at most, in tenths) of each, products of the risks of each two, and squares.

    Modules that are absent or failed are 0.
    """
    get = lambda m, name: F.coalesce(m[name], F.lit(0.0))
    v = [get(risks, m) for m in META_MODULES]
    base = [x for m, s in zip(META_MODULES, v) for x in (s, get(confidences, m), F.least(get(counts, m), F.lit(10.0)) / 10)]
    cross = [v[i] * v[j] for i in range(len(v)) for j in range(i + 1, len(v))]
    return F.array(*base, *cross, *(x * x for x in v))


N_FEATURES = len(META_MODULES) * 3 + len(META_MODULES) * (len(META_MODULES) + 1) // 2


def dot(x: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)


def logistic(logit: Column) -> Column:
    """1 / (1 + exp(-x)) with x within 500."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), logit))))


def class_probabilities(x: Column, binary: list[float], multi: dict[str, list[float]] | None = None) -> Column:
    """Probabilities of authentic, ai_generated and tampered: a softmax of three dot products, or, with binary weights only, .6 and .4 of the rest."""
    if multi is None:
        p = logistic(dot(x, binary))
        values = [1 - p, p * 0.6, p * 0.4]
    else:
        logits = [dot(x, multi[c]) for c in ("authentic", "ai_generated", "tampered")]
        top = F.greatest(*logits)
        exps = [F.exp(z - top) for z in logits]
        values = [e / (exps[0] + exps[1] + exps[2]) for e in exps]
    return F.struct(*(F.round(v, 4).alias(n) for v, n in zip(values, ("p_authentic", "p_ai", "p_tampered"))))


#: Made weights (trained ones come with a model): alternately signed and falling, and one set for each class.
BINARY = [(-1.0) ** i / (i + 1) for i in range(N_FEATURES)]
MULTI = {c: [((i * (7 + 4 * k)) % 13 - 6) / 20 for i in range(N_FEATURES)] for k, c in enumerate(("authentic", "ai_generated", "tampered"))}


def meta_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meta model's score and probabilities of the inspections, by multinomial weights and by the fallback."""
    k = F.col("o_orderkey")
    scores = F.col("scores")
    confidences, counts = F.transform_values(scores, lambda m, s: 0.5 + s / 2), F.transform_values(scores, lambda m, s: F.floor(s * 20).cast("double"))
    rows = scored_orders(spark, sf_dir).select(k, meta_features(scores, confidences, counts).alias("x"))
    rows = rows.select(k, F.size("x").alias("n_features"), F.round(logistic(dot(F.col("x"), BINARY)), 5).alias("p"), class_probabilities(F.col("x"), BINARY, MULTI).alias("m"), class_probabilities(F.col("x"), BINARY).alias("f"))
    return rows.select("o_orderkey", "n_features", "p", "m.*", F.col("f.p_ai").alias("fallback_ai"))


QUERIES = {f.__name__: f for f in (fuse_scores, fuse_scores_calibrated, verdict_probabilities, decision_engine, deterministic_verdict, severity_enforcement, inspection_risk, module_rollups, disagreement_uncertainty, label_cleaning, label_disagreement, meta_logistic)}

_S = ", ".join(f"{made_sql(m)} AS {m}" for m in MADE)
_Z = lambda c: f"coalesce({c}, 0)"
_N = lambda cs: "(" + " + ".join(f"coalesce(({c})::INT, 0)" for c in cs) + ")"

def fusion_sql(p: Profile) -> str:
    t = p.fusion
    return f"""
    WITH s AS (SELECT o_orderkey, {_S}, o_orderkey % 17 = 0 AS valid, o_orderkey % 19 = 0 AS tool, o_orderkey % 13 = 0 AS named FROM orders),
    a AS (SELECT *, coalesce(greatest(clip, organika, pixel, community), 0) AS m FROM s),
    b AS (SELECT *, CASE WHEN m >= {t.cnn_dampening_threshold} THEN 1 ELSE {t.cnn_dampening_floor} + (1 - {t.cnn_dampening_floor}) * m / {t.cnn_dampening_threshold} END AS d,
                 (clip IS NOT NULL)::INT * 0.20 + (organika IS NOT NULL)::INT * 0.25 + (community IS NOT NULL)::INT * 0.25 + (dino IS NOT NULL)::INT * 0.20 + (pixel IS NOT NULL)::INT * 0.10 AS w FROM a),
    c AS (SELECT *, CASE WHEN w > 0 THEN ({_Z('clip')} * 0.20 + {_Z('organika')} * 0.25 + {_Z('community')} * 0.25 + {_Z('dino')} * d * 0.20 + {_Z('pixel')} * 0.10) / w ELSE 0 END * CASE WHEN valid THEN {t.c2pa_factor} ELSE 1 END AS core0 FROM b),
    e AS (SELECT *, CASE WHEN tool THEN greatest(core0, {t.ai_metadata_floor})
                         WHEN named AND {_N([f'{x} >= 0.25' for x in ('dino', 'organika', 'community', 'clip', 'ai_generation')])} > 0 THEN greatest(core0, 0.75)
                         WHEN named THEN greatest(core0, least(core0 + 0.15, 0.50)) ELSE core0 END AS core,
                 list_filter([CASE WHEN deep_modification >= {t.deep_mod_min} THEN deep_modification END, CASE WHEN mesorch >= {t.mesorch_min} THEN mesorch END, CASE WHEN modification >= {t.ela_min} THEN modification * {t.ela_scale} END], lambda x: x IS NOT NULL) AS t FROM c),
    f AS (SELECT *, CASE WHEN len(t) >= 2 THEN list_max(t) WHEN len(t) = 1 AND list_max(t) >= {t.single_tamp_min} THEN list_max(t) * {t.single_tamp_scale} ELSE 0 END AS tampering,
                 {_N([f'dino >= {t.detector_high}'])} + {_N([f'{x} >= {t.detector_high}' for x in ('clip', 'organika', 'community', 'pixel')])} AS h, {_N([f'{x} >= {t.detector_high}' for x in ('clip', 'organika', 'community', 'pixel')])} AS hn,
                 {_N([f'{x} < {t.detector_low}' for x in ('clip', 'organika', 'community', 'dino', 'pixel')])} AS low, {_N([f'{x} >= {t.independent_confirm}' for x in ('organika', 'community', 'pixel')])} AS ind, {_N([f'{x} >= 0.40' for x in ('organika', 'community', 'pixel')])} AS strong FROM e),
    g AS (SELECT *, greatest(core, tampering, CASE WHEN text >= {t.text_ai_min} THEN text ELSE 0 END, CASE WHEN content >= {t.content_val_min} THEN content ELSE 0 END) AS o0 FROM f),
    i AS (SELECT *, CASE WHEN h >= {t.boost_strong_min_high} AND low <= 1 AND ind >= 1 THEN greatest(o0, {t.boost_strong_floor}) WHEN h >= {t.boost_moderate_min_high} AND hn >= 1 AND strong >= 1 THEN greatest(o0, {t.boost_moderate_floor}) ELSE o0 END AS o1 FROM g),
    j AS (SELECT *, CASE WHEN ai_generation >= {t.swin_min} AND ind >= 1 THEN greatest(o1, ai_generation) ELSE o1 END AS o2, {_N(['organika >= 0.25', 'pixel >= 0.25', 'community >= 0.20'])} AS cf FROM i),
    k AS (SELECT *, CASE WHEN clip >= 0.70 AND cf >= 2 THEN greatest(o2, 0.92, clip) WHEN clip >= 0.70 AND cf = 1 THEN greatest(o2, 0.85, clip) WHEN clip >= 0.70 AND ind >= 1 THEN greatest(o2, clip)
                         WHEN clip >= 0.50 AND clip < 0.70 AND low >= 3 THEN least(o2, 0.20) ELSE o2 END AS o3 FROM j),
    z AS (SELECT *, greatest(0, least(1, o3))::DOUBLE AS o, CASE WHEN core + tampering > 0 THEN core / (core + tampering) ELSE 0.7 END AS sh FROM k)
"""


_FUSION = fusion_sql(DEFAULT)
_R = lambda m: f"coalesce({m}, 0)::DOUBLE" if m in MADE else "0::DOUBLE"
_C = lambda m: f"coalesce(0.5 + {m} / 2, 0)::DOUBLE" if m in MADE else "0::DOUBLE"

ORACLES = {
    "fuse_scores": _FUSION + """
        SELECT o_orderkey, round(o, 9) AS overall, round_even(100 * o, 0)::INT AS score100, CASE WHEN o >= 0.85 THEN 'Critical' WHEN o >= 0.40 THEN 'High' WHEN o >= 0.20 THEN 'Medium' ELSE 'Low' END AS level FROM z""",
    "fuse_scores_calibrated": fusion_sql(CALIBRATED) + f"""
        SELECT o_orderkey, round(o, 9) AS overall, round_even(100 * o, 0)::INT AS score100,
               CASE WHEN o >= {CALIBRATED.fusion.risk_critical} THEN 'Critical' WHEN o >= {CALIBRATED.fusion.risk_high} THEN 'High' WHEN o >= {CALIBRATED.fusion.risk_medium} THEN 'Medium' ELSE 'Low' END AS level FROM z""",
    "verdict_probabilities": _FUSION + """
        SELECT o_orderkey, round(CASE WHEN o < 0.15 THEN greatest(0.85, 1 - 2 * o) WHEN o >= 0.65 THEN greatest(0.02, 1 - o) ELSE greatest(0.40, 1 - o) END + 1e-9, 4) AS p_authentic,
               round(CASE WHEN o < 0.15 THEN 0.4 * o WHEN o >= 0.65 THEN (1 - greatest(0.02, 1 - o)) * sh ELSE 0.6 * o END + 1e-9, 4) AS p_ai,
               round(CASE WHEN o < 0.15 THEN 0.6 * o * o WHEN o >= 0.65 THEN (1 - greatest(0.02, 1 - o)) * (1 - sh) ELSE 0.4 * o END + 1e-9, 4) AS p_tampered FROM z""",
    "decision_engine": f"""
        WITH l AS (SELECT l_orderkey, count(*) AS n, bool_or(l_quantity >= 49) AS crit, bool_or(l_tax >= 0.08) AS sev, bool_or(l_discount > 0.099) AS safe FROM lineitem GROUP BY 1),
        r AS (SELECT o_orderkey, {_Z(made_sql('modification'))} AS f, {_Z(made_sql('ai_generation'))} AS ai, {_Z(made_sql('pixel'))} AS spec, {_Z(made_sql('deep_modification'))} AS cnn, o_orderkey % 2 = 0 AS up,
                     coalesce(n, 0) AS n, coalesce(crit, false) AS crit, coalesce(sev, false) AS sev, coalesce(safe, false) AS safe FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
        t AS (SELECT *, list_filter([CASE WHEN f >= 0.85 THEN 'critical_risk' END, CASE WHEN crit OR ai >= 0.75 THEN 'critical_finding' END, CASE WHEN safe OR (f >= 0.6 AND ai >= 0.6) THEN 'safety' END,
                     CASE WHEN f >= 0.4 THEN 'high_risk' END, CASE WHEN sev THEN 'severe_finding' END, CASE WHEN n > 3 AND f >= 0.15 THEN 'many_findings' END, CASE WHEN f >= 0.15 THEN 'medium_risk' END,
                     CASE WHEN ai >= 0.6 THEN 'ai_detection' END, CASE WHEN ai >= 0.5 AND spec >= 0.4 THEN 'cross_validation' END, CASE WHEN up AND f >= 0.15 THEN 'upload' END], lambda x: x IS NOT NULL) AS tr FROM r)
        SELECT o_orderkey, array_to_string(tr, ',') AS trace,
               CASE WHEN list_has_any(tr, ['critical_risk', 'critical_finding', 'safety', 'ai_detection', 'cross_validation']) THEN 'Escalate' WHEN len(tr) > 0 OR cnn >= 0.5 THEN 'HumanReview' ELSE 'AutoApprove' END AS outcome FROM t""",
    "deterministic_verdict": f"""
        WITH r AS (SELECT o_orderkey, {_Z(made_sql('modification'))} AS risk, o_orderkey % 2 = 0 AS up, {_S} FROM orders)
        SELECT o_orderkey, CASE WHEN risk >= 0.85 THEN 'forged' WHEN risk >= 0.40 THEN 'suspicious' ELSE 'authentic' END AS verdict,
               CASE WHEN risk >= 0.85 THEN 'Critical' WHEN risk >= 0.40 THEN 'High' WHEN risk >= 0.15 THEN 'Medium' ELSE 'Low' END AS urgency,
               {_N([f'{m} >= CASE WHEN up THEN {up} ELSE {t} END' for m, t, up in (('ai_generation', 0.5, 0.4), ('clip', 0.45, 0.35), ('vae', 0.45, 0.35), ('deep_modification', 0.5, 0.4), ('modification', 0.45, 0.35), ('text', 0.45, 0.35), ('content', 0.4, 0.3))])} AS n_findings FROM r""",
    "severity_enforcement": f"""
        WITH r AS (SELECT ['Minor', 'Moderate', 'Severe', 'Critical'][l_linenumber % 4 + 1] AS severity, ['Safe', 'Warning', 'Critical'][l_partkey % 3 + 1] AS safety, {CAUSES}[l_suppkey % {len(CAUSES)} + 1] AS cause,
                     ['Low', 'Medium', 'High'][l_partkey % 3 + 1] AS urgency, {_Z(f"CASE WHEN l_orderkey % 5 > 0 THEN {made_sql('pixel', 'l_orderkey')} END")} AS own,
                     {_Z(f"greatest({made_sql('clip', 'l_orderkey')}, {made_sql('mesorch', 'l_orderkey')}, {made_sql('text', 'l_orderkey')})")} AS most, l_orderkey % 2 = 0 AS up FROM lineitem),
        q AS (SELECT *, CASE WHEN own = 0 THEN most ELSE own END AS risk, cause IN {tuple(FRAUD_CAUSES)} AS fraud, cause IN ('Autentično', ' AUTHENTIC ') AS auth FROM r),
        b AS (SELECT *, risk >= CASE WHEN up THEN 0.5 ELSE 0.65 END AS c, risk >= CASE WHEN up THEN 0.3 ELSE 0.4 END AS h, risk >= CASE WHEN up THEN 0.12 ELSE 0.2 END AS m FROM q)
        SELECT cause, severity, safety,
               CASE WHEN auth THEN CASE WHEN c THEN 'Severe' WHEN h THEN 'Moderate' ELSE severity END
                    WHEN fraud THEN CASE WHEN c THEN 'Critical' WHEN h THEN CASE WHEN severity IN ('Minor', 'Moderate') THEN 'Severe' ELSE severity END WHEN m AND severity = 'Minor' THEN 'Moderate' ELSE severity END
                    WHEN c THEN CASE WHEN severity IN ('Minor', 'Moderate') THEN 'Severe' ELSE severity END WHEN h AND safety = 'Safe' AND severity = 'Minor' THEN 'Moderate' ELSE severity END AS new_severity,
               CASE WHEN auth THEN CASE WHEN h THEN 'Warning' ELSE safety END
                    WHEN fraud THEN CASE WHEN c THEN 'Critical' WHEN safety <> 'Safe' THEN safety WHEN h THEN 'Critical' WHEN m THEN 'Warning' ELSE safety END
                    WHEN h AND safety = 'Safe' THEN 'Warning' ELSE safety END AS new_safety,
               CASE WHEN auth AND h THEN 'Metadata anomalija' ELSE cause END AS new_cause, auth AND h AS remarked,
               CASE WHEN c THEN 'Critical' WHEN h THEN 'High' WHEN m AND urgency = 'Low' THEN 'Medium' ELSE urgency END AS new_urgency, count(*) AS n FROM b GROUP BY ALL""",
    "inspection_risk": f"""
        WITH r AS (SELECT l_orderkey, {_Z(made_sql('pixel', '(l_orderkey * 8 + l_linenumber)'))} AS risk FROM lineitem),
        g AS (SELECT l_orderkey, max(risk) AS top, count(*) AS n FROM r GROUP BY 1)
        SELECT l_orderkey, round(least(top + CASE WHEN n >= 2 THEN round_even(least(0.30, top * 0.15 * (1 + least(n / 5, 1))), 4) ELSE 0 END, 1), 3) AS risk,
               CASE WHEN top >= 0.85 THEN 'Critical' WHEN top >= 0.40 THEN 'High' WHEN top >= 0.20 THEN 'Medium' ELSE 'Low' END AS level FROM g""",
    "module_rollups": """
        WITH r AS (SELECT l_orderkey, round(l_discount * 8 - l_tax * 4, 6) AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount * 8 - l_tax * 4 DESC) AS i FROM lineitem),
        g AS (SELECT l_orderkey, coalesce(max(x) FILTER (x > 0), 0) AS top, coalesce(sum(x) FILTER (x < 0), 0) AS neg, coalesce(avg(x) FILTER (x > 0 AND i <= 3), 0) AS mean3, count(*) FILTER (x >= 0.3) AS agree FROM r GROUP BY 1)
        SELECT l_orderkey, round(greatest(0, least(1, top + neg)), 4) AS module_risk,
               round(greatest(0, least(1, 0.55 * top + 0.30 * mean3 + 0.15 * greatest(least((agree - 1) / 3, 1), 0) + neg)), 4) AS document_risk FROM g""",
    "disagreement_uncertainty": f"""
        WITH s AS (SELECT o_orderkey, {_S} FROM orders),
        u AS (SELECT o_orderkey, unnest([clip, organika, pixel, community, dino, ai_generation]) AS x FROM s)
        SELECT o_orderkey, round(CASE WHEN count(x) >= 2 THEN var_pop(x) ELSE 0 END, 5) AS disagreement,
               round(CASE WHEN count(x) FILTER (x > 0) > 0 THEN 1 - 2 * abs(avg(x) FILTER (x > 0) - 0.5) ELSE 0 END, 5) AS uncertainty FROM u GROUP BY 1""",
    "label_cleaning": f"""
        WITH s AS (SELECT ['authentic', 'ai_generated', 'tampered'][o_orderkey % 3 + 1] AS truth, {_Z(made_sql('content'))} AS risk, {_S} FROM orders),
        r AS (SELECT truth, risk, {_N([f'{m} >= 0.5' for m in ('dino', 'community', 'clip', 'organika', 'pixel')])} AS a, {_N(['modification >= 0.4', 'mesorch >= 0.4'])} AS t FROM s)
        SELECT truth, CASE WHEN truth = 'authentic' THEN CASE WHEN a >= 3 OR (a >= 2 AND risk >= 0.5) THEN 'ai_generated' WHEN t >= 2 THEN 'tampered' WHEN risk >= 0.4 THEN 'REVIEW' ELSE 'keep' END
                           WHEN truth = 'ai_generated' THEN CASE WHEN a = 0 AND risk < 0.10 THEN 'authentic' WHEN a <= 1 AND risk < 0.15 THEN 'REVIEW' ELSE 'keep' END
                           WHEN a = 0 AND t = 0 AND risk < 0.10 THEN 'authentic' ELSE 'keep' END AS suggestion, count(*) AS n FROM r GROUP BY ALL""",
    "label_disagreement": f"""
        WITH s AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'authentic' ELSE 'ai_generated' END AS truth, {_Z(made_sql('clip'))} AS score FROM orders)
        SELECT truth, count(*) AS n, round(sum(score), 4) AS total FROM s WHERE (truth = 'authentic' AND score >= 0.65) OR (truth = 'ai_generated' AND score < 0.20) GROUP BY 1""",
    "meta_logistic": f"""
        WITH s AS (SELECT o_orderkey, {_S} FROM orders),
        v AS (SELECT o_orderkey, list_concat([{', '.join(f'{_R(m)}, {_C(m)}, least(floor({_R(m)} * 20), 10) / 10' for m in META_MODULES)}],
                [{', '.join(f'{_R(a)} * {_R(b)}' for i, a in enumerate(META_MODULES) for b in META_MODULES[i + 1:])}], [{', '.join(f'{_R(m)} * {_R(m)}' for m in META_MODULES)}]) AS x FROM s),
        z AS (SELECT o_orderkey, len(x)::INT AS n, 1 / (1 + exp(-list_sum(list_transform(x, lambda y, i: y * pow(-1, i - 1) / i)))) AS p, {', '.join(f"list_sum(list_transform(x, lambda y, i: y * ((((i - 1) * {7 + 4 * k}) % 13) - 6) / 20)) AS z{k}" for k in range(3))} FROM v),
        e AS (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM z)
        SELECT o_orderkey, n AS n_features, round(p, 5) AS p, round(e0 / (e0 + e1 + e2), 4) AS p_authentic, round(e1 / (e0 + e1 + e2), 4) AS p_ai, round(e2 / (e0 + e1 + e2), 4) AS p_tampered, round(p * 0.6, 4) AS fallback_ai FROM e""",
}
