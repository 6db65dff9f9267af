"""Fusion of module scores into one risk score, its level, and three class probabilities, as Column expressions.

The input is a column of type map<string,double> from the names of modules without an error to their scores, and a
column of type array<string> with the metadata module's finding codes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.config import CORE_WEIGHTS, DEFAULT, Profile
from claimlens.functions.columns import clamp01, fused_band

#: Finding codes of the metadata module that change the score.
PROVENANCE_VALID, AI_TOOL, AI_FILENAME = "META_C2PA_VALID", "META_XMP_AI_TOOL_HISTORY", "META_FILENAME_AI_GENERATOR"


def _count(*conditions: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in conditions])


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def fused(df: DataFrame, scores: str = "scores", codes: str = "codes", meta: Column | None = None, blend: float = 0.30, profile: Profile = DEFAULT) -> DataFrame:
    """df with core, tampering, overall, score100, level, p_authentic, p_ai and p_tampered.

    All thresholds are the profile's. meta, if given, is blended in at a share of blend where it isn't null and the score is between .15 and .85.
    No module at all gives 0, 0, Low and null probabilities.
    """
    # Each score is looked up once; the rules then are over plain columns.
    names = ("clip", "organika", "pixel", "community", "dino", "ai_generation", "modification", "mesorch", "deep_modification", "text", "content")
    df = df.withColumns({f"_s_{n}": F.col(scores)[n] for n in names})
    s = {n: F.col(f"_s_{n}") for n in names}
    has = lambda code: F.array_contains(codes, code)
    t = profile.fusion

    # The part of a lone detector is damped when the independent ones stay low.
    df = df.withColumn("_m", _or_zero(F.greatest(s["clip"], s["organika"], s["pixel"], s["community"])))
    damp = F.when(F.col("_m") >= t.cnn_dampening_threshold, 1.0).otherwise(t.cnn_dampening_floor + (1 - t.cnn_dampening_floor) * F.col("_m") / t.cnn_dampening_threshold)
    parts = {n: (s[n] * damp if n == "dino" else s[n]) for n in CORE_WEIGHTS}
    weight = reduce(lambda a, b: a + b, [F.when(s[n].isNotNull(), w).otherwise(0.0) for n, w in CORE_WEIGHTS.items()])
    total = reduce(lambda a, b: a + b, [_or_zero(parts[n] * w) for n, w in CORE_WEIGHTS.items()])
    df = df.withColumn("_core", F.when(weight > 0, total / weight).otherwise(0.0))

    core = F.when(has(PROVENANCE_VALID), F.col("_core") * t.c2pa_factor).otherwise(F.col("_core"))
    backed = _count(*(s[n] >= 0.25 for n in CORE_WEIGHTS if n != "pixel")) > 0
    named = F.when(backed, F.greatest(core, F.lit(0.75))).otherwise(F.greatest(core, F.least(core + 0.15, F.lit(0.50))))
    df = df.withColumn("core", F.when(has(AI_TOOL), F.greatest(core, F.lit(t.ai_metadata_floor))).when(has(AI_FILENAME), named).otherwise(core))

    signals = F.array_compact(F.array(F.when(s["deep_modification"] >= t.deep_mod_min, s["deep_modification"]), F.when(s["mesorch"] >= t.mesorch_min, s["mesorch"]), F.when(s["modification"] >= t.ela_min, s["modification"] * t.ela_scale)))
    df = df.withColumn("_t", signals)
    top = F.array_max("_t")
    df = df.withColumn("tampering", F.when(F.size("_t") >= 2, top).when((F.size("_t") == 1) & (top >= t.single_tamp_min), top * t.single_tamp_scale).otherwise(0.0))

    overall = F.greatest("core", "tampering", F.when(s["text"] >= t.text_ai_min, s["text"]).otherwise(0.0), F.when(s["content"] >= t.content_val_min, s["content"]).otherwise(0.0))
    reliable = [s[n] for n in ("clip", "organika", "community", "dino", "pixel")]
    h_non = _count(*(s[n] >= t.detector_high for n in ("clip", "organika", "community", "pixel")))
    h = _count(s["dino"] >= t.detector_high) + h_non
    low = _count(*(x < t.detector_low for x in reliable))
    ind, strong = (_count(*(s[n] >= least for n in ("organika", "community", "pixel"))) for least in (t.independent_confirm, 0.40))
    df = df.withColumns({"_o": overall, "_h": h, "_n": h_non, "_low": low, "_ind": ind, "_strong": strong})

    floor = lambda o, condition, value: F.when(F.coalesce(condition, F.lit(False)), F.greatest(o, value if isinstance(value, Column) else F.lit(value))).otherwise(o)
    o = F.when((F.col("_h") >= t.boost_strong_min_high) & (F.col("_low") <= 1) & (F.col("_ind") >= 1), F.greatest("_o", F.lit(t.boost_strong_floor))).otherwise(
        floor(F.col("_o"), (F.col("_h") >= t.boost_moderate_min_high) & (F.col("_n") >= 1) & (F.col("_strong") >= 1), t.boost_moderate_floor)
    )
    df = df.withColumn("_o", floor(o, (s["ai_generation"] >= t.swin_min) & (F.col("_ind") >= 1), _or_zero(s["ai_generation"])))
    confirms = _count(s["organika"] >= 0.25, s["pixel"] >= 0.25, s["community"] >= 0.20)
    clip = _or_zero(s["clip"])
    tier = F.when(confirms >= 2, F.greatest(F.lit(0.92), clip)).when(confirms == 1, F.greatest(F.lit(0.85), clip)).when(F.col("_ind") >= 1, clip).otherwise(0.0)
    o = floor(F.col("_o"), clip >= 0.70, tier)
    o = F.when((clip >= 0.50) & (clip < 0.70) & (F.col("_low") >= 3), F.least(o, F.lit(0.20))).otherwise(o)
    df = df.withColumn("_o", o)
    if meta is not None:
        df = df.withColumn("_o", F.when(meta.isNotNull() & (F.col("_o") > 0.15) & (F.col("_o") < 0.85), (1 - blend) * F.col("_o") + blend * meta).otherwise(F.col("_o")))

    o = clamp01(F.col("_o"))
    share = F.when(F.col("core") + F.col("tampering") > 0, F.col("core") / (F.col("core") + F.col("tampering"))).otherwise(0.7)
    authentic = F.greatest(F.lit(0.02), 1 - o)
    some = F.size(scores) > 0
    # Ties go up: binary noise doesn't decide them.
    probability = lambda a, b, c: F.when(some, F.round(F.when(o < t.verdict_low_threshold, a).when(o >= t.verdict_high_threshold, b).otherwise(c) + 1e-9, 4))
    out = {
        "overall": o,
        "score100": F.bround(100 * o).cast("int"),
        "level": fused_band(o, t.risk_critical, t.risk_high, t.risk_medium),
        "p_authentic": probability(F.greatest(F.lit(0.85), 1 - 2 * o), authentic, F.greatest(F.lit(0.40), 1 - o)),
        "p_ai": probability(0.4 * o, (1 - authentic) * share, 0.6 * o),
        "p_tampered": probability(0.6 * o * o, (1 - authentic) * (1 - share), 0.4 * o),
    }
    return df.withColumns(out).drop("_m", "_core", "_t", "_o", "_h", "_n", "_low", "_ind", "_strong", *(f"_s_{n}" for n in names))


def module_rollup(risks: Column) -> Column:
    """A module's score from its findings' risks: the largest positive one and all negative ones, between 0 and 1."""
    top = F.coalesce(F.array_max(F.filter(risks, lambda r: r > 0)), F.lit(0.0))
    return clamp01(top + F.aggregate(F.filter(risks, lambda r: r < 0), F.lit(0.0), lambda a, r: a + r))


def document_rollup(risks: Column) -> Column:
    """A document's score: .55 of the largest, .30 of the mean of the largest three, .15 of how many agree, and negative ones."""
    positive = F.sort_array(F.filter(risks, lambda r: r > 0), asc=False)
    top3 = F.slice(positive, 1, 3)
    mean = F.aggregate(top3, F.lit(0.0), lambda a, r: a + r) / F.greatest(F.size(top3), F.lit(1))
    agree = F.least((F.size(F.filter(risks, lambda r: r >= 0.30)) - 1) / 3.0, F.lit(1.0))
    base = 0.55 * F.coalesce(F.array_max(positive), F.lit(0.0)) + 0.30 * mean + 0.15 * F.greatest(agree, F.lit(0.0))
    return clamp01(base + F.aggregate(F.filter(risks, lambda r: r < 0), F.lit(0.0), lambda a, r: a + r))


def group_modifier(max_risk: Column, n: Column) -> Column:
    return F.bround(F.least(F.lit(0.30), max_risk * 0.15 * (1 + F.least(n / 5.0, F.lit(1.0)))), 4)


def disagreement(values: Column) -> Column:
    """Population variance of an array's non-null values; 0 for fewer than two."""
    v = F.array_compact(values)
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.greatest(n, F.lit(1))
    return F.when(n >= 2, F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n).otherwise(0.0)


def uncertainty(values: Column) -> Column:
    """1 - 2 |mean of the positive scores - .5|; 0 without any."""
    v = F.filter(values, lambda x: x > 0)
    return F.when(F.size(v) > 0, 1 - 2 * F.abs(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v) - 0.5)).otherwise(0.0)
