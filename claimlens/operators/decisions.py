"""The decision engine and the verdict rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.config import DEFAULT, FRAUD_CAUSES, Profile

#: The decision rules' names in the order of the trace.
RULES = ["critical_risk", "critical_finding", "safety", "high_risk", "severe_finding", "many_findings", "medium_risk", "ai_detection", "cross_validation", "upload"]


def decided(df: DataFrame) -> DataFrame:
    """df (fraud, ai, spec, cnn, n_findings, has_critical, has_severe, has_safety, source) with trace, the names of the rules that hold, and outcome.

    Null scores count as 0, null flags as false.
    """
    f, ai, spec, cnn = (F.coalesce(c, F.lit(0.0)) for c in ("fraud", "ai", "spec", "cnn"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    medium = f >= 0.15
    holds: list[Column] = [
        f >= 0.85,
        flag("has_critical") | (ai >= 0.75),
        flag("has_safety") | ((f >= 0.60) & (ai >= 0.60)),
        f >= 0.40,
        flag("has_severe"),
        (F.coalesce("n_findings", F.lit(0)) > 3) & medium,
        medium,
        ai >= 0.60,
        (ai >= 0.50) & (spec >= 0.40),
        F.coalesce(F.col("source") == "Upload", F.lit(False)) & medium,
    ]
    trace = F.array_compact(F.array(*(F.when(h, F.lit(n)) for n, h in zip(RULES, holds))))
    escalate = F.arrays_overlap("trace", F.array(*map(F.lit, ["critical_risk", "critical_finding", "safety", "ai_detection", "cross_validation"])))
    review = F.size("trace") > 0
    return df.withColumn("trace", trace).withColumn("outcome", F.when(escalate, "Escalate").when(review | (cnn >= 0.50), "HumanReview").otherwise("AutoApprove"))


def verdict(risk: Column, profile: Profile = DEFAULT) -> Column:
    return F.when(risk >= profile.verdict.forged_risk, "forged").when(risk >= profile.verdict.suspicious_risk, "suspicious").otherwise("authentic")


def urgency(risk: Column, profile: Profile = DEFAULT) -> Column:
    v = profile.verdict
    return F.when(risk >= v.urgency_critical, "Critical").when(risk >= v.urgency_high, "High").when(risk >= v.urgency_medium, "Medium").otherwise("Low")


def escalated_urgency(now: Column, risk: Column) -> Column:
    """A missing or low urgency is raised: .65 to Critical, .40 to High."""
    open_ = now.isNull() | (now == "Low")
    return F.when(open_ & (risk >= 0.65), "Critical").when(open_ & (risk >= 0.40), "High").otherwise(now)


def effective_risk(overall: Column, module_risks: Column) -> Column:
    """A missing or zero overall risk gives way to the largest of the modules' (an array, null for those with an error)."""
    known = F.coalesce(overall, F.lit(0.0))
    return F.when(known == 0, F.coalesce(F.array_max(module_risks), F.lit(0.0))).otherwise(known)


#: Causes that call a picture authentic, without diacritics and in lower case.
AUTHENTIC_CAUSES = ["autenticno", "autenticna", "authentic", "autenticni", "autentican", "autenticnost"]


def is_authentic(cause: Column) -> Column:
    return F.coalesce(F.translate(F.lower(F.trim(cause)), "čćžš", "cczs").isin(AUTHENTIC_CAUSES), F.lit(False))


#: What a cause of authenticity becomes at a high risk, and what its description gains.
RELABELLED, REMARK = "Metadata anomalija", " [Forenzicki moduli ukazuju na visok rizik manipulacije.]"


def enforced(severity: Column, safety: Column, cause: Column, risk: Column, upload: Column, profile: Profile = DEFAULT) -> Column:
    """Severity, safety rating, cause and remark of a finding as a risk at least demands, as a struct; an upload has lower thresholds.

    A null cause is neither fraud nor authentic. The remark is what the description gains, empty where the finding isn't relabelled.
    """
    e = profile.enforcement
    cut = lambda a, b: F.when(upload, a).otherwise(b)
    critical, high, medium = risk >= cut(e.upload_critical, e.critical), risk >= cut(e.upload_high, e.high), risk >= cut(e.upload_medium, e.medium)
    fraud, authentic, small = F.coalesce(cause.isin(FRAUD_CAUSES), F.lit(False)), is_authentic(cause), severity.isin("Minor", "Moderate")
    relabelled = authentic & high
    new_severity = (
        F.when(relabelled, F.when(critical, "Severe").otherwise("Moderate"))
        .when(fraud & critical, "Critical")
        .when(critical & small, "Severe")
        .when(fraud & high & small, "Severe")
        .when(fraud & medium & ~high & (severity == "Minor"), "Moderate")
        .when(high & (safety == "Safe") & (severity == "Minor"), "Moderate")
        .otherwise(severity)
    )
    new_safety = (
        F.when(relabelled, "Warning")
        .when(fraud & critical, "Critical")
        .when(critical & (safety == "Safe"), "Warning")
        .when(fraud & high & (safety == "Safe"), "Critical")
        .when(fraud & medium & ~high & (safety == "Safe"), "Warning")
        .when(high & (safety == "Safe"), "Warning")
        .otherwise(safety)
    )
    return F.struct(
        new_severity.alias("severity"), new_safety.alias("safety"), F.when(relabelled, RELABELLED).otherwise(cause).alias("cause"), F.when(relabelled, REMARK).otherwise("").alias("remark")
    )


def enforced_urgency(now: Column, risk: Column, upload: Column, profile: Profile = DEFAULT) -> Column:
    """An urgency as a risk at least demands; a medium risk raises a low one only."""
    e = profile.enforcement
    cut = lambda a, b: F.when(upload, a).otherwise(b)
    return (
        F.when(risk >= cut(e.upload_critical, e.critical), "Critical").when(risk >= cut(e.upload_high, e.high), "High").when((risk >= cut(e.upload_medium, e.medium)) & (now == "Low"), "Medium").otherwise(now)
    )


def label_suggestion(truth: Column, risk: Column, ai_high: Column, tamper_high: Column) -> Column:
    """What a label's cleaning suggests: another label, REVIEW, or keep."""
    return (
        F.when((truth == "authentic") & (ai_high >= 3), "ai_generated")
        .when((truth == "authentic") & (ai_high >= 2) & (risk >= 0.50), "ai_generated")
        .when((truth == "authentic") & (tamper_high >= 2), "tampered")
        .when((truth == "authentic") & (risk >= 0.40), "REVIEW")
        .when((truth == "ai_generated") & (ai_high == 0) & (risk < 0.10), "authentic")
        .when((truth == "ai_generated") & (ai_high <= 1) & (risk < 0.15), "REVIEW")
        .when((truth == "tampered") & (ai_high == 0) & (tamper_high == 0) & (risk < 0.10), "authentic")
        .otherwise("keep")
    )
