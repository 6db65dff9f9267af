"""The meta model over module scores: fitted by MLlib, saved with its feature order, applied as Column expressions.

Labels give the truth, keys give made module scores, to which the truth adds a signal. All 165 features of rules.meta_features are
used. Classes are weighted by n / (k n_class); folds are exactly stratified.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators.ordered import running
from claimlens.plans.calibration import truth
from claimlens.plans.rules import MADE, META_MODULES, dot, logistic, made, meta_features
from claimlens.sources.scratch import scratch
from claimlens.sources.tables import table

CLASSES = ("authentic", "ai_generated", "tampered")
#: Inverse strength of the L2 penalty: a fixed value, as are the class weights.
C = 0.1
AI, TAMPER = ("clip", "organika", "community", "dino", "ai_generation"), ("modification", "mesorch", "deep_modification")


def feature_names() -> list[str]:
    n = len(META_MODULES)
    base = [f"{m}.{part}" for m in META_MODULES for part in ("score", "confidence", "findings")]
    return [*base, *(f"{META_MODULES[i]}*{META_MODULES[j]}" for i in range(n) for j in range(i + 1, n)), *(f"{m}^2" for m in META_MODULES)]


def meta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, truth and x, the features of each labelled row."""
    k = F.col("doc_id")

    def score(m: str) -> Column:
        lift = F.when((F.col("truth") == "ai_generated") & F.lit(m in AI) | (F.col("truth") == "tampered") & F.lit(m in TAMPER), 0.35).otherwise(0.0)
        s = made(m, k)
        return s + lift * (1 - s)

    rows = table(spark, sf_dir, "labels").select("doc_id", truth().alias("truth"))
    scores = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, MADE)), F.array(*map(score, MADE))), lambda m, s: s.isNotNull())
    rows = rows.withColumn("scores", scores)
    confidences, counts = F.transform_values("scores", lambda m, s: 0.5 + s / 2), F.transform_values("scores", lambda m, s: F.floor(s * 20).cast("double"))
    return rows.select("doc_id", "truth", meta_features(F.col("scores"), confidences, counts).alias("x"))


def with_folds(rows: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """rows with fold: each class is dealt in the order of a seeded hash, so that folds differ by one row of a class at most."""
    return running(rows, ["truth"], [F.xxhash64("doc_id", F.lit(seed)), "doc_id"]).withColumn("fold", F.pmod(F.col("_upto") - 1, F.lit(folds)).cast("int")).drop("_upto", "_total")


@dataclass(frozen=True)
class Model:
    """A weight per feature and, last, the bias; one set for the binary score, and one of each class."""

    binary: list[float]
    multi: dict[str, list[float]]


def fitted(rows: DataFrame, c: float = C) -> Model:
    """Both models of rows (truth, x). The penalty is on weights only, and the loss is a weighted sum: regParam is 1 / (c n)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = {r.truth: r["count"] for r in rows.groupBy("truth").count().collect()}  # three at most
    n = sum(counts.values())

    def fit(label: Column, sizes: dict[float, int], family: str):
        weight = F.coalesce(*(F.when(F.col("label") == y, n / (len(sizes) * m)) for y, m in sizes.items()))
        data = rows.select(array_to_vector("x").alias("features"), label.cast("double").alias("label")).withColumn("weight", weight)
        return LogisticRegression(family=family, regParam=1 / (c * n), standardization=False, maxIter=500, tol=1e-10, weightCol="weight").fit(data)

    authentic = counts.get("authentic", 0)
    two = fit(F.col("truth") != "authentic", {0.0: authentic, 1.0: n - authentic}, "binomial")
    place = {c: float(i) for i, c in enumerate(CLASSES)}
    three = fit(F.coalesce(*(F.when(F.col("truth") == c, i) for c, i in place.items())), {place[c]: counts[c] for c in CLASSES}, "multinomial")
    matrix, bias = three.coefficientMatrix.toArray(), three.interceptVector.toArray()
    return Model([*map(float, two.coefficients), float(two.intercept)], {c: [*map(float, matrix[i]), float(bias[i])] for i, c in enumerate(CLASSES)})


def save(spark: SparkSession, path: str, model: Model) -> None:
    """A row per feature, in order, and the bias last."""
    columns = [model.binary, *(model.multi[c] for c in CLASSES)]
    rows = [(i, name, *map(float, w)) for i, (name, w) in enumerate(zip([*feature_names(), "(bias)"], zip(*columns, strict=True), strict=True))]
    spark.createDataFrame(rows, f"i int, feature string, binary double, {', '.join(f'{c} double' for c in CLASSES)}").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    """A saved model; an error if its features, their order or its classes aren't today's."""
    held = spark.read.parquet(path)
    if held.columns != ["i", "feature", "binary", *CLASSES]:
        raise ValueError("the model was saved for other classes")
    rows = held.orderBy("i").collect()  # 166 rows
    if [r.feature for r in rows] != [*feature_names(), "(bias)"]:
        raise ValueError("the model was saved for other features or another order")
    return Model([r.binary for r in rows], {c: [r[c] for r in rows] for c in CLASSES})


def with_probabilities(rows: DataFrame, model: Model) -> DataFrame:
    """rows (x) with p_manipulated by the binary weights and the softmax of the three classes."""
    x = F.concat("x", F.array(F.lit(1.0)))
    rows = rows.withColumns({"p_manipulated": logistic(dot(x, model.binary)), "_z": F.array(*(dot(x, model.multi[c]) for c in CLASSES))})
    exps = F.transform("_z", lambda z: F.exp(z - F.array_max("_z")))
    total = F.aggregate(exps, F.lit(0.0), lambda s, e: s + e)
    return rows.withColumns({f"p_{c}": exps[i] / total for i, c in enumerate(CLASSES)}).drop("_z")


def meta_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out probabilities of the first fold by a model that was fitted on the others, saved and loaded again."""
    rows = with_folds(meta_rows(spark, sf_dir))
    path = scratch(spark, "meta-model")
    save(spark, path, fitted(rows.where("fold <> 0")))
    out = with_probabilities(rows.where("fold = 0"), load(spark, path))
    return out.select("doc_id", "truth", *(F.round(p, 6).alias(p) for p in ("p_manipulated", *(f"p_{c}" for c in CLASSES))))


QUERIES = {"meta_model_scores": meta_model_scores}
#: Fitting has no SQL; tests hold it against Newton's method in numpy.
ORACLES: dict[str, str] = {}
