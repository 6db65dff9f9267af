"""The fitted meta model against Newton's method in numpy, its folds, and what loading refuses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.plans import meta_model as mm
from claimlens.sources.writers import save_weights

SF = "/root/testdata/sf0.01"


def newton(x, y, classes, c, steps=60):
    """Weights (features and bias by class) of the multinomial model; with two classes the first one's are 0 and the penalty is on the other's."""
    n, d = x.shape
    x1 = np.hstack([x, np.ones((n, 1))])
    sizes = np.bincount(y, minlength=classes)
    s = n / (classes * sizes[y])
    free = range(1, 2) if classes == 2 else range(classes)
    w = np.zeros((classes, d + 1))
    penalty = np.tile(np.r_[np.ones(d), 1e-9], len(free))
    for _ in range(steps):
        z = x1 @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = np.concatenate([c * x1.T @ (s * (p[:, k] - (y == k))) for k in free]) + penalty * w[list(free)].ravel()
        h = np.block([[c * (x1 * (s * (p[:, a] * ((a == b) - p[:, b])))[:, None]).T @ x1 for b in free] for a in free]) + np.diag(penalty)
        w[list(free)] -= np.linalg.solve(h, g).reshape(len(free), -1)
    return w


def probabilities(w, x):
    z = np.hstack([x, np.ones((len(x), 1))]) @ w.T
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_held_out_loss_equals_that_of_newton(spark):
    rows = mm.with_folds(mm.meta_rows(spark, SF)).collect()
    x, y = np.array([r.x for r in rows]), np.array([mm.CLASSES.index(r.truth) for r in rows])
    out = np.array([r.fold == 0 for r in rows])
    assert x.shape[1] == len(mm.feature_names()) == 165 and out.any()
    got = {r.doc_id: r for r in mm.meta_model_scores(spark, SF).collect()}
    mine = [got[r.doc_id] for r, o in zip(rows, out) if o]
    assert len(mine) == len(got)
    pick = lambda p, t: -np.log(p[np.arange(len(t)), t]).mean()
    three = pick(np.array([[r[f"p_{c}"] for c in mm.CLASSES] for r in mine]), y[out])
    assert abs(three - pick(probabilities(newton(x[~out], y[~out], 3, mm.C), x[out]), y[out])) < 1e-4
    b = (y > 0).astype(int)
    two = pick(np.array([[1 - r.p_manipulated, r.p_manipulated] for r in mine]), b[out])
    assert abs(two - pick(probabilities(newton(x[~out], b[~out], 2, mm.C), x[out]), b[out])) < 1e-4
    assert two < np.log(2)  # classes weigh alike, so that this is what no knowledge has


def test_folds_are_stratified(spark):
    df = spark.range(103).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("truth"))
    sizes = {}
    for r in mm.with_folds(df).groupBy("truth", "fold").count().collect():
        sizes.setdefault(r.truth, []).append(r["count"])
    assert sorted(map(sorted, sizes.values())) == [[7, 7, 7, 7, 7], [13, 13, 14, 14, 14]]


def test_loading_refuses_other_models(spark, tmp_path):
    model = mm.Model([0.5] * 166, {c: [float(i)] * 166 for i, c in enumerate(mm.CLASSES)})
    mm.save(spark, str(tmp_path / "m"), model)
    assert mm.load(spark, str(tmp_path / "m")) == model
    held = spark.read.parquet(str(tmp_path / "m"))
    swapped = held.withColumn("i", F.when(F.col("i") == 0, 1).when(F.col("i") == 1, 0).otherwise(F.col("i")))
    swapped.write.parquet(str(tmp_path / "swapped"))
    with pytest.raises(ValueError, match="order"):
        mm.load(spark, str(tmp_path / "swapped"))
    held.withColumnRenamed("tampered", "other").write.parquet(str(tmp_path / "classes"))
    with pytest.raises(ValueError, match="classes"):
        mm.load(spark, str(tmp_path / "classes"))
    save_weights(spark, str(tmp_path / "linear"), ["a"], [1.0], 0.0)
    with pytest.raises(ValueError):
        mm.load(spark, str(tmp_path / "linear"))
