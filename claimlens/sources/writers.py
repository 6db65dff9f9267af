"""Writers of reports and of model weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str, form: str = "json", mode: str = "errorifexists") -> None:
    """df as JSON lines or as CSV with a header, a file per partition; nulls are left out of JSON and empty in CSV."""
    if form not in ("json", "csv"):
        raise ValueError(f"unknown form {form}")
    df.write.mode(mode).options(**({"header": "true"} if form == "csv" else {})).format(form).save(path)


def save_weights(spark: SparkSession, path: str, names: list[str], weights: list[float], bias: float) -> None:
    """A linear model's weights by feature, in order; the bias comes last."""
    if len(names) != len(weights):
        raise ValueError("a weight for each feature")
    rows = [(i, n, float(w)) for i, (n, w) in enumerate(zip([*names, "(bias)"], [*weights, bias]))]
    spark.createDataFrame(rows, "i int, feature string, weight double").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str, names: list[str]) -> tuple[list[float], float]:
    """Weights and bias of a saved model; an error if its features or their order aren't those of names."""
    rows = spark.read.parquet(path).orderBy("i").select(F.col("feature"), F.col("weight")).collect()
    if [r.feature for r in rows] != [*names, "(bias)"]:
        raise ValueError("the model was saved for other features or another order")
    return [r.weight for r in rows[:-1]], rows[-1].weight
