"""Orders of whole tables and of large groups without a task that holds them: ranges, sums per range, places within a range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimlens.sources.scratch import stored


def running(df: DataFrame, by: list[str], order: list[Column | str], amount: Column | None = None) -> DataFrame:
    """df with _upto, the sum of amount (1 if none is given) up to and with each row in the ascending order of its group, and _total, that of the group.

    Rows are dealt to ranges of (by, order), however large one group is, and written once, since ranges are cut anew each time. The
    sums per group and range are at most as many as groups and ranges together; what lies before a range is a sum of theirs. Rows of
    equal order fall into one range; give an order that is unique, or sum up equal rows before.
    """
    rows = df.withColumn("_amount", F.lit(1).cast("long") if amount is None else amount)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_o{i}" for i in range(len(order))]
    rows = rows.withColumns({k: o if isinstance(o, Column) else F.col(o) for k, o in zip(keys, order)})
    rows = stored(rows.repartitionByRange(parts, *by, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = rows.groupBy(*by, "_range").agg(F.sum("_amount").alias("_in"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    sums = sums.withColumns({"_before": F.sum("_in").over(w.orderBy("_range")) - F.col("_in"), "_total": F.sum("_in").over(w)}).drop("_in")
    joined = rows.join(sums.select(*(F.col(b).alias(f"_b_{b}") for b in by), F.col("_range").alias("_r"), "_before", "_total"), _same(by), "inner")
    within = F.sum("_amount").over(W.partitionBy(*by, "_range").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn("_upto", F.col("_before") + within).drop("_amount", "_range", "_r", "_before", *keys, *(f"_b_{b}" for b in by))


def _same(by: list[str]) -> Column:
    condition = F.col("_range") == F.col("_r")
    for b in by:
        condition = condition & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    return condition


def values_at(df: DataFrame, by: list[str], value: str, names: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by and, under each name, the value at a place (from 0) among the group's values that aren't null; the place is made from their number."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_m"))
    ranked = running(counts, by, [value], F.col("_m"))
    hit = lambda at: (F.col("_upto") - F.col("_m") <= at) & (at < F.col("_upto"))
    return ranked.groupBy(*by).agg(*(F.max(F.when(hit(at(F.col("_total"))), F.col(value))).alias(k) for k, at in names.items()))


def ranks_of(df: DataFrame, by: list[str], value: str, names: dict[str, float], nearest: bool = False) -> DataFrame:
    """by and percentiles of the values that aren't null, each under its name.

    The percentile q of n sorted values is the one at round(q (n - 1)), half to even; with nearest, the one at floor(n q), at
    most the last. Equal values are counted first, and a group of any size is ranked in ranges.
    """

    def at(q: float) -> Callable[[Column], Column]:
        return lambda n: F.least(F.floor(n * F.lit(q)), n - 1) if nearest else F.bround(F.lit(q) * (n - 1)).cast("long")

    return values_at(df, by, value, {k: at(q) for k, q in names.items()})


def medians_of(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """by and the median of the values that aren't null: the middle one, or the mean of the two in the middle."""
    both = values_at(df, by, value, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)})
    return both.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias(name))
