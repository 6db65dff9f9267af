"""The calibration loop over labelled rows: labels give the truth, and keys give made scores of modules.

Percentiles and medians are places within ranges over counts of distinct values, and orders within a class are cut by histograms or
by limits before anything is sorted: there are only three classes, so a window over all rows of one would be a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimlens.operators.ordered import medians_of, ranks_of
from claimlens.sources.tables import table

MODULES = {"clip": (37, 11, 40), "pixel": (71, 29, 10), "mesorch": (53, 7, 25)}


def truth() -> Column:
    return F.when(F.col("toxic") == 1, "ai_generated").when(F.col("quality") == 0, "tampered").otherwise("authentic")


def score(m: str) -> Column:
    """Integer arithmetic, moved up for AI rows: thousandths."""
    a, b, up = MODULES[m]
    lift = F.when(F.col("toxic") == 1, 10 * up).otherwise(0)
    return F.least(F.lit(1000), ((F.col("doc_id") * a + b) % 1000) * 6 / 10 + lift).cast("int") / 1000.0


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", truth().alias("truth"), *(score(m).alias(m) for m in MODULES))


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per labelled row and module."""
    pairs = F.array(*(F.struct(F.lit(m).alias("module"), F.col(m).alias("score")) for m in MODULES))
    return labelled(spark, sf_dir).select("doc_id", "truth", F.explode(pairs).alias("x")).select("doc_id", "truth", "x.module", "x.score")


def class_module_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exploded(spark, sf_dir)
    g = rows.groupBy("truth", "module").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 4).alias("stdev"), F.min("score").alias("least"), F.max("score").alias("largest")
    )
    q = ranks_of(rows, ["truth", "module"], "score", {f"p{round(p * 100)}": p for p in (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)})
    return g.join(q, ["truth", "module"])


def class_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks_of(exploded(spark, sf_dir), ["truth", "module"], "score", {"median": 0.5})


def class_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of AI rows less that of authentic ones; a gap of .15 is marked good, one below 0 inverted."""
    ai, authentic = (F.avg(F.when(F.col("truth") == t, F.col("score"))) for t in ("ai_generated", "authentic"))
    gap = F.round(ai - authentic, 6)
    g = exploded(spark, sf_dir).groupBy("module").agg(gap.alias("gap"))
    return g.withColumn("mark", F.when(F.col("gap") >= 0.15, "good").when(F.col("gap") < 0, "inverted").otherwise("weak"))


def _flags(df: DataFrame, t: float) -> DataFrame:
    return df.select((F.col("truth") == "ai_generated").alias("positive"), (F.col("clip") >= t).alias("predicted"), "clip")


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Binary confusion with recalls over at least one row, accuracy, mean scores and margin; df has positive, predicted, clip."""
    n = lambda a, b: F.count_if((F.col("positive") == a) & (F.col("predicted") == b))
    tp, fp, tn, fn = n(True, True), n(False, True), n(False, False), n(True, False)
    mean = lambda a: F.coalesce(F.avg(F.when(F.col("positive") == a, F.col("clip"))), F.lit(0.0))
    one = F.lit(1)
    return df.groupBy(*(by or [])).agg(
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        F.round(tp / F.greatest(tp + fn, one), 6).alias("recall_ai"), F.round(tn / F.greatest(tn + fp, one), 6).alias("recall_other"),
        F.round((tp + tn) / F.greatest(F.count("*"), one), 6).alias("accuracy"), F.round(mean(True) - mean(False), 6).alias("margin"),
    )


def confusion_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(_flags(labelled(spark, sf_dir), 0.40))


def holdout_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of recall (.85 other, .75 AI) and margin (.20) on the newest tenth of ids."""
    rows = labelled(spark, sf_dir)
    cut = rows.agg(F.max("doc_id").alias("top")).select((F.col("top") * 0.9).alias("cut"))
    holdout = rows.join(F.broadcast(cut), F.col("doc_id") > F.col("cut"), "left_semi")
    c = confusion(_flags(holdout, 0.40))
    gates = {"pass_other": F.col("recall_other") >= 0.85, "pass_ai": F.col("recall_ai") >= 0.75, "pass_margin": F.col("margin") >= 0.20}
    return c.select("recall_other", "recall_ai", "margin", *(g.alias(k) for k, g in gates.items()), (gates["pass_other"] & gates["pass_ai"] & gates["pass_margin"]).alias("passed"))


def predicted_class() -> Column:
    return F.when(F.col("clip") >= 0.55, "ai_generated").when(F.col("mesorch") >= 0.45, "tampered").otherwise("authentic")


def metrics_three_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, from one confusion table."""
    pairs = labelled(spark, sf_dir).groupBy("truth", predicted_class().alias("predicted")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit("t").alias("side")), F.struct(F.col("predicted").alias("class"), F.lit("p").alias("side")))).alias("x"), (F.col("truth") == F.col("predicted")).alias("hit"), "n")
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g = sides.groupBy("x.class").agg(s((F.col("x.side") == "t") & F.col("hit")).alias("tp"), s(F.col("x.side") == "t").alias("support"), s(F.col("x.side") == "p").alias("guesses"))
    p, r = F.col("tp") / F.greatest("guesses", F.lit(1)), F.col("tp") / F.greatest("support", F.lit(1))
    return g.select("class", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def auc_no_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auc(labelled(spark, sf_dir))


def auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve over groups of equal scores, without the segment from the origin to the first point; .5 with one class only.

    Scores are thousandths, so that at most 1001 groups are left for the running sums.
    """
    g = rows.groupBy("clip").agg(F.count_if(F.col("truth") == "ai_generated").alias("p"), F.count_if(F.col("truth") != "ai_generated").alias("q"))
    w = W.orderBy(F.desc("clip"))
    run = g.select(F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp"), F.sum("p").over(W.partitionBy(F.lit(1))).alias("np"), F.sum("q").over(W.partitionBy(F.lit(1))).alias("nq"), "clip")
    x, y = F.col("fp") / F.greatest("nq", F.lit(1)), F.col("tp") / F.greatest("np", F.lit(1))
    pts = run.select(x.alias("x"), y.alias("y"), F.lag(x).over(w).alias("x0"), F.lag(y).over(w).alias("y0"), (F.least("np", "nq") > 0).alias("both"))
    area = F.coalesce(F.sum((F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0")) / 2), F.lit(0.0))
    return pts.agg(F.round(F.when(F.bool_and("both"), area).otherwise(0.5), 6).alias("auc"))


def module_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ai = F.col("truth") == "ai_generated"
    right = F.avg(((F.col("score") >= 0.5) == ai).cast("int"))
    return exploded(spark, sf_dir).groupBy("module").agg(F.round(right, 6).alias("accuracy"), F.round(F.avg(F.when(ai, F.col("score"))), 6).alias("mean_ai"), F.round(F.avg(F.when(~ai, F.col("score"))), 6).alias("mean_other"))


def swept(rows: DataFrame, first: int, last: int) -> DataFrame:
    """tp, fp, tn and fn at each threshold of hundredths: rows are counted by hundredth first, so that the sweep is over a few rows."""
    h = F.least(F.floor(F.col("clip") * 100 + 1e-9), F.lit(100)).cast("int")
    counts = rows.groupBy(h.alias("h")).agg(F.count_if(F.col("truth") == "ai_generated").alias("p"), F.count_if(F.col("truth") != "ai_generated").alias("q"))
    grid = counts.withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(last))))
    s = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    hit = F.col("h") >= F.col("t")
    return grid.groupBy("t").agg(s(hit, "p").alias("tp"), s(hit, "q").alias("fp"), s(~hit, "q").alias("tn"), s(~hit, "p").alias("fn"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_threshold(labelled(spark, sf_dir))


def best_threshold(rows: DataFrame) -> DataFrame:
    """The first threshold of .15 to .64 with the largest balanced accuracy."""
    g = swept(rows, 15, 64)
    ba = (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)) + F.col("tn") / F.greatest(F.col("tn") + F.col("fp"), F.lit(1))) / 2
    g = g.withColumn("ba", F.round(ba, 9))
    return g.agg(F.max_by("t", F.struct(F.col("ba"), -F.col("t"))).alias("t"), F.max("ba").alias("ba")).select((F.when(F.col("ba") > 0, F.col("t")).otherwise(40) / 100).alias("threshold"), F.round("ba", 6).alias("balanced_accuracy"))


def kappa_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa at each threshold."""
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    po = (F.col("tp") + F.col("tn")) / n
    pe = ((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp")) + (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn"))) / (n * n)
    return swept(labelled(spark, sf_dir), 0, 100).select("t", F.round(F.when(pe >= 1, 0.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def _kappas(tp, fp, tn, fn):
    """Cohen's kappa of confusion counts in numpy; where chance agrees wholly, 1 if all agree, else 0."""
    import numpy as np

    n = np.maximum(tp + fp + tn + fn, 1)
    po, pe = (tp + tn) / n, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return np.where(pe >= 1, np.where(po >= 1, 1.0, 0.0), (po - pe) / np.where(pe >= 1, 1, 1 - pe))


def ghost(rows: DataFrame, samples: int = 100, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Threshold by subsampling: kappa's median, 5th and 95th percentile over stratified samples at each hundredth, and the first best one.

    A sample is drawn without replacement, from each class in proportion and one row at least. Rows are counted by class and
    hundredth first, and samples are drawn from these 202 counts (which is the same distribution), each in a row of its own; the
    counts are all that tasks get. The random numbers are numpy's own, by seed and sample.
    """
    import numpy as np
    import pyarrow as pa

    h = F.least(F.floor(F.col("clip") * 100 + 1e-9), F.lit(100)).cast("int")
    found = rows.groupBy(h.alias("h")).agg(F.count_if(F.col("truth") == "ai_generated").alias("p"), F.count_if(F.col("truth") != "ai_generated").alias("q")).collect()
    counts = np.zeros((2, 101), np.int64)
    for r in found:
        counts[:, r.h] = r.p, r.q

    def draw(batches):
        totals = counts.sum(axis=1)
        size = round(share * int(totals.sum()))
        take = [min(int(n), max(1, round(size * int(n) / int(totals.sum())))) if n else 0 for n in totals]
        for batch in batches:
            for s in batch.column(0).to_pylist():
                rng = np.random.default_rng((seed, s))
                p, q = (rng.multivariate_hypergeometric(c, k, method="marginals") for c, k in zip(counts, take))
                # The rows at or above each hundredth are those predicted.
                tp, fp = p[::-1].cumsum()[::-1], q[::-1].cumsum()[::-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(101, dtype=np.int32)), pa.array(_kappas(tp, fp, take[1] - fp, take[0] - tp))], names=["t", "kappa"])

    drawn = rows.sparkSession.range(1, samples + 1, numPartitions=8).mapInArrow(draw, "t int, kappa double")
    g = drawn.groupBy("t").agg(F.median("kappa").alias("median"), F.percentile("kappa", 0.05).alias("p5"), F.percentile("kappa", 0.95).alias("p95"))
    best = g.agg(F.max_by("t", F.struct(F.col("median"), -F.col("t"))).alias("best"))
    return g.join(F.broadcast(best)).select("t", "median", "p5", "p95", (F.col("t") == F.col("best")).alias("optimal"))


def ghost_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ghost(labelled(spark, sf_dir))


def regression_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each class: mean, median, extremes, and the rate of wrong rows at the class's gate."""
    wrong = F.when(F.col("truth") == "authentic", F.col("clip") >= 0.15).when(F.col("truth") == "ai_generated", F.col("clip") < 0.60).otherwise(F.col("clip") < 0.40)
    limit = F.when(F.col("truth") == "authentic", 0.10).when(F.col("truth") == "ai_generated", 0.15).otherwise(0.20)
    rows = labelled(spark, sf_dir)
    g = rows.groupBy("truth").agg(F.round(F.avg("clip"), 6).alias("mean"), F.min("clip").alias("least"), F.max("clip").alias("largest"), F.round(F.avg(wrong.cast("int")), 6).alias("rate"))
    g = g.join(medians_of(rows, ["truth"], "clip").withColumn("median", F.round("median", 6)), "truth")
    return g.withColumn("passed", F.col("rate") < limit)


def coverage(rows: DataFrame, module: str, score: str, total: Column) -> DataFrame:
    """Of each module: rows that have it, rows with a score above 0, mean and population deviation, and whether under half of all have it."""
    g = rows.groupBy(module).agg(total.alias("_n"), F.count(score).alias("present"), F.count_if(F.col(score) > 0).alias("nonzero"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop(score), F.lit(0.0)), 6).alias("stdev"))
    return g.withColumn("missing", F.col("present") < F.col("_n") * 0.5).drop("_n")


def module_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the labelled rows, of which clip has no score for most keys, and pixel a score of 0 for some."""
    gone = (F.col("module") == "clip") & (F.col("doc_id") % 5 < 3)
    value = F.when(~gone, F.when((F.col("module") == "pixel") & (F.col("doc_id") % 3 == 0), 0.0).otherwise(F.col("score")))
    return coverage(exploded(spark, sf_dir).withColumn("score", value), "module", "score", F.count("*"))


def overrides(rows: DataFrame) -> DataFrame:
    """The fusion thresholds that rows (truth, clip, pixel, mesorch) give: percentiles of the authentic ones within bounds, and the best sweep."""
    authentic = rows.where("truth = 'authentic'").withColumns({"one": F.lit(1), "top": F.greatest("clip", "pixel", "mesorch")})
    top = ranks_of(authentic, ["one"], "top", {"p75_top": 0.75, "p90_top": 0.90})
    pixel = ranks_of(authentic, ["one"], "pixel", {"p95_pixel": 0.95})
    two = lambda c: F.bround(c + 1e-9, 2)
    g = top.join(pixel, "one").join(best_threshold(rows).withColumn("one", F.lit(1)), "one")
    return g.select(
        "p75_top",
        "p90_top",
        "p95_pixel",
        two(F.greatest(F.lit(0.20), "p75_top")).alias("cnn_dampening_threshold"),
        two(F.greatest(F.lit(0.20), "p95_pixel")).alias("independent_confirm"),
        two(F.least(F.lit(0.50), F.greatest(F.lit(0.40), "p90_top"))).alias("detector_high"),
        two(F.greatest(F.lit(0.15), F.col("threshold") - 0.20)).alias("risk_medium"),
        two(F.greatest(F.lit(0.30), "threshold")).alias("risk_high"),
    )


def derived_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overrides(labelled(spark, sf_dir))


def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each class the newest max(1, round(n / 5)) rows are held out.

    Rows are counted by class and a thousandth of the ids' range; only the rows of the thousandth that the cut falls into are
    ranked. At most 3 x 1001 counts are broadcast.
    """
    rows = labelled(spark, sf_dir).select("doc_id", "truth")
    ends = rows.groupBy("truth").agg(F.max("doc_id").alias("top"), (F.floor((F.max("doc_id") - F.min("doc_id")) / 1000) + 1).alias("width"))
    back = F.floor((F.col("top") - F.col("doc_id")) / F.col("width"))
    rows = rows.join(F.broadcast(ends), "truth").withColumn("part", back).drop("top", "width")
    parts = rows.groupBy("truth", "part").agg(F.count("*").alias("m"))
    w = W.partitionBy("truth")
    parts = parts.withColumns({"upto": F.sum("m").over(w.orderBy("part")), "n": F.sum("m").over(w)})
    k = F.greatest(F.lit(1), F.bround(F.col("n") * 0.2).cast("long"))
    parts = parts.select("truth", "part", (F.col("upto") <= k).alias("within"), (k - F.col("upto") + F.col("m")).alias("left"), ((F.col("upto") > k) & (F.col("upto") - F.col("m") < k)).alias("cut"))
    placed = rows.join(F.broadcast(parts), ["truth", "part"])
    place = F.row_number().over(W.partitionBy("truth").orderBy(F.desc("doc_id")))
    ranked = placed.where("cut").withColumn("within", place <= F.col("left"))
    both = placed.where("not cut").unionByName(ranked)
    return both.select("doc_id", F.when(F.col("within"), "holdout").otherwise("train").alias("split"))


def active_subset(spark: SparkSession, sf_dir: str, size: int = 30) -> DataFrame:
    """Of each class: 60 % by disagreement and uncertainty, 20 % at the boundary, 20 % of the easy ones, filled up by the next best.

    Limits come first: twice size of the hardest rows of a class, and of the boundary and the easy ones as many as may be
    chosen or be among the hardest, are all that can be chosen, and such limits are applied before the shuffle.
    """
    values = F.array("clip", "pixel", "mesorch")
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / 3
    spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / 3
    rows = labelled(spark, sf_dir).select("doc_id", "truth", "clip", F.round(spread + 1 - 2 * F.abs(mean - 0.5), 9).alias("hard"))
    boundary = (F.col("clip") >= 0.25) & (F.col("clip") <= 0.75)
    first_of = lambda df, n, *order: df.withColumn("r", F.row_number().over(W.partitionBy("truth").orderBy(*order))).where(F.col("r") <= n).drop("r")
    hardest = [F.desc("hard"), F.col("doc_id")]
    n_hard, n_other = size * 6 // 10, size * 2 // 10
    rows = first_of(rows, 2 * size, *hardest).union(first_of(rows.where(boundary), n_hard + n_other, *hardest)).union(first_of(rows.where(~boundary), n_hard + n_other, "hard", "doc_id")).distinct()
    rows = rows.withColumn("r1", F.row_number().over(W.partitionBy("truth").orderBy(*hardest)))
    rows = rows.withColumn("kind", F.when(F.col("r1") <= n_hard, "hard").when(boundary, "boundary").otherwise("easy"))
    rows = rows.withColumn("r2", F.row_number().over(W.partitionBy("truth", "kind").orderBy(F.when(F.col("kind") == "easy", F.col("hard")), F.desc("hard"), "doc_id")))
    first = (F.col("kind") == "hard") | (F.col("r2") <= n_other)
    rows = rows.withColumn("r3", F.row_number().over(W.partitionBy("truth").orderBy(F.when(first, 0).otherwise(1), "r1")))
    return rows.where(F.col("r3") <= size).select("doc_id", "truth", F.when(first, F.col("kind")).otherwise("fill").alias("why"))


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50, 25 and 25 rows of the classes by the ranks of a seeded hash; the limit of 50 is applied before the shuffle."""
    n = F.when(F.col("truth") == "authentic", 50).otherwise(25)
    rows = labelled(spark, sf_dir).select("doc_id", "truth").withColumn("r", F.row_number().over(W.partitionBy("truth").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id"))).where(F.col("r") <= 50)
    return rows.where(F.col("r") <= n).select("doc_id", "truth")


QUERIES = {
    f.__name__: f
    for f in (
        class_module_stats, class_medians, class_gap, confusion_binary, holdout_gate, metrics_three_class, auc_no_origin, module_separation, threshold_sweep, kappa_sweep,
        ghost_calibration, regression_gates, module_coverage, derived_thresholds, temporal_split, active_subset, balanced_sample,
    )
}


def _score(m: str) -> str:
    a, b, up = MODULES[m]
    return f"floor(least(1000, ((doc_id * {a} + {b}) % 1000) * 6 / 10 + CASE WHEN toxic = 1 THEN {10 * up} ELSE 0 END))::INT / 1000"


_L = f"""WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'ai_generated' WHEN quality = 0 THEN 'tampered' ELSE 'authentic' END AS truth, {', '.join(f'{_score(m)} AS {m}' for m in MODULES)} FROM labels)"""
_X = _L + ", x AS (" + " UNION ALL ".join(f"SELECT doc_id, truth, '{m}' AS module, {m} AS score FROM l" for m in MODULES) + ")"
_Q = lambda v, p, n: f"list_sort(list({v}))[round_even({p} * (count(*) - 1), 0)::INT + 1] AS {n}"
_CONF = """count(*) FILTER (pos AND pred) AS tp, count(*) FILTER (NOT pos AND pred) AS fp, count(*) FILTER (NOT pos AND NOT pred) AS tn, count(*) FILTER (pos AND NOT pred) AS fn,
    round(count(*) FILTER (pos AND pred) / greatest(count(*) FILTER (pos), 1), 6) AS recall_ai, round(count(*) FILTER (NOT pos AND NOT pred) / greatest(count(*) FILTER (NOT pos), 1), 6) AS recall_other,
    round(count(*) FILTER (pos = pred) / greatest(count(*), 1), 6) AS accuracy, round(coalesce(avg(clip) FILTER (pos), 0) - coalesce(avg(clip) FILTER (NOT pos), 0), 6) AS margin"""
_SWEEP = """, g AS (SELECT t::INT AS t, count(*) FILTER (truth = 'ai_generated' AND clip * 100 + 1e-9 >= t) AS tp, count(*) FILTER (truth <> 'ai_generated' AND clip * 100 + 1e-9 >= t) AS fp,
    count(*) FILTER (truth <> 'ai_generated' AND clip * 100 + 1e-9 < t) AS tn, count(*) FILTER (truth = 'ai_generated' AND clip * 100 + 1e-9 < t) AS fn FROM l, range({a}, {b}) AS r(t) GROUP BY 1)"""

ORACLES = {
    "class_module_stats": _X + f"""
        SELECT truth, module, count(*) AS n, round(avg(score), 4) AS mean, round(coalesce(stddev_samp(score), 0), 4) AS stdev, min(score) AS least, max(score) AS largest,
               {', '.join(_Q('score', p, f'p{round(p * 100)}') for p in (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99))} FROM x GROUP BY 1, 2""",
    "class_medians": _X + f" SELECT truth, module, {_Q('score', 0.5, 'median')} FROM x GROUP BY 1, 2",
    "class_gap": _X + """, g AS (SELECT module, round(avg(score) FILTER (truth = 'ai_generated') - avg(score) FILTER (truth = 'authentic'), 6) AS gap FROM x GROUP BY 1)
        SELECT module, gap, CASE WHEN gap >= 0.15 THEN 'good' WHEN gap < 0 THEN 'inverted' ELSE 'weak' END AS mark FROM g""",
    "confusion_binary": _L + f", f AS (SELECT truth = 'ai_generated' AS pos, clip >= 0.40 AS pred, clip FROM l) SELECT {_CONF} FROM f",
    "holdout_gate": _L + f""", f AS (SELECT truth = 'ai_generated' AS pos, clip >= 0.40 AS pred, clip FROM l WHERE doc_id > (SELECT max(doc_id) * 0.9 FROM l)), c AS (SELECT {_CONF} FROM f)
        SELECT recall_other, recall_ai, margin, recall_other >= 0.85 AS pass_other, recall_ai >= 0.75 AS pass_ai, margin >= 0.20 AS pass_margin, recall_other >= 0.85 AND recall_ai >= 0.75 AND margin >= 0.20 AS passed FROM c""",
    "metrics_three_class": _L + """, p AS (SELECT truth, CASE WHEN clip >= 0.55 THEN 'ai_generated' WHEN mesorch >= 0.45 THEN 'tampered' ELSE 'authentic' END AS pred FROM l),
        k AS (SELECT DISTINCT truth AS class FROM p UNION SELECT DISTINCT pred FROM p),
        g AS (SELECT class, count(*) FILTER (truth = class AND pred = class) AS tp, count(*) FILTER (truth = class) AS support, count(*) FILTER (pred = class) AS guesses FROM k, p GROUP BY 1)
        SELECT class, support, round(tp / greatest(guesses, 1), 6) AS precision, round(tp / greatest(support, 1), 6) AS recall,
               round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / guesses) * (tp / support) / (tp / guesses + tp / support) END, 6) AS f1 FROM g""",
    "auc_no_origin": _L + """, g AS (SELECT clip, count(*) FILTER (truth = 'ai_generated') AS p, count(*) FILTER (truth <> 'ai_generated') AS q FROM l GROUP BY 1),
        r AS (SELECT clip, sum(p) OVER w / greatest(sum(p) OVER (), 1) AS y, sum(q) OVER w / greatest(sum(q) OVER (), 1) AS x FROM g WINDOW w AS (ORDER BY clip DESC)),
        d AS (SELECT x, y, lag(x) OVER (ORDER BY clip DESC) AS x0, lag(y) OVER (ORDER BY clip DESC) AS y0 FROM r)
        SELECT round(CASE WHEN (SELECT count(DISTINCT truth = 'ai_generated') FROM l) < 2 THEN 0.5 ELSE coalesce(sum((x - x0) * (y + y0) / 2), 0) END, 6) AS auc FROM d""",
    "module_separation": _X + """ SELECT module, round(avg(((score >= 0.5) = (truth = 'ai_generated'))::INT), 6) AS accuracy, round(avg(score) FILTER (truth = 'ai_generated'), 6) AS mean_ai,
        round(avg(score) FILTER (truth <> 'ai_generated'), 6) AS mean_other FROM x GROUP BY 1""",
    "threshold_sweep": _L + _SWEEP.format(a=15, b=65) + """, b AS (SELECT t, round((tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2, 9) AS ba FROM g)
        SELECT CASE WHEN ba > 0 THEN t ELSE 40 END / 100 AS threshold, round(ba, 6) AS balanced_accuracy FROM b ORDER BY ba DESC, t LIMIT 1""",
    "kappa_sweep": _L + _SWEEP.format(a=0, b=101) + """, p AS (SELECT t, (tp + tn) / (tp + fp + tn + fn) AS po, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn)) AS pe FROM g)
        SELECT t, round(CASE WHEN pe >= 1 THEN 0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM p""",
    "regression_gates": _L + """, g AS (SELECT truth, round(avg(clip), 6) AS mean, round(median(clip), 6) AS median, min(clip) AS least, max(clip) AS largest,
            round(avg((CASE WHEN truth = 'authentic' THEN clip >= 0.15 WHEN truth = 'ai_generated' THEN clip < 0.60 ELSE clip < 0.40 END)::INT), 6) AS rate FROM l GROUP BY 1)
        SELECT *, rate < CASE WHEN truth = 'authentic' THEN 0.10 WHEN truth = 'ai_generated' THEN 0.15 ELSE 0.20 END AS passed FROM g""",
    "module_coverage": _X + """, y AS (SELECT module, CASE WHEN module = 'clip' AND doc_id % 5 < 3 THEN NULL WHEN module = 'pixel' AND doc_id % 3 = 0 THEN 0 ELSE score END AS score FROM x)
        SELECT module, count(score) AS present, count(*) FILTER (score > 0) AS nonzero, round(coalesce(avg(score), 0), 6) AS mean, round(coalesce(stddev_pop(score), 0), 6) AS stdev, count(score) < count(*) * 0.5 AS missing FROM y GROUP BY 1""",
    "derived_thresholds": _L + _SWEEP.format(a=15, b=65) + f""", b AS (SELECT t, round((tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2, 9) AS ba FROM g), s AS (SELECT CASE WHEN ba > 0 THEN t ELSE 40 END / 100 AS s FROM b ORDER BY ba DESC, t LIMIT 1),
        a AS (SELECT greatest(clip, pixel, mesorch) AS top, pixel FROM l WHERE truth = 'authentic'), q AS (SELECT {_Q('top', 0.75, 'p75_top')}, {_Q('top', 0.90, 'p90_top')}, {_Q('pixel', 0.95, 'p95_pixel')} FROM a)
        SELECT p75_top, p90_top, p95_pixel, round_even(greatest(0.20, p75_top) + 1e-9, 2) AS cnn_dampening_threshold, round_even(greatest(0.20, p95_pixel) + 1e-9, 2) AS independent_confirm,
               round_even(least(0.50, greatest(0.40, p90_top)) + 1e-9, 2) AS detector_high, round_even(greatest(0.15, s - 0.20) + 1e-9, 2) AS risk_medium, round_even(greatest(0.30, s) + 1e-9, 2) AS risk_high FROM q, s""",
    "temporal_split": _L + """, r AS (SELECT doc_id, row_number() OVER (PARTITION BY truth ORDER BY doc_id DESC) AS back, count(*) OVER (PARTITION BY truth) AS n FROM l)
        SELECT doc_id, CASE WHEN back <= greatest(1, round_even(n * 0.2, 0)) THEN 'holdout' ELSE 'train' END AS split FROM r""",
    "active_subset": _L + """, v AS (SELECT *, (clip + pixel + mesorch) / 3 AS m FROM l),
        h AS (SELECT doc_id, truth, clip, round((pow(clip - m, 2) + pow(pixel - m, 2) + pow(mesorch - m, 2)) / 3 + 1 - 2 * abs(m - 0.5), 9) AS hard FROM v),
        a AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY hard DESC, doc_id) AS r1 FROM h),
        k AS (SELECT *, CASE WHEN r1 <= 18 THEN 'hard' WHEN clip BETWEEN 0.25 AND 0.75 THEN 'boundary' ELSE 'easy' END AS kind FROM a),
        c AS (SELECT *, CASE WHEN kind = 'easy' THEN row_number() OVER (PARTITION BY truth, kind ORDER BY hard, doc_id) ELSE row_number() OVER (PARTITION BY truth, kind ORDER BY hard DESC, doc_id) END AS r2 FROM k),
        f AS (SELECT *, kind = 'hard' OR r2 <= 6 AS first FROM c),
        o AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY NOT first, r1) AS r3 FROM f)
        SELECT doc_id, truth, CASE WHEN first THEN kind ELSE 'fill' END AS why FROM o WHERE r3 <= 30""",
}
