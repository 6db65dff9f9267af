"""Cross-file checks: eight embeddings are the files of one case, and an embedding's signs are its 64-bit hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimlens.functions.blocks import compared, plain
from claimlens.functions.textbits import with_sign_bits
from claimlens.operators import fusion, pairs
from claimlens.plans.rules import made, made_sql
from claimlens.sources.scratch import stored
from claimlens.sources.tables import table

#: Thresholds for the made data: the tables' embeddings are far from each other.
BITS, SIMILAR = 27, 0.15


def sign_hash(v: Column) -> Column:
    """Bit k is set if component k is above 0."""
    return F.aggregate(F.transform(v, lambda x, i: F.when(x > 0, F.expr("bigint(1)")).otherwise(F.expr("bigint(0)"))), F.expr("bigint(0)"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).alias("case_id"), "embedding", sign_hash(F.col("embedding")).alias("h"))


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs.hash_pairs(files(spark, sf_dir), "case_id", "vec_id", "h", BITS, 23)
    return p.select("vec_id_i", "vec_id_j", F.col("distance").cast("int").alias("distance"), "risk")


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs.cosine_pairs(files(spark, sf_dir), "case_id", "vec_id", "embedding", SIMILAR, least_dims=64)
    return p.select("vec_id_i", "vec_id_j", F.round("similarity", 5).alias("similarity"))


def semantic_minus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic pairs that the hashes haven't found."""
    return cosine_pairs(spark, sf_dir).join(hamming_pairs(spark, sf_dir).select("vec_id_i", "vec_id_j"), ["vec_id_i", "vec_id_j"], "left_anti")


def historical_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document with a copy: the smallest id of its copies and how many others there are, without a cap."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    return pairs.duplicate_classes(docs, "doc_id", "h")


def gps_first_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pair (j, k) of each case whose positions differ by more than .05 degrees."""
    rows = files(spark, sf_dir).select("case_id", "vec_id", ((F.col("vec_id") * 37 % 11) / 100.0).alias("lat"), ((F.col("vec_id") * 53 % 7) / 100.0).alias("lon"))
    p = pairs.pairs_within(rows, "case_id", "vec_id", ["lat", "lon"])
    off = p.where((F.abs(F.col("lat_i") - F.col("lat_j")) > 0.05 + 1e-9) | (F.abs(F.col("lon_i") - F.col("lon_j")) > 0.05 + 1e-9))
    return off.groupBy("case_id").agg(F.min(F.struct("vec_id_i", "vec_id_j")).alias("p")).select("case_id", "p.vec_id_i", "p.vec_id_j")


def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of cases with made scores: every seventh case is high throughout, and in another one file stands out."""
    k = F.col("l_orderkey")
    base = F.coalesce(made("pixel", k * 8 + F.col("l_linenumber")), F.lit(0.0))
    s = F.when(k % 7 == 0, 0.5 + base / 2).when((k % 7 == 1) & (F.col("l_linenumber") == 1), 0.95).when(k % 7 == 1, base / 10).otherwise(base)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("file"), "l_partkey", "l_suppkey", s.alias("s"))


def group_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of cases of three or more whose score is over .5 and more than two deviations off, where the deviation is over .05."""
    w = W.partitionBy("case_id")
    r = case_scores(spark, sf_dir).withColumns({"mu": F.avg("s").over(w), "sigma": F.stddev_pop("s").over(w), "n": F.count("*").over(w)})
    hit = (F.col("n") >= 3) & (F.col("sigma") > 0.05) & (F.col("s") > 0.5) & (F.abs(F.col("s") - F.col("mu")) > 2 * F.col("sigma") + 1e-9)
    return r.where(hit).select("case_id", "file", F.round("s", 7).alias("score"))


def all_high_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = case_scores(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("n"), F.bool_and(F.col("s") >= 0.5).alias("high"))
    return g.where("n >= 3 and high").select("case_id", "n")


def same_source_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source that two or more confident files of a case share, the first seen on ties."""
    rows = case_scores(spark, sf_dir).where("s >= 0.1").select("case_id", "file", (F.col("l_suppkey") % 3).alias("source"))
    g = rows.groupBy("case_id", "source").agg(F.count("*").alias("n"), F.min("file").alias("first"))
    g = g.where("n >= 2").groupBy("case_id").agg(F.max_by(F.struct("source", "n"), F.struct(F.col("n"), -F.col("first"), -F.col("source"))).alias("x"))
    return g.select("case_id", "x.source", "x.n")


def group_modifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = case_scores(spark, sf_dir).groupBy("case_id").agg(F.max("s").alias("top"), F.count("*").alias("n"))
    return g.where("n >= 2").select("case_id", F.round(fusion.group_modifier(F.col("top"), F.col("n").cast("double")), 3).alias("modifier"))


def value_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with more than one device, or whose compression differs by more than 30."""
    g = case_scores(spark, sf_dir).groupBy("case_id").agg(F.countDistinct(F.col("l_suppkey") % 4).alias("devices"), (F.max(F.col("l_partkey") % 60) - F.min(F.col("l_partkey") % 60)).alias("spread"))
    return g.where("devices > 1 or spread > 30").select("case_id", "devices", "spread", (F.col("spread") > 30).alias("compression"))


def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each case's files when those near an earlier one go."""
    return pairs.greedy_dedup(files(spark, sf_dir), "case_id", "vec_id", "h", 28).select("case_id", "vec_id")


def greedy_dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each language's documents when each goes whose hash differs in fewer than 10 bits from an earlier one that stays."""
    docs = with_sign_bits(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text", "h")
    return pairs.greedy_firsts(stored(docs, "text-bits"), "lang", "doc_id", "h")


def text_layer_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with near hashes, compared as a text layer and what was read from its picture: similarity by matching blocks,
    long words of one side only, and whether they differ so much that text is hidden.

    Copies aren't paired: of texts with one hash the first stands for all. All pairs of a group of near copies are asked for, so that their
    number grows with the square of its size; they are compared in cells, to which a text is moved once for many pairs.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    near = stored(pairs.banded_hash_pairs(stored(with_sign_bits(documents, "text", "h"), "text-bits"), "doc_id", "h"), "near-pairs")
    keys = near.select(F.col("key_i").alias("key")).union(near.select("key_j")).distinct()
    texts = stored(documents.withColumnRenamed("doc_id", "key").join(keys, "key", "left_semi").select("key", plain(F.col("text")).alias("t")), "near-texts")
    out = pairs.compare_in_cells(near, texts, compared, "similarity double, only_left int, only_right int")
    hidden = (F.col("similarity") <= 0.80) & ((F.col("only_left") > 5) | (F.col("only_right") > 5) | (F.col("similarity") < 0.50))
    return out.select("key_i", "key_j", "distance", "only_left", "only_right", F.round("similarity", 6).alias("similarity"), hidden.alias("hidden"))


QUERIES = {
    f.__name__: f
    for f in (hamming_pairs, cosine_pairs, semantic_minus_hash, historical_duplicates, gps_first_mismatch, group_outliers, all_high_cases, same_source_mode, group_modifier, value_inconsistency, greedy_dedup, greedy_dedup_texts, text_layer_similarity)
}

_F = "WITH f AS (SELECT vec_id, vec_id // 8 AS case_id, embedding AS e FROM embeddings), p AS (SELECT a.case_id, a.vec_id AS i, b.vec_id AS j, a.e AS x, b.e AS y FROM f a JOIN f b ON a.case_id = b.case_id AND a.vec_id < b.vec_id)"
_H = f", h AS (SELECT i AS vec_id_i, j AS vec_id_j, list_sum([((x[k] > 0) <> (y[k] > 0))::INT for k in range(1, 65)])::INT AS distance FROM p), hp AS (SELECT *, CASE WHEN distance <= 23 THEN 0.85 ELSE 0.75 END::DOUBLE AS risk FROM h WHERE distance <= {BITS})"
_DOT = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda k: {a}[k]::DOUBLE * {b}[k]::DOUBLE))"
_C = f", c AS (SELECT i AS vec_id_i, j AS vec_id_j, {_DOT('x', 'y')} / (sqrt({_DOT('x', 'x')}) * sqrt({_DOT('y', 'y')}) + 1e-8) AS s FROM p), cp AS (SELECT vec_id_i, vec_id_j, round(s, 5) AS similarity FROM c WHERE s >= {SIMILAR})"
_S = f"""WITH b AS (SELECT *, coalesce({made_sql('pixel', '(l_orderkey * 8 + l_linenumber)')}, 0) AS b FROM lineitem),
    s AS (SELECT l_orderkey AS case_id, l_linenumber AS file, l_partkey, l_suppkey, CASE WHEN l_orderkey % 7 = 0 THEN 0.5 + b / 2 WHEN l_orderkey % 7 = 1 AND l_linenumber = 1 THEN 0.95 WHEN l_orderkey % 7 = 1 THEN b / 10 ELSE b END AS s FROM b)"""

ORACLES = {
    "hamming_pairs": _F + _H + " SELECT * FROM hp",
    "cosine_pairs": _F + _C + " SELECT * FROM cp",
    "semantic_minus_hash": _F + _H + _C + " SELECT * FROM cp ANTI JOIN hp USING (vec_id_i, vec_id_j)",
    "historical_duplicates": """
        WITH d AS (SELECT doc_id, min(doc_id) OVER c AS class_id, count(*) OVER c - 1 AS n_others FROM documents WINDOW c AS (PARTITION BY coalesce(text, '')))
        SELECT doc_id, class_id, n_others FROM d WHERE n_others > 0""",
    "gps_first_mismatch": """
        WITH f AS (SELECT vec_id, vec_id // 8 AS case_id, vec_id * 37 % 11 AS lat, vec_id * 53 % 7 AS lon FROM embeddings),
        p AS (SELECT a.case_id, a.vec_id AS i, b.vec_id AS j, row_number() OVER (PARTITION BY a.case_id ORDER BY a.vec_id, b.vec_id) AS r FROM f a JOIN f b ON a.case_id = b.case_id AND a.vec_id < b.vec_id AND (abs(a.lat - b.lat) > 5 OR abs(a.lon - b.lon) > 5))
        SELECT case_id, i AS vec_id_i, j AS vec_id_j FROM p WHERE r = 1""",
    "group_outliers": _S + """, w AS (SELECT *, avg(s) OVER c AS mu, stddev_pop(s) OVER c AS sigma, count(*) OVER c AS n FROM s WINDOW c AS (PARTITION BY case_id))
        SELECT case_id, file, round(s, 7) AS score FROM w WHERE n >= 3 AND sigma > 0.05 AND s > 0.5 AND abs(s - mu) > 2 * sigma + 1e-9""",
    "all_high_cases": _S + " SELECT case_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 3 AND min(s) >= 0.5",
    "same_source_mode": _S + """, g AS (SELECT case_id, l_suppkey % 3 AS source, count(*) AS n, min(file) AS first FROM s WHERE s >= 0.1 GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, first, source) AS r FROM g WHERE n >= 2) SELECT case_id, source, n FROM r WHERE r = 1""",
    "group_modifier": _S + " SELECT case_id, round(round_even(least(0.30, max(s) * 0.15 * (1 + least(count(*) / 5, 1))), 4), 3) AS modifier FROM s GROUP BY 1 HAVING count(*) >= 2",
    "value_inconsistency": _S + """, g AS (SELECT case_id, count(DISTINCT l_suppkey % 4) AS devices, max(l_partkey % 60) - min(l_partkey % 60) AS spread FROM s GROUP BY 1)
        SELECT case_id, devices, spread, spread > 30 AS compression FROM g WHERE devices > 1 OR spread > 30""",
}
