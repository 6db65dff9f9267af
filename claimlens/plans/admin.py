"""Admin and claims dashboards: orders stand for inspections, lineitem for their findings, customer for users, part for car parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimlens.functions.columns import ellipsis, extension
from claimlens.operators.ordered import ranks_of, running
from claimlens.sources.tables import table


def admin_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: inspections by status, 0 where there are none, and their sum."""
    by = {s: F.count_if(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}
    return table(spark, sf_dir, "orders").agg(*(n.alias(f"n_{s}") for s, n in by.items()), F.count("o_orderstatus").alias("total"))


def admin_processing_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of durations by event type, with mean (null as 0), least and largest."""
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    g = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("largest"), F.round(F.avg(F.coalesce("value", F.lit(0.0))), 6).alias("mean"))
    return g.join(ranks_of(rows, ["event_type"], "value", {f"p{round(p * 100)}": p for p in (0.5, 0.9, 0.95, 0.99)}, nearest=True), "event_type", "left")


def admin_file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension; names without one don't count."""
    ext = extension(F.concat(F.col("p_name"), F.lit("."), F.element_at(F.array(*map(F.lit, ["JPG", "png", "Pdf", ""])), (F.col("p_partkey") % 4 + 1).cast("int"))))
    return table(spark, sf_dir, "part").select(ext.alias("extension")).where("extension != ''").groupBy("extension").agg(F.count("*").alias("n"))


def argmax_key(json_map: Column) -> Column:
    """The key of the largest value of a JSON object of numbers, the first in its order on ties; null if it can't be read."""
    entries = F.map_entries(F.from_json(json_map, "map<string,double>", {"mode": "PERMISSIVE"}))
    top = F.array_max(F.transform(entries, lambda e: e["value"]))
    return F.try_element_at(F.filter(entries, lambda e: e["value"] == top), F.lit(1))["key"]


def admin_verdict_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda m: (F.col("o_orderkey") % m).cast("string")
    json = F.when(F.col("o_orderkey") % 11 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"authentic":'), part(7), F.lit(',"ai":'), part(5), F.lit(',"tampered":'), part(3), F.lit("}")))
    return table(spark, sf_dir, "orders").select(argmax_key(json).alias("verdict")).where("verdict is not null").groupBy("verdict").agg(F.count("*").alias("n"))


def admin_recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest failed inspections, cut first, with their users' names."""
    newest = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return newest.join(users, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderdate", F.col("c_name").alias("user_name"))


def admin_users_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("inspections"))


def admin_error_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent messages after they are cut to 16 characters; a null one has a default text."""
    message = ellipsis(F.coalesce(F.when(F.col("event_type") == "error", F.concat(F.lit("failure of key "), F.get_json_object("props", "$.k"))), F.lit("Unknown")), 16)
    return table(spark, sf_dir, "events").groupBy(message.alias("message")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(5)


def admin_time_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_ms"), F.count("*").alias("n"))


def admin_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority by status, 0 where a pair doesn't occur; the statuses are known, so no pass is needed to find them."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def admin_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak and quiet hour (the earlier on ties), events a day, and events an active user."""
    hours = table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    ends = hours.agg(F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("peak_hour"), F.min_by("hour", F.struct("n", "hour")).alias("quiet_hour"), F.sum("n").alias("total"))
    users = table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"))
    return ends.join(users).select("peak_hour", "quiet_hour", "total", F.round(F.try_divide("total", "days"), 6).alias("per_day"), F.round(F.try_divide("total", "users"), 6).alias("per_user"))


def dash_cost_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean least cost, and mean largest cost, which is the least where it is missing."""
    low = F.col("l_extendedprice").cast("decimal(12,2)")
    high = F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_extendedprice") * 2).cast("decimal(12,2)"))
    return table(spark, sf_dir, "lineitem").agg(F.round(F.avg(low).cast("double"), 4).alias("avg_min"), F.round(F.avg(F.coalesce(high, low)).cast("double"), 4).alias("avg_max"))


def dash_top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)
    return top.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")


def dash_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by type and by severity as rows of one table: a single scan that is expanded."""
    both = F.array(F.struct(F.lit("type").alias("what"), F.col("l_returnflag").alias("name")), F.struct(F.lit("severity").alias("what"), F.col("l_linestatus").alias("name")))
    return table(spark, sf_dir, "lineitem").select(F.explode(both).alias("x")).groupBy("x.what", "x.name").agg(F.count("*").alias("n"))


def dash_user_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the inspections of one group of users, by type: a semi join, so that no finding counts twice."""
    users = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    mine = table(spark, sf_dir, "orders").join(users, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(mine, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("cost"))


def dash_recent_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest inspections with their findings in order: the limit comes before the join."""
    newest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey", "o_orderdate")
    children = table(spark, sf_dir, "lineitem").join(F.broadcast(newest.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
    lists = children.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]), ",").alias("findings"))
    return newest.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderdate", F.coalesce("findings", F.lit("")).alias("findings"))


def worst_severity_per_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst severity by its order (F above O)."""
    rank = F.when(F.col("l_linestatus") == "F", 2).when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linestatus", rank).alias("worst"))


def group_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each inspection: mean risk, files of high risk, time and findings."""
    risk = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.avg(risk), 6).alias("avg_risk"), F.count_if(risk >= 0.4).alias("n_high"), F.sum(F.col("l_quantity").cast("long")).alias("total_time"), F.count("*").alias("n_findings")
    )


def primary_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finding of the lowest order number of each inspection, and how many others there are."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_returnflag"))["l_returnflag"].alias("primary_type"), (F.count("*") - 1).alias("others"))


def case_insensitive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of which any of three columns contains the text in any case; nulls contain nothing."""
    q = "brand#1"
    hit = F.lit(False)
    for c in ("p_name", "p_brand", "p_type"):
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return table(spark, sf_dir, "part").where(hit).select("p_partkey", "p_brand")


def latest_override(log: DataFrame) -> DataFrame:
    """The newest entry of each key of an append-only log (key, seq, outcome); unknown outcomes go to people."""
    newest = log.groupBy("key").agg(F.max_by("outcome", "seq").alias("outcome"))
    return newest.withColumn("outcome", F.when(F.col("outcome").isin("AutoApprove", "HumanReview", "Escalate"), F.col("outcome")).otherwise("HumanReview"))


def decision_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ["AutoApprove", "HumanReview", "Escalate", "bogus"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    log = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("seq"), names.alias("outcome"))
    return latest_override(log).withColumnRenamed("key", "o_orderkey")


def fair_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decides the order in which queued turns are served: the lane (single ones first), then the round of each user.

    Turns are served by (lane, round, user); no place is computed, so that nothing is sorted as a whole.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    n = F.count("*").over(W.partitionBy("conv_id"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role"))
    return turns.select("conv_id", "turn", F.when(n == 1, 0).otherwise(1).alias("lane"), place.alias("round"))


def serving_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place at which each queued job is served: conversations stand for jobs, their turns for files; who asked is the remainder of the key.

    Jobs of one file come first, in order of arrival. The others are served in rounds, one of each user, in the order in which users
    first came, except that each round begins with the second one (who served last isn't asked first; the first user comes last).
    Users who have no job left drop out, and the others keep their order.
    """
    jobs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_files"))
    jobs = jobs.select("conv_id", F.when(F.col("n_files") <= 1, 0).otherwise(1).alias("lane"), F.coalesce((F.col("conv_id") % 37).cast("string"), F.lit("anonymous")).alias("user"))
    albums = running(jobs.where("lane = 1"), ["user"], ["conv_id"]).withColumnRenamed("_upto", "round").drop("_total")
    users = running(albums.groupBy("user").agg(F.min("conv_id").alias("came")), [], ["came"]).select(F.col("user").alias("u"), F.pmod(F.col("_upto") - 2, F.col("_total")).alias("seat"))
    seated = albums.join(users, F.col("user") == F.col("u")).select("conv_id", "lane", "user", "round", "seat")
    single = jobs.where("lane = 0").select("conv_id", "lane", "user", F.lit(0).cast("long").alias("round"), F.lit(0).cast("long").alias("seat"))
    return running(seated.union(single), [], ["lane", "round", "seat", "conv_id"]).select("conv_id", "lane", "user", "round", F.col("_upto").alias("place"))


def evidence_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seal of each case's files: the SHA-256 of their hashes, sorted and joined by colons. Sixteen documents are the files of a case."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 16).alias("case_id"), h.alias("h"))
    return rows.groupBy("case_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ":"), 256).alias("seal"))


QUERIES = {
    f.__name__: f
    for f in (
        admin_status_pivot, admin_processing_percentiles, admin_file_types, admin_verdict_argmax, admin_recent_failures, admin_users_with_counts, admin_error_top5,
        admin_time_by_type, admin_crosstab, admin_peaks, dash_cost_averages, dash_top_parts, dash_distributions, dash_user_semi_join, dash_recent_with_children,
        worst_severity_per_inspection, group_overview, primary_finding, case_insensitive_search, decision_overrides, fair_schedule, serving_order, evidence_seal,
    )
}

_P = "list_sort(list(value))[least(floor(count(value) * {p})::INT, count(value) - 1)::INT + 1] AS p{n}"

ORACLES = {
    "admin_status_pivot": """
        SELECT count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'O') AS "n_O", count(*) FILTER (o_orderstatus = 'P') AS "n_P", count(o_orderstatus) AS total FROM orders""",
    "admin_processing_percentiles": f"""
        SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS largest, round(avg(coalesce(value, 0)), 6) AS mean,
               {', '.join(_P.format(p=p, n=n) for p, n in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))} FROM events GROUP BY 1""",
    "admin_file_types": "SELECT ['jpg', 'png', 'pdf', ''][p_partkey % 4 + 1] AS extension, count(*) AS n FROM part WHERE p_partkey % 4 <> 3 GROUP BY 1",
    "admin_verdict_argmax": """
        SELECT CASE WHEN o_orderkey % 7 >= o_orderkey % 5 AND o_orderkey % 7 >= o_orderkey % 3 THEN 'authentic'
                    WHEN o_orderkey % 5 >= o_orderkey % 3 THEN 'ai' ELSE 'tampered' END AS verdict, count(*) AS n
        FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1""",
    "admin_recent_failures": """
        WITH n AS (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)
        SELECT o_orderkey, o_orderdate, c_name AS user_name FROM n LEFT JOIN customer ON c_custkey = o_custkey""",
    "admin_users_with_counts": "SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS inspections FROM customer",
    "admin_error_top5": """
        WITH m AS (SELECT CASE WHEN event_type = 'error' THEN 'failure of key ' || json_extract_string(props, '$.k') ELSE 'Unknown' END AS t FROM events)
        SELECT CASE WHEN length(t) > 16 THEN left(t, 16) || '...' ELSE t END AS message, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, message LIMIT 5""",
    "admin_time_by_type": "SELECT event_type, round(avg(value), 6) AS mean_ms, count(*) AS n FROM events GROUP BY 1",
    "admin_crosstab": """
        SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
    "admin_peaks": """
        WITH h AS (SELECT hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1)
        SELECT (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) AS peak_hour, (SELECT hour FROM h ORDER BY n, hour LIMIT 1) AS quiet_hour, count(*)::BIGINT AS total,
               round(count(*) / count(DISTINCT ts::DATE), 6) AS per_day, round(count(*) / count(DISTINCT user_id), 6) AS per_user FROM events""",
    "dash_cost_averages": """
        SELECT round(avg(l_extendedprice::DECIMAL(12,2))::DOUBLE, 4) AS avg_min,
               round(avg(CASE WHEN l_linenumber % 2 = 0 THEN (l_extendedprice * 2)::DECIMAL(12,2) ELSE l_extendedprice::DECIMAL(12,2) END)::DOUBLE, 4) AS avg_max FROM lineitem""",
    "dash_top_parts": "SELECT l_partkey, n, p_name FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10) LEFT JOIN part ON p_partkey = l_partkey",
    "dash_distributions": "SELECT 'type' AS what, l_returnflag AS name, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'severity', l_linestatus, count(*) FROM lineitem GROUP BY 2",
    "dash_user_semi_join": """
        SELECT l_returnflag, count(*) AS n, sum(l_extendedprice::DECIMAL(12,2))::DOUBLE AS cost FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) GROUP BY 1""",
    "dash_recent_with_children": """
        WITH n AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5)
        SELECT o_orderkey, o_orderdate, coalesce((SELECT string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS findings FROM n""",
    "worst_severity_per_inspection": "SELECT l_orderkey, CASE WHEN bool_or(l_linestatus = 'F') THEN 'F' ELSE max(l_linestatus) END AS worst FROM lineitem GROUP BY 1",
    "group_overview": """
        SELECT l_orderkey, round(avg(l_discount * 10), 6) AS avg_risk, count(*) FILTER (l_discount * 10 >= 0.4) AS n_high, sum(l_quantity::BIGINT)::BIGINT AS total_time, count(*) AS n_findings
        FROM lineitem GROUP BY 1""",
    "primary_finding": "SELECT l_orderkey, substr(min(l_linenumber || l_returnflag), 2) AS primary_type, count(*) - 1 AS others FROM lineitem GROUP BY 1",
    "case_insensitive_search": "SELECT p_partkey, p_brand FROM part WHERE lower(p_name) LIKE '%brand#1%' OR lower(p_brand) LIKE '%brand#1%' OR lower(p_type) LIKE '%brand#1%'",
    "decision_overrides": """
        WITH l AS (SELECT l_orderkey AS o_orderkey, arg_max(['AutoApprove', 'HumanReview', 'Escalate', 'bogus'][l_linenumber % 4 + 1], l_linenumber) AS outcome FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
        SELECT o_orderkey, CASE WHEN outcome = 'bogus' THEN 'HumanReview' ELSE outcome END AS outcome FROM l""",
    "fair_schedule": """
        SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) = 1 THEN 0 ELSE 1 END AS lane,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn, role)::INT AS round FROM conversations""",
    "serving_order": """
        WITH j AS (SELECT conv_id, CASE WHEN count(*) <= 1 THEN 0 ELSE 1 END AS lane, coalesce((conv_id % 37)::VARCHAR, 'anonymous') AS "user" FROM conversations GROUP BY 1),
        u AS (SELECT "user", row_number() OVER (ORDER BY min(conv_id)) AS r, count(*) OVER () AS n FROM j WHERE lane = 1 GROUP BY 1),
        k AS (SELECT conv_id, lane, "user", CASE WHEN lane = 1 THEN row_number() OVER (PARTITION BY "user", lane ORDER BY conv_id) ELSE 0 END AS round FROM j)
        SELECT conv_id, lane, "user", round, row_number() OVER (ORDER BY lane, round, CASE WHEN lane = 1 THEN (r + n - 2) % n ELSE 0 END, conv_id) AS place FROM k LEFT JOIN u USING ("user")""",
    "evidence_seal": """
        WITH h AS (SELECT doc_id // 16 AS case_id, sha256(coalesce(text, '')) AS h FROM documents)
        SELECT case_id, sha256(string_agg(h, ':' ORDER BY h)) AS seal FROM h GROUP BY 1""",
}
