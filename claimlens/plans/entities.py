"""Entities as an API returns them, the filters of its lists, and the upkeep of users: orders stand for inspections, lineitem for
damages, customer for users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimlens.config import FINDING_MODULES, finding_threshold
from claimlens.operators.pairs import salted_join
from claimlens.plans.audit import path
from claimlens.plans.rules import MADE, made, made_sql
from claimlens.sources.tables import table

#: Status codes of the tables and their names.
STATUSES = {"F": "Completed", "O": "Pending", "P": "Failed"}
#: The moment that "today" and the like are counted from.
NOW = "TIMESTAMP_NTZ'2024-01-30 15:30:00'"
SKIPPED = ["/api/health", "/api/audit/track"]


def status_name(code: Column) -> Column:
    return F.coalesce(*(F.when(code == c, F.lit(n)) for c, n in STATUSES.items()))


def inspection_dtos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inspection with its owner's name (null without one), names for codes, its damages in order and its traces from JSON.

    Damages are gathered per inspection, which has a handful; decimals become doubles, and a token becomes whether there is one.
    """
    damage = F.struct("l_linenumber", F.col("l_returnflag").alias("type"), F.round(F.col("l_extendedprice"), 2).cast("double").alias("cost"))
    damages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(damage)).alias("damages"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("owner_name"))
    k = F.col("o_orderkey")
    trace = F.when(k % 9 == 0, F.lit("{broken")).otherwise(F.format_string('[{"rule":"r%d","fired":true},{"rule":"r2","fired":false}]', k % 3))
    traces = F.coalesce(F.from_json(trace, "array<struct<rule:string,fired:boolean>>"), F.array().cast("array<struct<rule:string,fired:boolean>>"))
    rows = table(spark, sf_dir, "orders").withColumns({"traces": traces, "token": F.when(k % 4 == 0, k)}).join(users, "o_custkey", "left").join(damages, "o_orderkey", "left")
    list_of = lambda c, f: F.array_join(F.transform(F.coalesce(c, F.array()), f), ";")
    return rows.select(
        "o_orderkey",
        status_name(F.col("o_orderstatus")).alias("status"),
        "owner_name",
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("created"),
        F.col("token").isNotNull().alias("has_timestamp"),
        F.coalesce(F.size("damages"), F.lit(0)).alias("n_damages"),
        F.coalesce(F.array_join(F.transform("damages", lambda d: F.concat(d["l_linenumber"].cast("string"), d["type"])), ";"), F.lit("")).alias("damages"),
        F.round(F.coalesce(F.aggregate("damages", F.lit(0.0), lambda a, d: a + d["cost"]), F.lit(0.0)), 2).alias("cost"),
        list_of(F.filter("traces", lambda t: t["fired"]), lambda t: t["rule"]).alias("fired"),
    )


def evidence_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of an inspection: its forensic result, custody events in order, and totals as doubles."""
    k = F.col("o_orderkey")
    result = F.struct(F.coalesce(made("clip", k), F.lit(0.0)).alias("risk"), made("clip", k).isNull().alias("failed"))
    event = lambda name, day: F.struct(F.date_format(day, "yyyy-MM-dd").alias("at"), F.lit(name).alias("event"))
    day = F.col("o_orderdate").cast("timestamp")
    custody = F.array_compact(F.array(event("received", day), event("analysed", day + F.expr("INTERVAL 1 DAY")), F.when(F.col("o_orderstatus") == "F", event("sealed", day + F.expr("INTERVAL 2 DAYS")))))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", result.alias("result"), custody.alias("custody"), F.col("o_totalprice").cast("decimal(14,2)").alias("total"))
    events = F.array_join(F.transform("custody", lambda e: F.concat(e["at"], F.lit(" "), e["event"])), ",")
    label = F.concat(F.format_string("%.1f", F.round(F.col("result.risk") * 100, 1)), F.lit("%"))
    return rows.select("o_orderkey", F.round("result.risk", 6).alias("risk"), F.col("result.failed").alias("failed"), label.alias("risk_label"), events.alias("custody"), F.col("total").cast("double").alias("total"))


def listed(orders: DataFrame, status: str | None = None, user: int | None = None) -> DataFrame:
    """Inspections of a status, named in any case, and a user; a name that isn't one, or none, and no user filter nothing."""
    codes = {n.lower(): c for c, n in STATUSES.items()}
    code = codes.get((status or "").lower())
    orders = orders if code is None else orders.where(F.col("o_orderstatus") == code)
    return orders if user is None else orders.where(F.col("o_custkey") == user)


def status_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each of some filters leaves."""
    orders = table(spark, sf_dir, "orders")
    asked = [("completed", None), ("PENDING", None), ("bogus", None), ("", None), ("Failed", 7), (None, 7)]
    parts = [listed(orders, s, u).agg(F.count("*").alias("n")).select(F.lit(f"{s}/{u}").alias("asked"), "n") for s, u in asked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def midnight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events today, since a week ago and since 30 days ago, all from midnight, in one pass."""
    today = F.date_trunc("day", F.expr(NOW)).cast("timestamp_ntz")
    since = lambda days: F.count_if(F.col("ts") >= today - F.expr(f"INTERVAL {days} DAYS"))
    return table(spark, sf_dir, "events").agg(since(0).alias("today"), since(7).alias("week"), since(30).alias("month"))


def audited_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are audited: paths under /api/, but for those that begin, in any case, with a skipped prefix."""
    k = F.col("event_id") % 5
    p = F.when(k == 0, F.concat(F.lit("/api/"), path())).when(k == 1, "/api/HEALTH/live").when(k == 2, "/API/x").when(k == 3, "/api/audit/tracking").otherwise("/static/app.js")
    skipped = F.exists(F.array(*map(F.lit, SKIPPED)), lambda s: F.startswith(F.lower("path"), s))
    rows = table(spark, sf_dir, "events").select(p.alias("path")).where(F.col("path").startswith("/api/") & ~skipped)
    return rows.groupBy("path").agg(F.count("*").alias("n"))


def days_of(days: DataFrame, first: str | None, last: str | None, period: int) -> DataFrame:
    """Pre-aggregated days (day, an ISO string) from first to last by comparing strings; without both, the last ones of all."""
    if first and last:
        return days.where(F.col("day").between(first, last))
    return days.orderBy(F.desc("day")).limit(period)


def day_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    a = days_of(days, "2024-01-05", "2024-01-08", 7).withColumn("asked", F.lit("range"))
    return a.unionByName(days_of(days, "2024-01-05", None, 7).withColumn("asked", F.lit("last")))


def module_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each inspection: its modules without an error, the slowest first, and how many had one."""
    k = F.col("o_orderkey")
    modules = F.array(*(F.struct(F.lit(m).alias("name"), (k * (i * 7 + 3) % 500).alias("ms"), F.when(made(m, k).isNull(), "failed").alias("error")) for i, m in enumerate(MADE)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", modules.alias("m"))
    live = F.filter("m", lambda x: x["error"].isNull() | (x["error"] == ""))
    slowest = F.array_sort(live, lambda a, b: F.when(a["ms"] != b["ms"], F.when(a["ms"] > b["ms"], -1).otherwise(1)).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return rows.select("o_orderkey", F.array_join(F.transform(slowest, lambda x: x["name"]), ",").alias("slowest_first"), (F.size("m") - F.size(live)).alias("n_errors"))


def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five users with most inspections; the limit comes before the names."""
    top = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(5)
    return top.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")


def processing_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By priority: mean days of completed inspections that have an end (0 if none), and the mean risk in per cent, null as 0."""
    k = F.col("o_orderkey")
    days = F.when((F.col("o_orderstatus") == "F") & (k % 6 != 0), k % 9)
    risk = F.coalesce(made("pixel", k), F.lit(0.0))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.bround(F.coalesce(F.avg(days), F.lit(0.0)), 0).alias("mean_days"), F.round(F.avg(risk) * 100, 1).alias("risk_percent"))


def time_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean duration and number of files by extension, with the place by falling number."""
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, ["jpg", "png", "pdf", "jpg", "heic"])), (k % 5 + 1).cast("int"))
    g = table(spark, sf_dir, "part").groupBy(ext.alias("extension")).agg(F.round(F.avg((k * 37 % 1000).cast("double")), 6).alias("mean_ms"), F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "extension")))


def zipped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their results by position, and with the first image of the same name: both sides carry an ordinal."""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("i"), F.col("l_returnflag").alias("name"), (F.col("l_partkey") % 10).alias("score"))
    files, results = rows.drop("score"), rows.where("i % 3 != 0").select("l_orderkey", "i", "score")
    images = rows.groupBy("l_orderkey", "name").agg(F.min("i").alias("image"))
    j = files.join(results, ["l_orderkey", "i"], "left").join(images, ["l_orderkey", "name"], "left")
    return j.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count("score").alias("n_scored"), F.sum("image").alias("images"))


def word_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a text layer that the recognised text lacks, findings of two lists as one, and the first of each code only."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    missing = F.array_except(words(F.col("p_name")), words(F.concat(F.col("p_brand"), F.lit(" "), F.substring_index("p_name", " ", 1))))
    one, two = F.array(F.col("p_brand"), F.col("p_type")), F.array(F.col("p_type"), F.col("p_brand"), F.lit("extra"))
    both = F.concat(one, two)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.size(missing).alias("n_missing"), F.size(both).alias("n_findings"), F.array_join(F.array_distinct(both), ",").alias("firsts"))
    return rows


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users after a log of changes: the newest one of each kind holds; who has none is active and has the role of a user."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, "active").otherwise("role").alias("what"), F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "yes").otherwise("no")).when(F.col("event_id") % 7 == 0, "admin").otherwise("user").alias("value"))
    newest = log.groupBy("user_id").agg(*(F.max_by(F.when(F.col("what") == w, F.col("value")), F.when(F.col("what") == w, F.col("event_id"))).alias(w) for w in ("active", "role")))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(newest, "user_id", "left")
    return users.groupBy(F.coalesce("active", F.lit("yes")).alias("active"), F.coalesce("role", F.lit("user")).alias("role")).agg(F.count("*").alias("n"))


def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a list of known file names overrides, whatever their case; the first of a name in the list holds."""
    known = spark.createDataFrame([("Photo_1.JPG", "authentic"), ("photo_2.jpg", "tampered"), ("PHOTO_2.jpg", "authentic")], "name string, known string")
    known = known.withColumn("i", F.when(F.col("name") == "PHOTO_2.jpg", 1).otherwise(0)).groupBy(F.lower("name").alias("key")).agg(F.min_by("known", "i").alias("known"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("PHOTO_"), (F.col("p_partkey") % 5).cast("string"), F.lit(".jpg")).alias("name"), F.lit("ai_generated").alias("label"))
    j = rows.join(F.broadcast(known), F.lower("name") == F.col("key"), "left")
    return j.groupBy("name", F.coalesce("known", "label").alias("label")).agg(F.count("*").alias("n"))


def mandatory_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per inspection and module that reaches its threshold (lower for uploads): cause, severity, safety and confidence."""
    k = F.col("o_orderkey")
    modules = F.array(
        *(F.struct(F.lit(m).alias("module"), made(m, k).alias("risk"), F.lit(finding_threshold(m, False)).alias("t"), F.lit(finding_threshold(m, True)).alias("up"), F.lit(c).alias("cause"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for m, (_, c, lo, hi) in FINDING_MODULES.items())
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(modules).alias("m")).select("o_orderkey", "m.*")
    high = F.col("risk") >= 0.60
    confidence = F.round(F.least(F.lit(0.95), 0.50 + F.col("risk") * 0.40) + 1e-9, 2)  # ties go up: binary noise doesn't decide them
    return rows.where(F.col("risk") >= F.when(k % 2 == 0, F.col("up")).otherwise(F.col("t"))).select(
        "o_orderkey", "module", "cause", F.when(high, F.col("hi")).otherwise(F.col("lo")).alias("severity"), F.when(high, "Critical").otherwise("Warning").alias("safety"), confidence.alias("confidence"), F.round("risk", 4).alias("risk")
    )


def duplicate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each document whose text occurred before: risk .85, confidence .95, with how many earlier ones there are.

    A group of copies is one row of counts, never paired; its rows are dealt to salts where the counts are joined.
    """
    h = F.md5(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", h.alias("h"))
    again = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return salted_join(rows, again, "h", "doc_id").where("doc_id > first").select("doc_id", F.col("first").alias("matched"), F.lit(0.85).alias("risk"), F.lit(0.95).alias("confidence"), (F.col("n") - 1).alias("n_matches"))


QUERIES = {
    f.__name__: f
    for f in (
        inspection_dtos, evidence_payloads, status_filters, midnight_counts, audited_paths, day_ranges, module_timings, top_users, processing_means, time_by_extension, zipped_results, word_layers,
        user_changes, known_labels, mandatory_findings, duplicate_findings,
    )
}

_MODULES = "[" + ", ".join(f"{{'name': '{m}', 'ms': o_orderkey * {i * 7 + 3} % 500, 'gone': {made_sql(m)} IS NULL}}" for i, m in enumerate(MADE)) + "]"
_FINDINGS = " UNION ALL ".join(
    f"SELECT o_orderkey, '{m}' AS module, '{c}' AS cause, {made_sql(m)} AS risk, {t} AS t, {up} AS up, '{lo}' AS lo, '{hi}' AS hi FROM orders"
    for m, c, t, up, lo, hi in (
        ("ai_generation", "AI generiranje", 0.50, 0.40, "Severe", "Critical"), ("clip", "AI generiranje", 0.45, 0.35, "Moderate", "Severe"), ("vae", "Sumnjiva tekstura", 0.45, 0.35, "Moderate", "Severe"),
        ("deep_modification", "Digitalna manipulacija", 0.50, 0.40, "Moderate", "Severe"), ("modification", "Rekompresijski artefakti", 0.45, 0.35, "Moderate", "Moderate"),
        ("text", "AI generiranje", 0.45, 0.35, "Moderate", "Severe"), ("content", "Krivotvoreni identifikatori", 0.40, 0.30, "Severe", "Critical"),
    )
)

ORACLES = {
    "inspection_dtos": """
        WITH d AS (SELECT l_orderkey, count(*)::INT AS n, string_agg(l_linenumber || l_returnflag, ';' ORDER BY l_linenumber, l_returnflag) AS s, round(sum(round(l_extendedprice, 2)), 2) AS cost FROM lineitem GROUP BY 1)
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Failed' END AS status, c_name AS owner_name, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d') AS created,
               o_orderkey % 4 = 0 AS has_timestamp, coalesce(n, 0) AS n_damages, coalesce(s, '') AS damages, coalesce(cost, 0) AS cost, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'r' || (o_orderkey % 3) END AS fired
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN d ON l_orderkey = o_orderkey""",
    "evidence_payloads": f"""
        WITH r AS (SELECT *, coalesce({made_sql('clip')}, 0) AS risk, {made_sql('clip')} IS NULL AS failed, o_orderdate::TIMESTAMP AS d FROM orders)
        SELECT o_orderkey, round(risk, 6) AS risk, failed, printf('%.1f%%', round(risk * 100, 1)) AS risk_label,
               strftime(d, '%Y-%m-%d') || ' received,' || strftime(d + INTERVAL 1 DAY, '%Y-%m-%d') || ' analysed' || CASE WHEN o_orderstatus = 'F' THEN ',' || strftime(d + INTERVAL 2 DAY, '%Y-%m-%d') || ' sealed' ELSE '' END AS custody,
               o_totalprice::DECIMAL(14,2)::DOUBLE AS total FROM r""",
    "status_filters": """
        SELECT 'completed/None' AS asked, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'PENDING/None', count(*) FROM orders WHERE o_orderstatus = 'O'
        UNION ALL SELECT 'bogus/None', count(*) FROM orders UNION ALL SELECT '/None', count(*) FROM orders
        UNION ALL SELECT 'Failed/7', count(*) FROM orders WHERE o_orderstatus = 'P' AND o_custkey = 7 UNION ALL SELECT 'None/7', count(*) FROM orders WHERE o_custkey = 7""",
    "midnight_counts": "SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (ts >= TIMESTAMP '2024-01-23') AS week, count(*) FILTER (ts >= TIMESTAMP '2023-12-31') AS month FROM events",
    "audited_paths": "SELECT '/api/' || event_type || '/' || json_extract_string(props, '$.k') AS path, count(*) AS n FROM events WHERE event_id % 5 = 0 GROUP BY 1",
    "day_ranges": """
        WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)
        SELECT day, n, 'range' AS asked FROM d WHERE day BETWEEN '2024-01-05' AND '2024-01-08' UNION ALL SELECT * FROM (SELECT day, n, 'last' FROM d ORDER BY day DESC LIMIT 7)""",
    "module_timings": f"""
        WITH m AS (SELECT o_orderkey, unnest({_MODULES}) AS m FROM orders)
        SELECT o_orderkey, coalesce(string_agg(m.name, ',' ORDER BY m.ms DESC, m.name) FILTER (NOT m.gone), '') AS slowest_first, (count(*) FILTER (m.gone))::INT AS n_errors FROM m GROUP BY 1""",
    "top_users": "SELECT o_custkey, n, c_name FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 5) LEFT JOIN customer ON c_custkey = o_custkey",
    "processing_means": f"""
        SELECT o_orderpriority, round_even(coalesce(avg(o_orderkey % 9) FILTER (o_orderstatus = 'F' AND o_orderkey % 6 <> 0), 0), 0) AS mean_days, round(avg(coalesce({made_sql('pixel')}, 0)) * 100, 1) AS risk_percent FROM orders GROUP BY 1""",
    "time_by_extension": """
        WITH g AS (SELECT ['jpg', 'png', 'pdf', 'jpg', 'heic'][p_partkey % 5 + 1] AS extension, round(avg(p_partkey * 37 % 1000), 6) AS mean_ms, count(*) AS n FROM part GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY n DESC, extension) AS place FROM g""",
    "zipped_results": """
        WITH r AS (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
        f AS (SELECT l_orderkey, CASE WHEN i % 3 <> 0 THEN l_partkey % 10 END AS s, min(i) OVER (PARTITION BY l_orderkey, l_returnflag) AS image FROM r)
        SELECT l_orderkey, count(*) AS n, count(s) AS n_scored, sum(image)::BIGINT AS images FROM f GROUP BY 1""",
    "word_layers": """
        WITH w AS (SELECT p_partkey, p_brand, p_type, list_distinct(string_split(lower(p_name), ' ')) AS a, string_split(lower(p_brand || ' ' || split_part(p_name, ' ', 1)), ' ') AS b FROM part)
        SELECT p_partkey, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS n_missing, 5 AS n_findings, p_brand || ',' || p_type || ',extra' AS firsts FROM w""",
    "user_changes": """
        WITH l AS (SELECT user_id, arg_max(event_id % 2 = 0, event_id) FILTER (event_id % 3 = 0) AS a, arg_max(event_id % 7 = 0, event_id) FILTER (event_id % 3 <> 0) AS r FROM events GROUP BY 1)
        SELECT CASE WHEN coalesce(a, true) THEN 'yes' ELSE 'no' END AS active, CASE WHEN coalesce(r, false) THEN 'admin' ELSE 'user' END AS role, count(*) AS n FROM customer LEFT JOIN l ON user_id = c_custkey GROUP BY 1, 2""",
    "known_labels": "SELECT 'PHOTO_' || (p_partkey % 5) || '.jpg' AS name, ['ai_generated', 'authentic', 'tampered', 'ai_generated', 'ai_generated'][p_partkey % 5 + 1] AS label, count(*) AS n FROM part GROUP BY 1, 2",
    "mandatory_findings": f"""
        WITH f AS ({_FINDINGS})
        SELECT o_orderkey, module, cause, CASE WHEN risk >= 0.6 THEN hi ELSE lo END AS severity, CASE WHEN risk >= 0.6 THEN 'Critical' ELSE 'Warning' END AS safety,
               round(least(0.95, 0.5 + risk * 0.4) + 1e-9, 2) AS confidence, round(risk, 4) AS risk
        FROM f WHERE risk >= CASE WHEN o_orderkey % 2 = 0 THEN up ELSE t END""",
    "duplicate_findings": """
        WITH d AS (SELECT doc_id, min(doc_id) OVER c AS matched, count(*) OVER c - 1 AS n_matches FROM documents WINDOW c AS (PARTITION BY coalesce(text, '')))
        SELECT doc_id, matched, 0.85::DOUBLE AS risk, 0.95::DOUBLE AS confidence, n_matches FROM d WHERE doc_id > matched""",
}
