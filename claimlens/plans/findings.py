"""Findings: pillars, categories, provenance of files, plausibility rules, and the upkeep of case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimlens.functions.columns import module_band
from claimlens.plans.rules import MADE, made, made_sql
from claimlens.sources.tables import table

#: The client's weights of the AI pillar.
PILLAR_WEIGHTS = {"clip": 0.30, "organika": 0.35, "community": 0.15, "pixel": 0.10, "dino": 0.02, "ai_generation": 0.08}
#: The pillar of each other module.
PILLAR_OF = {"modification": "modification", "mesorch": "modification", "deep_modification": "modification", "text": "document", "content": "document"}
#: Document finding categories by the prefixes of codes.
CATEGORIES = {
    "signatures": ["DOC_SIG_", "DOC_FAKE_REDACTION"],
    "security": ["DOC_SHADOW_", "DOC_FORM_OVERLAY_", "DOC_EVIL_", "DOC_DANGEROUS_", "DOC_XFA_"],
    "visual": ["DOC_VISUAL_", "DOC_VERSION_", "DOC_EMBEDDED_"],
    "fonts": ["DOC_FONT_", "DOC_ZERO_WIDTH_", "DOC_MIXED_SCRIPTS", "DOC_CHAR_METRICS_"],
    "structure": ["DOC_MULTIPLE_", "DOC_INCREMENTAL_", "DOC_META_", "DOC_ORPHANED_"],
    "content": ["DOC_COLORSPACE_", "DOC_COMPRESSION_", "DOC_TOUNICODE_", "DOC_ACTUALTEXT_", "DOC_PRIVATE_", "DOC_OCG_"],
}
#: Words in file names that label a file.
AI_NAMES = r"(?i)(?:^|[_\-/])(?:ai|dall[\-_]?e|dalle|midjourney|stable[\-_]?diffusion|sd\d|sdxl|flux|comfyui|automatic1111|invokeai|firefly|imagen|gemini[\-_]?gen|krea|leonardo|playground|ideogram|kandinsky|gen[\-_]?image|fake|generated|synthetic|aigen)"
TAMPERED_NAMES = r"(?i)(?:^|[_\-/])(?:tampered|edit(?:ed)?|splice|inpaint|copy[\-_]?move|forged?|manipulated)"


def module_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order and module that is there."""
    k = F.col("o_orderkey")
    pairs = F.array(*(F.struct(F.lit(m).alias("module"), made(m, k).alias("score")) for m in MADE))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(pairs).alias("x")).select("o_orderkey", "x.module", "x.score").where("score is not null")


def pillar_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean for the AI pillar, the largest score of .40 or more for modification, the largest for others.

    Modules with an error don't count unless all of a pillar have one. A pillar is significant at .20, with a finding of .05 or
    more, or with an error. Here a score stands for its module's finding, every eleventh order has no findings, and every
    thirteenth an error of one module.
    """
    weight = F.coalesce(*(F.when(F.col("module") == m, F.lit(w)) for m, w in PILLAR_WEIGHTS.items()))
    pillar = F.coalesce(F.when(weight.isNotNull(), "ai"), *(F.when(F.col("module") == m, F.lit(p)) for m, p in PILLAR_OF.items()))
    error = (F.col("o_orderkey") % 13 == 0) & F.col("module").isin("clip", "content")
    finding = F.when(F.col("o_orderkey") % 11 != 0, F.col("score"))
    rows = module_rows(spark, sf_dir).withColumns({"pillar": pillar, "w": weight, "error": error, "finding": finding}).where("pillar is not null")
    of = lambda f, c: F.coalesce(f(F.when(~F.col("error"), c)), f(c))
    g = rows.groupBy("o_orderkey", "pillar").agg(
        of(F.sum, F.col("score") * F.col("w")).alias("s"), of(F.sum, F.col("w")).alias("sw"), of(F.max, F.col("score")).alias("top"), F.max("finding").alias("finding"), F.bool_or("error").alias("error")
    )
    value = F.when(F.col("pillar") == "ai", F.col("s") / F.col("sw")).when((F.col("pillar") == "modification") & (F.col("top") < 0.40), 0.0).otherwise(F.col("top"))
    return g.select("o_orderkey", "pillar", F.round(value, 6).alias("risk"), module_band(F.col("top")).alias("level"), ((F.round(value, 6) >= 0.20) | F.coalesce(F.col("finding") >= 0.05, F.lit(False)) | F.col("error")).alias("significant"))


def category_of(code: Column) -> Column:
    """The category whose prefix a finding code has, else other: the first in the table's order."""
    return F.coalesce(*(F.when(F.array_contains(F.transform(F.array(*map(F.lit, ps)), lambda p: code.startswith(p)), True), F.lit(c)) for c, ps in CATEGORIES.items()), F.lit("other"))


_CODES = [p + "X" for ps in CATEGORIES.values() for p in ps][::2] + ["META_Y"]


def finding_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and largest risk of each category and its place: those with findings first, by falling risk, empty ones last."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("l_partkey") % (len(_CODES) - 3) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(category_of(code).alias("category"), F.col("l_discount").alias("risk"))
    g = rows.groupBy("category").agg(F.count("*").alias("n"), F.max("risk").alias("top"))
    spine = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counted = spine.join(g, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), "top")
    return counted.withColumn("place", F.row_number().over(W.orderBy(F.col("n") == 0, F.desc("top"), "category")))


def consensus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return module_rows(spark, sf_dir).groupBy("o_orderkey").agg(F.count_if(F.col("score") >= 0.30).alias("n_high"), F.count_if(F.col("score") < 0.20).alias("n_low"))


def top_module_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of the module with the highest score of .40 or more, the first in the modules' order on ties; metadata without one."""
    order = F.coalesce(*(F.when(F.col("module") == m, F.lit(i)) for i, m in enumerate(MADE)))
    g = module_rows(spark, sf_dir).where("score >= 0.40").groupBy("o_orderkey").agg(F.max_by("module", F.struct(F.col("score"), -order)).alias("module"))
    kinds = {"clip": "AI generation", "ai_generation": "AI generation", "modification": "digital manipulation", "deep_modification": "digital manipulation"}
    kind = F.coalesce(*(F.when(F.col("module") == m, F.lit(c)) for m, c in kinds.items()), F.lit("metadata anomaly"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(g, "o_orderkey", "left").groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by words in file names: AI first, then tampered, else authentic."""
    names = ["photo_{}.jpg", "x-midjourney_{}.png", "edited/{}.jpg", "shot_edit{}.jpg", "AI_{}.png", "maid{}.jpg", "a-forged{}.pdf"]
    name = F.replace(F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int")), F.lit("{}"), F.col("p_partkey").cast("string"))
    label = F.when(F.col("name").rlike(AI_NAMES), "ai_generated").when(F.col("name").rlike(TAMPERED_NAMES), "tampered").otherwise("authentic")
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).select("p_partkey", label.alias("label"))


def image_quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason for which a picture's size, sides or sharpness fail, by category; one category isn't tested for sharpness."""
    k = F.col("p_partkey")
    reason = (
        F.when(F.col("bytes") < 5000, "too_small_bytes")
        .when(F.least("w", "h") < 256, "too_small_resolution")
        .when((F.col("category") != "mobile_quality") & (F.col("sharpness") < 50), "too_blurry")
        .otherwise("ok")
    )
    rows = table(spark, sf_dir, "part").select((k * 37 % 20000).alias("bytes"), (k * 13 % 900).alias("w"), (k * 7 % 800 + 100).alias("h"), (k * 3 % 200).alias("sharpness"), F.when(k % 4 == 0, "mobile_quality").otherwise("desktop").alias("category"))
    return rows.groupBy("category", reason.alias("reason")).agg(F.count("*").alias("n"))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pictures each reason rejects, copies of one that passed included, and how many remain of each category.

    Copies are pictures of one category with the same bytes; the first stays. They only count among those that passed the other gates.
    """
    k = F.col("p_partkey")
    category = F.when(k % 4 == 0, "mobile_quality").otherwise("desktop")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), category.alias("category"), (k * 37 % 20000).alias("bytes"), F.least(k * 13 % 900, k * 7 % 800 + 100).alias("side"), (k * 3 % 200).alias("sharpness"), F.xxhash64("p_brand", "p_size").alias("digest"))
    reason = F.when(F.col("bytes") < 5000, "too_small_bytes").when(F.col("side") < 256, "too_small_resolution").when((F.col("category") != "mobile_quality") & (F.col("sharpness") < 50), "too_blurry")
    rows = rows.withColumn("reason", reason)
    firsts = rows.where("reason is null").groupBy("category", "digest").agg(F.count("*").alias("n")).groupBy("category").agg(F.count("*").alias("kept"), F.sum(F.col("n") - 1).alias("copies"))
    rejected = rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("rejected").alias("part"), F.col("reason").alias("name"), "n")
    copies = firsts.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).select(F.lit("rejected").alias("part"), F.lit("duplicate").alias("name"), "n")
    remaining = firsts.select(F.lit("remaining").alias("part"), F.col("category").alias("name"), F.col("kept").alias("n"))
    return rejected.union(copies).union(remaining)


def gps_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions out of range, at the null island, or at an impossible height."""
    k = F.col("c_custkey")
    lat, lon, alt = (k * 31 % 200 - 100) * 1.0, (k * 17 % 400 - 200) * 1.0, (k * 97 % 12000 - 1000)
    lat, lon = F.when(k % 10 == 0, 0.001).otherwise(lat), F.when(k % 10 == 0, -0.002).otherwise(lon)
    invalid = ~lat.between(-90, 90) | ~lon.between(-180, 180)
    codes = F.array_compact(F.array(F.when(invalid, "invalid"), F.when(~invalid & (F.abs(lat) < 0.01) & (F.abs(lon) < 0.01), "null_island"), F.when(~invalid & ((alt < -500) | (alt > 9000)), "altitude")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(codes, ",").alias("codes"))


def box_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes moved into the unit square, at least .01 wide and high."""
    k = F.col("l_partkey")
    clamp = lambda lo, hi, v: F.greatest(F.lit(lo), F.least(hi if isinstance(hi, Column) else F.lit(hi), v))
    x, y = clamp(0.0, 1.0, (k % 140 - 20) / 100.0), clamp(0.0, 1.0, (k % 130 - 10) / 100.0)
    rows = table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y"), ((k % 90) / 100.0).alias("w0"), ((k % 70) / 100.0).alias("h0"))
    rows = rows.select("x", "y", clamp(0.01, 1.0 - F.col("x"), F.col("w0")).alias("w"), clamp(0.01, 1.0 - F.col("y"), F.col("h0")).alias("h"))
    return rows.agg(*(F.round(F.sum(F.round(F.col(c), 6).cast("decimal(18,6)")).cast("double"), 4).alias(c) for c in "xywh"))


def enum_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as one of the known names: exact, or alike but for case, blanks, _, - and /; Other without one."""
    valid = ["HighPriority", "Urgent", "Medium", "Low"]
    raw = F.element_at(F.array(*map(F.lit, ["Urgent", "high_priority", "HIGH-priority", " m/edium", "lowest", "LOW"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    bare = F.translate(F.lower("raw"), " _-/", "")
    name = F.coalesce(*(F.when((F.col("raw") == v) | (bare == v.lower()), F.lit(v)) for v in valid), F.lit("Other"))
    return table(spark, sf_dir, "orders").select(raw.alias("raw")).groupBy("raw", name.alias("name")).agg(F.count("*").alias("n"))


def revision_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes between the revision marks of a document: differences of the marks' offsets in order."""
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("offset")).distinct()
    gap = F.col("offset") - F.lag("offset").over(W.partitionBy("doc").orderBy("offset"))
    return marks.withColumn("gap", gap).where("gap is not null").groupBy("doc").agg(F.count("*").alias("n_gaps"), F.min("gap").alias("least"), F.max("gap").alias("largest"))


def weather_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the weather of their day and place, where there is one; hail, and rain of more than .5, are marked."""
    days = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 5).alias("place"))
    seen = days.where(F.dayofmonth("day") % 3 != 0).select("day", "place").distinct()
    d = F.dayofyear("day") + F.col("place")
    weather = seen.select("day", "place", F.element_at(F.array(*map(F.lit, [0, 3, 61, 95, 96, 99])), (d % 6 + 1).cast("int")).alias("code"), ((d % 20) / 10.0).alias("mm"))
    j = days.join(weather, ["day", "place"], "left")
    kind = F.when(F.col("code").isNull(), "unknown").when(F.col("code").between(96, 99), "hail").when(F.col("mm") > 0.5, "rain").otherwise("dry")
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def merged_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mandatory findings with descriptions of the same cause, first come first served: both sides are numbered within the cause."""
    own = lambda df, by: df.withColumn("i", F.row_number().over(W.partitionBy("l_orderkey", "cause").orderBy(*by)))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("cause"))
    must = own(rows.where("l_linenumber <= 4"), ["l_linenumber", "l_partkey", "l_suppkey"])
    said = own(rows.where("l_linenumber > 4"), ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "cause", "i", F.col("l_partkey").alias("description"))
    j = must.join(said, ["l_orderkey", "cause", "i"], "left")
    return j.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count("description").alias("n_described"), F.sum(F.coalesce("description", F.lit(0))).alias("check"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of findings when inspections go: each child table is anti-joined with the deleted keys."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_anti").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inspection as its owner, another user and an administrator see it: a row, none, and a row."""
    orders = table(spark, sf_dir, "orders")
    owner = F.col("o_custkey")
    seen = [guarded(orders, 7, None).withColumn("viewer", F.lit("administrator")), guarded(orders, 7, -1).withColumn("viewer", F.lit("another user"))]
    mine = orders.where("o_orderkey = 7").select(owner.alias("me"))
    as_owner = guarded(orders, 7, None).join(mine, owner == F.col("me")).drop("me").withColumn("viewer", F.lit("owner"))
    return seen[0].unionByName(seen[1]).unionByName(as_owner).select("viewer", "o_orderkey", "o_custkey", "o_orderstatus")


def guarded(orders: DataFrame, key: int, user: int | None) -> DataFrame:
    """The inspection of a key for its owner, or for an administrator (no user); else no row. Key and user reach the scan as filters."""
    rows = orders.where(F.col("o_orderkey") == key)
    return (rows if user is None else rows.where(F.col("o_custkey") == user)).limit(1)


def camel_or_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON value under its camel-case or its snake-case name; broken JSON gives null."""
    json = F.when(F.col("event_id") % 3 == 0, F.format_string('{"riskScore": %d}', F.col("event_id") % 10)).when(F.col("event_id") % 3 == 1, F.format_string('{"risk_score": %d}', F.col("event_id") % 10)).otherwise(F.lit("{"))
    value = F.coalesce(F.get_json_object("j", "$.riskScore"), F.get_json_object("j", "$.risk_score")).try_cast("int")
    return table(spark, sf_dir, "events").select(json.alias("j")).groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def skipped_modules(spark: SparkSession, sf_dir: str, skip: str = "pixel, clip,,text", quick: bool = True) -> DataFrame:
    """Rows of the modules that a comma-separated list and the quick mode don't leave out."""
    names = {x.strip() for x in skip.split(",") if x.strip()} | ({"mesorch", "deep_modification"} if quick else set())
    return module_rows(spark, sf_dir).where(~F.col("module").isin(sorted(names))).groupBy("module").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        pillar_rollup, finding_categories, consensus_counts, top_module_category, file_labels, image_quality_gates, quality_report, gps_rules, box_clamp, enum_coercion, revision_gaps, weather_join,
        merged_descriptions, cascade_delete, point_lookup, camel_or_snake, skipped_modules,
    )
}

_M = "WITH m AS (" + " UNION ALL ".join(f"SELECT o_orderkey, '{m}' AS module, {i} AS i, {made_sql(m)} AS score FROM orders" for i, m in enumerate(MADE)) + "), r AS (SELECT * FROM m WHERE score IS NOT NULL)"
_CASE = lambda c, d: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in d.items()) + " END"
_CODE = f"{_CODES}[l_partkey % {len(_CODES) - 3} + 1]"

ORACLES = {
    "pillar_rollup": _M + f""", p AS (SELECT *, {_CASE('module', PILLAR_WEIGHTS)} AS w, CASE WHEN module IN {tuple(PILLAR_WEIGHTS)} THEN 'ai' ELSE {_CASE('module', PILLAR_OF)} END AS pillar FROM r),
        e AS (SELECT *, o_orderkey % 13 = 0 AND module IN ('clip', 'content') AS err FROM p WHERE pillar IS NOT NULL),
        x AS (SELECT *, bool_and(err) OVER (PARTITION BY o_orderkey, pillar) OR NOT err AS live FROM e),
        g AS (SELECT o_orderkey, pillar, sum(score * w) FILTER (live) / sum(w) FILTER (live) AS s, max(score) FILTER (live) AS top, max(score) FILTER (o_orderkey % 11 <> 0) AS finding, bool_or(err) AS err FROM x GROUP BY 1, 2),
        v AS (SELECT *, round(CASE WHEN pillar = 'ai' THEN s WHEN pillar = 'modification' AND top < 0.4 THEN 0 ELSE top END, 6) AS risk FROM g)
        SELECT o_orderkey, pillar, risk, CASE WHEN top >= 0.75 THEN 'Critical' WHEN top >= 0.5 THEN 'High' WHEN top >= 0.25 THEN 'Medium' ELSE 'Low' END AS level, risk >= 0.20 OR coalesce(finding >= 0.05, false) OR err AS significant FROM v""",
    "finding_categories": "WITH c AS (SELECT unnest(" + str(list(CATEGORIES)) + ") AS category), f AS (SELECT l_discount AS risk, CASE "
    + " ".join(f"WHEN {' OR '.join(f'starts_with({_CODE}, {p!r})' for p in ps)} THEN {c!r}" for c, ps in CATEGORIES.items())
    + " END AS category FROM lineitem), g AS (SELECT category, count(risk) AS n, max(risk) AS top FROM c LEFT JOIN f USING (category) GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n = 0, top DESC, category) AS place FROM g",
    "consensus_counts": _M + " SELECT o_orderkey, count(*) FILTER (score >= 0.30) AS n_high, count(*) FILTER (score < 0.20) AS n_low FROM r GROUP BY 1",
    "top_module_category": _M + """, t AS (SELECT o_orderkey, module, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, i) AS k FROM r WHERE score >= 0.40), j AS (SELECT o.o_orderkey, module FROM orders o LEFT JOIN t ON t.o_orderkey = o.o_orderkey AND k = 1)
        SELECT CASE WHEN module IN ('clip', 'ai_generation') THEN 'AI generation' WHEN module IN ('modification', 'deep_modification') THEN 'digital manipulation' ELSE 'metadata anomaly' END AS category, count(*) AS n FROM j GROUP BY 1""",
    "file_labels": "SELECT p_partkey, ['authentic', 'ai_generated', 'tampered', 'tampered', 'ai_generated', 'authentic', 'tampered'][p_partkey % 7 + 1] AS label FROM part",
    "image_quality_gates": """
        WITH p AS (SELECT p_partkey * 37 % 20000 AS b, p_partkey * 13 % 900 AS w, p_partkey * 7 % 800 + 100 AS h, p_partkey * 3 % 200 AS s, CASE WHEN p_partkey % 4 = 0 THEN 'mobile_quality' ELSE 'desktop' END AS category FROM part)
        SELECT category, CASE WHEN b < 5000 THEN 'too_small_bytes' WHEN least(w, h) < 256 THEN 'too_small_resolution' WHEN category = 'desktop' AND s < 50 THEN 'too_blurry' ELSE 'ok' END AS reason, count(*) AS n FROM p GROUP BY 1, 2""",
    "quality_report": """
        WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'mobile_quality' ELSE 'desktop' END AS category, p_brand || '|' || p_size AS d,
                          CASE WHEN p_partkey * 37 % 20000 < 5000 THEN 'too_small_bytes' WHEN least(p_partkey * 13 % 900, p_partkey * 7 % 800 + 100) < 256 THEN 'too_small_resolution' WHEN p_partkey % 4 <> 0 AND p_partkey * 3 % 200 < 50 THEN 'too_blurry' END AS reason FROM part)
        SELECT 'rejected' AS part, reason AS name, count(*) AS n FROM p WHERE reason IS NOT NULL GROUP BY reason
        UNION ALL SELECT 'rejected', 'duplicate', (SELECT count(*) - count(DISTINCT category || d) FROM p WHERE reason IS NULL)
        UNION ALL SELECT 'remaining', category, count(DISTINCT d) FROM p WHERE reason IS NULL GROUP BY category""",
    "gps_rules": """
        WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0.001 ELSE c_custkey * 31 % 200 - 100 END AS lat, CASE WHEN c_custkey % 10 = 0 THEN -0.002 ELSE c_custkey * 17 % 400 - 200 END AS lon, c_custkey * 97 % 12000 - 1000 AS alt FROM customer),
        f AS (SELECT *, abs(lat) > 90 OR abs(lon) > 180 AS bad FROM g)
        SELECT c_custkey, concat_ws(',', CASE WHEN bad THEN 'invalid' END, CASE WHEN NOT bad AND abs(lat) < 0.01 AND abs(lon) < 0.01 THEN 'null_island' END, CASE WHEN NOT bad AND (alt < -500 OR alt > 9000) THEN 'altitude' END) AS codes FROM f""",
    "box_clamp": """
        WITH b AS (SELECT greatest(0, least(100, l_partkey % 140 - 20)) AS x, greatest(0, least(100, l_partkey % 130 - 10)) AS y, l_partkey % 90 AS w0, l_partkey % 70 AS h0 FROM lineitem)
        SELECT sum(x) / 100 AS x, sum(y) / 100 AS y, sum(greatest(1, least(100 - x, w0))) / 100 AS w, sum(greatest(1, least(100 - y, h0))) / 100 AS h FROM b""",
    "enum_coercion": """
        WITH r AS (SELECT ['Urgent', 'high_priority', 'HIGH-priority', ' m/edium', 'lowest', 'LOW'][o_orderkey % 6 + 1] AS raw FROM orders)
        SELECT raw, CASE raw WHEN 'Urgent' THEN 'Urgent' WHEN 'high_priority' THEN 'HighPriority' WHEN 'HIGH-priority' THEN 'HighPriority' WHEN ' m/edium' THEN 'Medium' WHEN 'LOW' THEN 'Low' ELSE 'Other' END AS name, count(*) AS n FROM r GROUP BY 1, 2""",
    "revision_gaps": """
        WITH m AS (SELECT DISTINCT l_orderkey AS doc, l_partkey * 8 + l_linenumber AS o FROM lineitem), g AS (SELECT doc, o - lag(o) OVER (PARTITION BY doc ORDER BY o) AS gap FROM m)
        SELECT doc, count(gap) AS n_gaps, min(gap) AS least, max(gap) AS largest FROM g WHERE gap IS NOT NULL GROUP BY 1""",
    "weather_join": """
        WITH o AS (SELECT o_orderdate::DATE AS day, o_custkey % 5 AS place FROM orders), k AS (SELECT CASE WHEN day(day) % 3 = 0 THEN NULL ELSE dayofyear(day) + place END AS d FROM o)
        SELECT CASE WHEN d IS NULL THEN 'unknown' WHEN d % 6 >= 4 THEN 'hail' WHEN d % 20 > 5 THEN 'rain' ELSE 'dry' END AS kind, count(*) AS n FROM k GROUP BY 1""",
    "merged_descriptions": """
        WITH a AS (SELECT l_orderkey, l_returnflag AS c, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem WHERE l_linenumber <= 4),
        b AS (SELECT l_orderkey, l_returnflag AS c, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem WHERE l_linenumber > 4)
        SELECT l_orderkey, count(*) AS n, count(l_partkey) AS n_described, coalesce(sum(l_partkey), 0)::BIGINT AS "check" FROM a LEFT JOIN b USING (l_orderkey, c, i) GROUP BY 1""",
    "cascade_delete": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
    "point_lookup": "SELECT v AS viewer, o_orderkey, o_custkey, o_orderstatus FROM orders, (SELECT unnest(['administrator', 'owner']) AS v) WHERE o_orderkey = 7",
    "camel_or_snake": "SELECT CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_id % 10 END::INT AS value, count(*) AS n FROM events GROUP BY 1",
    "skipped_modules": _M + " SELECT module, count(*) AS n FROM r WHERE module NOT IN ('pixel', 'clip', 'text', 'mesorch', 'deep_modification') GROUP BY 1",
}
