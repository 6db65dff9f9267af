"""Rules of reports and lists in full: gates against a baseline, averages over classes, attention features, bands, weather, devices, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import columns as c
from claimlens.operators import fusion
from claimlens.plans import rules
from claimlens.plans.calibration import MODULES, confusion, labelled, predicted_class
from claimlens.plans.metadata import SOFTWARE
from claimlens.plans.rules import MADE, META_MODULES, made, made_sql, scored_orders
from claimlens.sources.tables import table


def gates_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of the held-out newest tenth, by the clip score at .40, and what each figure gained over a baseline: the pixel score at .30.

    Both confusions are one aggregation over the held-out rows; the failed gates are named in their order.
    """
    rows = labelled(spark, sf_dir)
    cut = rows.agg((F.max("doc_id") * 0.9).alias("cut"))
    held = rows.join(F.broadcast(cut), F.col("doc_id") > F.col("cut"), "left_semi")
    runs = F.array(F.struct(F.lit("now").alias("run"), F.col("clip").alias("clip"), (F.col("clip") >= 0.40).alias("predicted")), F.struct(F.lit("base").alias("run"), F.col("pixel").alias("clip"), (F.col("pixel") >= 0.30).alias("predicted")))
    both = held.select((F.col("truth") == "ai_generated").alias("positive"), F.explode(runs).alias("r")).select("positive", "r.*")
    figures = ("recall_other", "recall_ai", "accuracy", "margin")
    g = confusion(both, ["run"]).groupBy().agg(*(F.max(F.when(F.col("run") == r, F.col(f))).alias(f"{r}_{f}") for f in figures for r in ("now", "base")))
    failed = F.array_compact(F.array(F.when(F.col("now_recall_other") < 0.85, "authentic recall"), F.when(F.col("now_recall_ai") < 0.75, "AI recall"), F.when(F.col("now_margin") < 0.20, "inversion")))
    return g.select(*(F.col(f"now_{f}").alias(f) for f in figures), *(F.round(F.col(f"now_{f}") - F.coalesce(f"base_{f}", F.lit(0.0)), 6).alias(f"{f}_delta") for f in figures), F.array_join(failed, ",").alias("failed"))


def metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and the plain means over classes of precision, recall and F1, from one table of pairs; a class that is neither true nor guessed doesn't count."""
    pairs = labelled(spark, sf_dir).groupBy("truth", predicted_class().alias("predicted")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("truth").alias("class"), F.lit("t").alias("side")), F.struct(F.col("predicted").alias("class"), F.lit("p").alias("side")))
    rows = pairs.select(F.explode(sides).alias("x"), (F.col("truth") == F.col("predicted")).alias("hit"), "n").select("x.*", "hit", "n")
    s = lambda w: F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0))
    g = rows.groupBy("class").agg(s((F.col("side") == "t") & F.col("hit")).alias("tp"), s(F.col("side") == "t").alias("support"), s(F.col("side") == "p").alias("guesses"))
    p, r = F.col("tp") / F.greatest("guesses", F.lit(1)), F.col("tp") / F.greatest("support", F.lit(1))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    mean = lambda x: F.round(F.avg(x), 6)
    return g.agg(F.sum("support").alias("n"), F.round(F.sum("tp") / F.greatest(F.sum("support"), F.lit(1)), 6).alias("accuracy"), mean(p).alias("macro_precision"), mean(r).alias("macro_recall"), mean(f1).alias("macro_f1"))


def attention_features(scores: Column, confidences: Column, counts: Column, codes: Column) -> Column:
    """Four values a module (score, confidence, findings up to ten in tenths, whether it is there) and six of all: valid provenance, an AI
    tool, an AI file name, and the shares of modules that are there, high (.50) and low (under .15). Maps have the modules without an error."""
    n = len(META_MODULES)
    get = lambda m, name: F.coalesce(m[name], F.lit(0.0))
    each = [x for m in META_MODULES for x in (get(scores, m), get(confidences, m), F.least(get(counts, m), F.lit(10.0)) / 10, scores[m].isNotNull().cast("double"))]
    known = F.array(*(scores[m] for m in META_MODULES))
    share = lambda f: F.size(F.filter(known, f)) / n
    has = [F.array_contains(codes, code).cast("double") for code in (fusion.PROVENANCE_VALID, fusion.AI_TOOL, fusion.AI_FILENAME)]
    return F.array(*each, *has, share(lambda s: s.isNotNull()), share(lambda s: s >= 0.50), share(lambda s: s < 0.15))


def attention_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of each inspection: how many, those of all modules, and a weighted sum that every position enters."""
    scores = F.col("scores")
    x = attention_features(scores, F.transform_values(scores, lambda m, s: 0.5 + s / 2), F.transform_values(scores, lambda m, s: F.floor(s * 20).cast("double")), F.col("codes"))
    rows = scored_orders(spark, sf_dir).select("o_orderkey", x.alias("x"))
    at = lambda i: F.element_at("x", i - 7)
    total = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return rows.select("o_orderkey", F.size("x").alias("n"), *(F.round(at(i), 6).alias(name) for i, name in enumerate(("valid", "tool", "file_name", "present", "high", "low"), 1)), F.round(total, 4).alias("weighted"))


def class_by_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the largest probability where there are all three (ties: the first), else by the overall score and the stronger channel."""
    out = fusion.fused(scored_orders(spark, sf_dir)).withColumn("missing", F.col("o_orderkey") % 5 == 0)
    order = [("authentic", "p_authentic"), ("ai_generated", "p_ai"), ("tampered", "p_tampered")]
    top = F.greatest(*(F.col(p) for _, p in order))
    by_probability = F.coalesce(*(F.when(F.col(p) == top, F.lit(name)) for name, p in order))
    s = lambda m: F.coalesce(F.col("scores")[m], F.lit(0.0))
    ai, tamper = F.greatest(s("ai_generation"), s("community"), s("clip")), F.greatest(s("deep_modification"), s("mesorch"), s("modification"))
    by_channel = F.when(F.col("overall") < 0.40, "authentic").when(ai >= tamper, "ai_generated").otherwise("tampered")
    return out.select("o_orderkey", F.when(F.col("missing") | top.isNull(), by_channel).otherwise(by_probability).alias("predicted"))


#: First score, name and status of the six bands that pages show.
PAGE_BANDS = [(0.85, "critical", "fail"), (0.65, "high", "fail"), (0.40, "raised", "fail"), (0.20, "moderate", "warning"), (0.10, "low", "pass"), (0.0, "very_low", "pass")]


def page_band(score: Column) -> Column:
    """Name and status of a score's band; missing, infinite and negative ones count as 0."""
    s = F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(F.greatest(score, F.lit(0.0)))
    return F.coalesce(*(F.when(s >= least, F.struct(F.lit(name).alias("band"), F.lit(status).alias("status"))) for least, name, status in PAGE_BANDS))


def page_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of customers, in ten thousands, by band: some are negative, some missing, some not numbers."""
    score = F.when(F.col("c_custkey") % 11 == 0, None).when(F.col("c_custkey") % 13 == 0, float("nan")).otherwise(F.col("c_acctbal") / 10000)
    return table(spark, sf_dir, "customer").select(page_band(score).alias("b")).groupBy("b.band", "b.status").agg(F.count("*").alias("n"))


#: Weather codes and what they mean.
WEATHER = [
    ([0], "Vedro"), ([1], "Pretežno vedro"), ([2], "Djelomično oblačno"), ([3], "Oblačno"), ([45, 48], "Magla"), ([51, 53, 55], "Sitna kiša"), ([56, 57], "Ledena sitna kiša"), ([61, 63, 65], "Kiša"), ([66, 67], "Ledena kiša"),
    ([71, 73, 75], "Snijeg"), ([77], "Snježna zrna"), ([80, 81, 82], "Pljusak"), ([85, 86], "Snježni pljusak"), ([95], "Grmljavina"), ([96, 99], "Grmljavina s tučom"),
]


def weather_text(code: Column) -> Column:
    return F.coalesce(*(F.when(code.isin(codes), F.lit(text)) for codes, text in WEATHER), F.concat(F.lit("WMO kod "), code.cast("string")))


def weather_key(latitude: Column, longitude: Column, at: Column) -> list[Column]:
    """What an observation is looked up by: both coordinates to four places, and the day."""
    return [F.format_string("%.4f", F.bround(latitude, 4)).alias("lat"), F.format_string("%.4f", F.bround(longitude, 4)).alias("lon"), F.to_date(at).alias("day")]


def claim_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the weather of their place and day: the observations are shipments (place by part, code and rain by quantity and tax).

    Several observations of a key are one, the first by order and line. A claim without one keeps nulls.
    """
    place = lambda k: ((k % 40) / 16.0 + 44, (k % 25) / 8.0 + 14)
    code = (F.col("l_quantity") * 2 - 1).cast("int")
    seen = table(spark, sf_dir, "lineitem").select(*weather_key(*place(F.col("l_partkey")), F.col("l_shipdate")), F.struct("l_orderkey", "l_linenumber", code.alias("code"), F.round(F.col("l_tax") * 20, 2).alias("rain")).alias("o"))
    seen = seen.groupBy("lat", "lon", "day").agg(F.min("o").alias("o"))
    claims = table(spark, sf_dir, "orders").select("o_orderkey", *weather_key(*place(F.col("o_custkey")), F.col("o_orderdate")))
    j = claims.join(seen, ["lat", "lon", "day"], "left")
    n = F.col("o.code")
    return j.select("o_orderkey", "lat", "lon", F.when(n.isNotNull(), weather_text(n)).alias("weather"), (F.col("o.rain") > 0.5).alias("rained"), n.between(96, 99).alias("hailed"))


#: Makers of phones and cameras.
CAMERA_MAKERS = ["apple", "samsung", "google", "huawei", "xiaomi", "oppo", "vivo", "oneplus", "sony", "canon", "nikon", "fujifilm", "panasonic", "olympus", "leica"]


def device_finding(tags: Column) -> Column:
    """Code and risk: no maker and model though there are over three tags, or a camera whose software edits (risk of .20 or more). Null for neither."""
    get = lambda name: F.trim(F.coalesce(F.try_element_at(tags, F.lit(name)), F.lit("")))
    make, model, software = get("Make"), get("Model"), F.lower(get("Software"))
    edits = F.coalesce(*(F.when(F.contains(software, F.lit(k)), True) for k, risk, _ in SOFTWARE if risk >= 0.20), F.lit(False))
    camera = F.coalesce(*(F.when(F.contains(F.lower(make), F.lit(m)), True) for m in CAMERA_MAKERS), F.lit(False))
    of = lambda code, risk: F.struct(F.lit(code).alias("code"), F.lit(risk).alias("risk"))
    bare = (make == "") & (model == "")
    return F.when(bare & (F.size(tags) > 3), of("META_DEVICE_STRIPPED", 0.30)).when(~bare & (make != "") & (software != "") & camera & edits, of("META_DEVICE_SOFTWARE_MISMATCH", 0.20))


def device_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files whose tags are words of their address and text: the host is the maker, the path the model, what the page names the software."""
    html = F.coalesce("html", F.lit(""))
    host = c.url_host(F.col("url"))
    tags = F.map_concat(
        F.create_map(F.lit("SourceFile"), F.col("url")),
        F.when(F.length(html) % 3 > 0, F.create_map(F.lit("Make"), F.concat(F.lit("Sony "), host), F.lit("Model"), F.lit("A7"))).otherwise(F.create_map(F.lit("W"), F.lit("1"), F.lit("H"), F.lit("2"))),
        F.when(F.length(html) % 2 == 0, F.create_map(F.lit("Software"), F.when(F.contains(html, F.lit("<p")), "Adobe Photoshop 25").otherwise("Snapseed"))).otherwise(F.create_map(F.lit("Date"), F.lit("x"))),
    )
    f = device_finding(tags)
    return table(spark, sf_dir, "pages").select("page_id", F.size(tags).alias("n_tags"), f.alias("f")).select("page_id", "n_tags", F.col("f.code").alias("code"), F.col("f.risk").alias("risk"))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, whole: a minimum with the row behind its order, which is combined before the shuffle."""
    rest = [x for x in df.columns if x not in (*keys, *order)]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("r"))
    return g.select(*keys, "r.*")


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user and kind the first event with all it has."""
    return first_of_each(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value", "props"), ["user_id", "event_type"], ["ts", "event_id"])


def audit_search(events: DataFrame, event_type=None, category=None, user_id=None, session_id=None, start=None, end=None, contains=None) -> DataFrame:
    """events (event_type, category, user_id, session_id, ts, path) by what is given and isn't empty; bounds are inclusive, a null path contains nothing."""
    for name, value in (("event_type", event_type), ("category", category), ("user_id", user_id), ("session_id", session_id)):
        if value not in (None, ""):
            events = events.where(F.col(name) == value)
    for bound, compare in ((start, F.col("ts").__ge__), (end, F.col("ts").__le__)):
        if bound is not None:
            events = events.where(compare(F.lit(bound).cast("timestamp_ntz")))
    return events if contains in (None, "") else events.where(F.coalesce(F.contains("path", F.lit(contains)), F.lit(False)))


SEARCHES = [
    {}, {"event_type": "click", "category": ""}, {"category": "even"}, {"user_id": 7}, {"session_id": "s3"}, {"start": "2024-01-05 00:00:00", "end": "2024-01-09 12:00:00"}, {"contains": "/click/1"},
    {"event_type": "view", "category": "odd", "session_id": "s1", "start": "2024-01-02 00:00:00", "end": "2024-02-09 00:00:00", "contains": "view"},
]


def audit_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each of some searches finds: all seven filters, alone and together."""
    path = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("/api/"), "event_type", F.lit("/"), (F.col("event_id") % 10).cast("string")))
    events = table(spark, sf_dir, "events").withColumns({"category": F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"), "session_id": F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")), "path": path})
    counts = [audit_search(events, **s).agg(F.lit(i).alias("search"), F.count("*").alias("n")) for i, s in enumerate(SEARCHES)]
    out = counts[0]
    for x in counts[1:]:
        out = out.union(x)
    return out



def training_row(report: Column) -> Column:
    """overall and modules (name to risk and findings) of a report in JSON, whose names are in snake or in camel case, module by module.

    Modules without a name are left out, of a repeated one the last stays; missing numbers are 0. Broken JSON has no modules and 0.
    """
    kind = "overall_risk_score double, overallRiskScore double, modules array<struct<module_name:string,moduleName:string,risk_score:double,riskScore:double,findings:array<struct<code:string,confidence:double,risk_score:double,riskScore:double>>>>"
    or_zero = lambda *cs: F.coalesce(*cs, F.lit(0.0))
    found = lambda f: F.struct(F.coalesce(f["code"], F.lit("")).alias("code"), or_zero(f["confidence"]).alias("confidence"), or_zero(f["risk_score"], f["riskScore"]).alias("risk_score"))
    none = F.array().cast("array<struct<code:string,confidence:double,risk_score:double>>")
    module = lambda m: F.struct(F.coalesce(m["module_name"], m["moduleName"], F.lit("")).alias("name"), or_zero(m["risk_score"], m["riskScore"]).alias("risk_score"), F.coalesce(F.transform(m["findings"], found), none).alias("findings"))
    empty = F.array().cast("array<struct<name:string,risk_score:double,findings:array<struct<code:string,confidence:double,risk_score:double>>>>")

    def last(modules: Column) -> Column:
        names = lambda ms: F.filter(ms, lambda m, i: ~F.array_contains(F.slice(ms["name"], i + 2, F.size(ms)), m["name"]))
        return F.transform(F.array(F.filter(F.transform(modules, module), lambda m: m["name"] != "")), names)[0]

    # One parse: the report is bound as the element of an array, where each use of it as a column would parse it again.
    row = lambda r: F.struct(or_zero(r["overall_risk_score"], r["overallRiskScore"]).alias("overall"), F.coalesce(last(r["modules"]), empty).alias("modules"))
    return F.transform(F.array(F.from_json(report, kind)), row)[0]


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of inspections as training rows: damages are modules, in camel case for every other inspection, and broken for some."""
    camel = F.col("l_orderkey") % 2 == 0
    key = lambda a, b: F.when(camel, F.lit(f'"{b}":')).otherwise(F.lit(f'"{a}":'))
    risk = F.round("l_discount", 2).cast("string")
    module = F.concat(F.lit("{"), key("module_name", "moduleName"), F.lit('"'), F.col("l_returnflag"), F.lit('",'), key("risk_score", "riskScore"), risk, F.lit(',"findings":[{"code":"x",'), key("risk_score", "riskScore"), risk, F.lit("}]}"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", module.alias("m")))), lambda x: x["m"]), ",").alias("ms"), F.round(F.max("l_tax"), 2).cast("string").alias("top"))
    report = F.concat(F.lit("{"), key("overall_risk_score", "overallRiskScore"), "top", F.lit(',"modules":['), "ms", F.lit("]"), F.when(F.col("l_orderkey") % 10 == 3, "").otherwise("}"))
    text = lambda m: F.concat(m["name"], F.lit("="), F.format_string("%.2f", m["risk_score"]), F.lit("/"), F.size(m["findings"]).cast("string"))
    shown = lambda r: F.struct(r["overall"].alias("overall"), F.size(r["modules"]).alias("n"), F.array_join(F.array_sort(F.transform(r["modules"], text)), ",").alias("modules"))
    rows = g.select("l_orderkey", F.transform(F.array(training_row(report)), shown)[0].alias("r"))
    return rows.select("l_orderkey", "r.overall", "r.n", "r.modules")


def half_floats(encoded: Column) -> Column:
    """The numbers of a base64 text of 16-bit floats, little endian; null for a text that isn't base64 or has half a number. No Python runs."""
    raw = F.hex(F.try_to_binary(encoded, F.lit("base64")))
    n = (F.length(raw) / 4).cast("int")
    bits = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.concat(F.substring(raw, i * 4 + 3, F.lit(2)), F.substring(raw, i * 4 + 1, F.lit(2))), 16, 10).cast("int"))

    def value(b: Column) -> Column:
        sign = F.when(F.shiftright(b, 15) == 1, -1.0).otherwise(1.0)
        exponent, fraction = F.shiftright(b, 10).bitwiseAND(F.lit(31)), b.bitwiseAND(F.lit(1023))
        large = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        return sign * F.when(exponent == 31, large).when(exponent == 0, fraction * 2.0**-24).otherwise((1 + fraction / 1024.0) * F.pow(F.lit(2.0), exponent - 15))

    return F.when((F.length(raw) % 4 == 0) & raw.isNotNull(), F.transform(bits, value))


def half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as files hold them, 16-bit floats in base64, read back: length, sum and largest number of each."""
    import numpy as np
    import pyarrow as pa

    def encode(batches):
        import base64

        for batch in batches:
            texts = [base64.b64encode(np.asarray(v, "<f2").tobytes()).decode() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["vec_id", "encoded"])

    held = table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce("embedding", F.array().cast("array<float>"))).mapInArrow(encode, "vec_id long, encoded string")
    rows = held.select("vec_id", half_floats(F.col("encoded")).alias("v"))
    return rows.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.array_max("v"), 6).alias("largest"))


QUERIES = {
    f.__name__: f
    for f in (gates_vs_baseline, metrics_overall, attention_inputs, class_by_probabilities, page_bands, claim_weather, device_findings, first_events, audit_searches, training_rows, half_precision)
}

_SCORE = lambda m: f"floor(least(1000, ((doc_id * {MODULES[m][0]} + {MODULES[m][1]}) % 1000) * 6 / 10 + CASE WHEN toxic = 1 THEN {10 * MODULES[m][2]} ELSE 0 END))::INT / 1000"
_LABELLED = f"SELECT doc_id, CASE WHEN toxic = 1 THEN 'ai_generated' WHEN quality = 0 THEN 'tampered' ELSE 'authentic' END AS truth, {', '.join(f'{_SCORE(m)} AS {m}' for m in MODULES)} FROM labels"
_Z = lambda m: f"coalesce({m}, 0)"
_S = ", ".join(f"{made_sql(m)} AS {m}" for m in MADE)
_KNOWN = [m for m in META_MODULES if m in MADE]
_POSITION = {m: 4 * META_MODULES.index(m) for m in _KNOWN}


def _condition(s: dict) -> str:
    parts = [f"{k} = '{v}'" if isinstance(v, str) else f"{k} = {v}" for k, v in s.items() if k in ("event_type", "category", "user_id", "session_id") and v != ""]
    parts += [f"ts {op} TIMESTAMP '{s[k]}'" for k, op in (("start", ">="), ("end", "<=")) if k in s] + [f"contains(path, '{s[k]}')" for k in ("contains",) if k in s]
    return " AND ".join(parts) or "true"


_WMO = " ".join(f"WHEN code IN ({', '.join(map(str, codes))}) THEN '{text}'" for codes, text in WEATHER)
_PLACE = lambda k: f"printf('%.4f', ({k} % 40) / 16 + 44) AS lat, printf('%.4f', ({k} % 25) / 8 + 14) AS lon"

ORACLES = {
    "gates_vs_baseline": f"""
        WITH l AS ({_LABELLED}), h AS (SELECT truth = 'ai_generated' AS y, clip, pixel FROM l WHERE doc_id > (SELECT max(doc_id) * 0.9 FROM l)),
        r AS (SELECT 'now' AS run, y, clip AS s, clip >= 0.40 AS p FROM h UNION ALL SELECT 'base', y, pixel, pixel >= 0.30 FROM h),
        m AS (SELECT run, round(count(*) FILTER (NOT y AND NOT p) / greatest(count(*) FILTER (NOT y), 1), 6) AS ro, round(count(*) FILTER (y AND p) / greatest(count(*) FILTER (y), 1), 6) AS ra,
                     round(count(*) FILTER (y = p) / greatest(count(*), 1), 6) AS acc, round(coalesce(avg(s) FILTER (y), 0) - coalesce(avg(s) FILTER (NOT y), 0), 6) AS mg FROM r GROUP BY run)
        SELECT a.ro AS recall_other, a.ra AS recall_ai, a.acc AS accuracy, a.mg AS margin, round(a.ro - b.ro, 6) AS recall_other_delta, round(a.ra - b.ra, 6) AS recall_ai_delta, round(a.acc - b.acc, 6) AS accuracy_delta, round(a.mg - b.mg, 6) AS margin_delta,
               concat_ws(',', CASE WHEN a.ro < 0.85 THEN 'authentic recall' END, CASE WHEN a.ra < 0.75 THEN 'AI recall' END, CASE WHEN a.mg < 0.20 THEN 'inversion' END) AS failed
        FROM (SELECT * FROM m WHERE run = 'now') a, (SELECT * FROM m WHERE run = 'base') b""",
    "metrics_overall": f"""
        WITH l AS (SELECT truth, CASE WHEN clip >= 0.55 THEN 'ai_generated' WHEN mesorch >= 0.45 THEN 'tampered' ELSE 'authentic' END AS guess FROM ({_LABELLED})),
        k AS (SELECT c, count(*) FILTER (truth = c AND guess = c) AS tp, count(*) FILTER (truth = c) AS t, count(*) FILTER (guess = c) AS g FROM l, (SELECT unnest(['authentic', 'ai_generated', 'tampered']) AS c) GROUP BY c),
        q AS (SELECT tp, t, tp / greatest(g, 1) AS p, tp / greatest(t, 1) AS r FROM k WHERE t + g > 0)
        SELECT sum(t)::BIGINT AS n, round(sum(tp) / greatest(sum(t), 1), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1 FROM q""",
    "attention_inputs": f"""
        WITH s AS (SELECT o_orderkey, {_S}, (o_orderkey % 17 = 0)::INT AS valid, (o_orderkey % 19 = 0)::INT AS tool, (o_orderkey % 13 = 0)::INT AS fn FROM orders),
        f AS (SELECT *, ({' + '.join(f'({m} IS NOT NULL)::INT' for m in _KNOWN)}) / 15 AS present, ({' + '.join(f'coalesce(({m} >= 0.5)::INT, 0)' for m in _KNOWN)}) / 15 AS high, ({' + '.join(f'coalesce(({m} < 0.15)::INT, 0)' for m in _KNOWN)}) / 15 AS low FROM s)
        SELECT o_orderkey, 66 AS n, valid::DOUBLE AS valid, tool::DOUBLE AS tool, fn::DOUBLE AS file_name, round(present, 6) AS present, round(high, 6) AS high, round(low, 6) AS low,
               round({' + '.join(f"{p + 1} * {_Z(m)} + {p + 2} * coalesce(0.5 + {m} / 2, 0) + {p + 3} * CASE WHEN {m} IS NULL THEN 0 ELSE least(floor({m} * 20), 10) / 10 END + {p + 4} * ({m} IS NOT NULL)::INT" for m, p in _POSITION.items())}
                     + 61 * valid + 62 * tool + 63 * fn + 64 * present + 65 * high + 66 * low, 4) AS weighted FROM f""",
    "class_by_probabilities": f"""
        WITH v AS ({rules.ORACLES["verdict_probabilities"]}), o AS ({rules.ORACLES["fuse_scores"]}),
        s AS (SELECT o_orderkey, {_S} FROM orders),
        c AS (SELECT o_orderkey, overall, p_authentic AS a, p_ai AS b, p_tampered AS t, greatest(coalesce(ai_generation, 0), coalesce(community, 0), coalesce(clip, 0)) AS ai,
                     greatest(coalesce(deep_modification, 0), coalesce(mesorch, 0), coalesce(modification, 0)) AS tm FROM v JOIN o USING (o_orderkey) JOIN s USING (o_orderkey))
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR a IS NULL THEN CASE WHEN overall < 0.40 THEN 'authentic' WHEN ai >= tm THEN 'ai_generated' ELSE 'tampered' END
                                WHEN a >= b AND a >= t THEN 'authentic' WHEN b >= t THEN 'ai_generated' ELSE 'tampered' END AS predicted FROM c""",
    "page_bands": """
        WITH s AS (SELECT CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 0 ELSE greatest(c_acctbal / 10000, 0) END AS s FROM customer)
        SELECT CASE WHEN s < 0.10 THEN 'very_low' WHEN s < 0.20 THEN 'low' WHEN s < 0.40 THEN 'moderate' WHEN s < 0.65 THEN 'raised' WHEN s < 0.85 THEN 'high' ELSE 'critical' END AS band,
               CASE WHEN s < 0.20 THEN 'pass' WHEN s < 0.40 THEN 'warning' ELSE 'fail' END AS status, count(*) AS n FROM s GROUP BY ALL""",
    "claim_weather": f"""
        WITH w AS (SELECT {_PLACE('l_partkey')}, l_shipdate::DATE AS day, (l_quantity * 2 - 1)::INT AS code, round(l_tax * 20, 2) AS rain, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY lat, lon, day ORDER BY l_orderkey, l_linenumber, code, rain) = 1),
        o AS (SELECT o_orderkey, {_PLACE('o_custkey')}, o_orderdate::DATE AS day FROM orders)
        SELECT o_orderkey, o.lat, o.lon, CASE WHEN code IS NULL THEN NULL {_WMO} ELSE 'WMO kod ' || code END AS weather, rain > 0.5 AS rained, code BETWEEN 96 AND 99 AS hailed FROM o LEFT JOIN w USING (lat, lon, day)""",
    "device_findings": """
        WITH p AS (SELECT page_id, length(coalesce(html, '')) AS n, contains(coalesce(html, ''), '<p') AS ps FROM pages)
        SELECT page_id, 4 AS n_tags, CASE WHEN n % 3 = 0 THEN 'META_DEVICE_STRIPPED' WHEN n % 2 = 0 AND ps THEN 'META_DEVICE_SOFTWARE_MISMATCH' END AS code,
               CASE WHEN n % 3 = 0 THEN 0.30 WHEN n % 2 = 0 AND ps THEN 0.20 END::DOUBLE AS risk FROM p""",
    "first_events": "SELECT user_id, event_type, ts, event_id, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "audit_searches": "WITH e AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, 's' || (user_id % 5) AS session_id, CASE WHEN event_id % 4 > 0 THEN '/api/' || event_type || '/' || (event_id % 10) END AS path FROM events) "
    + " UNION ALL ".join(f"SELECT {i} AS search, count(*) AS n FROM e WHERE {_condition(s)}" for i, s in enumerate(SEARCHES)),
    "training_rows": """
        WITH l AS (SELECT l_orderkey, l_returnflag, l_discount, l_tax, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC, round(l_discount, 2)::VARCHAR DESC) AS r FROM lineitem),
        g AS (SELECT l_orderkey, round(max(l_tax), 2) AS top, count(*) FILTER (r = 1)::INT AS n, string_agg(l_returnflag || '=' || printf('%.2f', round(l_discount, 2)) || '/1', ',' ORDER BY l_returnflag) FILTER (r = 1) AS ms FROM l GROUP BY 1)
        SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 3 THEN 0 ELSE top END AS overall, CASE WHEN l_orderkey % 10 = 3 THEN 0 ELSE n END AS n, CASE WHEN l_orderkey % 10 = 3 THEN '' ELSE ms END AS modules FROM g""",
}
