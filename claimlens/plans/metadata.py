"""Metadata rules over maps of tags, and the rules that turn modules and descriptions into labels, on values made from keys."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import dates
from claimlens.functions.columns import extension
from claimlens.plans.rules import made, made_sql
from claimlens.sources.tables import spread, table

#: Keywords of editing software and generators in tags, their risks and names; the first that a tag has counts.
SOFTWARE = [
    ("photoshop", 0.30, "Adobe Photoshop"), ("gimp", 0.25, "GIMP"), ("faceapp", 0.35, "FaceApp"), ("facetune", 0.35, "FaceTune"), ("snapseed", 0.15, "Snapseed"), ("lightroom", 0.10, "Adobe Lightroom"),
    ("affinity", 0.15, "Affinity Photo"), ("pixelmator", 0.15, "Pixelmator"), ("paint.net", 0.20, "Paint.NET"), ("canva", 0.20, "Canva"), ("remove.bg", 0.30, "Remove.bg"), ("dall-e", 0.95, "DALL-E"), ("dall·e", 0.95, "DALL-E"),
    ("dall e", 0.95, "DALL-E"), ("dalle", 0.95, "DALL-E"), ("midjourney", 0.95, "Midjourney"), ("stable diffusion", 0.95, "Stable Diffusion"), ("stable-diffusion", 0.95, "Stable Diffusion"),
    ("stablediffusion", 0.95, "Stable Diffusion"), ("comfyui", 0.95, "ComfyUI"), ("comfy ui", 0.95, "ComfyUI"), ("automatic1111", 0.95, "Automatic1111"), ("a1111", 0.95, "Automatic1111"), ("invoke ai", 0.95, "InvokeAI"),
    ("invokeai", 0.95, "InvokeAI"), ("novelai", 0.95, "NovelAI"), ("adobe firefly", 0.95, "Adobe Firefly"), ("firefly", 0.95, "Adobe Firefly"), ("runway", 0.85, "Runway ML"), ("flux.1", 0.95, "Flux.1"), ("flux1", 0.95, "Flux.1"),
    ("flux dev", 0.95, "Flux.1"), ("flux-dev", 0.95, "Flux.1"), ("flux schnell", 0.95, "Flux.1"), ("imagen", 0.90, "Google Imagen"), ("playground", 0.80, "PlaygroundAI"), ("playgroundai", 0.85, "PlaygroundAI"),
    ("leonardo.ai", 0.90, "Leonardo.ai"), ("leonardo ai", 0.90, "Leonardo.ai"), ("ideogram", 0.95, "Ideogram"), ("krea.ai", 0.85, "Krea.ai"), ("kandinsky", 0.95, "Kandinsky"), ("ernie-vilg", 0.95, "ERNIE-ViLG"),
    ("diffusers", 0.85, "HuggingFace Diffusers"), ("huggingface diffusers", 0.85, "HuggingFace Diffusers"), ("generative fill", 0.85, "Adobe Generative Fill"), ("generative expand", 0.85, "Adobe Generative Expand"),
    ("photoshop ai", 0.85, "Photoshop AI"),
]
SOFTWARE_TAGS = ["EXIF:Software", "EXIF:ProcessingSoftware", "XMP:CreatorTool", "XMP:Software", "IPTC:OriginatingProgram"]
#: Tools that edit existing PDF files, and their risks.
PDF_TOOLS = [
    ("ilovepdf", 0.55), ("smallpdf", 0.55), ("pdf24", 0.55), ("sejda", 0.55), ("docfly", 0.55), ("sodapdf", 0.50), ("pdfcandy", 0.50), ("pdf-xchange", 0.45), ("pdftk", 0.40), ("nitro", 0.40), ("qoppa", 0.40), ("foxit phantompdf", 0.35),
]
#: Content types that go with a file extension.
IMAGE_TYPES = {"jpg": ["image/jpeg"], "jpeg": ["image/jpeg"], "png": ["image/png"], "webp": ["image/webp"], "heic": ["image/heic", "image/heif"], "heif": ["image/heic", "image/heif"], "tiff": ["image/tiff"], "tif": ["image/tiff"], "bmp": ["image/bmp", "image/x-ms-bmp"]}
#: Parts of words that mark a description as one of an authentic, a manipulated or a generated picture, and of summaries that contradict a risk.
AUTHENTIC = ["autentičn", "konzistentn", "realistič", "plauzibil", "potvrđuje autentičnost", "ne pokazuje znakove", "fizički ispravne", "nema naznaka"]
MANIPULATED = ["manipulacij", "krivotvor", "montaž", "zamućen", "prebrisano", "zalijepljen", "kopiran", "splice"]
GENERATED = ["ai gener", "umjetn", "sintetič", "generirano", "stable diffusion", "midjourney", "dall-e"]
CONTRADICTIONS = ["autenticna", "autenticno", "autenticna fotografija", "nema sumnje", "nema manipulacije", "prava fotografija", "originalna", "slika je autenticna"]

#: Latin letters with marks and the letters that are left without them, by Unicode's decompositions; đ and ł have none and stay.
_MARKED = [(chr(c), d) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) != chr(c) and len(d) == 1]


def without_marks(text: Column) -> Column:
    """Text in lower case and trimmed, its Latin letters without diacritic marks, combining marks left out."""
    plain = F.translate(text, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))
    return F.lower(F.trim(F.regexp_replace(plain, "\\p{Mn}", "")))


def contains_any(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))


def dms_to_decimal(text: Column, ref: Column) -> Column:
    """Decimal degrees of [degrees, minutes, seconds], whose numbers may be fractions; negative for S and W, null for fewer than two numbers."""
    parts = F.filter(F.split(F.translate(F.trim(text, F.lit("[]() ")), ",", " "), " +"), lambda s: s != "")
    number = lambda s: F.try_divide(F.element_at(F.split(s, "/"), 1).try_cast("double"), F.when(F.contains(s, F.lit("/")), F.try_element_at(F.split(s, "/"), F.lit(2)).try_cast("double")).otherwise(1.0))
    n = F.transform(parts, number)
    value = n[0] + n[1] / 60 + F.when(F.size(n) > 2, F.try_element_at(n, F.lit(3))).otherwise(0.0) / 3600
    return F.when(F.size(n) >= 2, F.when(F.upper(F.trim(ref)).isin("S", "W"), -value).otherwise(value))


def software_findings(tags: Column) -> Column:
    """Name and risk of the software in a map of tags: the first keyword of each tag; a name that came before doesn't count again."""
    known = F.array(*(F.struct(F.lit(r).alias("risk"), F.lit(n).alias("name")) for _, r, n in SOFTWARE))
    # A tag is put in lower case once, and no structs are made of keywords that it lacks.
    first = lambda t: F.coalesce(*(F.when(F.contains(t, F.lit(k)), F.lit(i)) for i, (k, _, _) in enumerate(SOFTWARE, 1)))
    values = F.array_compact(F.array(*(F.lower(F.try_element_at(tags, F.lit(t))) for t in SOFTWARE_TAGS)))
    hits = F.transform(F.array_compact(F.transform(values, first)), lambda i: F.element_at(known, i))
    once = lambda found: F.filter(found, lambda h, i: F.array_position(found["name"], h["name"]) == i + 1)
    return F.transform(F.array(hits), once)[0]


def pdf_metadata_findings(created: Column, modified: Column, producer: Column, creator: Column) -> Column:
    """Codes of a file's gap between creation and change (over 7 or 90 days) and of the first editing tool in producer or creator."""
    hours = (F.unix_micros(modified) - F.unix_micros(created)) / 3.6e9
    gap = F.when(hours > 2160, "date_gap_large").when(hours > 168, "date_gap")
    tools = F.array(*(F.lit(k) for k, _ in PDF_TOOLS))
    tool = lambda c: F.try_element_at(F.filter(tools, lambda k: F.contains(F.lower(c), k)), F.lit(1))
    return F.array_compact(F.array(gap, F.concat(F.lit("tool:"), F.coalesce(tool(producer), tool(creator)))))


def mime_mismatch(name: Column, content_type: Column) -> Column:
    """Whether a known image extension goes with another content type."""
    allowed = F.coalesce(*(F.when(extension(name) == e, F.array(*map(F.lit, ts))) for e, ts in IMAGE_TYPES.items()))
    return F.coalesce(~F.array_contains(allowed, content_type), F.lit(False))


def finding_category(description: Column, cause: Column, top_module: Column) -> Column:
    """Category by words of the description; else, for a metadata anomaly, by the highest module; else the cause."""
    d = F.lower(F.coalesce(description, F.lit("")))
    authentic, manipulated, generated = (contains_any(d, w) for w in (AUTHENTIC, MANIPULATED, GENERATED))
    by_words = F.when(authentic & ~manipulated & ~generated, "authentic").when(manipulated, "digital manipulation").when(generated, "AI generation")
    return F.coalesce(by_words, F.when((cause == "metadata anomaly") & top_module.isNotNull(), top_module), cause)


def safety_net(summary: Column, cause: Column, safety: Column, severity: Column, risk: Column) -> Column:
    """Summary, cause, safety and severity after the last checks of a risky case: nothing may contradict its risk."""
    critical = risk >= 0.75
    strict = F.when(critical, "Critical").when(risk >= 0.65, "Severe").otherwise("Moderate")
    new_safety = F.when(critical, "Critical").otherwise("Warning")
    safe = F.lower(safety) == "safe"
    claims = without_marks(F.coalesce(cause, F.lit(""))).isin("autenticno", "autenticna", "authentic", "autenticni")
    return F.struct(
        F.when(contains_any(without_marks(F.coalesce(summary, F.lit(""))), CONTRADICTIONS), "overridden").otherwise(summary).alias("summary"),
        F.when(claims, "forensic category").otherwise(cause).alias("cause"),
        F.when(safe | claims, new_safety).otherwise(safety).alias("safety"),
        F.when(claims | (safe & (F.lower(severity) == "minor")), strict).otherwise(severity).alias("severity"),
    )


def provenance_of(findings: Column) -> Column:
    """Status and issuer that the last provenance finding leaves, and the generator that the first finding with one names with its per cent.

    findings: an array of (module, code, issuer, generator, confidence).
    """
    states = {"META_C2PA_VALID": "valid", "META_C2PA_AI_GENERATED": "ai_generated", "META_C2PA_INVALID_SIGNATURE": "invalid"}
    of = lambda m: F.filter(findings, lambda f: f["module"] == m)
    status = F.try_element_at(F.filter(of("metadata"), lambda f: f["code"].isin(*states)), F.lit(-1))["code"]
    issuer = F.try_element_at(F.filter(of("metadata"), lambda f: f["code"].isin("META_C2PA_VALID", "META_C2PA_AI_GENERATED")), F.lit(-1))["issuer"]
    source = F.try_element_at(F.filter(of("ai_generation"), lambda f: F.coalesce(f["generator"] != "", F.lit(False))), F.lit(1))
    return F.struct(
        F.coalesce(*(F.when(status == c, F.lit(s)) for c, s in states.items()), F.lit("not_found")).alias("status"),
        issuer.alias("issuer"),
        source["generator"].alias("source"),
        F.coalesce(F.bround(source["confidence"] * 100, 0).cast("int"), F.lit(0)).alias("percent"),
    )


def _pick(values: list, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def editing_software(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tags = F.create_map(F.lit("EXIF:Software"), _pick(["Adobe Photoshop 24", "GIMP 2.10", "Canon EOS"], k), F.lit("XMP:CreatorTool"), _pick(["Midjourney v6", "adobe photoshop"], k), F.lit("XMP:Software"), _pick(["x", "FLUX.1 dev", "Lightroom", "PlaygroundAI"], k))
    # Keys are few bytes and much work each: they are dealt out, where a small file would be one task.
    rows = spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", software_findings(tags).alias("f"))
    out = F.transform(F.array("f"), lambda f: F.struct(F.array_join(f["name"], ",").alias("names"), F.round(F.aggregate(f, F.lit(0.0), lambda a, x: a + x["risk"]), 2).alias("risk")))[0]
    return rows.select("p_partkey", out.alias("o")).select("p_partkey", "o.names", "o.risk")


def pdf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    modified = F.concat(F.lit("D:2024"), _pick(["0103", "0120", "0901", "xx"], k), F.lit("000000Z"))
    found = pdf_metadata_findings(dates.pdf_date(F.lit("D:20240102000000")), dates.pdf_date(modified), _pick(["iLovePDF", "Word", ""], k), _pick(["Nitro Pro", "Chrome"], k))
    return table(spark, sf_dir, "part").select(F.array_join(found, ",").alias("findings")).groupBy("findings").agg(F.count("*").alias("n"))


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name, kind = F.concat(F.lit("f."), _pick(["JPG", "png", "heic", "pdf"], k)), _pick(["image/jpeg", "image/png", "image/heif"], k)
    return table(spark, sf_dir, "part").select(name.alias("name"), kind.alias("type")).groupBy("name", "type", mime_mismatch(F.col("name"), F.col("type")).alias("mismatch")).agg(F.count("*").alias("n"))


def gps_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.format_string("[%d, %d/2, 36]", k % 90, k % 60)).when(k % 4 == 1, F.format_string("(%d %d)", k % 90, k % 60)).when(k % 4 == 2, F.format_string("[%d]", k % 90)).otherwise(F.format_string("[%d, 5/0, 1]", k % 90))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(dms_to_decimal(text, _pick(["N", " s ", "W"], k)), 8).alias("degrees"))


def finding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    description = _pick(["Slika je AUTENTIČNA", "Vidljiva manipulacija, inače autentično", "Umjetno lice", "bez opisa", None], k)
    top = F.when(made("clip", k) >= 0.40, "AI generation")
    rows = table(spark, sf_dir, "orders").select(finding_category(description, _pick(["metadata anomaly", "other"], k), top).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def safety_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    net = safety_net(_pick(["Slika je autentična", "Nema sumnje", "Oštećenje"], k), _pick(["Autentično ", "ogrebotina"], k), _pick(["Safe", "Warning", "Critical", "safe", "Warning"], k), _pick(["Minor", "Severe"], k / 2), (k % 10) / 10.0)
    rows = table(spark, sf_dir, "orders").select(net.alias("n"))
    return rows.groupBy("n.summary", "n.cause", "n.safety", "n.severity").agg(F.count("*").alias("n"))


def provenance_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    finding = lambda m, code, issuer, gen, conf: F.struct(F.lit(m).alias("module"), code.alias("code"), issuer.alias("issuer"), gen.alias("generator"), conf.alias("confidence"))
    none = F.lit(None).cast("string")
    codes = ["META_C2PA_VALID", "META_C2PA_AI_GENERATED", "META_C2PA_INVALID_SIGNATURE", "META_GPS"]
    found = F.array(
        finding("metadata", _pick(codes, k), F.lit("first"), none, F.lit(None).cast("double")), finding("metadata", _pick(codes[::-1], k % 3), F.lit("second"), none, F.lit(None).cast("double")),
        finding("ai_generation", F.lit("AI"), none, _pick([None, "flux"], k), (k % 8) / 8.0), finding("ai_generation", F.lit("AI"), none, _pick(["sdxl", None, None], k), F.lit(0.5)),
    )
    rows = table(spark, sf_dir, "orders").select(provenance_of(found).alias("p"))
    return rows.groupBy("p.status", "p.issuer", "p.source", "p.percent").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (editing_software, pdf_metadata, file_types, gps_decimals, finding_labels, safety_nets, provenance_sources)}

ORACLES = {
    "editing_software": """
        WITH t AS (SELECT p_partkey, [['Adobe Photoshop', 'GIMP', NULL][p_partkey % 3 + 1], ['Midjourney', 'Adobe Photoshop'][p_partkey % 2 + 1], [NULL, 'Flux.1', 'Adobe Lightroom', 'PlaygroundAI'][p_partkey % 4 + 1]] AS a FROM part),
        f AS (SELECT p_partkey, list_filter(a, lambda x, i: x IS NOT NULL AND list_position(a, x) = i) AS a FROM t)
        SELECT p_partkey, array_to_string(a, ',') AS names, round(coalesce(list_sum(list_transform(a, lambda x: CASE x WHEN 'Adobe Photoshop' THEN 0.30 WHEN 'GIMP' THEN 0.25 WHEN 'Midjourney' THEN 0.95 WHEN 'Flux.1' THEN 0.95 WHEN 'Adobe Lightroom' THEN 0.10 ELSE 0.80 END)), 0), 2)::DOUBLE AS risk FROM f""",
    "pdf_metadata": """
        SELECT concat_ws(',', [NULL, 'date_gap', 'date_gap_large', NULL][p_partkey % 4 + 1], CASE WHEN p_partkey % 3 = 0 THEN 'tool:ilovepdf' WHEN p_partkey % 2 = 0 THEN 'tool:nitro' END) AS findings, count(*) AS n FROM part GROUP BY 1""",
    "file_types": """
        WITH f AS (SELECT ['JPG', 'png', 'heic', 'pdf'][p_partkey % 4 + 1] AS e, ['jpeg', 'png', 'heif'][p_partkey % 3 + 1] AS t FROM part)
        SELECT 'f.' || e AS name, 'image/' || t AS type, e <> 'pdf' AND NOT ((e = 'JPG' AND t = 'jpeg') OR (e = 'png' AND t = 'png') OR (e = 'heic' AND t = 'heif')) AS mismatch, count(*) AS n FROM f GROUP BY 1, 2, 3""",
    "gps_decimals": """
        WITH d AS (SELECT c_custkey, c_custkey % 90 AS d, c_custkey % 60 AS m, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE -1 END AS s FROM customer)
        SELECT c_custkey, round(CASE c_custkey % 4 WHEN 0 THEN s * (d + m / 2 / 60 + 36 / 3600) WHEN 1 THEN s * (d + m / 60) END, 8) AS degrees FROM d""",
    "finding_labels": f"""
        WITH o AS (SELECT *, {made_sql('clip')} AS clip FROM orders)
        SELECT CASE o_orderkey % 5 WHEN 0 THEN 'authentic' WHEN 1 THEN 'digital manipulation' WHEN 2 THEN 'AI generation' ELSE CASE WHEN o_orderkey % 2 = 1 THEN 'other' WHEN clip >= 0.40 THEN 'AI generation' ELSE 'metadata anomaly' END END AS category, count(*) AS n FROM o GROUP BY 1""",
    "safety_nets": """
        WITH c AS (SELECT ['Slika je autentična', 'Nema sumnje', 'Oštećenje'][o_orderkey % 3 + 1] AS su, o_orderkey % 2 = 0 AS claims, ['Safe', 'Warning', 'Critical', 'safe', 'Warning'][o_orderkey % 5 + 1] AS sa, (o_orderkey // 2) % 2 = 0 AS minor, o_orderkey % 10 AS r, o_orderkey % 3 AS s3 FROM orders)
        SELECT CASE WHEN s3 < 2 THEN 'overridden' ELSE su END AS summary, CASE WHEN claims THEN 'forensic category' ELSE 'ogrebotina' END AS cause,
               CASE WHEN claims OR lower(sa) = 'safe' THEN CASE WHEN r >= 8 THEN 'Critical' ELSE 'Warning' END ELSE sa END AS safety,
               CASE WHEN claims OR (lower(sa) = 'safe' AND minor) THEN CASE WHEN r >= 8 THEN 'Critical' WHEN r >= 7 THEN 'Severe' ELSE 'Moderate' END WHEN minor THEN 'Minor' ELSE 'Severe' END AS severity, count(*) AS n FROM c GROUP BY 1, 2, 3, 4""",
    "provenance_sources": """
        WITH k AS (SELECT o_orderkey AS k, ['valid', 'ai_generated', 'invalid', NULL][o_orderkey % 4 + 1] AS a, [NULL, 'invalid', 'ai_generated'][o_orderkey % 3 + 1] AS b FROM orders)
        SELECT coalesce(b, a, 'not_found') AS status, CASE WHEN b = 'ai_generated' THEN 'second' WHEN a IN ('valid', 'ai_generated') THEN 'first' END AS issuer,
               CASE WHEN k % 2 = 1 THEN 'flux' WHEN k % 3 = 0 THEN 'sdxl' END AS source, CASE WHEN k % 2 = 1 THEN round_even((k % 8) / 8 * 100, 0) WHEN k % 3 = 0 THEN 50 ELSE 0 END::INT AS percent, count(*) AS n FROM k GROUP BY 1, 2, 3, 4""",
}
