"""Binary files: each document's text is put into a file without loss, and the file is read back by its structure.

What a file holds follows from the text: its lines become pictures, sheets, paragraphs or revisions. The SQL evaluates the same rules over the
text itself, so that a row is only right if walker and rule both are.
"""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.plans.metadata import SOFTWARE
from claimlens.sources import compound, office, packages, revisions
from claimlens.sources.tables import spread, table


def lines(text: str) -> list[tuple[int, bytes]]:
    """The number and bytes of each line that isn't empty."""
    return [(i, x.encode()) for i, x in enumerate(text.split("\n")) if x]


def pictures_of(doc_id: int, text: str) -> bytes:
    """A package with a picture per line: even ones are PNG files with the line as a text chunk, odd ones JPEG files with it as a comment."""
    parts = [("[Content_Types].xml", b"<Types/>"), ("word/document.xml", text.encode())]
    for i, line in lines(text):
        width, height = 50 + len(line) % 1000, 80 + 10 * (i % 9)
        parts.append((f"word/media/image{i:06d}.{'jpg' if i % 2 else 'png'}", packages.jpeg(width, height, line) if i % 2 else packages.png(width, height, [packages.chunk(b"tEXt", b"Comment\0" + line)])))
    return packages.packed(parts)


def embedded_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each package the ten largest pictures of 100 pixels and 500 bytes at least, by their headers."""
    files = packages.built(table(spark, sf_dir, "documents"), "doc_id", "text", pictures_of)
    return packages.largest_pictures(packages.pictures(files), "doc_id").select("doc_id", "name", "form", "width", "height", "n_bytes", "place")


def chunks_of(doc_id: int, text: str) -> bytes:
    """A PNG file with a text chunk per line: of the three kinds in turn, with a generator's keyword where the line has a digit, and a spoilt checksum where it has an @."""
    chunks = []
    for i, line in lines(text):
        keyword = b"parameters" if any(48 <= c < 58 for c in line) else b"Comment"
        kind, payload = [
            (b"tEXt", keyword + b"\0" + line),
            (b"zTXt", keyword + b"\0\0" + packages.zlib.compress(line)),
            (b"iTXt", keyword + b"\0\1\0en\0\0" + packages.zlib.compress(line)),
        ][i % 3]
        chunks.append(packages.chunk(kind, payload, broken=b"@" in line))
    return packages.png(len(text) % 5000 + 1, 1, chunks, b"x")


def png_text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text chunks of each picture: how many, their characters, those whose checksum is wrong, and findings by keyword and by words."""
    found = packages.text_chunks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", chunks_of)
    found = found.withColumn("finding", packages.generator_finding(F.col("keyword"), F.col("text")))
    count = lambda code: F.count_if(F.col("finding.code") == code).alias(code.lower())
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chars"), F.count_if(~F.col("intact")).alias("n_broken"), count("META_PNG_AI_PARAMS"), count("META_PNG_AI_VALUE"), F.max("finding.risk").alias("risk"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), "\n"), 256).alias("texts_sha256"),
    )


#: Agents of the made histories, by the number of the turn.
AGENTS = ["Adobe Photoshop 25.1", "Adobe Photoshop 25.1", "GIMP 2.10", "Midjourney v6"]


def xmp_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as histories of a picture: a turn is an event, the user's saves, and what a long text is about names the agent."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    action = F.when(F.col("role") == "user", "saved").otherwise("produced")
    length = F.length(F.coalesce("text", F.lit("")))
    agent = F.when(length > 40, F.element_at(F.array(*map(F.lit, AGENTS)), (length % len(AGENTS) + 1).cast("int")))
    event = F.concat(F.lit('<rdf:li stEvt:action="'), action, F.lit('"'), F.when(agent.isNotNull(), F.concat(F.lit(" stEvt:softwareAgent='"), agent, F.lit("'"))).otherwise(""), F.lit(' stEvt:changed="/"/>'))
    g = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))), lambda x: x["e"]), "\n").alias("events"), F.count("*").alias("n"))
    head = F.lit('<x:xmpmeta><rdf:Description xmp:CreatorTool="Adobe Photoshop 25.1">')
    packet = F.concat(head, F.when(F.col("n") > 2, F.concat(F.lit("<rdf:Seq>"), "events", F.lit("</rdf:Seq>"))).otherwise(""), F.lit("</rdf:Description></x:xmpmeta>"))
    rows = g.select("conv_id", packet.alias("packet"))
    finding = packages.history_finding(F.col("packet"), [k for k, _, _ in SOFTWARE])
    return rows.select("conv_id", F.size(packages.history_events(F.col("packet"))).alias("n_events"), finding.alias("f")).select("conv_id", "n_events", F.col("f.code").alias("code"), F.col("f.risk").alias("risk"))


_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>'
_TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def office_of(key: str, text: str) -> bytes:
    """A package of a text; key is source and language. German ones are workbooks with a sheet per line, others documents with a paragraph per line."""
    source, lang = key.split("|")
    rows = [line.decode() for _, line in lines(text)]
    digit = lambda s: any("0" <= c <= "9" for c in s)
    clean = lambda s: "".join(c if c >= " " else " " for c in s)
    relation = lambda i, kind, target, mode="": f'<Relationship Id="r{i}" Type="{_TYPE}{kind}" Target={quoteattr(target)}{mode}/>'
    workbook = lang == "de"
    main = "xl/workbook.xml" if workbook else "word/document.xml"
    folder, file = main.split("/")
    if workbook:
        sheets = "".join(f'<sheet name="s{i}"{" state=" + quoteattr(state) if (state := "veryHidden" if "@" in x else "hidden" if digit(x) else "") else ""}/>' for i, x in enumerate(rows))
        body = f'<workbook xmlns="m"><sheets>{sheets}</sheets></workbook>'
    else:
        seen: set[str] = set()
        paragraphs = []
        for x in rows:
            t = escape(clean(x))
            paragraphs.append(f"<w:del><w:delText>{t}</w:delText></w:del>" if x in seen else f"<w:ins><w:t>{t}</w:t></w:ins>" if digit(x) else f"<w:p><w:t>{t}</w:t></w:p>")
            seen.add(x)
        body = f'<w:document xmlns:w="w">{"".join(paragraphs)}</w:document>'
    relations = [relation(i, "hyperlink", f"http://host/{i}", ' TargetMode="External"') for i, x in enumerate(rows) if "@" in x]
    relations += [relation(f"m{i}", "image", f"media/{i}.png") for i, x in enumerate(rows) if len(x) % 10 == 0]
    parts = [("_rels/.rels", _RELS % (relation(0, "officeDocument", "/" + main) + relation(1, "core-properties", "docProps/core.xml"))), (main, body), (f"{folder}/_rels/{file}.rels", _RELS % "".join(relations))]
    parts += [(f"{folder}/media/{i}.png", "") for i, x in enumerate(rows) if len(x) % 20 == 0]
    parts.append(("docProps/core.xml", f'<p xmlns:dc="d" xmlns:cp="c"><dc:creator>{escape(source)}</dc:creator><cp:lastModifiedBy>{escape(source if len(rows) % 2 else lang)}</cp:lastModifiedBy></p>'))
    parts.append(("docProps/app.xml", f'<p xmlns="a"><Template>{"Normal.dotm" if ";" not in text else "report.dotx"}</Template><TotalTime>{len(rows) - 1}</TotalTime></p>'))
    if "#" in text:
        parts.append((f"{folder}/embeddings/tool.EXE", "MZ"))
    if "$" not in text:
        parts.insert(0, ("[Content_Types].xml", "<Types/>"))
    return packages.packed([(name, data.encode()) for name, data in parts])


def office_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph and findings of each document's package, and its kind by the names in the directory alone."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.concat_ws("|", "doc_id", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("key"), "text")
    files = packages.built(docs, "key", "text", lambda key, text: office_of(key.split("|", 1)[1], text))
    facts = office.package_facts(files.withColumn("kind_by_names", office.package_kind(F.col("content")))).withColumnRenamed("kind_by_names", "triage")
    triage = F.coalesce(F.max(F.when(F.col("kind") == "type", F.col("triage"))), F.lit("unknown")).alias("triage")
    out = office.package_findings(facts, "key", triage).where("type is not null")
    return out.select(F.split("key", "\\|")[0].cast("long").alias("doc_id"), "type", "triage", "n_parts", "n_dangling", "n_external", "n_orphans", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"), "risk")


def pdf_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document, an update per line: end marks, length of the chain of tables, whether it ends well, gaps of the marks, finding."""
    docs = spread(table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text"))
    build = lambda _, text: revisions.written([x for _, x in lines(text)] or [b""])
    found = revisions.revisions_and_marks(docs, "%%EOF", "text", build)
    is_ = lambda kind: F.col("kind") == kind
    gap = F.col("offset") - F.col("before")
    g = found.groupBy("doc_id").agg(
        F.count_if(is_("mark")).alias("n_eof"), F.count_if(is_("table")).alias("n_tables"), F.max_by("state", F.when(is_("table"), F.col("number"))).alias("state"), F.min(F.when(is_("table"), F.col("offset"))).alias("first_table"),
        F.min(F.when(is_("mark"), gap)).alias("least_gap"), F.max(F.when(is_("mark"), gap)).alias("largest_gap"),
    )
    f = revisions.update_finding(F.col("n_eof"))
    return g.where("n_eof > 0 and n_tables > 0").select("doc_id", "n_eof", "n_tables", "state", "first_table", "least_gap", "largest_gap", f["code"].alias("code"), f["risk"].alias("risk"))


def macros_of(_: int, text: str) -> bytes:
    """A compound file with a module per four lines: a line is a comment in a procedure, which runs by itself where the line has an @. Where the text has a #, the
    file's tables are cut off."""
    modules: dict[str, bytes] = {}
    for i, line in lines(text):
        name = "AutoOpen" if b"@" in line else f"Work{i}"
        modules.setdefault(f"Module{i // 4}", b"")
        modules[f"Module{i // 4}"] += f"Sub {name}()\r\n' ".encode() + line.replace(b"\r", b" ") + b"\r\nEnd Sub\r\n"
    file = compound.project(modules)
    return file[: -compound.SECTOR] if "#" in text else file


def macro_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules and findings of each document's macro container."""
    modules = compound.macro_modules(spread(table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text")), "text", macros_of)
    out = compound.macro_findings(modules, "doc_id", F.sum(F.octet_length(F.encode("code", "ISO-8859-1"))).alias("code_bytes"))
    return out.select("doc_id", "n_modules", "n_broken", F.coalesce("code_bytes", F.lit(0)).alias("code_bytes"), F.array_join("codes", ",").alias("codes"), "risk")


QUERIES = {f.__name__: f for f in (embedded_pictures, png_text_findings, xmp_history, office_packages, pdf_revisions, macro_containers)}

_LINES = "SELECT doc_id, i - 1 AS i, l[i] AS line, strlen(l[i]) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) WHERE l[i] <> ''"

_WORDS = " WHEN ".join(f"contains(lower(line), '{w}') THEN {r}" for w, _, r in packages.GENERATOR_WORDS)

ORACLES = {
    "embedded_pictures": f"""
        WITH p AS (SELECT doc_id, 'word/media/image' || lpad(i::VARCHAR, 6, '0') || CASE WHEN i % 2 = 1 THEN '.jpg' ELSE '.png' END AS name, CASE WHEN i % 2 = 1 THEN 'jpeg' ELSE 'png' END AS form,
                          (50 + n % 1000)::INT AS width, (80 + 10 * (i % 9))::INT AS height, CASE WHEN i % 2 = 1 THEN 17 + n + 4 * ((n + 65532) // 65533) ELSE 77 + n END::BIGINT AS n_bytes FROM ({_LINES}))
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_bytes DESC, name)::INT AS place FROM p WHERE width >= 100 AND height >= 100 AND n_bytes >= 500 QUALIFY place <= 10""",
    "png_text_findings": f"""
        WITH c AS (SELECT doc_id, i, line, regexp_matches(line, '[0-9]') AS keyed, CASE WHEN regexp_matches(line, '[0-9]') THEN 0.95 WHEN {_WORDS} END AS risk FROM ({_LINES}))
        SELECT doc_id, count(*) AS n_chunks, sum(length(line))::BIGINT AS chars, count(*) FILTER (contains(line, '@')) AS n_broken, count(*) FILTER (keyed) AS meta_png_ai_params,
               count(*) FILTER (NOT keyed AND risk IS NOT NULL) AS meta_png_ai_value, max(risk)::DOUBLE AS risk, sha256(string_agg(line, chr(10) ORDER BY i)) AS texts_sha256 FROM c GROUP BY 1""",
    "xmp_history": f"""
        WITH t AS (SELECT conv_id, role = 'user' AS saves, CASE WHEN length(coalesce(text, '')) > 40 THEN {AGENTS}[length(text) % {len(AGENTS)} + 1] END AS agent, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL),
        g AS (SELECT conv_id, n, count(*) FILTER (saves) AS saves, count(*) FILTER (agent LIKE 'Midjourney%') AS ai, count(*) FILTER (agent LIKE '%Photoshop%') AS ps FROM t GROUP BY ALL),
        f AS (SELECT conv_id, n, CASE WHEN n <= 2 THEN 's' WHEN ai > 0 THEN 'a' WHEN ps >= 3 THEN 'p' WHEN saves >= 5 THEN 'v' END AS k FROM g)
        SELECT conv_id, CASE WHEN n > 2 THEN n ELSE 0 END::INT AS n_events, CASE k WHEN 's' THEN 'META_XMP_HISTORY_STRIPPED' WHEN 'a' THEN 'META_XMP_AI_TOOL_HISTORY' WHEN 'p' THEN 'META_XMP_EDIT_HISTORY' WHEN 'v' THEN 'META_XMP_EDIT_HISTORY' END AS code,
               CASE k WHEN 's' THEN 0.15 WHEN 'a' THEN 0.50 WHEN 'p' THEN 0.20 WHEN 'v' THEN 0.15 END::DOUBLE AS risk FROM f""",
    "macro_containers": f"""
        WITH l AS (SELECT doc_id, i, n, line, contains(line, '@') OR regexp_matches(line, '(?i)\\b({'|'.join(compound.AUTO_RUN)})\\b') AS auto, regexp_matches(line, '(?i){'|'.join(compound.SUSPICIOUS)}') AS bad FROM ({_LINES})),
        g AS (SELECT doc_id, count(DISTINCT i // 4) AS modules, bool_or(auto) AS auto, bool_or(bad) AS bad, sum(n + 4 + CASE WHEN contains(line, '@') THEN 8 ELSE 4 + length(i::VARCHAR) END + 2 + 2 + 2 + 2 + 9) AS bytes FROM l GROUP BY 1)
        SELECT doc_id, CASE WHEN contains(text, '#') THEN 0 ELSE modules END AS n_modules, contains(text, '#')::BIGINT AS n_broken, CASE WHEN contains(text, '#') THEN 0 ELSE bytes END::BIGINT AS code_bytes,
               CASE WHEN contains(text, '#') THEN '' ELSE CASE WHEN auto THEN 'OFFICE_VBA_AUTOEXEC' ELSE 'OFFICE_VBA_PRESENT' END || CASE WHEN bad THEN ',OFFICE_VBA_SUSPICIOUS' ELSE '' END END AS codes,
               CASE WHEN contains(text, '#') THEN 0 WHEN auto THEN 0.70 WHEN bad THEN 0.60 ELSE 0.45 END::DOUBLE AS risk FROM documents JOIN g USING (doc_id)""",
    "office_packages": f"""
        WITH l AS (SELECT doc_id, i, line, length(line) AS n, regexp_matches(line, '[0-9]') AS digit, contains(line, '@') AS sign, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM ({_LINES})),
        g AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (sign) AS signs, count(*) FILTER (digit AND NOT sign) AS hidden, count(*) FILTER (again AND trim(line) <> '') AS dels, count(*) FILTER (again OR digit) AS changes,
                     count(*) FILTER (n % 10 = 0) AS tens, count(*) FILTER (n % 20 = 0) AS twenties FROM l GROUP BY 1),
        d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang = 'de' AS x, coalesce(lines, 0) AS lines, coalesce(signs, 0) AS signs, coalesce(hidden, 0) AS hidden, coalesce(dels, 0) AS dels,
                     coalesce(changes, 0) AS changes, coalesce(tens, 0) AS tens, coalesce(twenties, 0) AS twenties FROM documents LEFT JOIN g USING (doc_id)),
        f AS (SELECT *, [CASE WHEN contains(t, '$') THEN {{'c': 'OFFICE_MISSING_CONTENT_TYPES', 'r': 0.40}} END, CASE WHEN contains(t, '#') THEN {{'c': 'OFFICE_DANGEROUS_EMBED', 'r': 0.75}} END,
                         CASE WHEN x AND signs > 0 THEN {{'c': 'OFFICE_VERY_HIDDEN_SHEET', 'r': 0.55}} END, CASE WHEN x AND hidden > 0 THEN {{'c': 'OFFICE_HIDDEN_SHEET', 'r': 0.35}} END,
                         CASE WHEN lines % 2 = 0 AND source <> lang AND source <> '' AND lang <> '' THEN {{'c': 'OFFICE_META_AUTHOR_MISMATCH', 'r': 0.25}} END, CASE WHEN contains(t, ';') THEN {{'c': 'OFFICE_META_CUSTOM_TEMPLATE', 'r': 0.15}} END,
                         CASE WHEN lines = 1 AND source <> '' THEN {{'c': 'OFFICE_META_ZERO_EDIT_TIME', 'r': 0.20}} END, CASE WHEN NOT x AND changes > 0 THEN {{'c': 'OFFICE_TRACKED_CHANGES', 'r': CASE WHEN dels > 0 THEN 0.40 ELSE 0.20 END}} END,
                         CASE WHEN signs > 0 THEN {{'c': 'OFFICE_EXTERNAL_REFS', 'r': 0.30}} END] AS all_f FROM d)
        SELECT doc_id, CASE WHEN x THEN 'xlsx' ELSE 'docx' END AS type, CASE WHEN contains(t, '$') THEN 'unknown' WHEN x THEN 'xlsx' ELSE 'docx' END AS triage,
               (3 + twenties + contains(t, '#')::INT)::INT AS n_parts, (tens - twenties)::INT AS n_dangling, signs::INT AS n_external, (1 + contains(t, '#')::INT)::INT AS n_orphans,
               array_to_string([y.c for y in all_f if y IS NOT NULL], ',') AS codes, coalesce(list_max([y.r for y in all_f if y IS NOT NULL]), 0)::DOUBLE AS risk FROM f""",
}
