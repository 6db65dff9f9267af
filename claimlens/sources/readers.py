"""Readers of labelled rows, tables with columns to check, listings of files, and the text of office files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.columns import extension
from claimlens.sources.office import package_kind

MODULES = T.MapType(T.StringType(), T.StructType([T.StructField("risk_score", T.DoubleType()), T.StructField("risk_level", T.StringType()), T.StructField("n_findings", T.IntegerType()), T.StructField("error", T.StringType())]))

LABELLED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "filename", "created_at")]
    + [T.StructField("overall_risk_score", T.DoubleType()), T.StructField("overall_risk_level", T.StringType()), T.StructField("modules", MODULES)]
    + [T.StructField("verdict_probabilities", T.MapType(T.StringType(), T.DoubleType())), T.StructField("ground_truth", T.StringType())]
)

CLASSES = ["authentic", "ai_generated", "tampered"]


def labelled_rows(spark: SparkSession, path: str, legacy: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines file, and what was left out with its reason: broken lines and unknown labels. Blank lines don't count.

    legacy maps old labels to new ones, for instance manipulated to ai_generated.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*LABELLED, T.StructField("_broken", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    label = F.col("r.ground_truth")
    for old, new in (legacy or {}).items():
        label = F.when(label == old, new).otherwise(label)
    parsed = parsed.withColumn("label", label)
    reason = F.when(F.col("r._broken").isNotNull() | F.col("r").isNull(), "broken").when(F.col("label").isNull() | ~F.col("label").isin(CLASSES), "label")
    marked = parsed.withColumn("reason", reason)
    good = marked.where("reason is null").select(*(F.col(f"r.{f.name}") for f in LABELLED if f.name != "ground_truth"), F.col("label").alias("ground_truth"))
    return good, marked.where("reason is not null").select("value", "reason")


def tsv_rows(spark: SparkSession, path: str, columns: list[str], json_column: str) -> DataFrame:
    """Rows of a tab-separated file: those with fewer columns or broken JSON in json_column go; empty fields are null."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= len(columns))
    rows = rows.select(*(F.nullif(F.col("p")[i], F.lit("")).alias(c) for i, c in enumerate(columns)))
    return rows.where(F.col(json_column).isNull() | F.try_parse_json(json_column).isNotNull())


def label_map(spark: SparkSession, path: str, key: str = "filename") -> DataFrame:
    """A CSV of labels, one row per key: the last in the file wins; of several files, that in the last by name.

    Tasks take splits of files in any order, so a row's place is its file, where its split begins, and its number within the task.
    """
    df = spark.read.option("header", True).csv(path)
    rest = [c for c in df.columns if c != key]
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return df.withColumn("_n", order).groupBy(key).agg(F.max_by(F.struct(*rest), "_n").alias("r")).select(key, "r.*")


def listing(spark: SparkSession, path: str, suffixes: list[str], leave_out: list[str]) -> DataFrame:
    """Files under a folder with one of the suffixes, without those named: path, length and name; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(extension(F.col("name")).isin(suffixes) & ~F.col("name").isin(leave_out))


def admitted(files: DataFrame, most_files: int = 8, most_bytes: int = 20 << 20, kinds: list[str] | None = None) -> DataFrame:
    """files (case_id, name, length) with the first reason for which a file isn't taken, null if it is."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("case_id").orderBy("name"))
    kind = extension(F.col("name"))
    reason = F.when(F.col("_n") > most_files, "too many files").when(F.col("length") > most_bytes, "too large").when(~kind.isin(kinds or ["jpg", "jpeg", "png", "webp", "heic", "pdf", "docx", "xlsx"]), "type")
    return files.withColumn("_n", place).withColumn("reason", reason).drop("_n")


def triage(content, name):
    """Category of a file by its first bytes, else by its extension, else unknown; columns in, a column out.

    A zip file is an office package if the names in its directory say so, or else its extension; no entry is read.
    """
    head = F.hex(F.substring(content, 1, 12))
    ext = extension(name)
    office = F.when(package_kind(content).isNotNull() | ext.isin("docx", "xlsx"), "office").otherwise("archive")
    magic = (
        F.when(head.startswith("FFD8FF"), "image")
        .when(head.startswith("89504E470D0A1A0A"), "image")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image")
        .when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304"), office)
    )
    by_name = F.when(ext.isin("jpg", "jpeg", "png", "webp", "heic"), "image").when(ext == "pdf", "pdf").when(ext.isin("docx", "xlsx"), "office")
    return F.coalesce(magic, by_name, F.lit("unknown"))


_CELL = re.compile(r"\{[^}]*\}")


def _office(content: bytes) -> tuple[str, list[str]]:
    """Text of a docx or xlsx file, and findings of its structure."""
    text, findings = [], []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if "[Content_Types].xml" not in names:
                findings.append("no_content_types")
            findings += [f for f, on in (("macro", any(n.endswith("vbaProject.bin") for n in names)), ("executable", any(n.lower().endswith((".exe", ".dll", ".bat", ".ps1", ".vbs")) for n in names)), ("external_link", any("externalLinks/" in n for n in names))) if on]
            for n in sorted(names):
                if n == "word/document.xml" or n == "xl/sharedStrings.xml" or n == "xl/workbook.xml":
                    for e in ElementTree.fromstring(z.read(n)).iter():
                        tag = _CELL.sub("", e.tag)
                        if tag == "t" and e.text:
                            text.append(e.text)
                        elif tag == "p":
                            text.append("\n")
                        elif tag == "sheet" and e.get("state", "visible") != "visible":
                            findings.append("hidden_sheet")
                        elif tag in ("ins", "del"):
                            findings.append("tracked_change")
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, OSError):
        findings.append("unreadable")
    return " ".join(text).replace(" \n ", "\n").strip(), sorted(set(findings))


def office_text(files: DataFrame) -> DataFrame:
    """path, text and findings of the docx and xlsx files of a binaryFile frame; an unreadable file says so."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = [_office(c or b"") for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([f for _, f in out], pa.list_(pa.string()))], names=["path", "text", "findings"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, findings array<string>")


def pdf_counts(content) -> dict:
    """Counts of the PDF keywords that mark active content and revisions, as columns."""
    text = F.decode(content, "ISO-8859-1")
    count = lambda k: ((F.length(text) - F.length(F.replace(text, F.lit(k), F.lit("")))) / len(k)).cast("int")
    return {k.strip("/%").lower(): count(k) for k in ("/JS", "/JavaScript", "/OpenAction", "/AA", "/Launch", "/EmbeddedFile", "/URI", "/AcroForm", "%%EOF", "startxref")}


def not_yet_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done."""
    return rows.join(done.select(key), key, "left_anti")
