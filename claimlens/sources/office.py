"""Office packages: the graph of their parts, and what their sheets, texts and properties say.

A walker gives facts of each package as rows; the rules are expressions over counts of them. Targets of relationships are
resolved against the folder of their source; parts are reached from the package's own relationships, and others are orphans.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.sources.packages import walked

#: Extensions of parts that can be run.
EXECUTABLE = ["exe", "bat", "cmd", "com", "scr", "pif", "vbs", "js", "jse", "wsf", "wsh", "ps1", "psm1", "dll", "sys", "drv", "msi", "jar"]
FACTS = "kind string, source string, name string, detail string, flag boolean"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class _Facts:
    """kind, source, name, detail, flag: part (flag: reached), relation (flag: target is there), external, sheet (detail: state),
    change (name: ins or del; detail: deleted text), property, and broken (a part, or the package if the name is empty)."""

    def eval(self, content: bytes):
        try:
            package = zipfile.ZipFile(io.BytesIO(content or b""))
            names = package.namelist()
        except (zipfile.BadZipFile, ValueError):
            yield "broken", "", "", None, None
            return
        there = set(names)
        broken: list[str] = []

        def tree(name: str):
            if name not in there:
                return None
            try:
                return ElementTree.fromstring(package.read(name))
            except (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, OSError, NotImplementedError, RuntimeError, EOFError):
                broken.append(name)
                return None

        leads: dict[str, set[str]] = {}
        for name in sorted(there):
            folder, file = posixpath.split(name)
            if not file.endswith(".rels") or posixpath.basename(folder) != "_rels":
                continue
            base = posixpath.dirname(folder)
            source = posixpath.join(base, file.removesuffix(".rels")) if file != ".rels" else ""
            for r in tree(name) or ():
                if _local(r.tag) != "Relationship":
                    continue
                target, kind = r.get("Target", ""), r.get("Type", "").rsplit("/", 1)[-1]
                if r.get("TargetMode") == "External":
                    yield "external", source, target, kind, target.startswith("http")
                    continue
                path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(base, target))
                leads.setdefault(source, set()).add(path)
                yield "relation", source, path, kind, path in there

        reached, todo = set(), [""]
        while todo:
            new = {t for t in leads.get(todo.pop(), ()) if t in there} - reached
            reached |= new
            todo += new
        for name in sorted(there):
            if not name.endswith((".rels", "/")) and name != "[Content_Types].xml":
                yield "part", None, name, name.rsplit(".", 1)[-1].lower() if "." in name else "", name in reached

        for e in _all(tree("xl/workbook.xml"), "sheet"):
            yield "sheet", None, e.get("name", ""), e.get("state", "visible"), None
        for e in _all(tree("word/document.xml"), "ins", "del"):
            text = "".join(t.text or "" for t in _all(e, "delText")).strip()
            yield "change", None, _local(e.tag), text, None
        for part in ("docProps/core.xml", "docProps/app.xml"):
            for e in _all(tree(part), "creator", "lastModifiedBy", "Template", "TotalTime"):
                if e.text and e.text.strip():
                    yield "property", None, _local(e.tag), e.text.strip(), None
        yield "type", None, "docx" if any(n.startswith("word/") for n in there) else "xlsx" if any(n.startswith("xl/") for n in there) else "unknown", None, "[Content_Types].xml" in there
        for name in broken:
            yield "broken", None, name, None, None


def _all(root, *tags: str):
    return () if root is None else [e for e in root.iter() if _local(e.tag) in tags]


def package_facts(df: DataFrame, content: str = "content") -> DataFrame:
    """df without its content, a row per fact of each package."""
    return walked(df, _Facts, FACTS, content)


def package_findings(facts: DataFrame, key: str, *also: Column) -> DataFrame:
    """key, type, n_parts, n_dangling, n_external, n_orphans, findings (code and risk, in the order of the rules) and risk, the largest; also: more
    aggregates of the package's facts, by name."""
    is_ = lambda kind: F.col("kind") == kind
    n = lambda *cs: F.count_if(_and(*cs)).cast("int")
    prop = lambda p: F.max(F.when(is_("property") & (F.col("name") == p), F.col("detail")))
    docx, xlsx = (F.max(F.when(is_("type"), F.col("name"))) == t for t in ("docx", "xlsx"))
    g = facts.groupBy(key).agg(
        F.max(F.when(is_("type"), F.col("name"))).alias("type"), F.max(F.when(is_("type"), F.col("flag"))).alias("typed"), n(is_("part")).alias("n_parts"), n(is_("relation"), ~F.col("flag")).alias("n_dangling"),
        n(is_("external"), F.col("flag")).alias("n_external"), n(is_("part"), ~F.col("flag")).alias("n_orphans"), n(is_("part"), F.col("detail").isin(EXECUTABLE)).alias("run"),
        n(is_("part"), F.contains("name", F.lit("vbaProject.bin"))).alias("vba"), n(is_("sheet"), F.col("detail") == "veryHidden").alias("very"), n(is_("sheet"), F.col("detail") == "hidden").alias("hidden"),
        n(is_("change")).alias("changes"), n(is_("change"), F.col("name") == "del", F.col("detail") != "").alias("deleted"), *(prop(p).alias(p) for p in ("creator", "lastModifiedBy", "Template", "TotalTime")),
        *also,
    )
    some = lambda c: F.col(c) > 0
    rules = [
        ("OFFICE_MISSING_CONTENT_TYPES", ~F.col("typed"), F.lit(0.40)),
        ("OFFICE_DANGEROUS_EMBED", some("run"), F.lit(0.75)),
        ("OFFICE_VBA_PRESENT", some("vba"), F.lit(0.45)),
        ("OFFICE_VERY_HIDDEN_SHEET", (F.col("type") == "xlsx") & some("very"), F.lit(0.55)),
        ("OFFICE_HIDDEN_SHEET", (F.col("type") == "xlsx") & some("hidden"), F.lit(0.35)),
        ("OFFICE_META_AUTHOR_MISMATCH", F.col("creator") != F.col("lastModifiedBy"), F.lit(0.25)),
        ("OFFICE_META_CUSTOM_TEMPLATE", ~F.lower("Template").isin("normal.dotm", "normal"), F.lit(0.15)),
        ("OFFICE_META_ZERO_EDIT_TIME", (F.col("TotalTime") == "0") & F.col("lastModifiedBy").isNotNull(), F.lit(0.20)),
        ("OFFICE_TRACKED_CHANGES", (F.col("type") == "docx") & some("changes"), F.when(some("deleted"), 0.40).otherwise(0.20)),
        ("OFFICE_EXTERNAL_REFS", some("n_external"), F.lit(0.30)),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), r.alias("risk"))) for code, c, r in rules)))
    more = g.columns[len(g.columns) - len(also) :]
    g = g.withColumn("findings", found)
    return g.select(key, "type", "n_parts", "n_dangling", "n_external", "n_orphans", "findings", F.coalesce(F.array_max(F.transform("findings", lambda f: f["risk"])), F.lit(0.0)).alias("risk"), *more)


def _and(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def directory_of(content: Column) -> Column:
    """The central directory of a zip file, as text of one character a byte: found from the file's tail, no entry is read. Null without one."""
    tail = F.substring(content, -65557, 65557)
    text = F.decode(F.when(F.octet_length(content) > 65557, tail).otherwise(content), "ISO-8859-1")
    end = F.substring_index(text, "PK\x05\x06", -1)  # what follows the last end record's mark
    number = lambda at: F.conv(F.hex(F.encode(F.reverse(F.substring(end, at, 4)), "ISO-8859-1")), 16, 10).cast("long")
    held = F.instr(text, "PK\x05\x06") > 0
    size, start = number(9), number(13)
    return F.when(held, F.decode(content.substr((start + 1).cast("int"), size.cast("int")), "ISO-8859-1"))


def package_kind(content: Column) -> Column:
    """docx or xlsx by the names in the package's directory, if one of them is its list of types; null otherwise."""
    names = directory_of(content)
    has = lambda name: F.regexp_like(names, F.lit(r"(?s)PK\x01\x02.{42}" + re.escape(name)))
    return F.when(has("[Content_Types].xml"), F.when(has("word/"), "docx").when(has("xl/"), "xlsx"))
