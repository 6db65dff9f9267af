"""Walkers of packages, pictures, histories and revisions: broken files, loops, and revisions against a plain reading of the bytes."""

import io
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from claimlens.plans import files
from claimlens.plans.metadata import SOFTWARE
from claimlens.sources import office, packages, readers, revisions
from claimlens.sources.tables import table

SF = "/root/testdata/sf0.001"


def frame(spark, contents):
    return spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "i int, content binary")


def test_picture_sizes():
    assert packages.picture_size(packages.png(640, 480, [])) == ("png", 640, 480)
    assert packages.picture_size(packages.jpeg(300, 200, b"x" * 70_000)) == ("jpeg", 300, 200)
    for head in (b"", b"\xff\xd8", b"\xff\xd8\xff\xe0\x00\x04ab\xff", packages.PNG, b"GIF89a", b"\xff\xd8" + b"\xff" * 50, b"\xff\xd8\xff\xd0\xff\xc2\x00\x0b\x08\x00\x05\x00\x07\x01"):
        assert packages.picture_size(head) in (None, ("jpeg", 7, 5))


def test_pictures_of_broken_packages(spark):
    good = packages.packed([("a.png", packages.png(200, 100, [], b"x" * 600)), ("b.txt", b"no picture"), ("c.jpg", packages.jpeg(120, 130, b"y" * 600)), ("d.png", packages.png(99, 500, [], b"z" * 900)), ("e.png", packages.png(100, 100, []))])
    spoilt = bytearray(good)
    at = good.index(b"a.png") + 5
    spoilt[at + 3 : at + 12] = b"\xff" * 9  # the first entry's data
    df = frame(spark, [good, spoilt, good[:-30], b"", None, b"PK\x03\x04"])
    found = packages.pictures(df)
    rows = {(r.i, r.name): (r.form, r.width, r.height) for r in found.collect()}
    assert {k[1]: v for k, v in rows.items() if k[0] == 0} == {"a.png": ("png", 200, 100), "c.jpg": ("jpeg", 120, 130), "d.png": ("png", 99, 500), "e.png": ("png", 100, 100)}
    assert rows[1, "a.png"][0] == "broken" and rows[1, "c.jpg"] == ("jpeg", 120, 130)
    assert {k[0] for k in rows} == {0, 1}
    assert [(r.i, r.name, r.place) for r in packages.largest_pictures(found.where("i = 0"), "i", most=1).collect()] == [(0, "a.png", 1)]


def test_png_chunks(spark):
    c = packages.chunk
    whole = packages.png(1, 1, [c(b"tEXt", b"Software\0made by ComfyUI"), c(b"zTXt", b"Dream\0\0" + zlib.compress("é".encode())), c(b"iTXt", b"Comment\0\0\0\0\0plain"), c(b"iTXt", b"prompt\0\1\0de\0\0" + zlib.compress(b"packed")), c(b"tEXt", b"no cut"), c(b"zTXt", b"k\0\0broken"), c(b"tEXt", b"a\0b", broken=True)])
    df = frame(spark, [whole, whole[:-1], packages.PNG + b"\0\0\0\xff", b"", None, packages.packed([("x/p.png", whole), ("t.txt", b"")])])
    found = packages.text_chunks(df).withColumn("f", packages.generator_finding(F.col("keyword"), F.col("text")))
    rows = sorted((r.i, r.picture, r.number, r.keyword, r.text, r.intact, r.f and (r.f.code, r.f.generator)) for r in found.where("i in (0, 1, 2, 3, 4)").collect())
    mine = [
        (0, "", 1, "Software", "made by ComfyUI", True, ("META_PNG_AI_VALUE", "ComfyUI")), (0, "", 2, "Dream", "é", True, ("META_PNG_AI_PARAMS", "InvokeAI")), (0, "", 3, "Comment", "plain", True, None),
        (0, "", 4, "prompt", "packed", True, ("META_PNG_AI_PARAMS", "ComfyUI / SD")), (0, "", 5, None, None, True, None), (0, "", 6, None, None, True, None), (0, "", 7, "a", "b", False, None),
    ]
    key = lambda r: r[:3]
    assert sorted((r for r in rows if r[0] == 0), key=key) == mine
    assert [r[1:] for r in sorted((r for r in rows if r[0] == 1), key=key)] == [r[1:] for r in mine] and {r[0] for r in rows} == {0, 1}
    assert {(r.picture, r.number) for r in found.where("i = 5").collect()} == {("x/p.png", k) for k in range(1, 8)}


def item(action=None, agent=None):
    return "<rdf:li" + (f' stEvt:action="{action}"' if action else "") + (f" stEvt:softwareAgent='{agent}'" if agent else "") + ' stEvt:when="x"/>'


@pytest.mark.parametrize(
    "packet, code, risk",
    [
        (None, None, None),
        ('<a xmp:CreatorTool="Adobe Photoshop"/>', "META_XMP_HISTORY_STRIPPED", 0.15),
        ("<xmp:CreatorTool>Snapseed 2.0</xmp:CreatorTool>", None, None),
        (item("saved", "Midjourney") + item("saved"), "META_XMP_AI_TOOL_HISTORY", 0.50),
        (item(None, "Midjourney"), None, None),  # agents without any action
        (item("saved", "Adobe Photoshop 22") * 3, "META_XMP_EDIT_HISTORY", 0.20),
        (item("saved", "Adobe Photoshop 22") * 2 + item("Converted") * 3, "META_XMP_EDIT_HISTORY", 0.15),
        (item("saved") * 4 + item("produced") * 4, None, None),
    ],
)
def test_history(spark, packet, code, risk):
    df = spark.createDataFrame([(packet,)], "p string")
    f = df.select(packages.history_finding(F.col("p"), [k for k, _, _ in SOFTWARE]).alias("f")).first().f
    assert (f and (f.code, f.risk)) == (code and (code, risk))


def test_office_graph_and_findings(spark):
    rel = '<Relationships xmlns="r"><Relationship Id="1" Type="t/officeDocument" Target="%s"/><Relationship Id="2" Type="t/x" Target="http://h/" TargetMode="External"/><Relationship Id="3" Type="t/y" Target="file:///c" TargetMode="External"/></Relationships>'
    inner = '<Relationships xmlns="r"><Relationship Id="1" Type="t/image" Target="../word/media/a.png"/><Relationship Id="2" Type="t/image" Target="media/gone.png"/><Relationship Id="3" Type="t/back" Target="/word/document.xml"/></Relationships>'
    parts = {"[Content_Types].xml": "<T/>", "_rels/.rels": rel % "word/document.xml", "word/document.xml": "<w><ins/><del><delText> x </delText></del></w>", "word/_rels/document.xml.rels": inner, "word/media/a.png": "", "word/run.VBS": "", "word/vbaProject.bin": "", "docProps/app.xml": "<broken"}
    df = frame(spark, [packages.packed([(k, v.encode()) for k, v in parts.items()]), packages.packed([("xl/workbook.xml", b"<w><sheets><sheet name='a' state='veryHidden'/><sheet/></sheets></w>")]), b"no zip", None])
    facts = office.package_facts(df)
    relations = {(r.source, r.name, r.flag) for r in facts.where("i = 0 and kind = 'relation'").collect()}
    assert relations == {("", "word/document.xml", True), ("word/document.xml", "word/media/a.png", True), ("word/document.xml", "word/media/gone.png", False), ("word/document.xml", "word/document.xml", True)}
    got = {r.i: r for r in office.package_findings(facts, "i").collect()}
    first = got[0]
    assert (first.type, first.n_parts, first.n_dangling, first.n_external, first.n_orphans, first.risk) == ("docx", 5, 1, 1, 3, 0.75)
    assert [f.code for f in first.findings] == ["OFFICE_DANGEROUS_EMBED", "OFFICE_VBA_PRESENT", "OFFICE_TRACKED_CHANGES", "OFFICE_EXTERNAL_REFS"] and first.findings[2].risk == 0.40
    assert [f.code for f in got[1].findings] == ["OFFICE_MISSING_CONTENT_TYPES", "OFFICE_VERY_HIDDEN_SHEET"]
    assert got[2].type is None and got[2].findings == [] and [r.name for r in facts.where("i = 0 and kind = 'broken'").collect()] == ["docProps/app.xml"]


def test_triage_by_the_directory(spark):
    big = packages.packed([("[Content_Types].xml", b"x"), ("word/document.xml", bytes(range(256)) * 1000)])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("notes/word/x", "[Content_Types].xml word/ PK")  # names inside contents and deeper folders don't count
    df = frame(spark, [big, packages.packed([("xl/w", b""), ("[Content_Types].xml", b"")]), out.getvalue(), packages.packed([("word/x", b"")]), b"PK\x03\x04", None])
    assert [r[0] for r in df.select(office.package_kind(F.col("content"))).collect()] == ["docx", "xlsx", None, None, None, None]
    names = df.select(readers.triage(F.col("content"), F.concat(F.lit("f"), "i", F.when(F.col("i") == 3, ".docx").otherwise(".bin"))).alias("t"))
    assert [r.t for r in names.collect()] == ["office", "office", "archive", "office", "archive", "unknown"]


def test_revision_chains(spark):
    good = revisions.written([b"o" * 100, b"two", b"three"])
    starts = [int(m[1]) for m in re.finditer(rb"startxref\n(\d+)", good)]
    loop = good.replace(b"/Prev %d" % starts[0], b"/Prev %d" % starts[2])
    outside = good.replace(b"/Prev %d" % starts[0], b"/Prev 999")
    lost = good.replace(b"startxref\n%d\n%%%%EOF\n" % starts[2], b"startxref\n%d\n%%%%EOF\n" % (starts[2] + 1))
    df = frame(spark, [good, loop, outside, lost, b"startxref", b"%PDF", None])
    rows: dict = {}
    for r in revisions.revisions(df).orderBy("i", "number").collect():
        rows.setdefault(r.i, []).append((r.xref, r.state))
    assert rows[0] == [(starts[2], "ok"), (starts[1], "ok"), (starts[0], "last")]
    assert [s for _, s in rows[1]] == ["ok", "ok", "loop"] and [s for _, s in rows[2]] == ["ok", "ok", "outside"] and [s for _, s in rows[3]] == ["lost"]
    assert rows.keys() == {0, 1, 2, 3}


def test_pdf_revisions_by_a_plain_reading(spark):
    got = {r.doc_id: r for r in files.pdf_revisions(spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert got.keys() == {r.doc_id for r in docs}
    for d in docs:
        content = revisions.written([x.encode() for x in (d.text or "").split("\n") if x] or [b""])
        ends = [m.start() for m in re.finditer(b"%%EOF", content)]
        gaps = [b - a for a, b in zip([0, *ends], ends)]
        r = got[d.doc_id]
        code = "DOC_MULTIPLE_UPDATES" if len(ends) >= 3 else "DOC_INCREMENTAL_UPDATE" if len(ends) == 2 else None
        assert (r.n_eof, r.n_tables, r.state, r.first_table, r.least_gap, r.largest_gap, r.code) == (len(ends), len(ends), "last", content.index(b"xref\n"), min(gaps), max(gaps), code)


def test_macro_containers(spark):
    from claimlens.sources import compound as c

    code = {"Small": b"Sub AutoOpen()\r\n", "Big": bytes(range(256)) * 300}
    good = c.project(code)
    large = c.project({"M": b"x = Shell(1)\n" * 500_000})
    fat = lambda f: 512 * (c.struct.unpack_from("<I", f, 76)[0] + 1)
    big = dict((p, (s, n)) for p, s, n in c.CompoundFile(good).streams())["VBA/Big"][0]
    loop = bytearray(good)
    c.struct.pack_into("<I", loop, fat(good) + 4 * (big + 1), big)
    siblings = bytearray(good)
    at = good.index("Small".encode("utf-16-le"))
    c.struct.pack_into("<I", siblings, at + 72, 2)  # its right sibling is the first one
    df = frame(spark, [good, loop, siblings, good[:-512], good[:100], b"", None, large])
    rows = c.macro_modules(df)
    got = {(r.i, r.module): (r.code, r.state) for r in rows.where("i < 7").collect()}
    assert got[0, "Small"] == ("Sub AutoOpen()\r\n", "ok") and got[0, "Big"] == (code["Big"].decode("latin-1"), "ok")
    assert got[1, "Small"][1] == "ok" and got[1, "Big"] == (None, "loop")
    assert {k[0]: v for k, v in got.items() if k[0] > 1} == {2: (None, "loop"), 3: (None, "outside"), 4: (None, "signature"), 5: (None, "signature"), 6: (None, "signature")}
    found = {r.i: (r.n_modules, r.n_broken, list(r.codes), r.risk) for r in c.macro_findings(rows, "i").collect()}
    assert found[0] == (2, 0, ["OFFICE_VBA_AUTOEXEC"], 0.70) and found[1] == (1, 1, ["OFFICE_VBA_AUTOEXEC"], 0.70) and found[3] == (0, 1, [], 0.0)
    assert found[7] == (1, 0, ["OFFICE_VBA_PRESENT", "OFFICE_VBA_SUSPICIOUS"], 0.60)


def test_copies_in_macro_code():
    from claimlens.sources import compound as c

    # the examples of the format's published specification
    plain = bytes.fromhex("0119B000616263646566676800696A6B6C6D6E6F70007172737475762E")
    assert c.unpacked(plain) == b"abcdefghijklmnopqrstuv."
    assert c.unpacked(bytes.fromhex("0103B002614500")) == b"a" * 73
    for broken in (b"", b"\x02", bytes.fromhex("0103B00161FFFF"), bytes.fromhex("0102B0026145")):
        with pytest.raises(c.Broken):
            c.unpacked(broken)


@pytest.mark.parametrize("name, workers", [("macro_containers", 1), ("office_packages", 2), ("png_text_findings", 1), ("pdf_revisions", 1)])
def test_files_are_built_and_walked_once(spark, name, workers):
    """A file is made once for all columns; where Spark itself doesn't read it, it is walked in the worker that makes it."""
    plan = getattr(files, name)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == workers and "Join" not in plan and "Generate" not in plan
