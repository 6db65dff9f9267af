"""Binary files by their structure: what lies in a package, how large its pictures are, and which texts their chunks hold.

Walkers are table functions that a lateral join calls for each file; they read directories and headers, and inflate what they
need. A broken file gives what can be read before the break, and a row that says so.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes of a picture that its size is looked for in.
HEADER_BYTES = 1 << 18


def png_chunks(content: bytes) -> Iterator[tuple[bytes, bytes, bool]]:
    """Type, payload and whether the checksum is right, of each chunk up to IEND; a chunk that is cut short ends the walk."""
    at = len(PNG)
    while content.startswith(PNG) and at + 12 <= len(content):
        length = int.from_bytes(content[at : at + 4], "big")
        end = at + 8 + length
        if end + 4 > len(content):
            return
        kind = content[at + 4 : at + 8]
        yield kind, content[at + 8 : end], zlib.crc32(content[at + 4 : end]) == int.from_bytes(content[end : end + 4], "big")
        if kind == b"IEND":
            return
        at = end + 4


def chunk_text(kind: bytes, payload: bytes) -> tuple[str, bytes] | None:
    """Keyword and text of a tEXt, zTXt or iTXt chunk; None if it has no keyword, or its compressed text is broken."""
    keyword, cut, rest = payload.partition(b"\0")
    if not cut:
        return None
    packed = kind == b"zTXt"
    if kind == b"zTXt":
        rest = rest[1:]
    elif kind == b"iTXt":
        if len(rest) < 4:
            return None
        packed, rest = rest[0] == 1, rest[2:].split(b"\0", 2)[-1]
    if packed:
        try:
            rest = zlib.decompress(rest)
        except zlib.error:
            return None
    return keyword.decode("latin-1"), rest


def picture_size(head: bytes) -> tuple[str, int, int] | None:
    """Form, width and height by the first bytes of a PNG or JPEG file."""
    if head.startswith(PNG) and head[12:16] == b"IHDR":
        return ("png", *struct.unpack(">II", head[16:24]))
    at = 2
    while head.startswith(b"\xff\xd8") and at + 9 <= len(head) and head[at] == 0xFF:
        marker = head[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame
            height, width = struct.unpack(">HH", head[at + 5 : at + 9])
            return "jpeg", width, height
        if marker in (0x01, 0xFF) or 0xD0 <= marker <= 0xD7:  # no length
            at += 1 if marker == 0xFF else 2
        else:
            at += 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return None


class _Pictures:
    """A row per picture of a package: name, form, width, height, bytes; form is broken for an entry that can't be read."""

    def eval(self, content: bytes):
        try:
            package = zipfile.ZipFile(io.BytesIO(content or b""))
        except (zipfile.BadZipFile, ValueError):
            return
        seen = set()
        for entry in package.infolist():
            key = (entry.header_offset, entry.CRC, entry.file_size)
            if entry.is_dir() or key in seen:
                continue
            seen.add(key)
            try:
                with package.open(entry) as f:
                    size = picture_size(f.read(HEADER_BYTES))
            except (zipfile.BadZipFile, zlib.error, OSError, NotImplementedError, RuntimeError, EOFError, struct.error):
                yield entry.filename, "broken", 0, 0, entry.file_size
                continue
            if size:
                yield entry.filename, *size, entry.file_size


class _Chunks:
    """A row per text chunk of each PNG picture of a package, or of content itself where it is one.

    picture (empty for content itself), number (of the chunk in its picture), kind, keyword, text, intact. keyword is null where a chunk
    can't be read. A picture's broken checksums of other chunks come as rows without keyword too.
    """

    def eval(self, content: bytes):
        content = content or b""
        if content.startswith(PNG):
            yield from self.walked("", content)
            return
        try:
            package = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError):
            return
        for entry in package.infolist():
            try:
                data = package.read(entry)
            except (zipfile.BadZipFile, zlib.error, OSError, NotImplementedError, RuntimeError, EOFError):
                continue
            if data.startswith(PNG):
                yield from self.walked(entry.filename, data)

    @staticmethod
    def walked(name: str, data: bytes):
        for i, (kind, payload, intact) in enumerate(png_chunks(data)):
            textual = kind in (b"tEXt", b"zTXt", b"iTXt")
            if textual or not intact:
                found = chunk_text(kind, payload) if textual else None
                keyword, text = found if found else (None, None)
                yield name, i, kind.decode("latin-1"), keyword, None if text is None else text.decode("utf-8", "replace"), intact


def _called(walker: type, schema: str, df: DataFrame, content: str) -> DataFrame:
    return df.lateralJoin(F.udtf(walker, returnType=schema)(F.col(content).outer())).drop(content)


#: Rows and characters of found texts that a walker gathers before they leave.
WALKED_ROWS, WALKED_CHARS = 4096, 1 << 21


def walked(df: DataFrame, walker: type, schema: str, content: str, build=None, args: tuple = ()) -> DataFrame:
    """df without its content, a row per row that the walker finds in each file; files without any give none.

    With build, content is a text (null texts are empty), and its file is build(first column, text), made and walked one at a time in one
    worker. A worker holds a batch of inputs, one file and a bounded number of rows.
    """
    keep, key = [c for c in df.columns if c != content], df.columns[0]
    found = T.StructType.fromDDL(schema)
    kinds = [{"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[f.dataType.simpleString()] for f in found]
    names = [*keep, *found.names]
    kind = T.StructType([*df.select(*keep).schema, *found])

    def run(batches):
        for batch in batches:
            others, files = batch.select(keep), batch.column(content)
            at, rows, chars = [], [], 0

            def gathered():
                parts = zip(*rows) if rows else [()] * len(kinds)
                return pa.RecordBatch.from_arrays([*others.take(pa.array(at, pa.int64())).columns, *(pa.array(x, k) for x, k in zip(parts, kinds))], names=names)

            for i in range(batch.num_rows):
                file = files[i].as_py()
                if build:
                    file = build(batch.column(key)[i].as_py(), file or "")
                for row in walker().eval(file, *args):
                    at.append(i)
                    rows.append(tuple(None if type(x) is int and x >> 63 not in (0, -1) else x for x in row))
                    chars += sum(len(x) for x in row if type(x) is str)
                    if len(at) >= WALKED_ROWS or chars >= WALKED_CHARS:
                        yield gathered()
                        at, rows, chars = [], [], 0
            if at:
                yield gathered()

    return df.mapInArrow(run, kind)


def pictures(df: DataFrame, content: str = "content") -> DataFrame:
    """df without its content, a row per picture of each package."""
    return _called(_Pictures, "name string, form string, width int, height int, n_bytes long", df, content)


def text_chunks(df: DataFrame, content: str = "content", build=None) -> DataFrame:
    """df without its content, a row per text chunk, and per broken chunk, of its PNG pictures; build: as for walked()."""
    return walked(df, _Chunks, "picture string, number int, kind string, keyword string, text string, intact boolean", content, build)


def largest_pictures(found: DataFrame, key: str, least_side: int = 100, least_bytes: int = 500, most: int = 10) -> DataFrame:
    """Of each file the largest pictures that are no icons, with place; the limit applies before the shuffle. Ties go by name."""
    from pyspark.sql import Window as W

    good = found.where((F.least("width", "height") >= least_side) & (F.col("n_bytes") >= least_bytes))
    return good.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n_bytes"), "name"))).where(F.col("place") <= most)


#: Keywords of PNG text chunks that only generators write, and words in texts of other chunks, with generator and risk; the first match counts.
GENERATOR_KEYS = [
    ("parameters", "Stable Diffusion (Auto1111/Forge)", 0.95), ("prompt", "ComfyUI / SD", 0.95), ("workflow", "ComfyUI", 0.95), ("Dream", "InvokeAI", 0.95), ("sd-metadata", "InvokeAI (legacy)", 0.95),
    ("invokeai_metadata", "InvokeAI", 0.95), ("sd_metadata", "Stable Diffusion", 0.95), ("NovelAI", "NovelAI", 0.95), ("NAI Generated", "NovelAI", 0.95),
]
GENERATOR_WORDS = [
    ("stable-diffusion", "Stable Diffusion", 0.95), ("stable diffusion", "Stable Diffusion", 0.95), ("stablediffusion", "Stable Diffusion", 0.95), ("automatic1111", "Automatic1111", 0.95), ("comfyui", "ComfyUI", 0.95),
    ("invokeai", "InvokeAI", 0.95), ("novelai", "NovelAI", 0.95), ("diffusers", "HuggingFace Diffusers", 0.85), ("flux.1", "Flux.1", 0.95), ("flux schnell", "Flux.1 Schnell", 0.95), ("flux dev", "Flux.1 Dev", 0.95),
    ("midjourney", "Midjourney", 0.95), ("dall-e", "DALL-E", 0.95), ("firefly", "Adobe Firefly", 0.95), ("adobe ai", "Adobe AI", 0.85), ("generative fill", "Adobe Generative Fill", 0.85), ("generative expand", "Adobe Generative Expand", 0.85),
]


def generator_finding(keyword: Column, text: Column) -> Column:
    """Code, generator and risk of a text chunk: by its keyword, else by the first known word of its text; null if it has neither."""
    of = lambda code, g, r: F.struct(F.lit(code).alias("code"), F.lit(g).alias("generator"), F.lit(r).alias("risk"))
    by_key = [F.when(F.lower(keyword) == k.lower(), of("META_PNG_AI_PARAMS", g, r)) for k, g, r in GENERATOR_KEYS]
    by_word = [F.when(F.contains(F.lower(text), F.lit(w)), of("META_PNG_AI_VALUE", g, r)) for w, g, r in GENERATOR_WORDS]
    return F.coalesce(*by_key, *by_word)


#: Agents in a picture's history that generate, and actions that save.
GENERATING_AGENTS = ["dall-e", "dall·e", "midjourney", "stable diffusion", "comfyui", "automatic1111", "invoke ai", "novelai", "adobe firefly", "runway"]
SAVING = ["saved", "converted", "derived"]


def history_events(packet: Column) -> Column:
    """action and agent of each event of an XMP packet's history, in order: attributes of rdf:li in any order, either one may be missing."""
    items = F.regexp_extract_all(packet, F.lit(r"(?s)<rdf:li\b([^>]*stEvt:[^>]*)>"), F.lit(1))
    attribute = lambda item, name: F.nullif(F.regexp_extract(item, rf"stEvt:{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    return F.transform(items, lambda i: F.struct(attribute(i, "action").alias("action"), attribute(i, "softwareAgent").alias("agent")))


def history_finding(packet: Column, editing: list[str]) -> Column:
    """Code and risk of an XMP packet's history: a generating agent, else three agents that are Photoshop, else five saves.

    A packet without events whose creator tool edits (editing: keywords; two of them are harmless) has been stripped. Null for none of these.
    """
    events = history_events(packet)
    agents = F.transform(F.filter(events, lambda e: e["agent"].isNotNull()), lambda e: F.lower(e["agent"]))
    actions = F.filter(events, lambda e: e["action"].isNotNull())
    first = lambda a: F.try_element_at(F.filter(F.array(*map(F.lit, editing)), lambda k: F.contains(a, k)), F.lit(1))
    generates = F.exists(agents, lambda a: F.coalesce(first(a).isin(GENERATING_AGENTS), F.lit(False)))
    photoshop = F.size(F.filter(agents, lambda a: F.contains(a, F.lit("photoshop")) & first(a).isNotNull()))
    saves = F.size(F.filter(actions, lambda e: F.lower(e["action"]).isin(SAVING)))
    creator = F.lower(F.regexp_extract(packet, r"xmp:CreatorTool(?:\s*=\s*[\"']|>)([^\"'<]*)", 1))
    suspicious = F.array(*(F.lit(k) for k in editing if k not in ("lightroom", "snapseed")))
    stripped = (F.size(actions) == 0) & (F.size(agents) == 0) & F.exists(suspicious, lambda k: F.contains(creator, k))
    of = lambda code, risk: F.struct(F.lit(code).alias("code"), F.lit(risk).alias("risk"))
    some = F.size(actions) > 0
    return (
        F.when(stripped, of("META_XMP_HISTORY_STRIPPED", 0.15))
        .when(some & generates, of("META_XMP_AI_TOOL_HISTORY", 0.50))
        .when(some & (photoshop >= 3), of("META_XMP_EDIT_HISTORY", 0.20))
        .when(some & (saves >= 5), of("META_XMP_EDIT_HISTORY", 0.15))
    )


def chunk(kind: bytes, payload: bytes, broken: bool = False) -> bytes:
    """A PNG chunk; broken spoils its checksum."""
    return len(payload).to_bytes(4, "big") + kind + payload + (zlib.crc32(kind + payload) ^ broken).to_bytes(4, "big")


def png(width: int, height: int, chunks: list[bytes], data: bytes = b"") -> bytes:
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + b"".join(chunks) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def jpeg(width: int, height: int, comment: bytes) -> bytes:
    """The header of a JPEG file with a comment, in segments of 65533 bytes."""
    parts = [comment[i : i + 65533] for i in range(0, len(comment), 65533)]
    segments = b"".join(b"\xff\xfe" + (len(p) + 2).to_bytes(2, "big") + p for p in parts)
    return b"\xff\xd8" + segments + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00\xff\xd9"


def packed(parts: list[tuple[str, bytes]]) -> bytes:
    """A zip package of parts by name, with fixed dates."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def built(df: DataFrame, key: str, text: str, build) -> DataFrame:
    """key and content: a file of each text (null texts are empty), by build(key, text)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                k, t = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([build(k, t or "")], pa.binary())], names=[key, "content"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, rows.select(key).schema.add("content", "binary"))
