"""WARC archives as a PySpark Python data source, format "warc".

Archives are .warc.gz files with a gzip member per record. Each member's header has an extra field "sl"
with the member's length and its length when inflated. A reader so inflates only as much as the WARC and
HTTP headers need, checks the pushed-down predicates, and seeks past the rest of the records it doesn't
want; payloads are inflated only if they are wanted and asked for.

A write is a set of files and a manifest that the driver adds when all tasks are done. Reads take the files that
manifests name, so that what lost or repeated tasks leave behind never counts.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .common import stored

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, content_length long, http_status int, http_length long, headers map<string,string>, payload binary"

#: The header that each column comes from.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes inflated at first in the search of the end of the headers.
HEAD_BYTES = 2048
#: Parts that the pages of one payload are dealt to where repeated digests are joined.
SALTS = 16
#: Bytes that a writing task holds before it begins a new archive, and of the archives that a reading task is given.
ARCHIVE_BYTES, BUNDLE_BYTES = 128 << 20, 64 << 20
#: Bits of the bitmap of repeated digests: 4 MB at most.
SLOTS = 1 << 25


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def member(record: bytes) -> bytes:
    """A gzip member that says in its header how long it is."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    n = 10 + 2 + 12 + len(body) + 8
    return struct.pack("<4BI2BH2sH2I", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, n, len(record) & 0xFFFFFFFF) + body + struct.pack("<2I", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str, date: str, digest: str, payload: bytes, length: int, refers_to: str | None) -> bytes:
    """A response record with its payload, or a revisit record: the block is the HTTP head, with the length of the payload it repeats."""
    block = HTTP_HEAD % length + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", digest)]
    if refers_to:
        head += [("WARC-Refers-To", refers_to), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    clean = ((k, v.replace("\r", " ").replace("\n", " ")) for k, v in head)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, out = [], None
        fs, root = _files(self.path)
        fs.create_dir(root, recursive=True)
        names = ("record_type", "record_id", "target_uri", "warc_date", "payload_digest", "payload", "payload_bytes", "refers_to")
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                kind, record_id, uri, date, digest, payload, length, refers_to = row
                if out is None:
                    files.append([f"{uuid.uuid4().hex}.warc.gz", 0])
                    out = fs.open_output_stream(f"{root}/{files[-1][0]}", compression=None)
                files[-1][1] += out.write(member(record(kind, record_id, uri or "", date or "", digest or "", payload or b"", length or 0, refers_to)))
                if files[-1][1] >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = _files(self.path)
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, root = _files(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                fs.delete_file(f"{root}/{name}")


@dataclass
class Archives(InputPartition):
    names: list


def bundled(files: list) -> list[Archives]:
    """Archives (name and bytes) in the order of the manifests, so many to a partition that it has BUNDLE_BYTES, or one."""
    out, held = [], 0
    for name, size in files:
        if not out or held + size > BUNDLE_BYTES:
            out.append(Archives([]))
            held = 0
        out[-1].names.append(name)
        held += size
    return out


def parse_headers(lines: bytes) -> dict[str, str]:
    """Header names in lower case and their values; folded lines go on from the one before."""
    out: dict[str, str] = {}
    last = None
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


class WarcReader(DataSourceReader):
    """Partitions of some archives each. Equality, IN and prefix predicates on the header columns are applied before payloads are inflated."""

    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload, self.wanted = path, with_payload, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADER_OF and isinstance(f, EqualTo):
                self.wanted.append((HEADER_OF[column], "is", (f.value,)))
            elif column in HEADER_OF and isinstance(f, In):
                self.wanted.append((HEADER_OF[column], "is", tuple(f.value)))
            elif column in HEADER_OF and isinstance(f, StringStartsWith):
                self.wanted.append((HEADER_OF[column], "starts", (f.value,)))
            else:
                yield f

    def partitions(self):
        fs, root = _files(self.path)
        files = []
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("manifest-"):
                with fs.open_input_stream(info.path) as f:
                    files += json.loads(f.read())
        return bundled(files) or [Archives([])]

    def matches(self, headers: dict[str, str]) -> bool:
        for name, how, values in self.wanted:
            value = headers.get(name)
            if value is None or not (value in values if how == "is" else value.startswith(values)):
                return False
        return True

    def read(self, partition: Archives):
        fs, root = _files(self.path)
        for name in partition.names:
            with fs.open_input_file(f"{root}/{name}") as f:
                yield from read_members(f, self.matches, self.with_payload)


def read_members(f, matches, with_payload: bool):
    """Rows of an archive that can seek; of each record the headers come first, and what isn't wanted is skipped."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        start = f.read(24 + HEAD_BYTES)
        if start[:4] != b"\x1f\x8b\x08\x04" or start[12:14] != b"sl":
            raise ValueError(f"no record with a length at byte {at}")
        n = struct.unpack("<I", start[16:20])[0]
        inflate = zlib.decompressobj(-15)
        data = inflate.decompress(start[24:], HEAD_BYTES)
        rest = start[24 + HEAD_BYTES :]
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = inflate.decompress(inflate.unconsumed_tail or f.read(HEAD_BYTES), HEAD_BYTES)
            if not more and f.tell() >= min(size, at + n):
                raise ValueError(f"headers without an end at byte {at}")
            data += more
        headers = parse_headers(data[:end])
        if matches(headers):
            length = int(headers.get("content-length", 0))
            block = data[end + 4 :]
            if with_payload or headers.get("content-type", "").startswith("application/http"):
                wanted = length if with_payload else min(length, HEAD_BYTES)
                while len(block) < wanted:
                    piece = inflate.unconsumed_tail or f.read(max(1, min(1 << 20, at + n - f.tell())))
                    if not (more := inflate.decompress(piece, wanted - len(block))) and not piece:
                        raise ValueError(f"a record that is cut off at byte {at}")
                    block += more
            block = block[:length]
            status = http_length = None
            if headers.get("content-type", "").startswith("application/http"):
                line = block.split(b"\r\n", 1)[0].split(b" ")
                status = int(line[1]) if len(line) > 1 and line[1].isdigit() else None
                http, _, block = block.partition(b"\r\n\r\n")
                http_length = int(parse_headers(http).get("content-length", -1))
            yield (*(headers.get(HEADER_OF[c]) for c in HEADER_OF), length, status, http_length, headers, block if with_payload else None)
        at += n


class WarcSource(DataSource):
    """Options: path; payload ("true" by default, "false" leaves the payload column null and payloads packed)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], str(self.options.get("payload", "true")).lower() == "true")

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are appended to a folder, not overwritten")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """The WARC records of pages (page_id, url, html): record_id urn:page:<page_id>, and so on.

    Among the rows with an equal payload of at least min_revisit_bytes, the one with the largest page_id is a
    response and the others are revisits of it. A row that repeats it with the same page_id is a response too.
    Null html is an empty payload, a null url an empty one; a row with a null page_id never is referred to unless
    all are null, and then all are responses. An empty table gives no rows; further columns are not used.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    large = F.col("bytes") >= min_revisit_bytes
    again = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("again"), "first_id")
    again = stored(again, "repeated-digests")
    # A bitmap of the digests that occur again keeps all other payloads where they are: only pages whose bit is set are joined. They
    # are dealt to salts, with a copy of the digests for each: one payload may be that of a third of all pages.
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    marks = again.groupBy(F.bitmap_bucket_number(slot("again")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot("again"))).alias("bits"))
    rows = rows.withColumn("bit", F.bitmap_bit_position(slot("digest"))).join(F.broadcast(marks), F.bitmap_bucket_number(slot("digest")) == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = large & F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = F.pmod(F.xxhash64("page_id", "target_uri"), F.lit(SALTS)).cast("int")
    few = rows.where(marked).withColumn("dealt", dealt).join(again.hint("merge"), (F.col("digest") == F.col("again")) & (F.col("dealt") == F.col("salt")), "left")
    columns = ("page_id", "target_uri", "payload", "digest", "bytes")
    rows = few.select(*columns, "first_id").union(rows.where(~marked).select(*columns, F.lit(None).cast(pages.schema["page_id"].dataType)))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return rows.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        F.when(revisit, urn(F.col("first_id"))).alias("refers_to"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        F.col("bytes").cast("long").alias("payload_bytes"),
    )


def write(pages: DataFrame, path: str) -> None:
    """Archives of all pages under path, a folder or URI that all executors can write to."""
    register(pages.sparkSession)
    records(pages).write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def resolved(archive: DataFrame) -> DataFrame:
    """The rows of an archive of pages with the full payload's length and digest.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to. Of a response, length and digest
    are computed from the payload that was read; of a revisit, they are those its headers repeat. Records of other types
    have what their headers say, ids that aren't numbers are null, and an empty archive gives no rows.
    """
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    response = F.col("record_type") == "response"
    return archive.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """resolved() of the responses and revisits under path. Both predicates on the type reach the source, and revisits are read by their headers alone."""
    of = lambda kind, payload: resolved(read(spark, path, payload).where(F.col("record_type") == kind))
    return of("response", True).unionByName(of("revisit", False))


__all__ = ["WarcSource", "member", "read", "read_members", "record", "records", "read_pages", "register", "resolved", "write"]
