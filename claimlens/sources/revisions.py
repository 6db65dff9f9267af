"""Revisions of PDF files from their bytes: marks, and the chain from the last cross-reference table back to the first."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.sources.packages import walked

_START = re.compile(rb"startxref\s+(\d{1,19})")
_PREV = re.compile(rb"/Prev\s+(\d{1,19})")
REVISIONS = "number int, xref long, trailer_end long, state string"


class _Revisions:
    """A row per cross-reference table, newest first: number (from 0), xref (its offset), trailer_end (of its startxref), state.

    state: ok, last (no table before it), loop (the next one came before), outside (the next one lies outside the file) or lost (no table
    or trailer there). A file without startxref gives no row.
    """

    def eval(self, content: bytes):
        content = content or b""
        at = content.rfind(b"startxref")
        found = _START.match(content, at) if at >= 0 else None
        offset, number, seen = int(found[1]) if found else None, 0, set()
        while offset is not None:
            if offset >= len(content):
                yield number, offset, None, "outside"
                return
            if offset in seen:
                yield number, offset, None, "loop"
                return
            seen.add(offset)
            end = content.find(b"startxref", offset)
            trailer = content.find(b"trailer", offset, end if end >= 0 else len(content))
            if not content.startswith(b"xref", offset) or trailer < 0:
                yield number, offset, None, "lost"
                return
            before = _PREV.search(content, trailer, end if end >= 0 else len(content))
            yield number, offset, end if end >= 0 else None, "ok" if before else "last"
            offset, number = int(before[1]) if before else None, number + 1


def revisions(df: DataFrame, content: str = "content", build=None) -> DataFrame:
    """df without its content, a row per cross-reference table that its chain leads to; build: as for walked()."""
    return walked(df, _Revisions, REVISIONS, content, build)


class _Marks:
    """A row per occurrence of a mark: number (from 0) and offset."""

    def eval(self, content: bytes, mark: str):
        for i, m in enumerate(re.finditer(re.escape(mark.encode()), content or b"")):
            yield i, m.start()


def marks(df: DataFrame, mark: str, content: str = "content", build=None) -> DataFrame:
    """df without its content, a row per occurrence of the mark in it; build: as for walked()."""
    return walked(df, _Marks, "number int, offset long", content, build, (mark,))


class _RevisionsAndMarks:
    """Both in one reading: kind (table or mark), number, offset, state of a table, and the offset of the mark before a mark (0 before the first)."""

    def eval(self, content: bytes, mark: str):
        for number, offset, _, state in _Revisions().eval(content):
            yield "table", number, offset, state, None
        before = 0
        for number, offset in _Marks().eval(content, mark):
            yield "mark", number, offset, None, before
            before = offset


def revisions_and_marks(df: DataFrame, mark: str, content: str = "content", build=None) -> DataFrame:
    """df without its content, a row per table and per mark of each file; build: as for walked()."""
    return walked(df, _RevisionsAndMarks, "kind string, number int, offset long, state string, before long", content, build, (mark,))


def update_finding(n_eof: Column) -> Column:
    """Code and risk by the number of end marks."""
    of = lambda code, risk: F.struct(F.lit(code).alias("code"), F.lit(risk).alias("risk"))
    return F.when(n_eof >= 3, of("DOC_MULTIPLE_UPDATES", 0.15)).when(n_eof == 2, of("DOC_INCREMENTAL_UPDATE", 0.10))


def written(parts: list[bytes]) -> bytes:
    """A file whose first part is the original and each other one an incremental update of it."""
    out, before = bytearray(b"%PDF-1.7\n"), None
    for i, part in enumerate(parts):
        out += b"%d 0 obj\n<< /Length %d >>\nstream\n" % (i + 1, len(part)) + part + b"\nendstream\nendobj\n"
        at = len(out)
        out += b"xref\n%d 1\n%010d 00000 n \ntrailer\n<< /Size %d" % (i + 1, at, i + 2) + (b" /Prev %d" % before if before is not None else b"") + b" >>\nstartxref\n%d\n%%%%EOF\n" % at
        before = at
    return bytes(out)


