"""Macro containers: the sector chains and the directory tree of a compound file, and the source code that its module streams hold."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.sources.packages import walked

SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT_SECTOR, NONE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFF
CUTOFF, SECTOR, MINI = 4096, 512, 64


class Broken(ValueError):
    """A structure that can't be followed: a loop, or a number outside the file."""


class CompoundFile:
    """Streams by path. Chains and siblings are followed once: a sector or an entry that comes again is a loop."""

    def __init__(self, content: bytes):
        if not content.startswith(SIGNATURE) or len(content) < 512:
            raise Broken("signature")
        self.content = content
        self.sector, self.mini = 1 << min(content[30], 20), 1 << min(content[32], 20)
        number = lambda at: struct.unpack_from("<I", content, at)[0]
        tables = list(struct.unpack_from("<109I", content, 76))
        at, seen = number(68), set()
        while at < FAT_SECTOR:  # more tables of tables
            if at in seen:
                raise Broken("loop")
            seen.add(at)
            entries = struct.unpack(f"<{self.sector // 4}I", self.block(at))
            tables += entries[:-1]
            at = entries[-1]
        self.fat = [x for t in tables if t < FAT_SECTOR for x in struct.unpack(f"<{self.sector // 4}I", self.block(t))]
        self.directory = self.chained(number(48))
        mini = self.chained(number(60)) if number(60) < FAT_SECTOR else b""
        self.mini_fat = list(struct.unpack(f"<{len(mini) // 4}I", mini))
        root = self.entry(0)
        self.mini_stream = self.chained(root[4])[: root[5]] if root[4] < FAT_SECTOR else b""

    def block(self, n: int) -> bytes:
        part = self.content[(n + 1) * self.sector : (n + 2) * self.sector]
        if len(part) < self.sector:
            raise Broken("outside")
        return part

    def numbers(self, first: int, table: list[int]) -> Iterator[int]:
        seen = set()
        while first < FAT_SECTOR:
            if first in seen:
                raise Broken("loop")
            if first >= len(table):
                raise Broken("outside")
            seen.add(first)
            yield first
            first = table[first]

    def chained(self, first: int) -> bytes:
        return b"".join(self.block(n) for n in self.numbers(first, self.fat))

    def entry(self, i: int) -> tuple:
        """name, type, (left, right, child), start, size of a directory entry."""
        raw = self.directory[128 * i : 128 * i + 128]
        if len(raw) < 128:
            raise Broken("outside")
        length = min(64, struct.unpack_from("<H", raw, 64)[0])
        return raw[: max(0, length - 2)].decode("utf-16-le", "replace"), raw[66], struct.unpack_from("<3I", raw, 68), 0, *struct.unpack_from("<II", raw, 116)

    def streams(self) -> Iterator[tuple[str, int, int]]:
        """Path, start and size of each stream, in the order of the tree."""
        todo, seen = [("", self.entry(0)[2][2])], set()
        while todo:
            path, i = todo.pop()
            if i == NONE:
                continue
            if i in seen:
                raise Broken("loop")
            seen.add(i)
            name, kind, (left, right, child), _, start, size = self.entry(i)
            todo += [(path, left), (path, right)]
            if kind == 1:
                todo.append((f"{path}{name}/", child))
            elif kind == 2:
                yield f"{path}{name}", start, size

    def read(self, start: int, size: int) -> bytes:
        if size >= CUTOFF:
            return self.chained(start)[:size]
        parts = [self.mini_stream[n * self.mini : (n + 1) * self.mini] for n in self.numbers(start, self.mini_fat)] if size else []
        return b"".join(parts)[:size]


def unpacked(data: bytes) -> bytes:
    """The text of a compressed container: chunks of literals and of copies of what the chunk already has."""
    if data[:1] != b"\x01":
        raise Broken("container")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        head = struct.unpack_from("<H", data, at)[0]
        end = min(len(data), at + 3 + (head & 0xFFF))
        at += 2
        if not head >> 15:
            out += data[at:end]
            at = end
            continue
        first = len(out)
        while at < end:
            flags = data[at]
            at += 1
            if not flags:  # literals only
                out += data[at : min(at + 8, end)]
                at = min(at + 8, end)
                continue
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > end:
                    raise Broken("container")
                token = struct.unpack_from("<H", data, at)[0]
                at += 2
                shift = 16 - max(4, (len(out) - first - 1).bit_length())
                back, n = (token >> shift) + 1, (token & (1 << shift) - 1) + 3
                if back > len(out) - first:
                    raise Broken("container")
                for _ in range(n):
                    out.append(out[-back])
    return bytes(out)


def module_offsets(directory: bytes) -> dict[str, int]:
    """Where each module's source begins in its stream, by the records of the project's directory."""
    found, name, at = {}, None, 0
    while at + 6 <= len(directory):
        kind, size = struct.unpack_from("<HI", directory, at)
        data = directory[at + 6 : at + 6 + size]
        if kind == 0x001A:
            name = data.decode("latin-1")
        elif kind == 0x0031 and size == 4 and name is not None:
            found[name] = struct.unpack("<I", data)[0]
        at += 6 + size + (2 if kind == 0x0009 else 0)  # the version's size leaves its minor part out
    return found


class _Modules:
    """module, code, state of each module of a compound file; state says ok, or what is broken (then module or code may be null)."""

    def eval(self, content: bytes):
        try:
            file = CompoundFile(content or b"")
            streams = {path: (start, size) for path, start, size in file.streams()}
        except (Broken, struct.error) as e:
            yield None, None, str(e) if isinstance(e, Broken) else "cut"
            return
        for path in sorted(streams):
            if not path.lower().endswith("vba/dir"):
                continue
            try:
                offsets = module_offsets(unpacked(file.read(*streams[path])))
            except (Broken, struct.error) as e:
                yield None, None, str(e)
                continue
            for name, at in offsets.items():
                own = streams.get(path[:-3] + name)
                if own is None:
                    yield name, None, "missing"
                    continue
                try:
                    yield name, unpacked(file.read(*own)[at:]).decode("latin-1"), "ok"
                except (Broken, struct.error) as e:
                    yield name, None, str(e)


def macro_modules(df: DataFrame, content: str = "content", build=None) -> DataFrame:
    """df without its content, a row per module of each macro container; build: as for walked()."""
    return walked(df, _Modules, "module string, code string, state string", content, build)


#: Procedures that run by themselves, and patterns of suspicious commands.
AUTO_RUN = [
    "AutoExec", "AutoOpen", "Auto_Open", "AutoExit", "AutoClose", "Auto_Close", "AutoNew", "Document_Open", "DocumentOpen", "Document_Close", "Document_BeforeClose", "DocumentBeforeClose", "DocumentChange", "Document_New", "NewDocument",
    "Workbook_Open", "Workbook_Activate", "Workbook_Close", "Workbook_BeforeClose",
]
SUSPICIOUS = ["Shell", "WScript", "CreateObject", "PowerShell", "cmd.exe", "Environ", "Kill", "Open.*Binary"]


def runs_itself(code: Column) -> Column:
    return F.regexp_like(code, F.lit(r"(?i)\b(?:" + "|".join(AUTO_RUN) + r")\b"))


def suspicious(code: Column) -> Column:
    """The patterns that the code has, in the order of the list."""
    return F.array_compact(F.array(*(F.when(F.regexp_like(code, F.lit("(?i)" + p)), F.lit(p)) for p in SUSPICIOUS)))


def macro_findings(modules: DataFrame, key: str, *also: Column) -> DataFrame:
    """key, n_modules, n_broken, codes and risk (the largest) of each container; also: more aggregates of its modules, by name."""
    ok = F.col("state") == "ok"
    g = modules.groupBy(key).agg(F.count_if(ok).alias("n_modules"), F.count_if(~ok).alias("n_broken"), F.coalesce(F.bool_or(runs_itself(F.col("code"))), F.lit(False)).alias("auto"), F.coalesce(F.bool_or(F.size(suspicious(F.col("code"))) > 0), F.lit(False)).alias("bad"), *also)
    some = F.col("n_modules") > 0
    codes = F.array_compact(F.array(F.when(some & F.col("auto"), "OFFICE_VBA_AUTOEXEC").when(some, "OFFICE_VBA_PRESENT"), F.when(some & F.col("bad"), "OFFICE_VBA_SUSPICIOUS")))
    risk = F.when(some & F.col("auto"), 0.70).when(some & F.col("bad"), 0.60).when(some, 0.45).otherwise(0.0)
    own = (key, "n_modules", "n_broken", "auto", "bad")
    return g.select(key, "n_modules", "n_broken", codes.alias("codes"), risk.alias("risk"), *(c for c in g.columns if c not in own))


def container(text: bytes) -> bytes:
    """text as a compressed container of literals."""
    out = bytearray(b"\x01")
    for i in range(0, len(text), 3640):  # with its flags, a chunk of so many literals has 4095 bytes at most
        part = text[i : i + 3640]
        body = b"".join(b"\0" + part[k : k + 8] for k in range(0, len(part), 8))
        out += struct.pack("<H", 0x8000 | 3 << 12 | len(body) - 1) + body
    return bytes(out)


def project(modules: dict[str, bytes], prefix: bytes = b"cache") -> bytes:
    """A compound file with a project of these modules; prefix is what precedes the source in a module's stream."""
    record = lambda kind, data: struct.pack("<HI", kind, len(data)) + data
    directory = record(0x0001, b"\0" * 4) + struct.pack("<HI", 0x0009, 4) + b"\0" * 6
    for name in modules:
        directory += record(0x0019, name.encode()) + record(0x001A, name.encode()) + record(0x0031, struct.pack("<I", len(prefix))) + record(0x002B, b"")
    streams = [("dir", container(directory)), *((name, prefix + container(code)) for name, code in modules.items())]
    sector = SECTOR if sum(map(len, modules.values())) < 5_000_000 else 4096
    entries, data, fat, small, mini_fat = [], bytearray(), [], bytearray(), []

    def placed(body: bytes) -> int:
        """The first sector of body, which becomes a chain."""
        first, n = len(fat), -(-len(body) // sector)
        fat.extend([*range(first + 1, first + n), END])
        data.extend(body.ljust(n * sector, b"\0"))
        return first

    for name, body in streams:
        if len(body) >= CUTOFF:
            entries.append((name, placed(body), len(body)))
            continue
        first, n = len(mini_fat), -(-len(body) // MINI)
        mini_fat += [*range(first + 1, first + n), END]
        small += body.ljust(n * MINI, b"\0")
        entries.append((name, first, len(body)))
    mini_first = placed(bytes(small)) if small else END
    mini_table = struct.pack(f"<{len(mini_fat)}I", *mini_fat)
    mini_table += b"\xff" * (-len(mini_table) % sector)
    mini_at = placed(mini_table) if mini_fat else END

    def entry(name: str, kind: int, right: int, child: int, start: int, size: int) -> bytes:
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw) + 2, kind, 1, NONE, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    tree = entry("Root Entry", 5, NONE, 1, mini_first, len(small)) + entry("VBA", 1, NONE, 2, 0, 0)
    for i, (name, start, size) in enumerate(entries):
        tree += entry(name, 2, i + 3 if i + 1 < len(entries) else NONE, NONE, start, size)
    at = placed(tree)
    tables = 1
    while tables * (sector // 4) < len(fat) + tables:
        tables += 1
    if tables > 109:
        raise ValueError("too large for the header's table")
    first = len(fat)
    fat += [FAT_SECTOR] * tables
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(tables * sector, b"\xff")
    head = SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3 if sector == SECTOR else 4, 0xFFFE, sector.bit_length() - 1, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIIII", 0, tables, at, 0, CUTOFF, mini_at, len(mini_table) // sector, END, 0, 0)[:36]
    head += struct.pack("<109I", *range(first, first + tables), *[FREE] * (109 - tables))
    return head.ljust(sector, b"\0") + bytes(data) + table
