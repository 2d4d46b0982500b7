"""A connector for single-file databases: table B-trees of fixed-size pages,
with an overlay of committed write-ahead-log frames.

The path has to be one that the driver and all executors share. The driver reads
the schema and the inner pages of a table; tasks decode runs of leaves, once for
the classes of values that a column holds and once for the rows. With a hot
rollback journal beside it, a file is refused; a damaged page is an error.
"""

from __future__ import annotations

import os
import struct
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import nodes as n
from ..errors import DialectError, SyntaxFault
from ..functions.core import real_text
from ..types import joined

LEAVES = 64  # leaf pages in a partition
JOURNAL = bytes.fromhex("d9d505f920a163d7")


class Pages:
    """Pages by number: the latest committed log frame, else the file."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://").removeprefix("file:")
        with open(self.path, "rb") as f:
            head = f.read(100)
        if head[:15] != b"SQLite format 3":
            raise DialectError(f"{path} is no database file")
        size = struct.unpack(">H", head[16:18])[0]
        self.size = 65536 if size == 1 else size
        self.usable = self.size - head[20]
        journal = self.path + "-journal"
        if os.path.exists(journal):
            with open(journal, "rb") as f:
                if f.read(8) == JOURNAL:
                    raise DialectError(f"{path} has a hot journal")
        self.overlay = self._log()

    def _log(self) -> dict[int, int]:
        """Page -> offset in the log, of frames up to the last commit whose
        salts and running checksum hold."""
        out: dict[int, int] = {}
        wal = self.path + "-wal"
        if not os.path.exists(wal):
            return out
        with open(wal, "rb") as f:
            data = f.read(32)
            if len(data) < 32 or struct.unpack(">I", data[:4])[0] & ~1 != 0x377F0682:
                return out
            order = ">" if data[3] & 1 else "<"
            salt, sums = data[16:24], (0, 0)
            sums = _checksum(data[:24], order, sums)
            if sums != struct.unpack(">II", data[24:32]) or struct.unpack(">I", data[8:12])[0] != self.size:
                return out
            pending, at = {}, 32
            while len(frame := f.read(24 + self.size)) == 24 + self.size:
                if frame[8:16] != salt:
                    break
                sums = _checksum(frame[24:], order, _checksum(frame[:8], order, sums))
                if sums != struct.unpack(">II", frame[16:24]):
                    break
                page, commit = struct.unpack(">II", frame[:8])
                pending[page] = at + 24
                if commit:
                    out |= pending
                    pending = {}
                at += 24 + self.size
        return out

    def read(self, page: int) -> bytes:
        at = self.overlay.get(page)
        with open(self.path + "-wal" if at is not None else self.path, "rb") as f:
            f.seek((page - 1) * self.size if at is None else at)
            return f.read(self.size)

    def children(self, page: int) -> list[int]:
        data = self.read(page)
        h = 100 if page == 1 else 0
        if data[h] != 5:
            raise DialectError(f"page {page} is no inner page of a table")
        size, right = struct.unpack(">H", data[h + 3 : h + 5])[0], struct.unpack(">I", data[h + 8 : h + 12])[0]
        places = struct.unpack(f">{size}H", data[h + 12 : h + 12 + 2 * size])
        return [*(struct.unpack(">I", data[at : at + 4])[0] for at in places), right]

    def leaves(self, root: int) -> list[int]:
        """The leaves of a tree in order. All leaves are equally deep, so a level
        is known by its first page, and no other leaf is read."""
        level = [root]
        while (kind := self.read(level[0])[100 if level[0] == 1 else 0]) != 13:
            if kind != 5:
                raise DialectError(f"page {level[0]} is no table page")
            level = [c for p in level for c in self.children(p)]
        return level

    def rows(self, leaf: int) -> Iterator[tuple[int, list]]:
        data = self.read(leaf)
        h = 100 if leaf == 1 else 0
        if data[h : h + 1] != b"\x0d":
            raise DialectError(f"page {leaf} is no leaf of a table")
        for k in range(struct.unpack(">H", data[h + 3 : h + 5])[0]):
            at = struct.unpack(">H", data[h + 8 + 2 * k : h + 10 + 2 * k])[0]
            size, at = _varint(data, at)
            rowid, at = _varint(data, at)
            most = self.usable - 35
            if size <= most:
                body = data[at : at + size]
            else:
                least = (self.usable - 12) * 32 // 255 - 23
                here = least + (size - least) % (self.usable - 4)
                here = here if here <= most else least
                parts, left = [data[at : at + here]], size - here
                page = struct.unpack(">I", data[at + here : at + here + 4])[0]
                while left > 0 and page:
                    more = self.read(page)
                    page = struct.unpack(">I", more[:4])[0]
                    parts.append(more[4 : 4 + min(left, self.usable - 4)])
                    left -= len(parts[-1])
                body = b"".join(parts)
            yield rowid - (1 << 64) if rowid >> 63 else rowid, _record(body)


def _checksum(data: bytes, order: str, sums: tuple[int, int]) -> tuple[int, int]:
    a, b = sums
    words = struct.unpack(f"{order}{len(data) // 4}I", data)
    for x, y in zip(words[::2], words[1::2], strict=True):
        a = (a + x + b) & 0xFFFFFFFF
        b = (b + y + a) & 0xFFFFFFFF
    return a, b


def _varint(data: bytes, at: int) -> tuple[int, int]:
    v = 0
    for i in range(9):
        byte = data[at + i]
        if i == 8:
            return (v << 8) | byte, at + 9
        v = (v << 7) | (byte & 0x7F)
        if byte < 0x80:
            return v, at + i + 1
    return v, at


def _record(body: bytes) -> list:
    end, at = _varint(body, 0)
    kinds = []
    while at < end:
        k, at = _varint(body, at)
        kinds.append(k)
    out = []
    for k in kinds:
        if k == 0:
            out.append(None)
        elif k in (1, 2, 3, 4, 5, 6):
            n = (1, 2, 3, 4, 6, 8)[k - 1]
            out.append(int.from_bytes(body[at : at + n], "big", signed=True))
            at += n
        elif k == 7:
            out.append(struct.unpack(">d", body[at : at + 8])[0])
            at += 8
        elif k in (8, 9):
            out.append(k - 8)
        elif k >= 12:
            n = (k - 12) // 2
            raw = body[at : at + n]
            out.append(raw.decode("utf-8", "replace") if k % 2 else raw)
            at += n
        else:
            raise DialectError(f"serial type {k}")
    return out


KINDS = {"int": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(), "null": T.StringType()}


def _class(v) -> str:
    return "null" if v is None else {int: "int", float: "real", str: "text", bytes: "blob"}[type(v)]


def _as(v, cls: str):
    if v is None or _class(v) == cls:
        return v
    if cls == "real" and isinstance(v, int):
        return float(v)
    if cls == "text":
        return v.decode("utf-8", "replace") if isinstance(v, bytes) else real_text(v) if isinstance(v, float) else str(v)
    raise DialectError(f"{v!r} is no value of class {cls}: name the column's class as text")


class Leaves(InputPartition):
    def __init__(self, pages: list[int]):
        self.pages = pages


class TableReader(DataSourceReader):
    def __init__(self, path: str, root: int, classes: list[str], ipk: int):
        self.path, self.root, self.classes, self.ipk = path, root, classes, ipk

    def partitions(self) -> list[Leaves]:
        pages = Pages(self.path).leaves(self.root)
        return [Leaves(pages[i : i + LEAVES]) for i in range(0, len(pages), LEAVES)]

    def read(self, partition: Leaves) -> Iterator[tuple]:
        file = Pages(self.path)
        for leaf in partition.pages:
            for rowid, values in file.rows(leaf):
                values += [None] * (len(self.classes) - len(values))  # columns added later
                if self.ipk >= 0:
                    values[self.ipk] = rowid
                yield (*(_as(v, c) for v, c in zip(values, self.classes, strict=True)), rowid)


class ClassReader(TableReader):
    """The classes that a column's values have, once from each partition."""

    def read(self, partition: Leaves) -> Iterator[tuple]:
        file, seen = Pages(self.path), set()
        for leaf in partition.pages:
            for _, values in file.rows(leaf):
                seen |= {(i, _class(v)) for i, v in enumerate(values)}
        yield from sorted(seen)


class DbFile(DataSource):
    """``spark.read.format("dbfile").option("table", t).load(path)``.

    Columns have the class that their type declares (text without one), or that
    the option ``classes`` names in their order; a value of a class that the
    column's can't hold is an error. With ``scan`` = ``classes`` the rows are the
    columns' numbers and the classes that they hold."""

    @classmethod
    def name(cls) -> str:
        return "dbfile"

    def _table(self) -> tuple[int, list[str], list[str], int]:
        path, want = self.options["path"], self.options["table"].lower()
        for name, root, ddl in tables_of(path):
            if name == want:
                columns = table_of(ddl).columns
                ipk = next((i for i, c in enumerate(columns) if c.ipk), -1)
                classes = [x for x in self.options.get("classes", "").split(",") if x] or [_declared(c) for c in columns]
                return root, [c.name for c in columns], classes, ipk
        raise DialectError(f"no such table: {want}")

    def schema(self) -> T.StructType:
        if self.options.get("scan") == "classes":
            return T.StructType([T.StructField("i", T.IntegerType()), T.StructField("kind", T.StringType())])
        _, names, classes, _ = self._table()
        return T.StructType([*(T.StructField(x, KINDS[c]) for x, c in zip(names, classes, strict=True)), T.StructField("_rowid_", T.LongType())])

    def reader(self, schema: T.StructType) -> TableReader:
        root, _, classes, ipk = self._table()
        reader = ClassReader if self.options.get("scan") == "classes" else TableReader
        return reader(self.options["path"], root, classes, ipk)


def tables_of(path: str) -> list[tuple[str, int, str]]:
    """Name, root page and DDL of each table; other objects are left out."""
    file = Pages(path)
    rows = [v for leaf in file.leaves(1) for _, v in file.rows(leaf)]
    return [(r[1].lower(), r[3], r[4]) for r in rows if r[0] == "table" and not r[1].lower().startswith("sqlite_")]


def table_of(ddl: str) -> n.CreateTable:
    from ..parser import parse

    return parse(ddl)[0]


def _declared(column: n.ColumnDef) -> str:
    from ..operators.dml import declared

    kind = declared(column.type)
    return "int" if column.ipk else "text" if kind == "null" else kind


def settings(path: str) -> tuple[int, int]:
    """The file's user version and application id."""
    head = Pages(path).read(1)
    return struct.unpack(">i", head[60:64])[0], struct.unpack(">i", head[68:72])[0]


def read_tables(spark: SparkSession, path: str) -> Iterator[tuple[str, DataFrame, n.CreateTable]]:
    """Each table with its declaration. A column's class is that of all of its
    values, found by a distributed pass; one of several is read as text. A table
    whose declaration the dialect can't read is left out with a warning."""
    spark.dataSource.register(DbFile)
    for name, _, ddl in tables_of(path):
        try:
            table = table_of(ddl)
        except SyntaxFault as e:
            warnings.warn(f"table {name} of {path} is left out: {e}", stacklevel=2)
            continue
        source = spark.read.format("dbfile").option("table", name)
        found: dict[int, set[str]] = {}
        for r in source.option("scan", "classes").load(path).distinct().collect():  # some classes a column
            found.setdefault(r["i"], set()).add(r["kind"])
        classes = [_declared(c) if c.ipk or found.get(i, {"null"}) == {"null"} else joined(sorted(found[i])) for i, c in enumerate(table.columns)]
        yield name, spark.read.format("dbfile").option("table", name).option("classes", ",".join(classes)).load(path), table
