"""Storage classes of expressions, and how Spark's types map to them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import DatatypeMismatch


@dataclass
class E:
    """An expression: Spark SQL text, its storage class, the collation that it
    carries (explicit ones win), for a literal its value, and whether it is a
    column of reals whose negative zeros keep their sign as text."""

    sql: str
    cls: str  # int, real, text, blob, null, bool, ts, any
    coll: str | None = None
    explicit: bool = False
    value: object = None
    literal: bool = False
    signed: bool = False


@dataclass
class Col:
    name: str
    cls: str
    coll: str = "binary"
    signed: bool = False


@dataclass
class TableMeta:
    """A table of the catalog: a Spark view, its columns, and the columns whose
    order is the order of insertion."""

    name: str
    view: str
    columns: list[Col]
    rowid: list[str] = field(default_factory=list)
    ipk: str | None = None
    defs: list = field(default_factory=list)
    sql: str = ""
    parts: int = 1  # snapshots that the view reads


def class_of(kind: T.DataType) -> str:
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "real"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(kind, T.BinaryType):
        return "blob"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "ts"
    return "null" if isinstance(kind, T.NullType) else "any"


SPARK = {"int": "BIGINT", "real": "DOUBLE", "text": "STRING", "blob": "BINARY", "null": "STRING", "bool": "BIGINT", "ts": "TIMESTAMP_NTZ"}


def joined(classes: list[str]) -> str:
    """The class that holds values of all ``classes``: integers and reals meet
    in real, anything else in text (a mixed column is rendered as text)."""
    kinds = {("int" if c == "bool" else c) for c in classes} - {"null"}
    if not kinds:
        return "null"
    if len(kinds) == 1:
        return kinds.pop()
    if kinds == {"int", "real"}:
        return "real"
    if "any" in kinds:
        raise DatatypeMismatch("nested columns can't be mixed")
    return "text"
