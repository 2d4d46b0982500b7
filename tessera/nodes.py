"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Literal:
    value: Any  # None, int, float, str, bytes, bool


@dataclass
class Ref:
    name: str
    qualifier: str | None = None


@dataclass
class Star:
    qualifier: str | None = None


@dataclass
class Unary:
    op: str
    arg: Any


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class IsTruth:
    arg: Any
    truth: bool
    negated: bool


@dataclass
class Between:
    arg: Any
    low: Any
    high: Any
    negated: bool


@dataclass
class InList:
    arg: Any
    items: list
    negated: bool


@dataclass
class InQuery:
    arg: Any
    query: Any
    negated: bool


@dataclass
class Exists:
    query: Any


@dataclass
class Scalar:
    query: Any


@dataclass
class Match:
    op: str  # like, glob
    arg: Any
    pattern: Any
    escape: Any
    negated: bool


@dataclass
class Case:
    operand: Any
    whens: list
    other: Any


@dataclass
class Cast:
    arg: Any
    type: str


@dataclass
class Collate:
    arg: Any
    name: str


@dataclass
class Call:
    name: str
    args: list
    distinct: bool = False
    star: bool = False


@dataclass
class Item:
    expr: Any
    alias: str | None
    text: str


@dataclass
class Order:
    expr: Any
    desc: bool
    nulls: str | None


@dataclass
class Source:
    kind: str  # table, query, values
    body: Any
    alias: str | None
    join: str = "first"  # first, comma, inner, cross, left
    on: Any = None


@dataclass
class Select:
    items: list
    distinct: bool = False
    sources: list = field(default_factory=list)
    where: Any = None
    group: list = field(default_factory=list)
    having: Any = None


@dataclass
class Values:
    rows: list


@dataclass
class Query:
    """A chain of cores with set operators, and what stands around it."""

    ctes: list  # (name, columns, Query)
    cores: list
    ops: list
    order: list = field(default_factory=list)
    limit: Any = None
    offset: Any = None


@dataclass
class ColumnDef:
    name: str
    type: str
    ipk: bool = False
    not_null: bool = False
    collation: str = "binary"
    check: Any = None


@dataclass
class CreateTable:
    name: str
    columns: list
    sql: str = ""  # the statement as it was given


@dataclass
class Insert:
    table: str
    columns: list | None
    query: Any  # Query or None for DEFAULT VALUES
    action: str = "abort"
    returning: list | None = None
    ctes: list = field(default_factory=list)


@dataclass
class Update:
    table: str
    sets: list
    where: Any
    action: str = "abort"
    returning: list | None = None
    ctes: list = field(default_factory=list)


@dataclass
class Delete:
    table: str
    where: Any
    returning: list | None = None
    ctes: list = field(default_factory=list)


@dataclass
class Transaction:
    verb: str
    name: str | None = None


@dataclass
class Pragma:
    name: str
    value: Any = None
