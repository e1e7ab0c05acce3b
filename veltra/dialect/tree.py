"""Syntax trees: frozen, so equal expressions compare equal."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Name(Node):
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Literal(Node):
    kind: str  # integer, long, decimal, string, boolean, null
    value: object = None


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Nested(Node):
    inner: Node


@dataclass(frozen=True)
class Is(Node):
    operand: Node
    what: str  # NULL, TRUE, FALSE
    negated: bool


@dataclass(frozen=True)
class DataType(Node):
    name: str
    numbers: tuple[int, ...] = ()


@dataclass(frozen=True)
class Cast(Node):
    operand: Node
    type: DataType
    safe: bool


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case(Node):
    operand: Node | None
    branches: tuple[tuple[Node, Node], ...]
    default: Node | None


@dataclass(frozen=True)
class InList(Node):
    operand: Node
    items: tuple[Node, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery(Node):
    operand: Node
    query: Query
    negated: bool


@dataclass(frozen=True)
class Exists(Node):
    query: Query


@dataclass(frozen=True)
class ScalarQuery(Node):
    query: Query


@dataclass(frozen=True)
class Between(Node):
    operand: Node
    low: Node
    high: Node
    negated: bool


@dataclass(frozen=True)
class Match(Node):
    operand: Node
    pattern: Node
    regexp: bool
    negated: bool


@dataclass(frozen=True)
class Index(Node):
    operand: Node
    index: Node


@dataclass(frozen=True)
class Star(Node):
    qualifier: str | None = None


@dataclass(frozen=True)
class Item(Node):
    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class Relation(Node):
    name: tuple[str, ...] | None
    query: Query | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Join(Node):
    kind: str  # inner, left, right, full, cross, left_semi, left_anti
    left: Node
    right: Node
    on: Node | None = None
    using: tuple[str, ...] = ()
    natural: bool = False


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Item, ...]
    source: Node | None
    where: Node | None = None
    group: tuple[Node, ...] = ()
    grouping: str = ""  # "", ROLLUP, CUBE, SETS
    having: Node | None = None
    distinct: bool = False
    sets: tuple[tuple[int, ...], ...] = ()  # of GROUPING SETS: places in group


@dataclass(frozen=True)
class Values(Node):
    rows: tuple[tuple[Node, ...], ...]


@dataclass(frozen=True)
class SetOperation(Node):
    op: str
    all: bool
    left: Node
    right: Node


@dataclass(frozen=True)
class Order(Node):
    expr: Node
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Query(Node):
    body: Node
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None
    ctes: tuple[tuple[str, Query], ...] = ()


@dataclass(frozen=True)
class Insert(Node):
    table: tuple[str, ...]
    columns: tuple[str, ...]
    query: Query


@dataclass(frozen=True)
class Update(Node):
    table: tuple[str, ...]
    changes: tuple[tuple[str, Node], ...]
    where: Node | None


@dataclass(frozen=True)
class Delete(Node):
    table: tuple[str, ...]
    where: Node | None


@dataclass(frozen=True)
class CreateTable(Node):
    table: tuple[str, ...]
    columns: tuple[tuple[str, DataType], ...]


@dataclass(frozen=True)
class Drop(Node):
    tables: tuple[tuple[str, ...], ...]
    if_exists: bool = False


@dataclass(frozen=True)
class ShowTables(Node):
    pass
