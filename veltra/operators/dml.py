"""INSERT, UPDATE and DELETE on versioned tables, copy-on-write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltra.dialect import tree as t
from veltra.errors import PlannerError
from veltra.plans.resolve import Entry, Resolver, Scope, plain
from veltra.plans.types import fits
from veltra.sources.tables import Table


def inserted(resolver: Resolver, table: Table, node: t.Insert) -> DataFrame:
    """The rows that an INSERT adds, in the table's columns. Columns that aren't named are null."""
    schema = table.schema()
    names = list(node.columns) or schema.names
    for name in names:
        if name not in schema.names:
            raise PlannerError(f"column '{name}' not found")
    if len(set(names)) < len(names):
        raise PlannerError("a column is named twice")
    body = node.query.body
    if isinstance(body, t.Values):
        for row in body.rows:
            if len(row) != len(names):
                raise PlannerError(f"Column count mismatch: expected {len(names)}, got {len(row)}")
            for name, value in zip(names, row):
                value = plain(value)
                if isinstance(value, t.Literal) and not fits(value, schema[name].dataType, resolver.strict):
                    raise PlannerError(f"Type mismatch for column '{name}': {value.kind} does not fit {schema[name].dataType.simpleString()}")
        rows = resolver.values(body)
    else:
        rows = resolver.query(node.query)
        if len(rows.columns) != len(names):
            raise PlannerError(f"Column count mismatch: expected {len(names)}, got {len(rows.columns)}")
    rows = rows.toDF(*[f"in#{i}" for i in range(len(names))])
    place = {name: f"`in#{i}`" for i, name in enumerate(names)}
    return rows.select(*[(F.col(place[f.name]) if f.name in place else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def update(resolver: Resolver, table: Table, node: t.Update) -> None:
    """Every right-hand side sees the old row, and only a true condition matches. Files without such a row stay."""
    schema = table.schema()
    scope, changes = Scope([Entry(table.name, c, c) for c in schema.names]), dict(node.changes)
    for name in changes:
        if name not in schema.names:
            raise PlannerError(f"column '{name}' not found")
        value = plain(changes[name])
        if isinstance(value, t.Literal) and not fits(value, schema[name].dataType, resolver.strict):
            raise PlannerError(f"Type mismatch for column '{name}': {value.kind} does not fit {schema[name].dataType.simpleString()}")
    hit = F.lit(True) if node.where is None else F.coalesce(resolver.column(resolver.bind(node.where, scope)), F.lit(False))
    value = lambda f: F.when(hit, resolver.column(resolver.bind(changes[f.name], scope)).cast(f.dataType)).otherwise(F.col(f"`{f.name}`"))
    out = [(value(f) if f.name in changes else F.col(f"`{f.name}`")).alias(f.name) for f in schema.fields]
    if node.where is None:
        table.replace(table.read().select(*out))
    else:
        table.rewrite(table.files_with(hit), lambda df: df.select(*out))


def delete(resolver: Resolver, table: Table, node: t.Delete) -> None:
    """Rows for which the condition is true go. Files without such a row stay; without a condition nothing is written."""
    if node.where is None:
        table.clear()
        return
    hit = F.coalesce(resolver.column(resolver.bind(node.where, Scope([Entry(table.name, c, c) for c in table.schema().names]))), F.lit(False))
    table.rewrite(table.files_with(hit), lambda df: df.where(~hit))
