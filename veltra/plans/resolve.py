"""Names, types and clauses of a query to DataFrame operations; Catalyst does the rest.

Every relation's columns get names of their own inside a query, so that self-joins and equal names are told apart by the
scope and not by Spark. Column pruning removes what a query doesn't use. The order of clauses is scan, join, filter,
aggregate, projection, sort, offset and limit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, is_dataclass, replace
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veltra.dialect import tree as t
from veltra.errors import PlannerError
from veltra.plans.types import cast_type

#: Aggregates by name; further names of Spark's own are taken as they are.
AGGREGATES = frozenset(
    "SUM COUNT MIN MAX AVG STDDEV STDDEV_POP STDDEV_SAMP VARIANCE VAR_POP VAR_SAMP APPROX_COUNT_DISTINCT COLLECT_LIST COLLECT_SET "
    "FIRST LAST ANY_VALUE BOOL_AND BOOL_OR MEDIAN MODE CORR COVAR_POP COVAR_SAMP MAX_BY MIN_BY COUNT_IF PERCENTILE_APPROX GROUPING "
    "GROUPING_ID APPROX_PERCENTILE PERCENTILE EVERY SOME STD SKEWNESS KURTOSIS REGR_COUNT REGR_SLOPE REGR_INTERCEPT REGR_R2 BIT_AND BIT_OR "
    "BIT_XOR HISTOGRAM_NUMERIC ARRAY_AGG LISTAGG STRING_AGG HLL_SKETCH_AGG".split()
)
NUMBERS = count()


@dataclass(frozen=True)
class Ref(t.Node):
    """A resolved column by its name inside the query."""

    column: str


@dataclass(frozen=True)
class Outer(t.Node):
    """A column of an enclosing query."""

    column: str


@dataclass(frozen=True)
class Inner(t.Node):
    """A subquery with the names that it sees around it."""

    node: t.Node
    scopes: tuple


@dataclass(frozen=True)
class Entry:
    qualifier: str | None
    name: str
    column: str


class Scope:
    def __init__(self, entries: list[Entry]):
        self.entries = entries

    def find(self, parts: tuple[str, ...]) -> str:
        name, qualifier = parts[-1], parts[-2] if len(parts) > 1 else None
        found = [e for e in self.entries if e.name == name and (qualifier is None or e.qualifier == qualifier)]
        if not found:
            raise PlannerError(f"column '{'.'.join(parts)}' not found")
        if len({e.column for e in found}) > 1:
            raise PlannerError(f"column '{'.'.join(parts)}' is ambiguous")
        return found[0].column

    def __add__(self, other: Scope) -> Scope:
        return Scope(self.entries + other.entries)


def rebuild(node, change: Callable):
    """node with change applied to every node from the top; where change returns a node, it isn't entered."""
    if isinstance(node, tuple):
        return tuple(rebuild(x, change) for x in node)
    if not is_dataclass(node):
        return node
    new = change(node)
    if new is not None:
        return new
    return replace(node, **{f.name: rebuild(getattr(node, f.name), change) for f in fields(node)})


def is_aggregate(node) -> bool:
    return isinstance(node, t.Call) and node.name in AGGREGATES


def aggregates(node) -> list[t.Call]:
    found: list[t.Call] = []

    def visit(x):
        if is_aggregate(x):
            found.append(x)
            return x
        return x if isinstance(x, t.Query) else None

    rebuild(node, visit)
    return found


def plain(node):
    """Without parentheses."""
    return rebuild(node, lambda x: plain(x.inner) if isinstance(x, t.Nested) else None)


class Resolver:
    def __init__(self, spark: SparkSession, table: Callable[[tuple[str, ...]], DataFrame], strict: bool = False):
        self.spark, self.table, self.strict = spark, table, strict
        self.ctes: dict[str, DataFrame] = {}
        #: Scopes of the enclosing queries, the nearest last.
        self.around: tuple[Scope, ...] = ()

    # -- expressions
    def bind(self, node, scope: Scope):
        """Names to Refs; names that only an enclosing query has to Outers."""

        def change(x):
            if isinstance(x, t.Name):
                return self.named(x.parts, scope)
            if isinstance(x, (t.Exists, t.ScalarQuery)):
                return Inner(x, (*self.around, scope))
            if isinstance(x, t.InQuery):
                return Inner(replace(x, operand=self.bind(x.operand, scope)), (*self.around, scope))
            return x if isinstance(x, (t.Query, Ref, Outer, Inner)) else None

        return rebuild(plain(node), change)

    def named(self, parts: tuple[str, ...], scope: Scope) -> Ref | Outer:
        try:
            return Ref(scope.find(parts))
        except PlannerError:
            # Spark correlates with the query just outside.
            if not self.around or not any(e.name == parts[-1] for e in self.around[-1].entries):
                raise
            return Outer(self.around[-1].find(parts))

    def inside(self, query: t.Query, scopes: tuple) -> DataFrame:
        before, self.around = self.around, scopes
        try:
            return self.query(query)
        finally:
            self.around = before

    def found_in(self, x: t.InQuery, scopes: tuple) -> Column:
        """IN of a subquery as a value: unknown where the operand or, without a match, a row of the subquery is null."""
        operand = self.column(x.operand)
        rows, names = self.scan(self.inside(x.query, scopes), None)
        if len(names.entries) != 1:
            raise PlannerError("a subquery of IN has one column")
        value = F.col(f"`{names.entries[0].column}`")
        outer = self.column(rebuild(x.operand, lambda n: Outer(n.column) if isinstance(n, Ref) else None))
        hit = F.when(rows.where(value == outer).exists(), F.lit(True)).when(operand.isNull() & rows.exists(), F.lit(None)).when(rows.where(value.isNull()).exists(), F.lit(None)).otherwise(F.lit(False))
        return ~hit if x.negated else hit

    def column(self, x) -> Column:
        """A bound expression as a Column."""
        c = self.column
        match x:
            case Ref(name):
                return F.col(f"`{name}`")
            case t.Literal("integer", v):
                return F.lit(v)
            case t.Literal("long", v):
                return F.lit(v).cast("bigint")
            case t.Literal("decimal", v):
                return F.lit(float(v))
            case t.Literal("null", _):
                return F.lit(None)
            case t.Literal(_, v):
                return F.lit(v)
            case t.Binary(op, left, right):
                return self.binary(op, c(left), c(right))
            case t.Unary("NOT", e):
                return ~c(e)
            case t.Unary("-", e):
                return -c(e)
            case t.Unary("+", e):
                return c(e)
            case t.Is(e, "NULL", negated):
                return c(e).isNotNull() if negated else c(e).isNull()
            case t.Is(e, what, negated):
                same = F.equal_null(c(e).cast("boolean"), F.lit(what == "TRUE"))
                return ~same if negated else same
            case t.Cast(e, kind, safe):
                target = cast_type(kind, self.strict)
                return c(e).try_cast(target) if safe else c(e).cast(target)
            case t.Case(operand, branches, default):
                out = None
                for condition, value in branches:
                    test = c(condition) if operand is None else c(operand) == c(condition)
                    out = F.when(test, c(value)) if out is None else out.when(test, c(value))
                return out if default is None else out.otherwise(c(default))
            case t.InList(e, items, negated):
                found = c(e).isin(*[c(i) for i in items])
                return ~found if negated else found
            case t.Between(e, low, high, negated):
                inside = (c(e) >= c(low)) & (c(e) <= c(high))
                return ~inside if negated else inside
            case t.Match(e, pattern, regexp, negated):
                hit = F.regexp(c(e), c(pattern)) if regexp else F.like(c(e), c(pattern))
                return ~hit if negated else hit
            case t.Index(e, index):
                return c(e)[c(index)]
            case Outer(name):
                return F.col(f"`{name}`").outer()
            case Inner(t.ScalarQuery(query), scopes):
                return self.inside(query, scopes).scalar()
            case Inner(t.Exists(query), scopes):
                return self.inside(query, scopes).exists()
            case Inner(t.InQuery() as query, scopes):
                return self.found_in(query, scopes)
            case t.Call():
                return self.call(x)
        raise PlannerError(f"unsupported expression {type(x).__name__}")

    @staticmethod
    def binary(op: str, a: Column, b: Column) -> Column:
        match op:
            case "+":
                return a + b
            case "-":
                return a - b
            case "*":
                return a * b
            case "/":
                return a / b
            case "%":
                return a % b
            case "||":
                return F.concat(a, b)
            case "=":
                return a == b
            case "<>":
                return a != b
            case "<":
                return a < b
            case "<=":
                return a <= b
            case ">":
                return a > b
            case ">=":
                return a >= b
            case "AND":
                return a & b
            case "OR":
                return a | b
            case "XOR":
                return a.cast("boolean") != b.cast("boolean")
            case "|":
                return a.bitwiseOR(b)
            case "&":
                return a.bitwiseAND(b)
            case "^":
                return a.bitwiseXOR(b)
        raise PlannerError(f"unsupported operator {op}")

    def call(self, x: t.Call) -> Column:
        args = [self.column(a) for a in x.args]
        if x.star or x.name == "COUNT" and not args:
            if x.name != "COUNT":
                raise PlannerError(f"{x.name}(*) is not supported")
            return F.count(F.lit(1))
        if x.distinct:
            if x.name == "COUNT":
                return F.count_distinct(*args)
            if x.name == "SUM":
                return F.sum_distinct(*args)
            if x.name == "AVG":
                return F.sum_distinct(*args) / F.count_distinct(*args)
            if x.name not in ("MIN", "MAX"):
                raise PlannerError(f"{x.name}(DISTINCT) is not supported")
        if x.name == "IF":
            return F.when(args[0], args[1]).otherwise(args[2] if len(args) > 2 else F.lit(None))
        return F.call_function(x.name.lower(), *args)

    # -- relations
    def scan(self, df: DataFrame, qualifier: str | None) -> tuple[DataFrame, Scope]:
        entries = [Entry(qualifier, name, f"{name}#{next(NUMBERS)}") for name in df.columns]
        return df.toDF(*[e.column for e in entries]), Scope(entries)

    def source(self, node) -> tuple[DataFrame, Scope]:
        if isinstance(node, t.Relation):
            if node.query is not None:
                return self.scan(self.query(node.query), node.alias)
            if len(node.name) == 1 and node.name[0] in self.ctes:
                return self.scan(self.ctes[node.name[0]], node.alias or node.name[0])
            return self.scan(self.table(node.name), node.alias or node.name[-1])
        (left, a), (right, b) = self.source(node.left), self.source(node.right)
        if node.kind == "cross":
            return left.crossJoin(right), a + b
        using = node.using
        if node.natural:
            names = {e.name for e in b.entries}
            using = tuple(dict.fromkeys(e.name for e in a.entries if e.name in names))
            if not using:
                raise PlannerError("a natural join needs a common column")
        if using:
            pairs = [(a.find((n,)), b.find((n,))) for n in using]
            on = None
            for x, y in pairs:
                test = F.col(f"`{x}`") == F.col(f"`{y}`")
                on = test if on is None else on & test
            joined = left.join(right, on, node.kind)
            if node.kind in ("left_semi", "left_anti"):
                return joined, a
            keys = []
            for name, (x, y) in zip(using, pairs):
                key = f"{name}#{next(NUMBERS)}"
                joined = joined.withColumn(key, F.coalesce(F.col(f"`{x}`"), F.col(f"`{y}`")))
                keys.append(Entry(None, name, key))
            used = {c for pair in pairs for c in pair}
            return joined, Scope(keys + [e for e in a.entries + b.entries if e.column not in used])
        both = a + b
        if self.strict and not (isinstance(plain(node.on), t.Binary) and plain(node.on).op == "="):
            raise PlannerError("a join condition must be one equality")
        joined = left.join(right, self.column(self.bind(node.on, both)), node.kind)
        return joined, a if node.kind in ("left_semi", "left_anti") else both

    def filtered(self, df: DataFrame, scope: Scope, where) -> DataFrame:
        """IN subqueries among the conditions become semi and anti joins."""
        rest = []

        def conditions(x):
            x = x.inner if isinstance(x, t.Nested) else x
            if isinstance(x, t.Binary) and x.op == "AND":
                return conditions(x.left) + conditions(x.right)
            return [x]

        for x in conditions(where):
            if isinstance(x, t.Unary) and x.op == "NOT" and isinstance(plain(x.operand), t.InQuery):
                inner = plain(x.operand)
                x = replace(inner, negated=not inner.negated)
            if isinstance(x, t.InQuery) and self.correlated(x.query, scope):
                x = self.as_exists(x, scope)
            if isinstance(x, t.InQuery):
                right, names = self.scan(self.inside(x.query, (*self.around, scope)), None)
                if len(names.entries) != 1:
                    raise PlannerError("a subquery of IN has one column")
                value, operand = F.col(f"`{names.entries[0].column}`"), self.column(self.bind(x.operand, scope))
                if x.negated:
                    # Nulls apart, so that the join itself is an equality: a row of nulls lets nothing pass, no rows let all pass.
                    some, nulls = right.limit(1).agg(F.count(F.lit(1))).scalar(), right.where(value.isNull()).limit(1).agg(F.count(F.lit(1))).scalar()
                    df = df.where((some == 0) | (operand.isNotNull() & (nulls == 0)))
                df = df.join(right, operand == value, "left_anti" if x.negated else "left_semi")
            else:
                rest.append(self.column(self.bind(x, scope)))
        for condition in rest:
            df = df.where(condition)
        return df

    def correlated(self, query: t.Query, scope: Scope) -> bool:
        """Whether a subquery uses a name of the query around it; found by resolving it."""
        seen: list[bool] = []
        named = self.named
        self.named = lambda parts, own: seen.append(isinstance(out := named(parts, own), Outer)) or out
        try:
            self.inside(query, (*self.around, scope))
        finally:
            del self.named
        return any(seen)

    def as_exists(self, x: t.InQuery, scope: Scope) -> t.Node:
        """A condition that holds where IN of a correlated subquery is true."""
        body = x.query.body
        if not isinstance(body, t.Select) or body.group or body.having is not None or x.query.limit is not None or x.query.offset is not None or len(body.items) != 1 or aggregates(body.items[0].expr):
            raise PlannerError("a correlated subquery of IN selects one column of rows")
        operand = rebuild(self.bind(x.operand, scope), lambda n: Outer(n.column) if isinstance(n, Ref) else None)
        value = body.items[0].expr
        test: t.Node = t.Binary("=", value, operand)
        if x.negated:
            test = t.Binary("OR", test, t.Binary("OR", t.Is(value, "NULL", False), t.Is(operand, "NULL", False)))
        found = t.Exists(replace(x.query, body=replace(body, where=test if body.where is None else t.Binary("AND", body.where, test)), order=()))
        return t.Unary("NOT", found) if x.negated else found

    # -- queries
    def query(self, q: t.Query) -> DataFrame:
        outer = dict(self.ctes)
        for name, inner in q.ctes:
            self.ctes[name] = self.query(inner)
        try:
            df = self.body(q.body, q.order)
        finally:
            self.ctes = outer
        if q.offset is not None:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df

    def body(self, node, order: tuple[t.Order, ...]) -> DataFrame:
        if isinstance(node, t.Select):
            return self.select(node, order)
        if isinstance(node, t.Query):
            df = self.query(node)
        elif isinstance(node, t.Values):
            df = self.values(node)
        else:
            left, right = self.body(node.left, ()), self.body(node.right, ())
            if len(left.columns) != len(right.columns):
                raise PlannerError("set operations need as many columns on both sides")
            right = right.toDF(*[f"{c}#{i}" for i, c in enumerate(right.columns)])
            match node.op, node.all:
                case "UNION", True:
                    df = left.union(right)
                case "UNION", False:
                    df = left.union(right).distinct()
                case "EXCEPT", every:
                    df = left.exceptAll(right) if every else left.subtract(right)
                case _, every:
                    df = left.intersectAll(right) if every else left.intersect(right)
        if order:
            scope = Scope([Entry(None, c, c) for c in df.columns])
            df = df.orderBy(*[self.sort(o, self.column(self.ordinal(o.expr, [Ref(c) for c in df.columns]) or self.bind(o.expr, scope))) for o in order])
        return df

    def values(self, node: t.Values) -> DataFrame:
        """One row or several, with columns column_0, column_1 and so on."""
        width = len(node.rows[0])
        if any(len(row) != width for row in node.rows):
            raise PlannerError("rows of VALUES differ in length")
        rows = [F.struct(*[self.column(self.bind(x, Scope([]))).alias(f"column_{i}") for i, x in enumerate(row)]) for row in node.rows]
        return self.spark.range(1).select(F.inline(F.array(*rows)))

    @staticmethod
    def sort(o: t.Order, c: Column) -> Column:
        if o.nulls_first is None:
            return c.desc() if o.descending else c.asc()
        return {(False, True): c.asc_nulls_first, (False, False): c.asc_nulls_last, (True, True): c.desc_nulls_first, (True, False): c.desc_nulls_last}[o.descending, o.nulls_first]()

    def ordinal(self, node, outputs: list):
        if isinstance(node, t.Literal) and node.kind == "integer" and not self.strict:
            if not 1 <= node.value <= len(outputs):
                raise PlannerError(f"there is no column {node.value}")
            return outputs[node.value - 1]
        return None

    def select(self, s: t.Select, order: tuple[t.Order, ...]) -> DataFrame:
        df, scope = self.source(s.source) if s.source is not None else (self.spark.range(1).select(), Scope([]))
        if s.where is not None:
            df = self.filtered(df, scope, s.where)
        items: list[tuple[object, str]] = []
        for i, item in enumerate(s.items):
            if isinstance(item.expr, t.Star):
                chosen = [e for e in scope.entries if item.expr.qualifier in (None, e.qualifier)]
                if not chosen:
                    raise PlannerError("* has no columns to stand for")
                items += [(Ref(e.column), e.name) for e in chosen]
            else:
                items.append((self.bind(item.expr, scope), item.alias or self.title(item.expr, i)))
        aliases = {item.alias: expr for item, (expr, _) in zip(s.items, items) if item.alias} if not any(isinstance(i.expr, t.Star) for i in s.items) else {n: e for e, n in items}
        outputs = [e for e, _ in items]

        def order_expr(o: t.Order):
            out = self.ordinal(o.expr, outputs)
            if out is not None:
                return out
            name = plain(o.expr)
            if isinstance(name, t.Name) and len(name.parts) == 1 and name.parts[0] in aliases:
                return aliases[name.parts[0]]
            known = {e.name for e in scope.entries}
            change = lambda x: aliases[x.parts[0]] if isinstance(x, t.Name) and len(x.parts) == 1 and x.parts[0] in aliases and x.parts[0] not in known else None
            return self.bind(rebuild(name, change), scope)

        sorts = [(o, order_expr(o)) for o in order]
        having = None if s.having is None else self.bind(rebuild(plain(s.having), lambda x: aliases[x.parts[0]] if isinstance(x, t.Name) and len(x.parts) == 1 and x.parts[0] in aliases and x.parts[0] not in {e.name for e in scope.entries} else None), scope)
        found = [a for e in [*outputs, having, *[e for _, e in sorts]] if e is not None for a in aggregates(e)]
        if s.group or found or having is not None:
            keys = []
            for g in s.group:
                key = self.ordinal(g, outputs)
                if key is None and isinstance(g, t.Name) and len(g.parts) == 1 and g.parts[0] in aliases and g.parts[0] not in {e.name for e in scope.entries}:
                    key = aliases[g.parts[0]]
                keys.append(key if key is not None else self.bind(g, scope))
            key_names = {key: f"key#{next(NUMBERS)}" for key in dict.fromkeys(keys)}
            agg_names = {a: f"agg#{next(NUMBERS)}" for a in dict.fromkeys(found)}
            columns = [self.column(k).alias(n) for k, n in key_names.items()]
            results = [self.column(replace(a, args=tuple(Ref(key_names[x]) if x in key_names else x for x in a.args)) if a.name in ("GROUPING", "GROUPING_ID") else a).alias(n) for a, n in agg_names.items()]
            if s.grouping:
                df = df.select("*", *columns)
                columns = [F.col(f"`{n}`") for n in key_names.values()]
            if not columns and results:
                df = df.select(*results)
            else:
                if s.grouping == "SETS":
                    grouped = df.groupingSets([[F.col(f"`{key_names[keys[i]]}`") for i in one] for one in s.sets], *columns)
                else:
                    grouped = {"ROLLUP": df.rollup, "CUBE": df.cube}.get(s.grouping, df.groupBy)(*columns)
                df = grouped.agg(*results) if results else grouped.agg(F.lit(1).alias("one#")).drop("one#")
            known = set(key_names.values()) | set(agg_names.values())

            def after(x):
                if x in key_names:
                    return Ref(key_names[x])
                if x in agg_names:
                    return Ref(agg_names[x])
                if isinstance(x, Ref) and x.column not in known:
                    raise PlannerError(f"column '{x.column.split('#')[0]}' must be grouped or aggregated")
                return x if isinstance(x, t.Query) else None

            items = [(rebuild(e, after), n) for e, n in items]
            sorts = [(o, rebuild(e, after)) for o, e in sorts]
            if having is not None:
                df = df.where(self.column(rebuild(having, after)))
        columns = [self.column(e).alias(n) for e, n in items]
        if s.distinct:
            df = df.select(*columns)
            positions = {e: n for e, n in items}
            if any(e not in positions for _, e in sorts):
                raise PlannerError("ORDER BY of a DISTINCT query can only use its columns")
            df = df.distinct()
            return df.orderBy(*[self.sort(o, F.col(f"`{positions[e]}`")) for o, e in sorts]) if sorts else df
        if sorts:
            df = df.orderBy(*[self.sort(o, self.column(e)) for o, e in sorts])
        return df.select(*columns)

    @staticmethod
    def title(node, i: int) -> str:
        node = plain(node)
        if isinstance(node, t.Name):
            return node.parts[-1]
        if isinstance(node, t.Call):
            return node.name.lower()
        return f"column_{i}"
