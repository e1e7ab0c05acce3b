"""The engine: SQL text over registered DataFrames and its own versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from veltra.dialect import parse
from veltra.dialect import tree as t
from veltra.errors import CatalogError
from veltra.operators import dml
from veltra.plans.resolve import Resolver
from veltra.plans.types import spark_type
from veltra.sources.tables import Catalog


class Engine:
    """root: folder of the engine's tables; by default a new one under Spark's warehouse. strict: the surveyed grammar only."""

    def __init__(self, spark: SparkSession, root: str | None = None, strict: bool = False):
        self.spark, self.strict = spark, strict
        self._root, self._catalog = root, None
        self.views: dict[str, DataFrame] = {}

    @property
    def catalog(self) -> Catalog:
        if self._catalog is None:
            root = self._root or f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/veltra-{uuid.uuid4().hex}"
            self._catalog = Catalog(self.spark, root)
        return self._catalog

    def register(self, name: str, df: DataFrame) -> Engine:
        """Make a DataFrame readable as a table."""
        self.views[name] = df
        return self

    def register_parquet(self, folder: str, *names: str) -> Engine:
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))
        return self

    def register_source(self, name: str, kind: str, path: str | None = None, **options: str) -> Engine:
        """Make files or a connection of one of Spark's readers (csv, json, orc, parquet, jdbc) readable as a table."""
        reader = self.spark.read.format(kind).options(**options)
        return self.register(name, reader.load(path) if path else reader.load())

    def table(self, name: tuple[str, ...] | str) -> DataFrame:
        name = name if isinstance(name, str) else name[-1]
        if name in self.views:
            return self.views[name]
        return self.catalog.table(name).read()

    def tables(self) -> list[str]:
        return sorted({*self.views, *(self.catalog.names() if self._root or self._catalog else ())})

    def sql(self, text: str) -> DataFrame | None:
        """Run a script and return the DataFrame of its last statement; None where that returns no rows."""
        out = None
        for statement in parse(text, self.strict):
            out = self.run(statement)
        return out

    def script(self, text: str) -> list[DataFrame | None]:
        return [self.run(s) for s in parse(text, self.strict)]

    def explain(self, text: str) -> str:
        """Spark's formatted plan of a query."""
        return self.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def run(self, node: t.Node) -> DataFrame | None:
        resolver = Resolver(self.spark, self.table, self.strict)
        if isinstance(node, t.Query):
            return resolver.query(node)
        if isinstance(node, t.ShowTables):
            return self.spark.createDataFrame([(n,) for n in self.tables()], "table_name string")
        if isinstance(node, t.CreateTable):
            name, schema = node.table[-1], StructType([StructField(c, spark_type(k)) for c, k in node.columns])
            if len(set(schema.names)) < len(schema.names):
                raise CatalogError(f"a column of '{name}' is named twice")
            if name in self.views:
                raise CatalogError(f"table '{name}' already exists")
            self.catalog.table(name).create(schema)
            return None
        if isinstance(node, t.Drop):
            for name in (n[-1] for n in node.tables):
                if self.views.pop(name, None) is None:
                    table = self.catalog.table(name)
                    if table.exists() or not node.if_exists:
                        table.drop()
            return None
        name = node.table[-1]
        if name in self.views:
            raise CatalogError(f"'{name}' is a registered DataFrame and can't be changed")
        table = self.catalog.table(name)
        if isinstance(node, t.Insert):
            table.append(dml.inserted(resolver, table, node))
        elif isinstance(node, t.Update):
            dml.update(resolver, table, node)
        else:
            dml.delete(resolver, table, node)
        return None
