"""Versioned tables on Parquet: data folders, and a manifest per version that lists a version's folders.

A write first adds its folder and then creates the next manifest, which fails if another writer was faster; readers take
the newest manifest, or an older one to see a snapshot. Nothing that a reader may hold is changed in place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veltra.errors import CatalogError
from veltra.sources.files import Files


class Table:
    def __init__(self, spark: SparkSession, root: str, name: str, write_options: dict[str, str] | None = None):
        self.spark, self.name, self.files = spark, name, Files(spark, f"{root.rstrip('/')}/{name}")
        self.options = write_options or {}

    def versions(self) -> list[int]:
        return [int(f[:-5]) for f in self.files.list("manifests") if f.endswith(".json") and f[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise CatalogError(f"table '{self.name}' not found")
        version = known[-1] if version is None else version
        if version not in known:
            raise CatalogError(f"table '{self.name}' has no version {version}")
        return json.loads(self.files.read(f"manifests/{version:020d}.json")) | {"version": version}

    def create(self, schema: StructType) -> None:
        if not self.files.create(f"manifests/{0:020d}.json", json.dumps({"schema": schema.jsonValue(), "folders": []}).encode()):
            raise CatalogError(f"table '{self.name}' already exists")

    def exists(self) -> bool:
        return bool(self.versions())

    def drop(self) -> None:
        self.manifest()
        self.files.remove("")

    def schema(self) -> StructType:
        return StructType.fromJson(self.manifest()["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = StructType.fromJson(m["schema"])
        paths = self.paths(m)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.files.root}/{f}" for f in paths])

    def paths(self, manifest: dict) -> list[str]:
        """A version's folders; of those that have lost files to a later version the files that are left."""
        gone = set(manifest.get("gone", []))
        touched = {f.rsplit("/", 1)[0] for f in gone}
        out = []
        for folder in manifest["folders"]:
            if folder in touched:
                out += [f"{folder}/{f}" for f in self.files.list(folder) if f.endswith(".parquet") and f"{folder}/{f}" not in gone]
            else:
                out.append(folder)
        return out

    def files_with(self, condition: Column) -> list[str]:
        """The files, relative to the table, that hold a row for which condition holds: names only, as many as a manifest may list."""
        rows = self.read().where(condition).select(F.col("_metadata.file_path").alias("f")).distinct().collect() if self.paths(self.manifest()) else []
        return sorted("data/" + unquote(r["f"]).rsplit("/data/", 1)[1] for r in rows)

    def rewrite(self, files: list[str], change: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the rows of some files by what change makes of them; the other files stay as they are."""
        before = self.manifest()
        if not files:
            return before["version"]
        rows = change(self.spark.read.schema(StructType.fromJson(before["schema"])).parquet(*[f"{self.files.root}/{f}" for f in files]))
        return self._commit(rows, True, {"gone": sorted({*before.get("gone", []), *files})}, before)

    def clear(self, **extra) -> int:
        """A version without rows; no data is written."""
        return self._commit(None, False, extra)

    def note(self, **extra) -> int:
        """A version with the same rows and other remarks."""
        return self._commit(None, True, extra)

    def _commit(self, df: DataFrame | None, keep: bool, extra: dict | None = None, before: dict | None = None) -> int:
        before = before or self.manifest()
        folder = f"data/{uuid.uuid4().hex}"
        if df is not None:
            df.write.options(**self.options).parquet(f"{self.files.root}/{folder}")
        folders = ([*before["folders"]] if keep else []) + ([folder] if df is not None else [])
        after = {k: v for k, v in before.items() if k != "version"} | {"folders": folders} | ({} if keep else {"gone": []}) | (extra or {})
        if not self.files.create(f"manifests/{before['version'] + 1:020d}.json", json.dumps(after).encode()):
            self.files.remove(folder)
            raise CatalogError(f"table '{self.name}' was changed by another writer")
        return before["version"] + 1

    def append(self, df: DataFrame, **extra) -> int:
        return self._commit(df, True, extra)

    def replace(self, df: DataFrame, **extra) -> int:
        return self._commit(df, False, extra)


class Catalog:
    """The tables under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    def table(self, name: str) -> Table:
        return Table(self.spark, self.root, name)

    def names(self) -> list[str]:
        return [n for n in self.files.list() if self.table(n).exists()]
