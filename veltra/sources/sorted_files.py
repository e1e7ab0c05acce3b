"""Sorted key files: Parquet with range partitions, sorted rows, and Bloom filters on the key.

Row-group statistics stand for the block index, the filter answers point reads, and dictionary and delta encodings of
Parquet stand for prefix-compressed blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, key: str = "user_key", *, block_bytes: int = 16 << 20, page_bytes: int = 64 << 10, compression: str = "snappy", distinct_keys: int = 1_000_000, order: list[str] | None = None) -> None:
    """Rows by key, newest version first, in files of disjoint key ranges."""
    rest = [F.col(c).desc() for c in (order or [c for c in ("seq", "kind") if c in df.columns])]
    out = df.repartitionByRange(F.col(key)).sortWithinPartitions(F.col(key), *rest)
    options = {"compression": compression, "parquet.block.size": block_bytes, "parquet.page.size": page_bytes, f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": distinct_keys}
    out.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read(spark: SparkSession, path: str, key: str = "user_key", *, at=None, at_least=None, at_most=None) -> DataFrame:
    """Rows of a key or range; the conditions are pushed into the scan."""
    df = spark.read.parquet(path)
    for value, test in ((at, lambda v: F.col(key) == F.lit(v)), (at_least, lambda v: F.col(key) >= F.lit(v)), (at_most, lambda v: F.col(key) <= F.lit(v))):
        if value is not None:
            df = df.where(test(value))
    return df
