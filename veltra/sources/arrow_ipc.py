"""Arrow IPC streams, compressed with Zstandard, in and out of DataFrames."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

import veltra._ship  # noqa: F401

def _options() -> pa.ipc.IpcWriteOptions:
    return pa.ipc.IpcWriteOptions(compression="zstd")


def to_stream(df: DataFrame) -> bytes:
    """A result of driver size as one stream: its schema once, then its batches."""
    table = df.toArrow()
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=_options()) as writer:
        writer.write_table(table)
    return out.getvalue()


def batches(stream: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(stream) as reader:
        yield from reader


def from_stream(spark: SparkSession, stream: bytes) -> DataFrame:
    with pa.ipc.open_stream(stream) as reader:
        return spark.createDataFrame(reader.read_all())


def schema_to_stream(schema: StructType) -> bytes:
    return to_arrow_schema(schema).serialize().to_pybytes()


def schema_from_stream(raw: bytes) -> StructType:
    return from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(raw)))


def to_streams(df: DataFrame) -> DataFrame:
    """One row (stream binary) per batch of every partition: nothing goes through the driver."""

    def run(parts):
        for batch in parts:
            out = io.BytesIO()
            with pa.ipc.new_stream(out, batch.schema, options=_options()) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["stream"])

    return df.mapInArrow(run, "stream binary")


def from_streams(streams: DataFrame, schema: StructType | str) -> DataFrame:
    """The rows of to_streams() again."""

    def run(parts):
        for part in parts:
            for raw in part.column(0).to_pylist():
                with pa.ipc.open_stream(raw) as reader:
                    yield from reader

    return streams.mapInArrow(run, schema)
