"""The wire form of an event: a zero byte, the schema's number in four bytes, then the fields in Avro's binary encoding.

``encoded`` and ``decoded`` work on columns of a batch or a stream, in Arrow batches; Spark's own Avro functions know neither these five bytes nor are they in every installation.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarmac.schema import FLIGHT, RAW_DOUBLE

_OPTIONAL = set(RAW_DOUBLE.values())


def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the record ends early")
        self.at += n
        return self.data[self.at - n : self.at]


def encode(event: dict[str, Any], schema_id: int) -> bytes:
    out = [b"\0", struct.pack(">I", schema_id)]
    for f in FLIGHT:
        value = event.get(f.name)
        if f.name in _OPTIONAL:
            out.append(_long(0) if value is None else _long(1) + struct.pack("<d", value))
        elif isinstance(f.dataType, T.StringType):
            text = value.encode()
            out.append(_long(len(text)) + text)
        else:
            out.append(_long(int(value)))
    return b"".join(out)


def decode(data: bytes) -> tuple[int, dict[str, Any]]:
    """The schema's number and the event."""
    if len(data) < 5 or data[0]:
        raise ValueError("not a record with a schema's number")
    read, event = _Reader(data, 5), {}
    for f in FLIGHT:
        if f.name in _OPTIONAL:
            event[f.name] = struct.unpack("<d", read.take(8))[0] if read.long() else None
        elif isinstance(f.dataType, T.StringType):
            event[f.name] = read.take(read.long()).decode()
        else:
            event[f.name] = read.long()
    return struct.unpack(">I", data[1:5])[0], event


def encoded(events: DataFrame, schema_id: int) -> DataFrame:
    """``value`` (binary) of every event; other columns than an event's are ignored. An event without a time, an airline or one of the whole numbers has no wire form: its value is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = [f.name for f in FLIGHT if f.name not in _OPTIONAL]
        for batch in batches:
            values = [encode(e, schema_id) if all(e[n] is not None for n in needed) else None for e in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["value"])

    return events.select(*FLIGHT.names).mapInArrow(run, "value binary")


def decoded(rows: DataFrame, value: str = "value") -> DataFrame:
    """The events of wire records in order; all fields are null where a record is null or damaged."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in FLIGHT])
    types = to_arrow_schema(schema)

    def event(data: bytes | None) -> dict[str, Any]:
        try:
            return decode(data)[1] if data is not None else {}
        except (ValueError, IndexError):
            return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events = [event(v) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([e.get(f.name) for e in events], types.field(f.name).type) for f in schema], schema=types)

    return rows.select(value).mapInArrow(run, schema)
