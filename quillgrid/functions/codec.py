"""Byte codecs of cache entries: an envelope of sections, and rows by their schema."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAGIC = b"QGRD"


def sealed(kind: int, sections: list[bytes]) -> bytes:
    """Magic, kind (a byte), then each section behind its length (eight bytes, little endian)."""
    return b"".join([MAGIC, bytes([kind]), *(x for s in sections for x in (struct.pack("<Q", len(s)), s))])


def opened(kind: int, body: bytes) -> list[bytes]:
    """The sections of an envelope of that kind; another kind, or a body cut short or gone on, is an error."""
    if body[:4] != MAGIC or body[4:5] != bytes([kind]):
        raise ValueError("not an envelope of this kind")
    out, at = [], 5
    while at < len(body):
        size = struct.unpack_from("<Q", body, at)[0] if at + 8 <= len(body) else len(body)
        if at + 8 + size > len(body):
            raise ValueError("the envelope is cut short")
        out.append(body[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def encoded(rows: list[tuple], ddl: str) -> bytes:
    """Rows as an Arrow stream; the schema travels with them."""
    schema = T._parse_datatype_string(ddl)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema.fields)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, arrow) as w:
        w.write_batch(pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow))
    return sink.getvalue().to_pybytes()


def decoded(body: bytes, ddl: str) -> list[tuple]:
    """Rows of an Arrow stream; another schema is an error."""
    with pa.ipc.open_stream(body) as r:
        if r.schema.names != [f.name for f in T._parse_datatype_string(ddl).fields]:
            raise ValueError(f"another schema: {r.schema.names}")
        return [tuple(x.values()) for x in r.read_all().to_pylist()]


def sealed_column(kind: int, *sections: Column) -> Column:
    """As :func:`sealed`, of binary columns."""
    size = lambda s: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(F.octet_length(s).cast("long")), 16, "0"), F.lit("(..)"), F.lit(1))), ""))
    return F.concat(F.lit(bytearray(MAGIC + bytes([kind]))), *[x for s in sections for x in (size(s), s)])
