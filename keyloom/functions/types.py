"""The column types: names, Spark types, literals, bulk checks and rendering.

Integers are unsigned. LONG holds 0 .. 2^63 - 1 as a Spark bigint; an engine opened with
``wide_long=True`` maps it to decimal(20,0) and takes the whole range to 2^64 - 1.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import EngineError, ErrorCode, bad_value, ddl


@dataclass(frozen=True)
class Kind:
    name: str
    type_id: int
    family: str  # int, float, text, blob, vector
    spark: T.DataType
    limit: int | None = None  # largest value of an integer
    element: str | None = None
    key: bool = False


def _vector(name: str, type_id: int, element: str, spark: T.DataType) -> Kind:
    return Kind(name, type_id, "vector", T.ArrayType(spark, False), element=element)


# fixed values: names and ids of the types
KINDS: dict[str, Kind] = {
    k.name: k
    for k in (
        Kind("BYTE", 0x1, "int", T.ShortType(), 2**8 - 1),
        Kind("SHORT", 0x2, "int", T.IntegerType(), 2**16 - 1, key=True),
        Kind("INT", 0x3, "int", T.LongType(), 2**32 - 1, key=True),
        Kind("LONG", 0x4, "int", T.LongType(), 2**63 - 1, key=True),
        Kind("TIMESTAMP", 0x5, "int", T.LongType(), 2**63 - 1, key=True),
        Kind("FLOAT", 0x8, "float", T.FloatType()),
        Kind("DOUBLE", 0x9, "float", T.DoubleType()),
        _vector("BYTE_VECTOR", 0x10, "BYTE", T.ShortType()),
        _vector("SHORT_VECTOR", 0x11, "SHORT", T.IntegerType()),
        _vector("INT_VECTOR", 0x12, "INT", T.LongType()),
        _vector("LONG_VECTOR", 0x13, "LONG", T.LongType()),
        _vector("FLOAT_VECTOR", 0x14, "FLOAT", T.FloatType()),
        _vector("DOUBLE_VECTOR", 0x15, "DOUBLE", T.DoubleType()),
        Kind("VARCHAR", 0x20, "text", T.StringType()),
        Kind("JSON", 0x21, "text", T.StringType()),
        Kind("BLOB", 0x22, "blob", T.BinaryType()),
    )
}
_ALIASES = {"INTEGER": "INT", "BIGINT": "LONG", "TEXT": "VARCHAR", "REAL": "FLOAT"}
_SPELLING = re.compile(r"([A-Za-z_]+)\s*(?:[\[(]\s*(\d+)\s*[\])])?$")


@dataclass(frozen=True)
class ColumnType:
    kind: Kind
    dimension: int = 0  # elements of a vector, byte limit of a text; 0: none

    @property
    def name(self) -> str:
        return self.kind.name + (f"[{self.dimension}]" if self.dimension else "")

    def spark(self, wide_long: bool = False) -> T.DataType:
        if wide_long and self.kind.name == "LONG":
            return T.DecimalType(20, 0)
        if wide_long and self.kind.element == "LONG":
            return T.ArrayType(T.DecimalType(20, 0), False)
        return self.kind.spark

    def limit(self, wide_long: bool = False) -> int | None:
        return 2**64 - 1 if wide_long and "LONG" in (self.kind.name, self.kind.element) else self.kind.limit


def parse_type(spelling: str) -> ColumnType:
    m = _SPELLING.match(spelling.strip())
    if not m:
        raise EngineError(ErrorCode.SQL_UNKNOWN_DATA_TYPE, "bad data type")
    kind = KINDS.get(_ALIASES.get(m[1].upper(), m[1].upper()))
    if kind is None:
        raise EngineError(ErrorCode.SQL_UNKNOWN_DATA_TYPE, "bad data type")
    dimension = int(m[2] or 0)
    if kind.family == "vector" and dimension < 1:
        raise ddl("bad dimension definition")
    if kind.family in ("int", "float") and m[2]:
        raise ddl("bad dimension definition")
    return ColumnType(kind, dimension)


def from_spark(dt: T.DataType, dimension: int = 0) -> ColumnType:
    """The column type nearest to a Spark type, for registered files."""
    simple = {T.ByteType: "BYTE", T.ShortType: "SHORT", T.IntegerType: "INT", T.LongType: "LONG", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR", T.BinaryType: "BLOB", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.DateType: "TIMESTAMP"}
    if isinstance(dt, T.ArrayType):
        inner = {T.ShortType: "SHORT", T.IntegerType: "INT", T.LongType: "LONG", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE"}.get(type(dt.elementType))
        if inner:
            return ColumnType(KINDS[f"{inner}_VECTOR"], dimension)
    if type(dt) in simple:
        return ColumnType(KINDS[simple[type(dt)]])
    if isinstance(dt, T.DecimalType) and dt.scale == 0:
        return ColumnType(KINDS["LONG"])
    return ColumnType(KINDS["VARCHAR"])


# -- literals ----------------------------------------------------------------------------------
def _integer(text: str, limit: int, signed: bool = False) -> int:
    if not re.fullmatch(r"[+-]?\d+" if signed else r"\+?\d+", text):
        raise bad_value(f"bad value {text!r}")
    n = int(text)
    if abs(n) > limit:
        raise bad_value(f"bad value {text!r}: above {limit}")
    return n


def _real(text: str, single: bool) -> float:
    try:
        x = float(text)
        return struct.unpack("<f", struct.pack("<f", x))[0] if single else x
    except (ValueError, OverflowError) as e:
        raise bad_value(f"bad value {text!r}") from e


def parse_literal(value: object, ctype: ColumnType, wide_long: bool = False, signed: bool = False):
    """A literal or a bound Python value as a value of the column, checked for range.
    ``signed``: columns of registered files, which may hold negative numbers."""
    if value is None:
        return None
    kind = ctype.kind
    if kind.family == "int":
        if isinstance(value, bool) or isinstance(value, float):
            raise bad_value(f"bad value {value!r}")
        n = _integer(str(value).strip(), ctype.limit(wide_long), signed)
        return Decimal(n) if wide_long and kind.name == "LONG" else n
    if kind.family == "float":
        if isinstance(value, bool):
            raise bad_value(f"bad value {value!r}")
        return _real(str(value).strip(), kind.name == "FLOAT")
    if kind.family == "vector":
        parts = [p.strip() for p in value.split(",")] if isinstance(value, str) else list(value)
        if len(parts) != ctype.dimension:
            raise bad_value(f"vector has {len(parts)} elements, the column has {ctype.dimension}")
        inner = ColumnType(KINDS[kind.element])
        return [parse_literal(p, inner, wide_long) for p in parts]
    if kind.family == "blob":
        return bytearray(value if isinstance(value, (bytes, bytearray)) else str(value).encode())
    text = str(value)
    if ctype.dimension and len(text.encode()) > ctype.dimension:
        raise bad_value(f"text has more than {ctype.dimension} bytes")
    return text


# -- bulk data -----------------------------------------------------------------------------------
def checked(col: Column, ctype: ColumnType, name: str, wide_long: bool = False) -> Column:
    """``col`` cast to the type; a row out of range fails the job."""
    kind, target = ctype.kind, ctype.spark(wide_long)
    if kind.family == "int":
        wide = col.cast("decimal(38,0)")
        fine = col.isNull() | ((wide >= 0) & (wide <= F.lit(Decimal(ctype.limit(wide_long)))))
    elif kind.family == "vector":
        target = T.ArrayType(target.elementType, True)  # the check keeps nulls out
        fine = col.isNull() | ((F.size(col) == ctype.dimension) & ~F.exists(col, lambda x: x.isNull()))
        limit = ColumnType(KINDS[kind.element]).limit(wide_long)
        if limit is not None:
            fine = fine & (col.isNull() | F.forall(col, lambda x: (x >= 0) & (x.cast("decimal(38,0)") <= F.lit(Decimal(limit)))))
    elif kind.family == "text" and ctype.dimension:
        fine = col.isNull() | (F.octet_length(col) <= ctype.dimension)
    else:
        return col.cast(target)
    return F.when(F.coalesce(fine, F.lit(False)), col.cast(target)).otherwise(F.raise_error(F.lit(f"bad value in column {name} of type {ctype.name}")).cast(target))


def rendered(col: Column, ctype: ColumnType) -> Column:
    """The text form: comma-separated vectors, lower-case hex for blobs."""
    if ctype.kind.family == "vector":
        return F.when(col.isNotNull(), F.concat_ws(",", F.transform(col, lambda x: x.cast("string"))))
    if ctype.kind.family == "blob":
        return F.lower(F.hex(col))
    return col.cast("string")


def render_value(value: object, ctype: ColumnType) -> str:
    if ctype.kind.family == "vector":
        return ",".join(str(x) for x in value)
    if ctype.kind.family == "blob":
        return bytes(value).hex()
    if isinstance(value, float) and math.isfinite(value) and value == int(value) and abs(value) < 1e16:
        return f"{value:.1f}"
    return str(value)
