"""Type strings, durations and schemas of declared tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = {
    "BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BYTES": T.BinaryType(), "DATE": T.DateType(),
}
_SIZED = {"VARCHAR": T.StringType, "CHAR": T.StringType, "BINARY": T.BinaryType, "VARBINARY": T.BinaryType}
_UNITS = {"ms": 1, "millisecond": 1, "s": 1000, "sec": 1000, "second": 1000, "m": 60_000, "min": 60_000, "minute": 60_000, "h": 3_600_000, "hr": 3_600_000, "hour": 3_600_000, "d": 86_400_000, "day": 86_400_000}
_TOKEN = re.compile(r"\s*(<|>|\(|\)|,|`[^`]+`|[A-Za-z_][A-Za-z0-9_]*|\d+)")


def parse_type(text: str) -> T.DataType:
    """The Spark type of a type string such as ``ARRAY<ROW<a INT, b DECIMAL(10, 2)>>``.

    ``TIMESTAMP(p)`` has no time zone, ``TIMESTAMP_LTZ(p)`` is an instant; ``NOT NULL`` is accepted
    and makes a row's field required. Anything else that cannot be read raises ValueError.
    """
    tokens, at = [], 0
    while at < len(text.rstrip()):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"cannot read type {text!r} at {at}")
        tokens.append(found[1])
        at = found.end()
    place = 0

    def take(wanted: str | None = None) -> str:
        nonlocal place
        if place >= len(tokens) or (wanted and tokens[place] != wanted):
            raise ValueError(f"cannot read type {text!r}: expected {wanted or 'more'}")
        place += 1
        return tokens[place - 1]

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def numbers() -> list[int]:
        if peek() != "(":
            return []
        take("(")
        found = [int(take())]
        while peek() == ",":
            take(",")
            found.append(int(take()))
        take(")")
        return found

    def nullable() -> bool:
        if peek().upper() == "NOT":
            take()
            if take().upper() != "NULL":
                raise ValueError(f"cannot read type {text!r}")
            return False
        return True

    def one() -> T.DataType:
        name = take().upper()
        if name in _PLAIN:
            return _PLAIN[name]
        if name in _SIZED:
            numbers()
            return _SIZED[name]()
        if name == "DECIMAL":
            sizes = numbers() or [10, 0]
            precision, scale = sizes[0], sizes[1] if len(sizes) > 1 else 0
            if not (1 <= precision <= 38 and 0 <= scale <= precision):
                raise ValueError(f"no such decimal: {text!r}")
            return T.DecimalType(precision, scale)
        if name == "TIMESTAMP":
            numbers()
            return T.TimestampNTZType()
        if name == "TIMESTAMP_LTZ":
            numbers()
            return T.TimestampType()
        if name == "TIME":
            numbers()
            return T.TimeType() if hasattr(T, "TimeType") else T.StringType()
        if name == "ARRAY":
            take("<")
            inner = one()
            can_be_null = nullable()
            take(">")
            return T.ArrayType(inner, can_be_null)
        if name == "MAP":
            take("<")
            key = one()
            nullable()
            take(",")
            value = one()
            can_be_null = nullable()
            take(">")
            return T.MapType(key, value, can_be_null)
        if name == "ROW":
            take("<")
            fields = []
            while True:
                column = take().strip("`")
                kind = one()
                fields.append(T.StructField(column, kind, nullable()))
                if peek() != ",":
                    break
                take(",")
            take(">")
            return T.StructType(fields)
        raise ValueError(f"unknown type {name} in {text!r}")

    parsed = one()
    nullable()
    if place != len(tokens):
        raise ValueError(f"cannot read the end of type {text!r}")
    return parsed


def to_milliseconds(duration: str | int) -> int:
    """``5000``, ``'5 seconds'``, ``'5s'``, ``'1 day'`` or ``INTERVAL '5' SECOND`` as milliseconds."""
    if isinstance(duration, int) or str(duration).strip().isdigit():
        return int(duration)
    found = re.fullmatch(r"\s*(?:INTERVAL\s+)?'?\s*(\d+)\s*'?\s*([A-Za-z]+)\s*", str(duration), re.I)
    unit = found[2].lower() if found else ""
    unit = unit if unit in _UNITS else unit.removesuffix("s")
    if not found or unit not in _UNITS:
        raise ValueError(f"cannot read duration {duration!r}")
    return int(found[1]) * _UNITS[unit]


def to_interval(duration: str | int) -> str:
    """A duration as Spark writes intervals."""
    return f"{to_milliseconds(duration)} milliseconds"


@dataclass(frozen=True)
class Watermark:
    """Event-time column and how long late rows are waited for."""

    column: str
    delay: str | int = 0

    @staticmethod
    def parse(column: str, expression: str) -> Watermark:
        """From ``column - INTERVAL '5' SECOND`` or a bare column."""
        found = re.fullmatch(rf"\s*`?{re.escape(column)}`?\s*(?:-\s*(INTERVAL\s+'\d+'\s+\w+)\s*)?", expression, re.I)
        if not found:
            raise ValueError(f"cannot read watermark {expression!r}")
        return Watermark(column, to_milliseconds(found[1]) if found[1] else 0)


@dataclass(frozen=True)
class Schema:
    """Declared columns with optional watermark, key and metadata columns.

    ``metadata`` maps a column to the name of the source's own field.
    """

    fields: dict[str, str]
    watermark: Watermark | None = None
    primary_key: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, kind in self.fields.items():
            try:
                parse_type(kind)
            except ValueError as error:
                raise ValueError(f"column {name}: {error}") from error
        if self.watermark and self.watermark.column not in self.fields:
            raise ValueError(f"watermark column {self.watermark.column} is not declared")
        for name in self.primary_key:
            if name not in self.fields:
                raise ValueError(f"key column {name} is not declared")
        for name in self.metadata:
            if name not in self.fields:
                raise ValueError(f"metadata column {name} is not declared")

    def to_spark(self, with_metadata: bool = True) -> T.StructType:
        return T.StructType([T.StructField(n, parse_type(k)) for n, k in self.fields.items() if with_metadata or n not in self.metadata])


def with_watermark(df: DataFrame, watermark: Watermark | None) -> DataFrame:
    """Declare the watermark; a column without time zone is read as UTC."""
    if watermark is None:
        return df
    if isinstance(df.schema[watermark.column].dataType, T.TimestampNTZType):
        df = df.withColumn(watermark.column, F.col(watermark.column).cast("timestamp"))
    return df.withWatermark(watermark.column, to_interval(watermark.delay))
