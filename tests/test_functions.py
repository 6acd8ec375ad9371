import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tarnflow.functions.dialect import quote, rewrite
from tarnflow.functions.types import Schema, Watermark, parse_type, to_milliseconds


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("BIGINT", T.LongType()),
        ("DECIMAL(10, 2)", T.DecimalType(10, 2)),
        ("TIMESTAMP(3)", T.TimestampNTZType()),
        ("TIMESTAMP_LTZ(3)", T.TimestampType()),
        ("VARCHAR(20)", T.StringType()),
        ("ARRAY<INT>", T.ArrayType(T.IntegerType())),
        ("MAP<STRING, ARRAY<DOUBLE>>", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))),
        ("ROW<a INT NOT NULL, `b c` ARRAY<ROW<x STRING>>>", T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b c", T.ArrayType(T.StructType([T.StructField("x", T.StringType())])))])),
    ],
)
def test_parse_type(text, wanted):
    assert parse_type(text) == wanted


@pytest.mark.parametrize("text", ["", "INTS", "ARRAY<INT", "ROW<a>", "DECIMAL(40, 2)", "INT INT", "MAP<INT>"])
def test_parse_type_rejects(text):
    with pytest.raises(ValueError):
        parse_type(text)


@pytest.mark.parametrize("text, wanted", [(250, 250), ("250", 250), ("5 seconds", 5000), ("5s", 5000), ("2 h", 7_200_000), ("1 day", 86_400_000), ("INTERVAL '5' SECOND", 5000), ("10 ms", 10), ("3 min", 180_000)])
def test_durations(text, wanted):
    assert to_milliseconds(text) == wanted


def test_duration_rejects():
    with pytest.raises(ValueError):
        to_milliseconds("soon")


def test_schema_checks():
    schema = Schema({"id": "BIGINT", "at": "TIMESTAMP(3)"}, Watermark.parse("at", "at - INTERVAL '5' SECOND"), ("id",))
    assert schema.watermark.delay == 5000 and schema.to_spark().names == ["id", "at"]
    for bad in ({"fields": {"a": "WRONG"}}, {"fields": {"a": "INT"}, "primary_key": ("b",)}, {"fields": {"a": "INT"}, "watermark": Watermark("b")}):
        with pytest.raises(ValueError):
            Schema(**bad)


def test_rewrite():
    assert rewrite("LISTAGG(a)", "t") == "listagg(a, ',') WITHIN GROUP (ORDER BY t)"
    assert rewrite("LISTAGG(a, '|')") == "listagg(a, '|')"
    assert rewrite("FIRST_VALUE(price)", "ts") == "min_by(price, ts)"
    assert rewrite("FIRST_VALUE(price) OVER w", "ts") == "FIRST_VALUE(price) OVER w"
    assert rewrite("'PROCTIME()' || PROCTIME()") == "'PROCTIME()' || current_timestamp()"
    assert rewrite("IFNULL(a, 'IFNULL(')") == "coalesce(a, 'IFNULL(')"
    assert quote("a`b") == "`a``b`"


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab'`(), PROCTIME", max_size=30))
def test_rewrite_keeps_quoted_text(text):
    quoted = "'" + text.replace("'", "''") + "'"
    assert rewrite(quoted) == quoted
