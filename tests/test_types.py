from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import EngineError, ErrorCode
from keyloom.functions.types import KINDS, checked, parse_literal, parse_type, render_value, rendered

INTEGERS = [("byte", 255), ("short", 65535), ("int", 2**32 - 1), ("long", 2**63 - 1), ("timestamp", 2**63 - 1)]


@pytest.mark.parametrize(("name", "top"), INTEGERS)
def test_integer_limits(name, top):
    t = parse_type(name)
    assert parse_literal(str(top), t) == top
    assert parse_literal(0, t) == 0
    for bad in (str(top + 1), "-1", "1.5", "x", "", 1.0, True):
        with pytest.raises(EngineError) as e:
            parse_literal(bad, t)
        assert e.value.code is ErrorCode.SQL_WRONG_VALUE_FORMAT


def test_wide_long():
    t = parse_type("LONG")
    assert parse_literal(str(2**64 - 1), t, wide_long=True) == Decimal(2**64 - 1)
    assert t.spark(True) == T.DecimalType(20, 0)
    with pytest.raises(EngineError):
        parse_literal(str(2**64), t, wide_long=True)


def test_names_are_case_insensitive_and_dimensions_are_read():
    assert parse_type("Long_Vector[8]").dimension == 8
    assert parse_type("varchar(16)").dimension == 16
    assert parse_type("json").kind is KINDS["JSON"]
    for bad in ("uuid", "long_vector", "long[3]", "int_vector[0]"):
        with pytest.raises(EngineError):
            parse_type(bad)


def test_floats_vectors_text_blob():
    assert parse_literal("1.1", parse_type("double")) == 1.1
    assert parse_literal("1.1", parse_type("float")) == pytest.approx(1.1, abs=1e-6)
    assert parse_literal("1, 2 ,3", parse_type("int_vector[3]")) == [1, 2, 3]
    assert parse_literal([1.5, 2], parse_type("float_vector[2]")) == [1.5, 2.0]
    with pytest.raises(EngineError):
        parse_literal("1,2", parse_type("int_vector[3]"))
    with pytest.raises(EngineError):
        parse_literal("1,256", parse_type("byte_vector[2]"))
    assert parse_literal("äb", parse_type("varchar[3]")) == "äb"
    with pytest.raises(EngineError):
        parse_literal("äbc", parse_type("varchar[3]"))
    assert parse_literal("ab", parse_type("blob")) == bytearray(b"ab")
    assert render_value([1, 2], parse_type("int_vector[2]")) == "1,2"
    assert render_value(b"\x0a\xff", parse_type("blob")) == "0aff"
    assert render_value(3.0, parse_type("double")) == "3.0"


def test_column_checks_and_rendering(spark):
    df = spark.createDataFrame([(1, [1, 2], b"\x01"), (None, None, None)], "a int, v array<int>, b binary")
    out = df.select(checked(F.col("a"), parse_type("byte"), "a").alias("a"), rendered(F.col("v"), parse_type("int_vector[2]")).alias("v"), rendered(F.col("b"), parse_type("blob")).alias("b")).collect()
    assert [tuple(r) for r in out] == [(1, "1,2", "01"), (None, None, None)]
    for expr, kind in (("256", "byte"), ("-1", "long")):
        with pytest.raises(Exception, match="bad value"):
            df.select(checked(F.expr(expr), parse_type(kind), "a")).collect()
    with pytest.raises(Exception, match="bad value"):
        df.select(checked(F.col("v"), parse_type("int_vector[3]"), "v")).collect()
