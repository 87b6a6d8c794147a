"""Numbers and dates in text."""

import math
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from pagetables.functions.values import date_of, number_of, number_of_text, shortest_digits
from pagetables.operators.structured import _number_text

NUMBERS = [
    ("168", 168.0), (" 12.5 ", 12.5), ("", 0.0), (" \n ", 0.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("+7", 7.0), ("-0", -0.0),
    ("0x10", 16.0), ("0XfF", 255.0), ("0b101", 5.0), ("0o17", 15.0), ("Infinity", math.inf), ("-Infinity", -math.inf), ("010", 10.0),
    ("1d", None), ("1f", None), ("1_0", None), ("0x", None), ("-0x10", None), ("1e", None), ("inf", None), ("NaN", None), ("1 2", None),
    ("0b2", None), (".", None), ("a week", None), ("١", None), ("0x1fffffffffffff", 9007199254740991.0),
]


def test_numbers(spark):
    rows = spark.createDataFrame([(text,) for text, _ in NUMBERS], "text string")
    assert [row[0] for row in rows.select(number_of(F.col("text"))).collect()] == [want for _, want in NUMBERS]
    for text, want in NUMBERS:
        got = number_of_text(text)
        assert got == want or (want is None and math.isnan(got))


@pytest.mark.parametrize(
    "value, text",
    [
        (2e23, "2e+23"), (8.41e21, "8.41e+21"), (1.1e-5, "0.000011"), (5e-324, "5e-324"), (1.2e-320, "1.2e-320"), (2.2250738585072014e-308, "2.2250738585072014e-308"),
        (0.1 + 0.2, "0.30000000000000004"), (9007199254740993.0, "9007199254740992"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"),
        (1.7976931348623157e308, "1.7976931348623157e+308"), (-2e23, "-2e+23"), (5.684341886080802e-14, "5.684341886080802e-14"), (9.99, "9.99"), (1e-7, "1e-7"), (0.0, "0"),
    ],
)
def test_shortest_text(spark, value, text):
    row = spark.createDataFrame([(value,)], "n double").select(_number_text(F.col("n")), shortest_digits(F.col("n"))).first()
    assert row[0] == text and float(row[1]) == value


def test_shortest_digits_equal_pythons(spark):
    import random
    import struct

    rng = random.Random(6)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if math.isfinite(v)] + [rng.randrange(10**6) * 10.0 ** rng.randrange(-30, 30) for _ in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "n double").select("n", shortest_digits(F.col("n")).alias("t")).collect()
    for row in got:
        digits = lambda t: t.lower().split("e")[0].replace(".", "").replace("-", "").strip("0")
        assert digits(row.t) == digits(repr(row.n)), (row.n, row.t)


def utc(*parts):
    return datetime(*parts, tzinfo=UTC)


DATES = [
    ("2024-01-02T03:04:05.678Z", utc(2024, 1, 2, 3, 4, 5, 678000)),
    ("2024-01-02T03:04:05.6781239+02:30", utc(2024, 1, 2, 0, 34, 5, 678123)),
    ("2024-01-02T03:04Z", utc(2024, 1, 2, 3, 4)),
    ("2024-01-02T24:00:00Z", utc(2024, 1, 3)),
    ("2024-01-02", utc(2024, 1, 2)),
    ("2024-02", utc(2024, 2, 1)),
    ("2024", utc(2024, 1, 1)),
    ("+002024-01-02T00:00:00Z", utc(2024, 1, 2)),
    ("2024-01-02 03:04:05", utc(2024, 1, 2, 3, 4, 5)),
    ("2024-1-2 3:04", utc(2024, 1, 2, 3, 4)),
    ("2024/01/02 03:04:05 +0100", utc(2024, 1, 2, 2, 4, 5)),
    ("Tue, 02 Jan 2024 03:04:05 GMT", utc(2024, 1, 2, 3, 4, 5)),
    ("Tue, 2 Jan 2024 03:04:05 -0500", utc(2024, 1, 2, 8, 4, 5)),
    ("Tuesday, 02-Jan-24 03:04:05 GMT", utc(2024, 1, 2, 3, 4, 5)),
    ("02 January 2024", utc(2024, 1, 2)),
    ("Jan 2, 2024", utc(2024, 1, 2)),
    ("January 2, 2024 3:04 PM", utc(2024, 1, 2, 15, 4)),
    ("January 2, 2024 12:04 am EST", utc(2024, 1, 2, 5, 4)),
    ("Tue Jan 02 2024 03:04:05 GMT+0100 (Central European Standard Time)", utc(2024, 1, 2, 2, 4, 5)),
    ("Tue Jan  2 03:04:05 2024", utc(2024, 1, 2, 3, 4, 5)),
    ("1/2/2024", utc(2024, 1, 2)),
    ("1/2/99 13:00", utc(1999, 1, 2, 13)),
    ("2024-02-30", utc(2024, 3, 1)),
    (" 2024-01-02T03:04:05Z ", utc(2024, 1, 2, 3, 4, 5)),
    ("yesterday", None), ("", None), ("2024-13-01", None), ("2024-01-32", None), ("2024-01-02T25:00Z", None), ("2024-01-02T03:60Z", None),
    ("1/2", None), ("Jan 2024x", None), ("2024-01-02T03:04:05ZZ", None), ("13:00 pm", None), ("Jan 2, 2024 13:00 PM", None),
]


def test_dates(spark):
    rows = spark.createDataFrame([(text,) for text, _ in DATES], "text string")
    got = [row[0] for row in rows.select(F.unix_micros(date_of(F.col("text")))).collect()]
    want = [None if time is None else round(time.timestamp() * 1_000_000) for _, time in DATES]
    assert list(zip((t for t, _ in DATES), got, strict=True)) == list(zip((t for t, _ in DATES), want, strict=True))
