"""Numbers and dates written as text, read and written as the web platform does."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .exprs import let
from .text import trim_space

# The grammar of a number in text.  Java and Python would also take `1d`, `1_0` or `nan`.
_DECIMAL = r"[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_BASES = (("[xX]", "[0-9a-fA-F]", 16), ("[oO]", "[0-7]", 8), ("[bB]", "[01]", 2))

# Month names and zones of dates in text, hours from UTC.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_ZONES = {"edt": -4, "est": -5, "cdt": -5, "cst": -6, "mdt": -6, "mst": -7, "pdt": -7, "pst": -8}


def number_of(text: Column) -> Column:
    """The finite or infinite number a text stands for: blank is 0, NULL if it is none."""

    def digits(t: Column, base: int) -> Column:
        # Sixteen digits at a time would lose nothing, one at a time needs no cut.
        each = F.split(F.lower(F.substr(t, F.lit(3))), "")
        return F.aggregate(each, F.lit(0.0), lambda sum_, digit: sum_ * base + F.conv(digit, base, 10).cast("double"))

    def read(t: Column) -> Column:
        value = F.when(t == "", F.lit(0.0))
        for prefix, digit, base in _BASES:
            value = value.when(F.rlike(t, F.lit(rf"\A0{prefix}{digit}+\z")), digits(t, base))
        return value.when(F.rlike(t, F.lit(rf"\A{_DECIMAL}\z")), t.try_cast("double"))

    return let(trim_space(text), read)


def number_of_text(text: str) -> float:
    """`number_of` for one value; no number is NaN."""
    trimmed = text.strip("\n\t\v\f\r \xa0     　﻿" + "".join(map(chr, range(0x2000, 0x200B))))
    if not trimmed:
        return 0.0
    for prefix, digit, base in _BASES:
        if re.fullmatch(f"0{prefix}{digit}+", trimmed):
            return float(int(trimmed[2:], base))
    return float(trimmed) if re.fullmatch(_DECIMAL, trimmed) else float("nan")


def shortest_digits(number: Column) -> Column:
    """Text of a double with the fewest digits that read back to it, as ``d.dddEn`` or plain.

    The JVM writes a digit too many for a few doubles of sixteen digits or more, and for
    those next to zero; of these every number of digits is tried.
    """

    def search(n: Column) -> Column:
        tries = F.array(*[F.regexp_replace(F.format_string(f"%.{d}e", n), r"e\+?", "E") for d in range(17)])
        return F.get(F.filter(tries, lambda t: t.try_cast("double") == n), 0)

    def write(n: Column) -> Column:
        plain = n.cast("string")
        digits = F.length(F.regexp_replace(F.regexp_replace(plain, r"E.*\z", ""), "[^0-9]", ""))
        return F.when((digits >= 16) | (F.abs(n) < 2.3e-308), F.coalesce(search(n), plain)).otherwise(plain)

    return let(number, write)


# Forms of a date in text.  Every form names its parts in the order of ``_PARTS``.
_PARTS = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "zone")
_CLOCK = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?(?:\s*(am|pm))?"
_ZONE = r"\s*(z|(?:(?:gmt|utc|ut)\s*)?[+-][0-9]{1,2}:?[0-9]{2}|(?:gmt|utc|ut)(?:\s*[+-][0-9]{1,2})?|[ecmp][sd]t)?"
_REST = r"\s*(?:\([^()]*\)\s*)*\z"
_WEEKDAY = r"(?:(?:sun|mon|tue|wed|thu|fri|sat)[a-z]*\.?,?\s*)?"
_MONTH = rf"({'|'.join(_MONTHS)})[a-z]*\.?"
_TIME = rf"(?:,?\s+{_CLOCK})?{_ZONE}"
_ORDER = tuple(range(1, 10))
#: (pattern, group of each part).  In the first two, dates alone are UTC; all else is UTC too,
#: since the session's zone is.
_DATE_FORMS = (
    (r"\A([0-9]{4}|[+-][0-9]{6})(?:-([0-9]{2})(?:-([0-9]{2}))?)?(?:t([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?()(z|[+-][0-9]{2}:[0-9]{2})?)?\z", _ORDER),
    (rf"\A{_WEEKDAY}([0-9]{{4}})[-/]([0-9]{{1,2}})[-/]([0-9]{{1,2}}){_TIME}{_REST}", _ORDER),
    (rf"\A{_WEEKDAY}([0-9]{{1,2}})[\s-]+{_MONTH}[\s,-]+([0-9]{{4}}|[0-9]{{2}}){_TIME}{_REST}", (3, 2, 1, *_ORDER[3:])),
    (rf"\A{_WEEKDAY}{_MONTH}[\s-]+([0-9]{{1,2}})(?:st|nd|rd|th)?[\s,-]+([0-9]{{4}}){_TIME}{_REST}", (3, 1, 2, *_ORDER[3:])),
    (rf"\A{_WEEKDAY}{_MONTH}\s+([0-9]{{1,2}})\s+{_CLOCK}\s+([0-9]{{4}}){_ZONE}{_REST}", (8, 1, 2, 3, 4, 5, 6, 7, 9)),
    (rf"\A{_WEEKDAY}([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]([0-9]{{4}}|[0-9]{{2}}){_TIME}{_REST}", (3, 1, 2, *_ORDER[3:])),
)


def _offset_minutes(zone: Column) -> Column:
    signed = F.regexp_extract(zone, r"([+-])[0-9]", 1)
    hours = F.regexp_extract(zone, r"[+-]([0-9]{1,2}?)(?::?[0-9]{2})?\z", 1).try_cast("int")
    minutes = F.regexp_extract(zone, r"[+-][0-9]{1,2}:?([0-9]{2})\z", 1).try_cast("int")
    named = F.lit(0)
    for name, hour in _ZONES.items():
        named = F.when(zone == name, hour * 60).otherwise(named)
    return F.when(signed == "", named).otherwise(
        F.when(signed == "-", -1).otherwise(1) * (F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(minutes, F.lit(0)))
    )


def date_of(text: Column) -> Column:
    """The time a text names, NULL if it names none; text without a zone is UTC.

    Days beyond the end of a month run on into the next one.  Fractions keep microseconds.
    """

    def parts(t: Column) -> Column:
        found = F.lit(None).cast(f"struct<{','.join(f'{name}:string' for name in _PARTS)}>")
        for pattern, groups in reversed(_DATE_FORMS):
            fields = [F.regexp_extract(t, pattern, group).alias(name) for group, name in zip(groups, _PARTS, strict=True)]
            found = F.when(F.rlike(t, F.lit(pattern)), F.struct(*fields)).otherwise(found)
        return found

    def numbers(p: Column) -> Column:
        month = p.month.try_cast("int")
        for i, name in enumerate(_MONTHS, 1):
            month = F.when(p.month == name, i).otherwise(month)
        short = F.length(p.year) == 2
        year = p.year.try_cast("int")
        return F.struct(
            F.when(short, year + F.when(year < 50, 2000).otherwise(1900)).otherwise(year).alias("year"),
            F.coalesce(month, F.lit(1)).alias("month"),
            F.coalesce(p.day.try_cast("int"), F.lit(1)).alias("day"),
            F.coalesce(p.hour.try_cast("int"), F.lit(0)).alias("hour"),
            F.coalesce(p.minute.try_cast("int"), F.lit(0)).alias("minute"),
            F.coalesce(p.second.try_cast("int"), F.lit(0)).alias("second"),
            F.rpad(F.substring(p.fraction, 1, 6), 6, "0").cast("int").alias("micros"),
            p.half.alias("half"),
            _offset_minutes(p.zone).alias("offset"),
        )

    def assembled(n: Column) -> Column:
        twelve = n.half != ""
        hour = F.when(twelve, n.hour % 12 + F.when(n.half == "pm", 12).otherwise(0)).otherwise(n.hour)
        day_end = (n.hour == 24) & (n.minute == 0) & (n.second == 0) & (n.micros == 0) & ~twelve
        valid = (
            n.month.between(1, 12)
            & n.day.between(1, 31)
            & (F.when(twelve, n.hour.between(1, 12)).otherwise(n.hour <= 23) | day_end)
            & (n.minute <= 59)
            & (n.second <= 59)
            & n.year.between(-270_000, 270_000)
        )
        days = F.unix_date(F.make_date(n.year, n.month, F.lit(1))).cast("bigint") + n.day - 1
        seconds = days * 86_400 + hour * 3_600 + (n.minute - n.offset) * 60 + n.second
        return F.when(valid, F.timestamp_micros(seconds * 1_000_000 + n.micros))

    return let(
        F.lower(trim_space(text)),
        lambda t: let(parts(t), lambda p: F.when(p.isNotNull(), let(numbers(p), assembled))),
    )
