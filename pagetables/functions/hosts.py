"""Hosts of web URLs: IPv6 addresses and names outside ASCII."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .exprs import let

# The parameters of Punycode.
_BASE, _LEAST, _MOST, _SKEW, _DAMP, _FIRST_BIAS = 36, 1, 26, 38, 700, 72
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
_FOUR_NUMBERS = r"\A(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z"
# A colon too many, or a gap where there are eight groups.
_BROKEN_ADDRESS = r"\A:(?!:)|[^:]:\z|:::|::.*::|\A(?=.*::)(?:[^:]*[0-9a-f]+:*){8}"
#: Longest name outside ASCII, in code points: as long as a name may be.
_LONGEST = 253
# Wide forms of ASCII letters, digits and signs become these, and other full stops ".".
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
# What is left out of names: soft hyphen, zero-width space, word joiner and variation selectors.
_IGNORED = r"[­​⁠﻿︀-️]"
# Names that would need composition or compatibility mapping, or that hold no letters or signs.
_UNMAPPED = (
    r"[̀-ͯ‌‍℀-⅏Ⅰ-ↈ①-⓿ﬀ-ﭏ﷐-﷿ﹰ-﻾｟-￯"
    r"\x{1D400}-\x{1D7FF}\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Z}]"
)


def ipv6(inside: Column) -> Column:
    """Shortest text of an address without its brackets, NULL if it is none."""
    # The last two groups may be written as four decimal numbers.
    decimal = F.regexp_extract(inside, r"(?:\A|:)([0-9.]*\.[0-9.]*)\z", 1)

    def hexadecimal(four: Column) -> Column:
        number = F.split(four, r"\.")
        high, low = (F.get(number, i).cast("int") * 256 + F.get(number, i + 1).cast("int") for i in (0, 2))
        return F.when(four == "", inside).when(
            F.rlike(four, F.lit(_FOUR_NUMBERS)),
            F.concat(F.substr(inside, F.lit(1), F.length(inside) - F.length(four)), F.format_string("%x:%x", high, low)),
        )

    def filled(t: Column) -> Column:
        zeros = F.repeat(F.lit("0:"), 8 - F.regexp_count(t, F.lit("[0-9a-f]+")))
        whole = F.btrim(F.replace(t, F.lit("::"), F.concat(F.lit(":"), zeros)), F.lit(":"))
        return F.when(~F.rlike(t, F.lit(_BROKEN_ADDRESS)), F.regexp_replace(whole, r"\b0+(?=[0-9a-f])", ""))

    def written(t: Column) -> Column:
        # The longest run of zeros, the first of equal ones, becomes "::".
        run = F.array_max(F.regexp_extract_all(t, F.lit(r"\b0(?::0)+\b"), F.lit(0)))
        ends = F.split(F.concat(F.lit(":"), t, F.lit(":")), F.concat(F.lit(":"), run, F.lit(":")), 2)
        short = F.concat(F.ltrim(F.get(ends, 0), F.lit(":")), F.lit("::"), F.rtrim(F.get(ends, 1), F.lit(":")))
        return F.when(F.rlike(t, F.lit(r"\A(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\z")), F.coalesce(short, t))

    return let(let(let(decimal, hexadecimal), filled), written)


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def _varint(delta: Column, bias: Column) -> Column:
    """A delta as Punycode digits; eight are enough for any."""

    def step(state: Column, i: Column) -> Column:
        def write(t: Column) -> Column:
            last, rest = state.q < t, state.q - t
            digit = F.when(last, state.q).otherwise(t + rest % (_BASE - t))
            return F.struct(
                F.when(last, -1).otherwise(_div(rest, _BASE - t)).alias("q"),
                F.when(state.q < 0, state.out)
                .otherwise(F.concat(state.out, F.substr(F.lit(_DIGITS), digit.cast("int") + 1, F.lit(1))))
                .alias("out"),
            )

        return let(F.least(F.greatest(i * _BASE - bias, F.lit(_LEAST)), F.lit(_MOST)), write)

    start = F.struct(delta.alias("q"), F.lit("").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step).out


def _next_bias(delta: Column, points: Column, first: Column) -> Column:
    def step(state: Column, _: Column) -> Column:
        high = state.d > (_BASE - _LEAST) * _MOST // 2
        return F.struct(
            F.when(high, _div(state.d, _BASE - _LEAST)).otherwise(state.d).alias("d"),
            (state.k + F.when(high, _BASE).otherwise(0)).alias("k"),
        )

    halved = F.when(first, _div(delta, _DAMP)).otherwise(_div(delta, 2))
    start = let(halved, lambda d: F.struct((d + _div(d, points)).alias("d"), F.lit(0).cast("bigint").alias("k")))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(7)), start, step, lambda s: s.k + _div(s.d * (_BASE - _LEAST + 1), s.d + _SKEW)
    )


def punycode(label: Column) -> Column:
    """Punycode of a label: its ASCII characters, then where the others go, lowest first."""

    def encode(points: Column) -> Column:
        basic = F.regexp_replace(label, r"[^\x00-\x7F]+", "")
        others = F.array_sort(F.filter(points, lambda p: p.cp >= 128))

        def step(state: Column, p: Column) -> Column:
            # How many characters that are there already stand before this one.
            earlier = F.size(F.filter(points, lambda q: (q.at < p.at) & (q.cp <= p.cp))).cast("bigint")

            def add(x: Column) -> Column:
                return F.struct(
                    p.cp.alias("n"),
                    (x.i + 1).alias("i"),
                    (state.h + 1).alias("h"),
                    _next_bias(x.delta, state.h + 1, state.n == 128).alias("bias"),
                    F.concat(state.out, _varint(x.delta, state.bias)).alias("out"),
                )

            delta = (p.cp - state.n) * (state.h + 1) + earlier - state.i
            return let(F.struct(earlier.alias("i"), delta.alias("delta")), add)

        start = F.struct(
            F.lit(128).cast("bigint").alias("n"),
            F.lit(0).cast("bigint").alias("i"),
            F.length(basic).cast("bigint").alias("h"),
            F.lit(_FIRST_BIAS).cast("bigint").alias("bias"),
            F.when(basic == "", "").otherwise(F.concat(basic, F.lit("-"))).alias("out"),
        )
        return F.aggregate(others, start, step).out

    letters = F.transform(F.split(label, ""), lambda ch, i: F.struct(F.ascii(ch).cast("bigint").alias("cp"), i.alias("at")))
    return let(letters, encode)


def ascii_host(host: Column) -> Column:
    """A name outside ASCII in its ASCII form, NULL if it is not supported.

    Letters are lower-cased, wide forms narrowed, other full stops read as ".".  Names that
    would need composition or another compatibility mapping are not supported.
    """
    mapped = F.translate(F.translate(F.regexp_replace(host, _IGNORED, ""), _WIDE, _NARROW), "。．｡Σ", "...σ")

    def encode(h: Column) -> Column:
        labels = F.transform(
            F.split(h, r"\."),
            lambda label: F.when(
                F.rlike(label, F.lit(r"[^\x00-\x7F]")), F.concat(F.lit("xn--"), punycode(label))
            ).otherwise(label),
        )
        return F.when((F.length(h) <= _LONGEST) & ~F.rlike(h, F.lit(_UNMAPPED)), F.array_join(labels, "."))

    return let(F.lower(mapped), encode)
