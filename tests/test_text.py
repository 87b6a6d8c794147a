"""Text rules."""

import pytest
from pyspark.sql import functions as F

from pagetables.functions.exprs import first_error, scrub
from pagetables.functions.text import attribute, decode_entities, inline_text, normalize_markdown, trim_end, trim_space


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a&nbsp;b", "a b"),
        ("&AMP;&lt;&gt;&quot;&#39;&apos;", "&<>\"''"),
        ("&amp;lt;", "<"),
        ("&amp;#65;", "A"),
        ("&#38;#x41;", "A"),
        ("&#233;&#x1F600;&#xFEFF;", "é\U0001f600\ufeff"),
        ("&copy; &middot;", "&copy; &middot;"),
        ("&#0065;", "A"),
        ("&#xD800;", "\ufffd"),
        ("no entity", "no entity"),
    ],
)
def test_entities(spark, text, want):
    assert one(spark, text, decode_entities) == want


@pytest.mark.parametrize(
    "text, message",
    [
        ("&#1114111;", None),
        ("&#1114112;", "Invalid code point 1114112"),
        ("&#x110000;", "Invalid code point 1114112"),
        ("x &#99999999; y", "Invalid code point 99999999"),
    ],
)
def test_characters_that_do_not_exist(spark, text, message):
    assert one(spark, text, lambda t: first_error(decode_entities(t))) == message


@pytest.mark.parametrize(
    "text, want",
    [
        ("<b>a</b><i>b</i>", "ab"),
        ("  a \n\t b\u00a0\u2003c\ufeff ", "a b c"),
        ("a\u0085b", "a\u0085b"),
        ("a &lt;b&gt; c", "a <b> c"),
        ("", ""),
    ],
)
def test_inline_text(spark, text, want):
    assert one(spark, text, inline_text) == want


def test_normalized_lines(spark):
    text = "\n\n a  b \t\r\n\u3000c\n \n\n\n\nd &amp;amp; e \u00a0\n"
    assert one(spark, text, normalize_markdown) == "a  b\nc\n\nd &amp; e"


def test_trimming(spark):
    assert one(spark, "\ufeff\u2028 a b \n\v", trim_space) == "a b"
    assert one(spark, " a\u00a0\n", trim_end) == " a"


@pytest.mark.parametrize(
    "attrs, want",
    [
        (' href="/a"', "/a"),
        (" HREF = '/a\"b'", '/a"b'),
        (' data-href="/a" href="/b"', "/a"),
        (" href=/a", None),
        (' href=""', ""),
        (' href="a\nb"', None),
    ],
)
def test_attributes(spark, attrs, want):
    assert one(spark, attrs, lambda t: attribute(t, "href")) == want


def test_reserved_characters_are_replaced(spark):
    assert one(spark, "a\ufdd0b\ufdd1c\ufdd2d", scrub) == "a\ufffdb\ufffdc\ufffdd"
