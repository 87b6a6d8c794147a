"""URL rules."""

import random

import pytest
from pyspark.sql import functions as F

from pagetables.functions.hosts import punycode
from pagetables.functions.urls import page_url, parse_url, resolve_urls, resource_key, url_host, url_path, url_text

BASE = "https://Example.com:443/a/b/c?x=1#h"

ABSOLUTE = [
    ("https://shop.example/boots/red?size=9#top", "https://shop.example/boots/red?size=9"),
    ("HTTPS://EXAMPLE.com", "https://example.com/"),
    ("http://example.com:80/x", "http://example.com/x"),
    ("http://example.com:8080/x", "http://example.com:8080/x"),
    ("https://example.com:0443/", "https://example.com/"),
    ("https://user:p%40ss@example.com/", "https://user:p%40ss@example.com/"),
    (" https://example.com/a\nb ", "https://example.com/ab"),
    ('https://example.com/a{b}|`^"<>', "https://example.com/a%7Bb%7D|%60%5E%22%3C%3E"),
    ("https://example.com/*'~!()", "https://example.com/*'~!()"),
    ("https://example.com/%zz%41", "https://example.com/%zz%41"),
    ("https:///example.com//a//b", "https://example.com//a//b"),
    ("http://ex%41mple.com/", "http://example.com/"),
    ("http://192.168.0.1/", "http://192.168.0.1/"),
    ("http://0x7f.1/", "http://127.0.0.1/"),
    ("http://[::1]:80/", "http://[::1]/"),
    ("http://example.com./", "http://example.com./"),
    ("http://a/..", "http://a/"),
    ("http://x:/a", "http://x/a"),
    ("file:///etc/hosts", "file:///etc/hosts"),
    ("foo://Bar/../x y", "foo://Bar/x%20y"),
    ("relative", None),
    ("", None),
    ("http://", None),
    ("http://a b/", None),
    ("http://256.1.1.1/", None),
    ("http://1.2.3.4.5/", None),
    ("http://x:99999/", None),
    ("http://x:abc/", None),
    ("https://bücher.example/", "https://xn--bcher-kva.example/"),
    ("https://BÜCHER.example:444/ü", "https://xn--bcher-kva.example:444/%C3%BC"),
    ("https://b%C3%BCcher.example/", "https://xn--bcher-kva.example/"),
    ("https://faß.example/", "https://xn--fa-hia.example/"),
    ("https://ｅｘａｍｐｌｅ。com/", "https://example.com/"),
    ("https://ΣΊΣΥΦΟΣ.example/", "https://xn--kxa6akbbkh.example/"),
    ("https://a­b.example/", "https://ab.example/"),
    ("https://☕.example/", "https://xn--53h.example/"),
    ("https://bu\u0308cher.example/", None),
    ("https://a\u3000b.example/", None),
    ("https://ü" + "a" * 300 + ".example/", None),
    ("http://[2001:0DB8:0:0:0:0:0:1]/", "http://[2001:db8::1]/"),
    ("http://[2001:db8:0:0:1:0:0:1]/", "http://[2001:db8::1:0:0:1]/"),
    ("http://[1:0:0:2:0:0:0:3]/", "http://[1:0:0:2::3]/"),
    ("http://[::ffff:192.168.0.1]:8080/x", "http://[::ffff:c0a8:1]:8080/x"),
    ("http://[1:2:3:4:5:6:1.2.3.4]/", "http://[1:2:3:4:5:6:102:304]/"),
    ("http://[0:0:0:0:0:0:0:0]/", "http://[::]/"),
    ("http://[1:2:3:4:5:6:7:8]/", "http://[1:2:3:4:5:6:7:8]/"),
    ("http://[1:2:3:4:5:6:7::]/", "http://[1:2:3:4:5:6:7:0]/"),
    ("http://[::1:2:3:4:5:6:7]/", "http://[0:1:2:3:4:5:6:7]/"),
    ("http://[1:0:3:4:5:6:7:8]/", "http://[1:0:3:4:5:6:7:8]/"),
    ("http://[1:2:3:4:5:6:7]/", None),
    ("http://[1:2:3:4:5:6:7:8:9]/", None),
    ("http://[1::2::3]/", None),
    ("http://[:::1]/", None),
    ("http://[:1::2]/", None),
    ("http://[12345::]/", None),
    ("http://[::1.2.3]/", None),
    ("http://[::1.2.3.256]/", None),
    ("http://[::01.2.3.4]/", None),
    ("http://[::g]/", None),
]

RELATIVE = [
    ("/für a", "https://example.com/f%C3%BCr%20a"),
    ("../d", "https://example.com/a/d"),
    ("./d/./e/..", "https://example.com/a/b/d/"),
    ("../../../../d", "https://example.com/d"),
    ("%2e%2E/d", "https://example.com/a/d"),
    ("?q=ü'", "https://example.com/a/b/c?q=%C3%BC%27"),
    ("#z", "https://example.com/a/b/c?x=1"),
    ("", "https://example.com/a/b/c?x=1"),
    ("//cdn.example.com/x", "https://cdn.example.com/x"),
    ("\\\\cdn.example.com\\x", "https://cdn.example.com/x"),
    ("/a\\b", "https://example.com/a/b"),
    ("/b?", "https://example.com/b?"),
    ("/plain/path#part", "https://example.com/plain/path"),
    ("/dots/../x", "https://example.com/x"),
    ("https:foo", "https://example.com/a/b/foo"),
    ("http:foo", "http://foo/"),
    ("https://other.example.com/a#b", "https://other.example.com/a"),
    ("mailto:a@b.c", "mailto:a@b.c"),
    ("javascript:void(0)", "javascript:void(0)"),
    ("tel:+1 23", "tel:+1 23"),
    ("data:text/plain,a b#c", "data:text/plain,a b"),
    ("http://", None),
]


def test_absolute_urls(spark):
    rows = spark.createDataFrame(ABSOLUTE, "url string, want string")
    got = rows.select("url", "want", url_text(parse_url("url")).alias("got")).collect()
    assert [(row.url, row.got) for row in got] == [(row.url, row.want) for row in got]


def test_short_way_of_page_url_equals_the_long_one(spark):
    more = [("https://a.example.com/x/y.html?q=/../#f",), ("https://a.example.com/x/.",), ("https://a.b.1/",)]
    rows = spark.createDataFrame([(url,) for url, _ in ABSOLUTE] + more, "url string")
    long_way = url_text(parse_url("url"), query=False)
    assert rows.filter(~page_url("url").eqNullSafe(long_way)).collect() == []


def test_relative_urls(spark):
    rows = spark.createDataFrame([(BASE, href, want) for href, want in RELATIVE], "base string, href string, want string")
    resolved = rows.select(
        "href", "want", F.array("href").alias("hrefs"), parse_url("base").alias("parsed")
    ).withColumn("got", url_text(resolve_urls("hrefs", "parsed")[0]))
    assert [(row.href, row.got) for row in resolved.collect()] == RELATIVE


@pytest.mark.parametrize(
    "url, key, host, path",
    [
        ("https://shop.example/boots/red?size=9#top", "page:https://shop.example/boots/red", "shop.example", "/boots/red"),
        ("https://u@example.com:8443/a b", "page:https://u@example.com:8443/a%20b", "example.com:8443", "/a%20b"),
        ("not a url", None, None, None),
    ],
)
def test_keys(spark, url, key, host, path):
    row = (
        spark.createDataFrame([(url,)], "url string")
        .withColumn("page", page_url("url"))
        .select(resource_key("url").alias("key"), url_host(F.col("page")).alias("host"), url_path(F.col("page")).alias("path"))
        .first()
    )
    assert tuple(row) == (key, host, path)


def plain_walk(path):
    """Dot segments as the standard describes them: a list, a step at a time."""
    steps, kept = path.split("/")[1:], []
    for i, step in enumerate(steps):
        dots = step.lower().replace("%2e", ".")
        if dots == "..":
            kept = kept[:-1]
        if dots in (".", ".."):
            kept += [""] if i == len(steps) - 1 else []
        else:
            kept.append(step)
    return "/" + "/".join(kept)


def test_dot_segments(spark):
    rng = random.Random(4)
    names = ["a", "b", "", ".", "..", "..", "%2e", "%2E.", "..."]
    paths = ["".join("/" + rng.choice(names) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    rows = spark.createDataFrame([(f"https://a.example{path}",) for path in paths], "url string")
    got = [row[0] for row in rows.select(url_text(parse_url("url"))).collect()]
    assert got == ["https://a.example" + plain_walk(path) for path in paths]


def test_punycode(spark):
    """Samples of RFC 3492, and labels at random against Python's codec."""
    samples = [
        ("他们为什么不说中文", "ihqwcrb4cv8a8dqg056pqjye"),
        ("ليهمابتكلموشعربي؟", "egbpdaj6bu4bxfgehfvwxn"),
        ("pročprostěnemluvíčesky", "proprostnemluvesky-uyb24dma41a"),
        ("3年b組金八先生", "3b-ww4c5e180e575a65lsy2b"),
        ("そのスピードで", "d9juau41awczczp"),
        ("-> $1.00 <-", "-> $1.00 <--"),
        ("\U0001f600a\U0001f601", None),
    ]
    rng = random.Random(8)
    samples += [("".join(rng.choice("ab-ü漢я\U0001f600ß0") for _ in range(rng.randrange(1, 60))), None) for _ in range(300)]
    rows = spark.createDataFrame([(text,) for text, _ in samples], "label string")
    got = [row[0] for row in rows.select(punycode(F.col("label"))).collect()]
    assert got == [want or text.encode("punycode").decode() for text, want in samples]
