"""JSON-LD entities."""

import json

import pytest

from pagetables.operators.structured import structured_entities, structured_markdown

PAGES = "page_id bigint, url string, html string"


def page_with(spark, *scripts):
    html = "".join(
        script if script.startswith("<") else f'<script type="application/ld+json">{script}</script>' for script in scripts
    )
    return spark.createDataFrame([(1, "https://example.com/docs/page", html)], PAGES)


def entities(spark, *scripts):
    return structured_entities(page_with(spark, *scripts)).orderBy("node_no").collect()


def named(name, kind="WebPage", **more):
    return {"@type": kind, "name": name, **more}


def test_fields(spark):
    organization = named(
        " Org &amp; <b>Co</b> ", "Organization", url="/org", description=True, sameAs=["https://s.example.com/a#x", {"name": "/n"}, "", None]
    )
    application = named(
        7.50, "SoftwareApplication", operatingSystem="Web", applicationCategory=False, featureList=["f1", 2, {"url": "u"}], offers={"url": "/buy"}
    )
    crumbs = {
        "@type": "BreadcrumbList",
        "name": "not shown",
        "itemListElement": [{"name": "Home", "item": "/"}, {"name": "Here"}, {"item": {"@id": "http://["}}, {}, "x"],
    }
    got = entities(spark, json.dumps([organization, application, crumbs]))
    assert [row.entity for row in got] == ["Organization", "SoftwareApplication", "BreadcrumbList"]
    first, second, third = got
    assert (first.name, first.url, first.description) == ("Org & Co", "https://example.com/org", "true")
    assert first.same_as == ["https://s.example.com/a", "https://example.com/n"]
    assert (second.name, second.category, second.operating_system) == ("7.5", "false", "Web")
    assert (second.features, second.offer_url) == (["f1", "2", "u"], "https://example.com/buy")
    assert third.name == ""
    assert [tuple(crumb) for crumb in third.breadcrumbs] == [("Home", "https://example.com/"), ("Here", ""), ("", "http://[")]


def test_visit_order_and_depth(spark):
    deep = {"@graph": [{"@graph": [{"@graph": [[[{"@graph": [{"@graph": [named("inner")]}]}]]]}]}, named("second")]}
    nested = {**named("parent"), "@graph": [named("child")], "about": named("not visited")}
    got = entities(spark, json.dumps([deep, [nested, [named("last")]]]))
    assert [row.name for row in got] == ["inner", "second", "child", "parent", "last"]


def test_types_and_precedence(spark):
    nodes = [
        {"@type": ["BreadcrumbList", "WebPage", "Organization"], "name": "a"},
        {"@type": "organization", "name": "b"},
        {"@type": "Thing", "name": "c"},
        {"@type": ["Thing", 5, "SoftwareApplication"], "name": "d"},
        {"name": "e"},
    ]
    assert [(row.entity, row.name) for row in entities(spark, json.dumps(nodes))] == [
        ("Organization", "a"),
        ("SoftwareApplication", "d"),
    ]


def test_scripts_that_count(spark):
    got = entities(
        spark,
        "{bad json",
        json.dumps(named("ok")) + " trailing",
        "",
        '<!-- <script type="APPLICATION/LD+JSON" id="x">' + json.dumps(named("in comment")) + "</script> -->",
        "<script type='text/javascript'>" + json.dumps(named("no")) + "</script>",
        "<script>" + json.dumps(named("no")) + "</script>",
        '{"@type":"WebPage","name":"first","name":"repeated key"}',
        '"text"',
    )
    assert [row.name for row in got] == ["in comment", "repeated key"]


def test_numbers(spark):
    values = [1, -2.5, 1e21, 1e-7, 12345678901, 0.1]
    got = entities(spark, json.dumps([named(value) for value in values]))
    assert [row.name for row in got] == ["1", "-2.5", "1e+21", "1e-7", "12345678901", "0.1"]


def test_sections(spark):
    nodes = [
        named("Org", "Organization", sameAs="https://s.example.com/"),
        {"@type": "BreadcrumbList", "itemListElement": [{"name": "Home", "item": "/"}, {"name": "Here"}]},
        named("Org", "Organization", sameAs="https://s.example.com/"),
        {"@type": "WebPage"},
        named("App", "SoftwareApplication", featureList=["a"], offers="buy"),
    ]
    row = structured_markdown(page_with(spark, json.dumps(nodes))).first()
    assert row.markdown == (
        "### Organization\nName: Org\nSame as:\n- https://s.example.com/\n\n"
        "### Breadcrumbs\n- Home: https://example.com/\n- Here\n\n"
        "### SoftwareApplication\nName: App\nFeatures:\n- a\nOffer: https://example.com/docs/buy"
    )


def test_blank_lone_list_entry_counts(spark):
    row = entities(spark, json.dumps(named("Org", "Organization", sameAs=" ")))[0]
    assert row.same_as == ["https://example.com/docs/page"]


@pytest.mark.parametrize(
    "written, text",
    [
        ("0.12345678901234568", "0.12345678901234568"),
        ("1.2345678901234e-5", "0.000012345678901234"),
        ("1e-6", "0.000001"),
        ("1.5e-7", "1.5e-7"),
        ("123456789012345680000", "123456789012345680000"),
        ("1e21", "1e+21"),
        ("-2.5e+30", "-2.5e+30"),
        ("-0.001", "-0.001"),
        ("100", "100"),
        ("7.50", "7.5"),
        ("0", "0"),
        ("-0.0", "0"),
        ("4.9e-324", "5e-324"),
    ],
)
def test_numbers_keep_all_digits(spark, written, text):
    html = f'<script type="application/ld+json">{{"@type":"WebPage","name":{written}}}</script>'
    page = spark.createDataFrame([(1, "https://e.com/", html)], "page_id bigint, url string, html string")
    assert structured_entities(page).first()["name"] == text
