"""JSON-LD entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cache import once
from ..functions.exprs import SEP, after_sep, before_sep, let, matches, scrub, settle
from ..functions.text import NOT_WORD_AHEAD, attribute, disarm, inline_text, rearm, trim_space
from ..functions.urls import resolve_url, url_text
from ..functions.values import shortest_digits
from .metadata import with_metadata

_SCRIPT = rf"(?is)<script{NOT_WORD_AHEAD}([^>]*)>(.*?)</script>"
_JSON_LD = "application/ld+json"

# Entity types in order of precedence, with their section titles.
_SECTION_TITLES = (
    ("Organization", "Organization"),
    ("SoftwareApplication", "SoftwareApplication"),
    ("WebPage", "WebPage"),
    ("BreadcrumbList", "Breadcrumbs"),
)


# --- JSON values ----------------------------------------------------------------


def _items(value: Column, path: str = "$") -> Column:
    """Array members, NULL if not an array."""
    return F.try_variant_get(value, path, "array<variant>")


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _kind(value: Column) -> Column:
    """First character of the JSON text: tells strings, numbers and booleans apart."""
    return F.substring(F.to_json(value), 1, 1)


def _member(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _string(value: Column) -> Column:
    """The text of a JSON string, NULL for anything else."""
    return F.when(_kind(value) == '"', F.try_variant_get(value, "$", "string"))


def _number_text(number: Column) -> Column:
    """Shortest text of a number as the web platform writes it: all its digits, and an
    exponent below a millionth and from 1e21."""

    def read(text: Column) -> Column:
        whole = F.regexp_extract(text, r"\A-?([0-9]+)", 1)
        fraction = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]+)", 1), r"0+\z", "")
        written = F.concat(whole, fraction)
        digits = F.regexp_replace(written, r"\A0+", "")
        exponent = F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)", 1).try_cast("int"), F.lit(0))
        # Where the point stands, counted from the first digit that is not zero.
        point = F.length(whole) + exponent - (F.length(written) - F.length(digits))
        return F.struct(
            F.when(F.startswith(text, F.lit("-")), "-").otherwise("").alias("sign"),
            digits.alias("digits"),
            point.alias("point"),
        )

    def write(n: Column) -> Column:
        size = F.length(n.digits)
        power = n.point - 1
        rest = F.regexp_replace(F.substr(n.digits, F.lit(2)), r"0+\z", "")
        plain = (
            F.when(n.point >= size, F.concat(n.digits, F.repeat(F.lit("0"), n.point - size)))
            .when(n.point > 0, F.concat(F.substr(n.digits, F.lit(1), n.point), F.lit("."), F.substr(n.digits, n.point + 1)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -n.point), n.digits))
        )
        scaled = F.concat(
            F.substr(n.digits, F.lit(1), F.lit(1)),
            F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)),
            F.when(power < 0, "e-").otherwise("e+"),
            F.abs(power).cast("string"),
        )
        return F.when(size == 0, "0").otherwise(
            F.concat(n.sign, F.when((n.point > -6) & (n.point <= 21), plain).otherwise(scaled))
        )

    return let(let(shortest_digits(number), read), write)


def _scalar(value: Column) -> Column:
    """Text of a string, number or boolean, else empty; not cleaned yet."""

    def text(v: Column) -> Column:
        kind = _kind(v)
        return (
            F.when(kind.isin('"', "t", "f"), F.try_variant_get(v, "$", "string"))
            .when(F.rlike(kind, F.lit("[-0-9]")), _number_text(F.try_variant_get(v, "$", "double")))
        )

    return let(value, lambda v: F.coalesce(text(v), F.lit("")))


def _texts(*values: Column) -> Column:
    """Clean texts of scalar values."""
    return F.transform(F.transform(F.array(*values), _scalar), inline_text)


def _text_list(value: Column) -> Column:
    """Clean texts of an array of scalars or named objects; one string counts as a list."""

    def candidates(item: Column) -> Column:
        named = F.array(_member(item, "$.name"), _member(item, "$.url"))
        return F.when(_is_object(item), named).otherwise(F.array(item))

    def texts(v: Column) -> Column:
        items = _items(v)
        read = F.transform(
            F.coalesce(items, F.array(v)),
            lambda item: F.get(
                F.filter(
                    F.transform(F.transform(candidates(item), _scalar), inline_text),
                    lambda text: (text != "") | items.isNull(),
                ),
                0,
            ),
        )
        # A lone value counts if it is a string, even a blank one.
        wanted = items.isNotNull() | (_kind(v) == '"')
        return F.when(wanted, F.filter(read, lambda text: text.isNotNull())).otherwise(
            F.array().cast("array<string>")
        )

    return let(value, texts)


# --- nodes ----------------------------------------------------------------------


def _pending(value: Column) -> Column:
    return F.struct(F.lit(False).alias("done"), value.alias("value"))


def _depth(body: Column) -> Column:
    """How deep the arrays of a JSON text are nested."""
    outside = F.regexp_replace(F.regexp_replace(body, r"(?s)\\.", ""), r'"[^"]*"', "")
    brackets = F.regexp_extract_all(outside, F.lit(r"[\[\]]"), F.lit(0))

    def step(state: Column, bracket: Column) -> Column:
        now = F.when(bracket == "[", state.now + 1).otherwise(state.now - 1)
        return F.struct(now.alias("now"), F.greatest(state.most, now).alias("most"))

    return F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step).most


@once
def _parse_scripts() -> Column:
    """Parsed JSON of every JSON-LD script, with a bound on its nesting."""

    def parse(script: Column) -> Column:
        # Wrapped in an array, so that anything after the value is an error.
        return let(
            trim_space(rearm(after_sep(script))),
            lambda body: F.struct(
                _depth(body).alias("levels"),
                F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).alias("value"),
            ),
        )

    scripts = F.filter(
        matches(disarm(scrub(F.col("html")), "script"), _SCRIPT, f"$1{SEP}$2"),
        lambda script: F.coalesce(F.lower(attribute(before_sep(script), "type")) == _JSON_LD, F.lit(False)),
    )
    # Most pages have no such script at all.
    return F.when(F.rlike("html", F.lit("(?i)ld\\+json")), F.transform(scripts, parse))


@once
def _visit_nodes() -> Column:
    """``array<variant>`` of all nodes in visit order.

    Arrays are visited item by item and ``@graph`` members come before the node
    that holds them.  Every round of the fold opens one level of nesting; there are
    as many levels as the arrays of the text are deep.
    """

    def open_value(entry: Column) -> Column:
        members = F.transform(_items(entry.value), _pending)
        graph = F.transform(_items(entry.value, '$["@graph"]'), _pending)
        itself = F.array(F.struct(F.lit(True).alias("done"), entry.value.alias("value")))
        return (
            F.when(entry.done, F.array(entry))
            .when(members.isNotNull(), members)
            .when(_is_object(entry.value), F.concat(F.coalesce(graph, F.slice(itself, 1, 0)), itself))
            .otherwise(F.slice(itself, 1, 0))
        )

    def open_level(entries: Column, _level: Column) -> Column:
        return F.when(
            F.exists(entries, lambda entry: ~entry.done), F.flatten(F.transform(entries, open_value))
        ).otherwise(entries)

    def visit(parsed: Column) -> Column:
        members = F.transform(_items(parsed.value), _pending)
        opened = F.aggregate(F.sequence(F.lit(0), parsed.levels), members, open_level)
        return F.when(F.size(members) == 1, F.transform(opened, lambda entry: entry.value))

    per_script = F.transform(F.col("_scripts"), visit)
    return F.flatten(F.filter(per_script, lambda nodes: nodes.isNotNull()))


def _entity_type(node: Column) -> Column:
    """The recognized type that wins, NULL for other nodes."""
    declared = _member(node, '$["@type"]')
    names = let(
        declared,
        lambda value: F.coalesce(
            F.transform(_items(value), _string), F.array(_string(value))
        ),
    )

    def pick(types: Column) -> Column:
        winner = None
        for name, _ in _SECTION_TITLES:
            hit = F.coalesce(F.array_contains(types, name), F.lit(False))
            winner = F.when(hit, name) if winner is None else winner.when(hit, name)
        return winner

    return let(names, pick)


def _read_entity(node: Column) -> Column:
    """Fields of a node with URLs as written, NULL for other nodes."""

    def link(value: Column, *names: str) -> Column:
        """A string as it is, or the first non-blank member of an object."""

        def read(v: Column) -> Column:
            members = F.filter(
                _texts(*[_member(v, f'$["{name}"]') for name in names]), lambda text: text != ""
            )
            return (
                F.when(_kind(v) == '"', F.try_variant_get(v, "$", "string"))
                .when(_is_object(v), F.coalesce(F.get(members, 0), F.lit("")))
                .otherwise("")
            )

        return let(value, read)

    def crumb(item: Column) -> Column:
        return F.struct(
            _texts(_member(item, "$.name"))[0].alias("name"),
            link(_member(item, "$.item"), "url", "@id").alias("url"),
        )

    def fields(kind: Column) -> Column:
        named = kind != "BreadcrumbList"
        application = kind == "SoftwareApplication"
        texts = _texts(
            *[_member(node, f"$.{name}") for name in ("name", "url", "description", "applicationCategory", "operatingSystem")]
        )
        listed = F.when(kind == "Organization", _member(node, "$.sameAs")).when(
            application, _member(node, "$.featureList")
        )
        return F.struct(
            kind.alias("entity"),
            texts.alias("texts"),
            F.coalesce(_text_list(listed), F.array().cast("array<string>")).alias("listed"),
            F.when(application, link(_member(node, "$.offers"), "url")).otherwise("").alias("offer_url"),
            F.when(
                kind == "BreadcrumbList",
                F.transform(F.filter(_items(node, "$.itemListElement"), _is_object), crumb),
            ).alias("crumbs"),
            named.alias("named"),
            application.alias("application"),
        )

    def plain(entity: Column) -> Column:
        def text(i: int, wanted: Column) -> Column:
            return F.when(wanted, entity.texts[i]).otherwise("")

        return F.struct(
            entity.entity.alias("entity"),
            text(0, entity.named).alias("name"),
            text(1, entity.named).alias("url"),
            text(2, entity.named).alias("description"),
            text(3, entity.application).alias("category"),
            text(4, entity.application).alias("operating_system"),
            entity.listed.alias("listed"),
            entity.offer_url.alias("offer_url"),
            entity.crumbs.alias("crumbs"),
        )

    return let(
        _entity_type(node), lambda kind: F.when(kind.isNotNull(), let(fields(kind), plain))
    )


@once
def _read_entities() -> Column:
    return F.filter(F.transform(F.col("_nodes"), _read_entity), lambda entity: entity.isNotNull())


def _listed_links(entity: Column) -> Column:
    return F.when(entity.entity == "Organization", entity.listed).otherwise(F.array().cast("array<string>"))


@once
def _absolute_urls() -> Column:
    """For every entity its URLs made absolute: its own, that of the offer, those of the list
    and of the crumbs.  One that is not valid stays as written."""

    def written(entity: Column) -> Column:
        crumbs = F.transform(entity.crumbs, lambda c: c.url)
        return F.concat(
            F.array(entity.url, entity.offer_url),
            _listed_links(entity),
            F.coalesce(crumbs, F.array().cast("array<string>")),
        )

    def absolute(url: Column) -> Column:
        return F.coalesce(let(resolve_url(url, F.col("canonical")), url_text), url)

    return F.transform("_read", lambda entity: F.transform(written(entity), absolute))


@once
def _absolute_entities() -> Column:
    """Entities with absolute URLs, taken by their place in `_absolute_urls`."""
    no_texts = F.array().cast("array<string>")

    def field(written: Column, absolute: Column) -> Column:
        return F.when(written == "", written).otherwise(absolute)

    def place(entity: Column, urls: Column) -> Column:
        organization = entity.entity == "Organization"
        links = F.size(_listed_links(entity))
        crumbs = F.transform(
            entity.crumbs,
            lambda c, i: F.struct(c["name"].alias("name"), field(c.url, F.get(urls, 2 + links + i)).alias("url")),
        )
        return F.struct(
            entity.entity.alias("entity"),
            entity["name"].alias("name"),
            field(entity.url, F.get(urls, 0)).alias("url"),
            entity.description.alias("description"),
            # A blank list entry resolves to the page itself, a blank field is absent.
            F.when(organization, F.slice(urls, F.lit(3), links)).otherwise(no_texts).alias("same_as"),
            entity.category.alias("category"),
            entity.operating_system.alias("operating_system"),
            F.when(organization, no_texts).otherwise(entity.listed).alias("features"),
            field(entity.offer_url, F.get(urls, 1)).alias("offer_url"),
            F.filter(crumbs, lambda c: (c["name"] != "") | (c.url != "")).alias("breadcrumbs"),
        )

    return F.zip_with("_read", "_absolute", place)


def with_entities(prepared: DataFrame) -> DataFrame:
    """Add ``entities`` (array of structs, NULL if none) to the output of `with_metadata`."""
    resolved = (
        prepared.withColumn("_scripts", _parse_scripts())
        .withColumn("_nodes", _visit_nodes())
        .withColumn("_read", _read_entities())
        .withColumn("_absolute", _absolute_urls())
    )
    return resolved.withColumn("entities", _absolute_entities()).drop("_scripts", "_nodes", "_read", "_absolute")


def structured_entities(pages: DataFrame) -> DataFrame:
    """One row per recognized JSON-LD node in visit order; no shuffle."""
    prepared = with_entities(with_metadata(pages.select("page_id", "url", "html")))
    valid = F.when(F.col("canonical").isNotNull(), F.col("entities"))
    return (
        settle(prepared, "page_id", valid.alias("entities"))
        .select("page_id", F.posexplode("entities").alias("node_no", "node"))
        .select("page_id", "node_no", "node.*")
    )


# --- Markdown ---------------------------------------------------------------------


def _labelled(label: str, text: Column) -> Column:
    return F.when(text != "", F.array(F.concat(F.lit(f"{label}: "), text))).otherwise(F.array().cast("array<string>"))


def _bulleted(label: str, texts: Column) -> Column:
    return F.when(
        F.size(texts) > 0,
        F.concat(F.array(F.lit(f"{label}:")), F.transform(texts, lambda text: F.concat(F.lit("- "), text))),
    ).otherwise(F.array().cast("array<string>"))


def entity_section(entity: Column) -> Column:
    """Markdown section of an entity, empty if it has no line."""
    crumbs = F.transform(
        F.coalesce(entity.breadcrumbs, F.slice(entity.breadcrumbs, 1, 0)),
        lambda c: F.concat(
            F.lit("- "),
            F.array_join(F.filter(F.array(c["name"], c["url"]), lambda text: text != ""), ": "),
        ),
    )
    lines = F.concat(
        _labelled("Name", entity["name"]),
        _labelled("URL", entity.url),
        _labelled("Description", entity.description),
        _bulleted("Same as", entity.same_as),
        _labelled("Category", entity.category),
        _labelled("Operating system", entity.operating_system),
        _bulleted("Features", entity.features),
        _labelled("Offer", entity.offer_url),
        F.coalesce(crumbs, F.array().cast("array<string>")),
    )
    title = None
    for name, heading in _SECTION_TITLES:
        hit = entity.entity == name
        title = F.when(hit, heading) if title is None else title.when(hit, heading)
    return let(
        lines,
        lambda ls: F.when(
            F.size(ls) > 0, F.concat(F.lit("### "), title, F.lit("\n"), F.array_join(ls, "\n"))
        ).otherwise(""),
    )


@once
def _sections() -> Column:
    """All sections, without empty ones and exact repeats, first one kept."""
    sections = F.filter(F.transform(F.col("entities"), entity_section), lambda section: section != "")
    return F.coalesce(F.array_join(F.array_distinct(sections), "\n\n"), F.lit(""))


def with_sections(prepared: DataFrame) -> DataFrame:
    """Add ``structured``, the Markdown of all entities, to the output of `with_metadata`."""
    return with_entities(prepared).withColumn("structured", _sections()).drop("entities")


def structured_markdown(pages: DataFrame) -> DataFrame:
    """Structured-data section per page that has one."""
    prepared = with_sections(with_metadata(pages.select("page_id", "url", "html")))
    valid = F.when(F.col("canonical").isNotNull(), F.col("structured"))
    return settle(prepared, "page_id", valid.alias("markdown")).filter(F.col("markdown") != "")
