"""Traffic classification and the request log."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trim_space
from ..functions.urls import (
    ASSET_PATTERN,
    page_url,
    parse_url,
    resolve_urls,
    resource_key,
    url_path,
    url_text,
)
from ..rules import (
    AI_AGENT,
    ANY_KNOWN_PATTERN,
    BOT_TOKEN_ENDINGS,
    BROWSER,
    BotRule,
    DEFAULT_AI_RULES,
    DEFAULT_SEARCH_RULES,
    GENERIC_PATTERN,
    SEARCH_CRAWLER,
    UNKNOWN_BOT,
)


def infer_bot_name(user_agent: Column) -> Column:
    token = F.regexp_extract(user_agent, rf"[A-Za-z][A-Za-z0-9_-]*(?:{BOT_TOKEN_ENDINGS})", 0)
    first_word = F.regexp_extract(user_agent, r"(?s)\A([^ /;]*)", 1)
    return F.coalesce(F.nullif(token, F.lit("")), F.nullif(first_word, F.lit("")), F.lit("UnknownBot"))


def _label(traffic: str, name: str | Column) -> Column:
    return F.struct(F.lit(traffic).alias("type"), (F.lit(name) if isinstance(name, str) else name).alias("name"))


def _first_match(user_agent: Column, rules: Iterable[BotRule], otherwise: Column) -> Column:
    branches: Column | None = None
    for rule in rules:
        if rule.kind == "regex":
            hit = F.rlike(user_agent, F.lit(rule.pattern))
        elif rule.kind == "substring":
            hit = F.contains(F.lower(user_agent), F.lit(rule.pattern.lower()))
        else:
            raise ValueError(f"unknown rule kind: {rule.kind}")
        label = _label(rule.traffic, rule.name)
        branches = F.when(hit, label) if branches is None else branches.when(hit, label)
    return otherwise if branches is None else branches.otherwise(otherwise)


def _by_signs(agent: Column, accept: Column) -> Column:
    """Class of an agent that no rule names: bot words, then signs of a browser."""
    return (
        F.when(F.rlike(agent, F.lit(GENERIC_PATTERN)), _label(UNKNOWN_BOT, infer_bot_name(agent)))
        .when(
            (agent == "")
            | F.contains(agent, F.lit("Mozilla/"))
            | F.contains(F.lower(F.coalesce(accept, F.lit(""))), F.lit("text/html")),
            _label(BROWSER, "Browser"),
        )
        .otherwise(_label(UNKNOWN_BOT, infer_bot_name(agent)))
    )


def traffic_class(agent: Column, accept: Column, rules: Iterable[BotRule] = ()) -> Column:
    """``struct<type, name>`` of the first rule that matches a trimmed user agent.

    Custom AI rules, default AI rules, custom search rules, default search rules,
    generic bot words, browser signs, unknown.  One CASE expression, no shuffle;
    user agents without any known bot word skip the default rules in one test.
    """
    ordered = sorted(rules, key=lambda rule: rule.priority)
    unknown = [rule.traffic for rule in ordered if rule.traffic not in (AI_AGENT, SEARCH_CRAWLER)]
    if unknown:
        raise ValueError(f"rules must be {AI_AGENT} or {SEARCH_CRAWLER}, got {unknown[0]}")
    custom_ai = [rule for rule in ordered if rule.traffic == AI_AGENT]
    custom_search = [rule for rule in ordered if rule.traffic == SEARCH_CRAWLER]

    by_signs = _by_signs(agent, accept)
    known = _first_match(
        agent, DEFAULT_AI_RULES, _first_match(agent, custom_search + DEFAULT_SEARCH_RULES, by_signs)
    )
    unlisted = _first_match(agent, custom_search, by_signs)
    return _first_match(
        agent, custom_ai, F.when(F.rlike(agent, F.lit(ANY_KNOWN_PATTERN)), known).otherwise(unlisted)
    )


def classify_traffic(requests: DataFrame, rules: Iterable[BotRule] = ()) -> DataFrame:
    """Add ``type`` and ``name`` to every request."""
    labelled = requests.withColumn(
        "_agent", trim_space(F.coalesce("user_agent", F.lit("")))
    ).withColumn("_class", traffic_class(F.col("_agent"), F.col("accept"), rules))
    return labelled.select("*", "_class.type", "_class.name").drop("_agent", "_class")


def _named_by_table(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``_agent`` and the names that the best rule of each class gives it.

    Rules are tried on the different agents only.  The least priority wins, among equals
    the least name; a rule of another kind or class matches nothing.
    """
    agents = requests.withColumn("_agent", trim_space(F.coalesce("user_agent", F.lit(""))))
    rules = rules.select("priority", "traffic", "name", "kind", "pattern")
    hit = F.when(F.col("kind") == "regex", F.rlike("_agent", F.col("pattern"))).when(
        F.col("kind") == "substring", F.contains(F.lower("_agent"), F.lower("pattern"))
    )
    matched = agents.select("_agent").distinct().join(rules, hit)

    def best(traffic: str) -> Column:
        order = F.struct("priority", "name")
        return F.min_by(F.when(F.col("traffic") == traffic, F.col("name")), F.when(F.col("traffic") == traffic, order))

    named = matched.groupBy("_agent").agg(best(AI_AGENT).alias("_ai"), best(SEARCH_CRAWLER).alias("_search"))
    return agents.join(named, "_agent", "left")


def classify_with_rules(requests: DataFrame, rules: DataFrame | Iterable[BotRule]) -> DataFrame:
    """`classify_traffic` with user rules before the default rules of their class.

    A rule table can be of any length: it is joined with the different user agents.
    """
    if not isinstance(rules, DataFrame):
        return classify_traffic(requests, list(rules))
    agent = F.col("_agent")
    nothing = F.lit(None).cast("struct<type:string,name:string>")
    label = F.coalesce(
        F.when(F.col("_ai").isNotNull(), _label(AI_AGENT, F.col("_ai"))),
        _first_match(agent, DEFAULT_AI_RULES, nothing),
        F.when(F.col("_search").isNotNull(), _label(SEARCH_CRAWLER, F.col("_search"))),
        _first_match(agent, DEFAULT_SEARCH_RULES, _by_signs(agent, F.col("accept"))),
    )
    labelled = _named_by_table(requests, rules).withColumn("_class", label)
    return labelled.select(*requests.columns, "_class.type", "_class.name")


def is_page_request(method: Column, page: Column) -> Column:
    """GET or HEAD (exactly) of a page URL, made by `page_url`, that is not an asset."""
    return method.isin("GET", "HEAD") & ~F.rlike(url_path(page), F.lit(ASSET_PATTERN))


def page_requests(requests: DataFrame) -> DataFrame:
    """Requests for pages.  `invalid_requests` has those whose URL is not valid."""
    return requests.filter(is_page_request(F.col("method"), page_url("url")))


def invalid_requests(requests: DataFrame) -> DataFrame:
    """Requests whose URL is not valid, to report."""
    return requests.filter(page_url("url").isNull())


def normalize_requests(log: DataFrame, origin: str | None = None) -> DataFrame:
    """Request rows from landed server logs with raw paths and header maps."""

    def header(name: str) -> Column:
        named = F.filter(F.col("_headers"), lambda h: h["name"] == name)
        return F.array_join(F.try_element_at(named, F.lit(-1))["values"], ", ")

    prepared = log.withColumn(
        "_headers",
        F.transform(
            F.map_entries("headers"),
            lambda entry: F.struct(F.lower(entry.key).alias("name"), entry.value.alias("values")),
        ),
    )
    target = F.coalesce("original_url", "url", F.lit("/"))
    if origin is None:
        prepared = prepared.withColumn("url", target)
    else:
        prepared = (
            prepared.withColumn("_targets", F.array(target))
            .withColumn("_origin", parse_url(F.lit(origin)))
            .withColumn("url", url_text(resolve_urls("_targets", "_origin")[0]))
        )
    return prepared.select(
        "request_id",
        "ts",
        F.coalesce("method", F.lit("GET")).alias("method"),
        "url",
        header("user-agent").alias("user_agent"),
        header("accept").alias("accept"),
    )


def traffic_mix(requests: DataFrame) -> DataFrame:
    """Requests and distinct pages per class and name, with subtotals.

    Counts per page first, so the rollup expands few rows and hot pages are
    combined before the shuffle.
    """
    per_page = (
        classify_traffic(requests)
        .select("type", "name", resource_key("url").alias("key"))
        .groupBy("type", "name", "key")
        .agg(F.count("*").alias("n"))
    )
    return (
        per_page.rollup("type", "name")
        .agg(
            F.sum("n").alias("requests"),
            F.count_distinct("key").alias("pages"),
            F.grouping_id().alias("level"),
        )
        .select("type", "name", "level", "requests", "pages")
    )
