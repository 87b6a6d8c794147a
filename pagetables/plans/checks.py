"""DuckDB SQL for the registered queries, written independently of the operators.

The regular expressions are RE2: no back references, so both quotes and all heading
levels are spelled out.
"""

from __future__ import annotations

from .views import with_views

CHECKS: dict[str, str] = {}

# Known agents in match order, as RE2 words.
AI_AGENT_WORDS = (
    ("Applebot", r"applebot"),
    ("GPTBot", r"gptbot"),
    ("ChatGPT-User", r"chatgpt-user"),
    ("OAI-SearchBot", r"oai-searchbot"),
    ("Google-CloudVertexBot", r"google-cloudvertexbot"),
    ("Claude", r"claude/[0-9]+(?:\.[0-9]+)?"),
    ("ClaudeBot", r"claudebot"),
    ("Claude-User", r"claude-user"),
    ("Claude-SearchBot", r"claude-searchbot"),
    ("Anthropic-AI", r"anthropic-ai"),
    ("PerplexityBot", r"perplexitybot"),
    ("Perplexity-User", r"perplexity-user"),
    ("YouBot", r"youbot"),
    ("Cohere-AI", r"cohere-ai"),
    ("Amazonbot", r"amazonbot"),
    ("Anchor Browser", r"anchor[ -]?browser"),
    ("Bytespider", r"bytespider"),
    ("Cloudflare Crawler", r"cloudflare[ -]?crawler"),
    ("CCBot", r"ccbot"),
    ("DuckAssistBot", r"duckassistbot"),
    ("FacebookBot", r"facebookbot"),
    ("Manus Bot", r"manus[ -]?bot"),
    ("Meta-ExternalAgent", r"meta-externalagent"),
    ("Meta-ExternalFetcher", r"meta-externalfetcher"),
    ("MistralAI-User", r"mistralai-user"),
    ("Novellum AI Crawl", r"novellum[ -]?ai[ -]?crawl"),
    ("PetalBot", r"petalbot"),
    ("ProRataInc", r"proratainc"),
    ("TikTok Spider", r"tiktok[ -]?spider"),
    ("Timpibot", r"timpibot"),
)
SEARCH_CRAWLER_WORDS = (
    ("Googlebot", r"googlebot"),
    ("Bingbot", r"bingbot"),
    ("DuckDuckBot", r"duckduckbot"),
    ("YandexBot", r"yandexbot"),
    ("Baiduspider", r"baiduspider"),
    ("archive.org_bot", r"archive\.org_bot"),
    ("Arquivo Web Crawler", r"arquivo[ -]?web[ -]?crawler"),
    ("Terracotta Bot", r"terracotta[ -]?bot"),
    ("Slurp", r"slurp"),
)
GENERIC_WORDS = "bot|crawler|spider|scraper|agent"

_AS_OF = "TIMESTAMP '2024-01-05 00:00:00'"
_GENERATED = "2024-01-02T03:04:05.678Z"
_SPACES = r"[\s\x0B\x{A0}\x{FEFF}\x{2028}\x{2029}\x{3000}]"
_ISO = "%Y-%m-%dT%H:%M:%S.%gZ"


def _check(name: str, select: str, *views: str) -> None:
    CHECKS[name] = with_views(select, *views)


# --- fragments ------------------------------------------------------------------------


def page(url: str) -> str:
    site = f"lower(regexp_extract({url}, '^([A-Za-z]+://[^/]*)', 1))"
    return f"({site} || regexp_extract({url}, '^[A-Za-z]+://[^/]*(/[^?#]*)', 1))"


def key(url: str) -> str:
    return f"('page:' || {page(url)})"


def decode(text: str) -> str:
    for entity, mark in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''")):
        text = f"regexp_replace({text}, '{entity}', '{mark}', 'gi')"
        if entity == "&quot;":
            text = f"replace({text}, '&#39;', '''')"
    return text


def strip(text: str) -> str:
    return f"regexp_replace({text}, '<[^>]+>', '', 'g')"


def inline(text: str) -> str:
    return f"trim(regexp_replace({decode(strip(text))}, '{_SPACES}+', ' ', 'g'))"


def without(text: str, tags: str) -> str:
    for tag in tags.split():
        text = rf"regexp_replace({text}, '<{tag}\b[^>]*>.*?</{tag}>', '', 'gis')"
    return text


def without_noise(text: str) -> str:
    text = without(text, "script style noscript template svg canvas iframe")
    return f"regexp_replace({text}, '<!--.*?-->', '', 'gs')"


def first_inside(text: str, tag: str) -> str:
    pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"
    return f"CASE WHEN regexp_matches({text}, '{pattern}') THEN regexp_extract({text}, '{pattern}', 1) END"


def attr(attrs: str, name: str) -> str:
    pattern = rf"(?i){name}\s*=\s*(?:\"([^\"\n\r]*)\"|''([^''\n\r]*)'')"
    return (
        f"CASE WHEN regexp_matches({attrs}, '{pattern}') THEN "
        f"regexp_extract({attrs}, '{pattern}', 1) || regexp_extract({attrs}, '{pattern}', 2) END"
    )


def escape_path(path: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({path}, '[!-~]+|[^!-~]+'), "
        "lambda run: CASE WHEN regexp_matches(run, '^[!-~]') THEN run ELSE url_encode(run) END), '')"
    )


# Main content of cleaned pages, ready to render.  Two links of the chain per CTE.
def contents(source: str) -> str:
    return f"""
cleaned AS (SELECT page_id, url, html, {without_noise('html')} AS cleaned FROM {source}),
regions AS (
  SELECT *, CASE
      WHEN {first_inside('cleaned', 'main')} IS NOT NULL THEN 'main'
      WHEN {first_inside('cleaned', 'article')} IS NOT NULL THEN 'article'
      WHEN regexp_matches(cleaned, 'role=["'']main["'']') THEN 'role'
      WHEN {first_inside('cleaned', 'body')} IS NOT NULL THEN 'body' ELSE 'whole' END AS region,
    coalesce({first_inside('cleaned', 'main')}, {first_inside('cleaned', 'article')},
      {first_inside('cleaned', 'body')}, cleaned) AS inside
  FROM cleaned),
contents AS (SELECT *, {without(without_noise('inside'), 'nav footer aside')} AS content FROM regions)"""


METADATA = f"""
linked AS (
  SELECT *, {attr('''list_filter(regexp_extract_all(cleaned, '(?i)<link\\b([^>]*)>', 1), lambda a: list_contains(string_split_regex(lower(''' + "coalesce(" + attr('a', 'rel') + ", '')" + '''), '\\s+'), 'canonical'))[1]''', 'href')} AS canonical_href,
    list_filter(regexp_extract_all(cleaned, '(?i)<meta\\b([^>]*)>', 1), lambda a: lower({attr('a', 'name')}) = 'description')[1] AS description_tag,
    {inline("regexp_extract(cleaned, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS page_title
  FROM contents),
metadata AS (
  SELECT *, {page("coalesce(canonical_href, url)")} AS canonical_url, page_title AS title,
    CASE WHEN description_tag IS NULL THEN '' ELSE {inline("coalesce(" + attr('description_tag', 'content') + ", '')")} END AS meta_description
  FROM linked)"""


def with_steps(select: str, source: str, *steps: str) -> str:
    """``select`` over the page steps on top of ``source``."""
    views = with_views("", source) if source != "pages" else "WITH"
    joined = ", ".join((contents(source), *steps))
    return f"{views}{',' if source != 'pages' else ''} {joined} {select}"


# --- sources and sinks ------------------------------------------------------------------

_RESOURCE_FIELDS = f"key, url, status, strftime(generated_at, '{_ISO}') AS generated_at, markdown, reason"
_LATEST = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY generated_at DESC) AS n FROM resource_history"

_check(
    "read_requests",
    "SELECT request_id, method, 'https://app.example.com' || regexp_replace("
    "regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1), '#.*', '') AS url, user_agent, "
    "accept || ', text/plain' AS accept FROM requests",
    "requests",
)
_check("read_resource_json", f"""SELECT key, url, status, strftime(generated_at, '{_ISO}') AS generated_at,
  CASE WHEN status <> 'failed' THEN markdown END AS markdown, CASE WHEN status = 'failed' THEN reason END AS reason
  FROM resources WHERE status <> 'pending'""", "resources")
_check("write_resources", f"SELECT {_RESOURCE_FIELDS} FROM ({_LATEST}) WHERE n = 1", "resource_history")
_check("latest_resources", f"SELECT {_RESOURCE_FIELDS} FROM ({_LATEST}) WHERE n = 1", "resource_history")
_check("export_resource_json", f"""
SELECT key, status, '{{' || array_to_string(list_filter([
    '"status":' || to_json(status), '"url":' || to_json(url),
    '"generatedAt":' || to_json(strftime(generated_at, '{_ISO}')),
    CASE WHEN status <> 'failed' AND markdown IS NOT NULL THEN '"markdown":' || to_json(markdown) END,
    CASE WHEN status = 'failed' AND reason IS NOT NULL THEN '"reason":' || to_json(reason) END
  ], lambda f: f IS NOT NULL), ',') || '}}' AS value FROM resource_history""", "resource_history")

# --- pages --------------------------------------------------------------------------------

_check("resource_keys", f"SELECT page_id, url, {key('url')} AS key FROM pages")
_check("collapse_variants", f"SELECT {key('url')} AS key, count(*) AS variants, min(url) AS first_url FROM pages GROUP BY 1")
CHECKS["page_metadata"] = with_steps(
    "SELECT page_id, canonical_url, title, meta_description, CAST(NULL AS VARCHAR) AS error FROM metadata",
    "pages_enriched",
    METADATA,
)
CHECKS["content_profile"] = with_steps(
    f"""SELECT regexp_extract({page('url')}, '://([^/]*)', 1) AS host, region, count(*) AS pages,
  CAST(sum(length(html)) AS BIGINT) AS raw_chars, CAST(sum(length(content)) AS BIGINT) AS content_chars,
  CAST(sum(length(html)) - sum(length(content)) AS DOUBLE) / CAST(sum(length(html)) AS DOUBLE) AS removed_share
FROM contents GROUP BY 1, 2""",
    "pages",
)

TABLE_ROWS = f"""
tables AS (
  SELECT page_id, list_filter(list_transform(regexp_extract_all(content, '(?is)<table\\b[^>]*>.*?</table>'),
    lambda t: list_filter(list_transform(regexp_extract_all(t, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1),
      lambda r: list_transform(regexp_extract_all(r, '(?is)<th\\b[^>]*>.*?</th>|<td\\b[^>]*>.*?</td>'),
        lambda c: {inline('c')})), lambda r: len(r) > 0)), lambda t: len(t) > 0) AS found
  FROM contents),
table_list AS (SELECT page_id, unnest(found) AS rows, generate_subscripts(found, 1) - 1 AS table_no FROM tables),
table_rows AS (
  SELECT page_id, table_no, list_max(list_transform(rows, lambda r: len(r))) AS width,
    unnest(rows) AS cells, generate_subscripts(rows, 1) - 1 AS row_no FROM table_list)"""
CHECKS["html_tables"] = with_steps(
    """SELECT page_id, CAST(table_no AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no,
  array_to_string(list_concat(cells, list_transform(range(width - len(cells)), lambda i: '')), ' | ') AS cells
FROM table_rows""",
    "pages_enriched",
    TABLE_ROWS,
)

# JSON-LD: array items and one level of @graph.
ENTITIES = f"""
scripts AS (
  SELECT page_id, canonical_url, unnest(found) AS script, generate_subscripts(found, 1) AS script_no
  FROM (SELECT page_id, canonical_url, regexp_extract_all(html, '(?is)<script type="application/ld.json">(.*?)</script>', 1) AS found FROM metadata)),
documents_ld AS (SELECT page_id, canonical_url, script_no, script::JSON AS doc FROM scripts WHERE json_valid(script)),
roots AS (
  SELECT page_id, canonical_url, script_no, unnest(items) AS node, generate_subscripts(items, 1) AS item_no
  FROM (SELECT *, CASE json_type(doc) WHEN 'ARRAY' THEN CAST(doc AS JSON[]) ELSE [doc] END AS items FROM documents_ld)),
visited AS (
  SELECT page_id, canonical_url, script_no, item_no, unnest(members) AS node, generate_subscripts(members, 1) AS member_no
  FROM (SELECT *, list_concat(coalesce(CAST(json_extract(node, '$."@graph"') AS JSON[]), []), [node]) AS members FROM roots)),
typed AS (
  SELECT *, CASE json_type(node, '$."@type"') WHEN 'ARRAY' THEN CAST(json_extract(node, '$."@type"') AS VARCHAR[])
    ELSE [json_extract_string(node, '$."@type"')] END AS types FROM visited),
recognized AS (
  SELECT *, CASE WHEN list_contains(types, 'Organization') THEN 'Organization'
    WHEN list_contains(types, 'SoftwareApplication') THEN 'SoftwareApplication'
    WHEN list_contains(types, 'WebPage') THEN 'WebPage'
    WHEN list_contains(types, 'BreadcrumbList') THEN 'BreadcrumbList' END AS entity,
    regexp_extract(canonical_url, '^([a-z]+://[^/]*)', 1) AS site FROM typed),
fields AS (
  SELECT page_id, entity, row_number() OVER (PARTITION BY page_id ORDER BY script_no, item_no, member_no) - 1 AS node_no,
    CASE WHEN entity <> 'BreadcrumbList' THEN coalesce(json_extract_string(node, '$.name'), '') ELSE '' END AS name,
    coalesce(site || json_extract_string(node, '$.url'), '') AS url,
    coalesce(json_extract_string(node, '$.description'), '') AS description,
    coalesce(CAST(json_extract(node, '$.sameAs') AS VARCHAR[]), []) AS same_as,
    coalesce(json_extract_string(node, '$.applicationCategory'), '') AS category,
    coalesce(json_extract_string(node, '$.operatingSystem'), '') AS operating_system,
    coalesce(CAST(json_extract(node, '$.featureList') AS VARCHAR[]), []) AS features,
    coalesce(site || json_extract_string(node, '$.offers.url'), '') AS offer_url,
    list_transform(coalesce(CAST(json_extract(node, '$.itemListElement') AS JSON[]), []), lambda c: {{
      'name': coalesce(json_extract_string(c, '$.name'), ''),
      'url': coalesce(site || json_extract_string(c, '$.item'), '')}}) AS crumbs
  FROM recognized WHERE entity IS NOT NULL)"""
CHECKS["structured_entities"] = with_steps(
    """SELECT page_id, CAST(node_no AS INTEGER) AS node_no, entity, name, url, description,
  array_to_string(same_as, chr(10)) AS same_as, category, operating_system,
  array_to_string(features, chr(10)) AS features, offer_url,
  array_to_string(list_transform(crumbs, lambda c: c.name || ' ' || c.url), chr(10)) AS breadcrumbs FROM fields""",
    "pages_enriched",
    METADATA,
    ENTITIES,
)

SECTIONS = """
section_texts AS (
  SELECT page_id, node_no, list_concat(
    CASE WHEN name <> '' THEN ['Name: ' || name] ELSE [] END,
    CASE WHEN url <> '' THEN ['URL: ' || url] ELSE [] END,
    CASE WHEN description <> '' THEN ['Description: ' || description] ELSE [] END,
    CASE WHEN len(same_as) > 0 THEN list_concat(['Same as:'], list_transform(same_as, lambda s: '- ' || s)) ELSE [] END,
    CASE WHEN category <> '' THEN ['Category: ' || category] ELSE [] END,
    CASE WHEN operating_system <> '' THEN ['Operating system: ' || operating_system] ELSE [] END,
    CASE WHEN len(features) > 0 THEN list_concat(['Features:'], list_transform(features, lambda f: '- ' || f)) ELSE [] END,
    CASE WHEN offer_url <> '' THEN ['Offer: ' || offer_url] ELSE [] END,
    list_transform(crumbs, lambda c: '- ' || c.name || CASE WHEN c.url <> '' THEN ': ' || c.url ELSE '' END)) AS lines,
    CASE entity WHEN 'BreadcrumbList' THEN 'Breadcrumbs' ELSE entity END AS heading
  FROM fields),
sections AS (
  SELECT page_id, string_agg(section, chr(10) || chr(10) ORDER BY node_no) AS structured
  FROM (SELECT page_id, min(node_no) AS node_no, '### ' || heading || chr(10) || array_to_string(lines, chr(10)) AS section
        FROM section_texts WHERE len(lines) > 0 GROUP BY 1, 3)
  GROUP BY 1)"""
CHECKS["structured_markdown"] = with_steps(
    "SELECT page_id, structured AS markdown FROM sections", "pages_enriched", METADATA, ENTITIES, SECTIONS
)

_HREF = r"(?i)<a\b[^>]*href\s*=\s*(?:\"[^\"\n\r]*\"|''[^''\n\r]*'')"


def edges(source: str) -> str:
    return f"""
hrefs AS (
  SELECT page_id, {page('url')} AS source, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS site,
    list_transform(regexp_extract_all(html, '{_HREF}'),
      lambda m: trim(regexp_extract(m, '["'']([^"'']*)["'']$', 1))) AS found FROM {source}),
href_list AS (SELECT page_id, source, site, unnest(found) AS href, generate_subscripts(found, 1) AS n FROM hrefs),
targets AS (
  SELECT page_id, source, site || {escape_path("regexp_replace(replace(href, '&amp;', '&'), '[?#].*', '')")} AS target, min(n) AS n
  FROM href_list WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|tel:)')
  GROUP BY ALL),
edges AS (
  SELECT page_id, source, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS link_no, target
  FROM targets WHERE NOT regexp_matches(target, '(?i)\\.(avif|bmp|css|gif|ico|jpeg|jpg|js|json|map|mp3|mp4|pdf|png|svg|txt|webm|webp|woff2?)$'))"""


CHECKS["link_graph"] = f"WITH {edges('pages')} SELECT * FROM edges"
CHECKS["link_in_degree"] = f"""WITH {edges('pages')}
SELECT target, count(DISTINCT source) AS linking_pages, count(*) AS links FROM edges GROUP BY 1"""
CHECKS["uncrawled_links"] = f"""{with_views('', 'resources', 'pages_enriched')}, {edges('pages_enriched')}
SELECT 'page:' || target AS key, target AS url, count(DISTINCT source) AS linking_pages FROM edges
WHERE NOT EXISTS (SELECT 1 FROM resources r WHERE r.key = 'page:' || target) GROUP BY ALL"""

# --- sitemaps -------------------------------------------------------------------------------

_LOCATIONS = r"""
located AS (
  SELECT sitemap_id, list_filter(list_transform(regexp_extract_all(xml, '(?is)<loc>\s*(.*?)\s*</loc>', 1),
    lambda u: replace(trim(u), '&amp;', '&')), lambda u: u <> '') AS urls FROM sitemaps),
listed AS (SELECT sitemap_id, CAST(generate_subscripts(urls, 1) - 1 AS INTEGER) AS pos, unnest(urls) AS url FROM located)"""
CHECKS["sitemap_urls"] = f"{with_views('', 'sitemaps')}, {_LOCATIONS} SELECT * FROM listed"
CHECKS["crawl_run_frontier"] = f"""{with_views('', 'sitemaps')}, {_LOCATIONS}
SELECT sitemap_id, pos, url FROM listed ORDER BY sitemap_id, pos LIMIT 100"""
CHECKS["read_sitemaps"] = f"""{with_views('', 'sitemaps')}, {_LOCATIONS}
SELECT 'https://example.com/map' || sitemap_id AS sitemap_url, pos, url FROM listed WHERE sitemap_id % 5 <> 0"""
CHECKS["crawl_frontier"] = f"{with_views('', 'sitemaps')}, {_LOCATIONS} SELECT * FROM listed WHERE pos < 2"

# --- requests -------------------------------------------------------------------------------


def _rules(kind: str, words: tuple[tuple[str, str], ...]) -> str:
    return " ".join(
        rf"WHEN regexp_matches(ua, '(?i)\b(?:{word})\b') THEN {{'type': '{kind}', 'name': '{name}'}}"
        for name, word in words
    )


def labelled(custom_ai: str = "", custom_search: str = "") -> str:
    guess = (
        "coalesce(nullif(regexp_extract(ua, '[A-Za-z][A-Za-z0-9_-]*(?:Bot|bot|Crawler|crawler|Spider|spider|Agent|agent)'), ''), "
        "nullif(regexp_extract(ua, '^[^ /;]*'), ''), 'UnknownBot')"
    )
    return rf"""
labelled AS (
  SELECT * EXCLUDE (class, ua), class.type AS type, class.name AS name, {page('url')} AS page, {key('url')} AS key FROM (
    SELECT *, CASE {custom_ai} {_rules('ai-agent', AI_AGENT_WORDS)}
      {custom_search} {_rules('search-crawler', SEARCH_CRAWLER_WORDS)}
      WHEN regexp_matches(ua, '(?i)\b(?:{GENERIC_WORDS})\b') THEN {{'type': 'unknown-bot', 'name': {guess}}}
      WHEN ua = '' OR contains(ua, 'Mozilla/') OR contains(lower(accept), 'text/html') THEN {{'type': 'browser', 'name': 'Browser'}}
      ELSE {{'type': 'unknown-bot', 'name': {guess}}} END AS class
    FROM (SELECT *, trim(user_agent) AS ua FROM requests))),
wanted AS (SELECT *, method IN ('GET', 'HEAD') AND NOT regexp_matches(page, '(?i)\.(avif|bmp|css|gif|ico|jpeg|jpg|js|json|map|mp3|mp4|pdf|png|svg|txt|webm|webp|woff2?)$') AS is_page FROM labelled)"""


def _on_requests(select: str, *views: str, more: str = "", **custom: str) -> str:
    return f"{with_views('', 'requests', *views)}, {labelled(**custom)}{more} {select}"


CHECKS["page_requests"] = _on_requests("SELECT request_id, method, url FROM wanted WHERE is_page")
CHECKS["classify_traffic"] = _on_requests("SELECT request_id, type, name FROM labelled")
CHECKS["classify_with_rules"] = _on_requests(
    "SELECT request_id, type, name FROM labelled",
    custom_ai="WHEN regexp_matches(ua, '(?i)deskagent') THEN {'type': 'ai-agent', 'name': 'DeskAgent'} "
    "WHEN contains(lower(ua), 'curl/') THEN {'type': 'ai-agent', 'name': 'Curl'}",
    custom_search="WHEN contains(lower(ua), 'my crawler') THEN {'type': 'search-crawler', 'name': 'Mine'}",
)
CHECKS["traffic_mix"] = _on_requests(
    "SELECT type, name, CAST(grouping(type, name) AS BIGINT) AS level, count(*) AS requests, count(DISTINCT key) AS pages "
    "FROM labelled GROUP BY ROLLUP (type, name)"
)


def routed(found: str, as_of: str) -> str:
    return f""",
found AS ({found}),
decided AS (
  SELECT *, CASE WHEN NOT (is_page AND type = 'ai-agent') THEN 'passthrough'
      WHEN coalesce(trim(markdown), '') <> '' AND (status = 'ready' OR (status = 'stale' AND {as_of} - generated_at <= INTERVAL 168 HOUR)) THEN 'serve_markdown'
      WHEN status IS NULL AND method = 'GET' THEN 'origin_warm' ELSE 'origin' END AS decision FROM found),
routed AS (
  SELECT request_id, method, type, name, key, decision,
    CASE WHEN decision = 'serve_markdown' THEN 'text/markdown; charset=utf-8' END AS content_type,
    CASE WHEN decision = 'serve_markdown' THEN status END AS resource_state,
    CASE WHEN decision = 'serve_markdown' THEN {page('coalesce(record_url, page)')} END AS canonical_url,
    CASE WHEN decision = 'serve_markdown' THEN length(markdown) END AS markdown_length FROM decided)"""


_LOOKUP = """SELECT w.*, r.url AS record_url, r.status, r.generated_at, r.markdown
  FROM wanted w LEFT JOIN resources r ON r.key = w.key"""
_LOOKUP_ASOF = """SELECT w.*, r.url AS record_url, r.status, r.generated_at, r.markdown
  FROM wanted w ASOF LEFT JOIN resource_history r ON r.key = w.key AND r.generated_at <= w.ts"""
CHECKS["route_requests"] = _on_requests("SELECT * FROM routed", "resources", more=routed(_LOOKUP, _AS_OF))
CHECKS["route_requests_asof"] = _on_requests(
    "SELECT * FROM routed", "resource_history", more=routed(_LOOKUP_ASOF, "ts")
)
CHECKS["serve_coverage"] = _on_requests(
    """SELECT name, count(*) AS requests, count(*) FILTER (decision = 'serve_markdown') AS served,
  count(*) FILTER (decision = 'origin') AS at_origin, count(*) FILTER (decision = 'origin_warm') AS warmed,
  count(*) FILTER (decision = 'serve_markdown') / CAST(count(*) AS DOUBLE) AS served_share
FROM routed WHERE decision <> 'passthrough' GROUP BY 1""",
    "resources",
    more=routed(_LOOKUP, _AS_OF),
)
_MISSES = """SELECT key, min(page) AS url, min(ts) AS first_requested_at, count(*) AS requests FROM wanted
  WHERE is_page AND type = 'ai-agent' AND method = 'GET' AND key NOT IN (SELECT key FROM resources) GROUP BY 1"""
CHECKS["warmup_queue"] = _on_requests(_MISSES, "resources")
CHECKS["crawl_candidates"] = _on_requests(
    f"""SELECT 'page:' || url AS key, url, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM (SELECT {page('url')} AS url, 'sitemap' AS source FROM listed UNION ALL SELECT url, 'miss' FROM ({_MISSES}))
GROUP BY 1, 2""",
    "resources",
    "sitemaps",
    more=f", {_LOCATIONS}",
)

# --- resources ------------------------------------------------------------------------------

_check(
    "servable_resources",
    f"""SELECT key, status, markdown FROM resource_history WHERE coalesce(trim(markdown), '') <> ''
  AND (status = 'ready' OR (status = 'stale' AND {_AS_OF} - generated_at <= INTERVAL 168 HOUR))""",
    "resource_history",
)
_check(
    "drop_resources",
    f"""SELECT key, status FROM resources WHERE key NOT IN (
  SELECT {key('url')} FROM pages WHERE contains(url, '.html') OR contains(url, '/es/'))""",
    "resources",
)
_check("clear_resources", "SELECT key, status FROM resources WHERE NOT starts_with(key, 'page:https:')", "resources")

# --- Markdown ---------------------------------------------------------------------------------

_NL = "chr(10)"


def replace_each(text: str, pattern: str, variable: str, result: str) -> str:
    """``text`` with every match, bound to ``variable``, replaced by ``result``."""
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({text}, '{pattern}'), "
        f"list_transform(regexp_extract_all({text}, '{pattern}'), lambda {variable}: {result})), "
        "lambda z: z[1] || coalesce(z[2], '')), '')"
    )


def trim_all(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


def inner(match: str, tag: str) -> str:
    return rf"regexp_extract({match}, '(?is)^<{tag}\b[^>]*>(.*)</{tag}>$', 1)"


def normalized(text: str) -> str:
    lines = f"list_transform(string_split({decode(strip(text))}, {_NL}), lambda line: {trim_all('line')})"
    return trim_all(rf"regexp_replace(array_to_string({lines}, {_NL}), '\n{{3,}}', {_NL} || {_NL}, 'g')")


def blocks(name: str, source: str, text: str) -> str:
    """CTEs from headings to normalized text; the last is ``name``."""
    headings = "|".join(rf"<h{n}\b[^>]*>.*?</h{n}>" for n in range(1, 7))
    heading = (
        rf"{_NL} || repeat('#', CAST(m[3] AS INTEGER)) || ' ' || "
        rf"{inline(inner('m', 'h[1-6]'))} || {_NL} || {_NL}"
    )
    item = f"{_NL} || '- ' || {inline(inner('m', 'li'))} || {_NL}"
    paragraph = f"{_NL} || {inline(inner('m', 'p'))} || {_NL} || {_NL}"
    broken = rf"regexp_replace(paragraphs, '<br\s*/?>', {_NL}, 'gi')"
    broken = rf"regexp_replace({broken}, '</(div|section|article|main|ul|ol|tr)>', {_NL}, 'gi')"
    broken = rf"regexp_replace({broken}, '<(div|section|article|main|ul|ol|tbody|thead|tr)\b[^>]*>', {_NL}, 'gi')"
    item_pattern, paragraph_pattern = r"(?is)<li\b[^>]*>.*?</li>", r"(?is)<p\b[^>]*>.*?</p>"
    return f"""
{name}_1 AS (SELECT *, {replace_each(text, '(?is)' + headings, 'm', heading)} AS headed FROM {source}),
{name}_2 AS (SELECT *, {replace_each('headed', item_pattern, 'm', item)} AS items FROM {name}_1),
{name}_3 AS (SELECT *, {replace_each('items', paragraph_pattern, 'm', paragraph)} AS paragraphs FROM {name}_2),
{name} AS (SELECT * EXCLUDE (headed, items, paragraphs), {normalized(broken)} AS rendered FROM {name}_3)"""


def _table_text(match: str) -> str:
    cells = f"list_transform(regexp_extract_all(r, '(?is)<th\\b[^>]*>.*?</th>|<td\\b[^>]*>.*?</td>'), lambda c: {inline('c')})"
    rows = (
        f"list_filter(list_transform(regexp_extract_all({match}, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1), "
        f"lambda r: {cells}), lambda r: len(r) > 0)"
    )
    width = f"list_max(list_transform({rows}, lambda r: len(r)))"
    lines = (
        f"list_transform({rows}, lambda r, i: '| ' || array_to_string(list_concat(r, "
        f"list_transform(range({width} - len(r)), lambda k: '')), ' | ') || ' |' || CASE WHEN i = 1 THEN "
        f"{_NL} || '| ' || array_to_string(list_transform(range({width}), lambda k: '---'), ' | ') || ' |' ELSE '' END)"
    )
    return (
        f"CASE WHEN len({rows}) = 0 THEN {_NL} ELSE {_NL} || array_to_string({lines}, {_NL}) || {_NL} || {_NL} END"
    )


_ANCHOR = r"(?is)<a\b[^>]*>.*?</a>"
_BARE = r"regexp_replace(regexp_replace(line, '^#+\s*', ''), '^-\s*', '')"

# Links in the data are site-relative, so the site of the canonical URL completes them.
MARKDOWN = f"""
tabled AS (
  SELECT *, regexp_extract(canonical_url, '^([a-z]+://[^/]*)', 1) AS site,
    {replace_each('content', '(?is)<table\\b[^>]*>.*?</table>', 't', _table_text('t'))} AS with_tables FROM metadata),
anchor_lists AS (SELECT page_id, site, regexp_extract_all(with_tables, '{_ANCHOR}') AS found FROM tabled),
anchors AS (
  SELECT page_id, n, regexp_extract(m, '(?is)^<a\\b([^>]*)>', 1) AS attrs, regexp_extract(m, '(?is)^<a\\b[^>]*>(.*)</a>$', 1) AS label, site
  FROM (SELECT page_id, site, unnest(found) AS m, generate_subscripts(found, 1) AS n FROM anchor_lists)),
{blocks('labels', 'anchors', 'label')},
chosen AS (
  SELECT *, {attr('attrs', 'href')} AS href, coalesce(
      list_filter(list_transform(string_split(rendered, {_NL}), lambda line: {trim_all(_BARE)}),
        lambda line: length(line) <= 80 AND regexp_matches(line, '(?i)^(Explore|Learn|Read|View|Open|Start|Try|Sign up|Get started)\\b'))[-1],
      {inline("coalesce(" + attr('attrs', 'aria-label') + ", 'Open page')")}) AS link_label FROM labels),
written AS (
  SELECT page_id, n, CASE
      WHEN NOT regexp_matches(label, '(?i)<(h[1-6]|p|div|section|article|main|ul|ol|li|table)\\b') THEN
        CASE WHEN coalesce(href, '') = '' OR {inline('label')} = '' THEN {inline('label')}
          ELSE '[' || {inline('label')} || '](' || site || {escape_path('href')} || ')' END
      ELSE {_NL} || {trim_all(f"array_to_string(list_filter(string_split(rendered, {_NL}), lambda line: {inline(_BARE)} <> link_label), {_NL})")}
        || CASE WHEN coalesce(href, '') = '' THEN '' ELSE {_NL} || {_NL} || '[' || link_label || '](' || site || {escape_path('href')} || ')' END || {_NL}
      END AS text FROM chosen),
anchored AS (
  SELECT t.*, array_to_string(list_transform(list_zip(string_split_regex(with_tables, '{_ANCHOR}'), coalesce(w.texts, [])),
    lambda z: z[1] || coalesce(z[2], '')), '') AS with_anchors
  FROM tabled t LEFT JOIN (SELECT page_id, list(text ORDER BY n) AS texts FROM written GROUP BY 1) w USING (page_id)),
{blocks('bodies', 'anchored', 'with_anchors')}"""
CHECKS["render_markdown"] = with_steps(
    "SELECT page_id, rendered AS markdown, CAST(NULL AS VARCHAR) AS error FROM bodies",
    "pages_enriched",
    METADATA,
    MARKDOWN,
)


def document(structured: str) -> str:
    line = trim_all("line")
    return f"""
described AS (
  SELECT *, CASE WHEN meta_description <> '' THEN meta_description ELSE coalesce(list_filter(
      list_transform(string_split(rendered, {_NL}), lambda line: {line}),
      lambda line: line <> '' AND NOT regexp_matches(line, '^(#|- |\\|)'))[1], '') END AS description,
    {structured} AS structured FROM bodies),
written_documents AS (
  SELECT *, regexp_replace('# ' || title || {_NL} || {_NL} || 'Canonical URL: ' || canonical_url || {_NL} ||
    'Last generated: {_GENERATED}' || {_NL} || 'Source: public HTML' || {_NL} || {_NL} || '## Description' || {_NL} ||
    CASE WHEN description <> '' THEN description ELSE 'No description found.' END || {_NL} ||
    CASE WHEN structured <> '' THEN {_NL} || '## Structured Data' || {_NL} || structured || {_NL} ELSE '' END || {_NL} ||
    '## Content' || {_NL} || CASE WHEN rendered <> '' THEN rendered ELSE 'No extractable content found.' END, '{_SPACES}+$', '') || {_NL} AS document
  FROM described)"""


CHECKS["build_documents"] = with_steps(
    """SELECT page_id, canonical_url, title, description, document AS markdown, CAST(NULL AS VARCHAR) AS error
FROM written_documents""",
    "pages_enriched",
    METADATA,
    ENTITIES,
    SECTIONS,
    MARKDOWN,
    document("coalesce((SELECT structured FROM sections s WHERE s.page_id = bodies.page_id), '')"),
)

# The records of the responses: documents of the pages, which have no structured data.
RECORDS = f"""
records AS (
  SELECT r.seq, {key('r.url')} AS key, {page('r.url')} AS url, coalesce(r.fetch_error,
      CASE WHEN r.http_status NOT BETWEEN 200 AND 299 THEN 'http-' || r.http_status
        WHEN NOT contains(lower(r.content_type), 'text/html') THEN 'unsupported-content-type'
        WHEN r.html = '' THEN 'empty-html' END) AS reason, d.document
  FROM responses r JOIN written_documents d ON d.page_id = r.seq),
crawled AS (
  SELECT seq, key, url, CASE WHEN reason IS NULL THEN 'ready' ELSE 'failed' END AS status,
    '{_GENERATED}' AS generated_at, CASE WHEN reason IS NULL THEN document END AS markdown, reason FROM records)"""


def _crawled(select: str) -> str:
    steps = ", ".join((contents("pages"), METADATA, MARKDOWN, document("''"), RECORDS))
    return f"{with_views('', 'responses')}, {steps} {select}"


CHECKS["crawl_pages"] = _crawled("SELECT * FROM crawled")
CHECKS["crawl_status_report"] = _crawled(
    "SELECT regexp_extract(url, '://([^/]*)', 1) AS host, status, reason, count(*) AS records FROM crawled GROUP BY ALL"
)
_STORED = """SELECT key, url, status, generated_at, markdown, reason
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM crawled) WHERE n = 1"""
CHECKS["stream_crawl"] = _crawled(_STORED)
CHECKS["stream_crawl_queue"] = _crawled(_STORED)
CHECKS["scheduled_crawl"] = _crawled(
    f"""{_STORED} UNION ALL
SELECT 'page:' || url, url, 'failed', '{_GENERATED}', NULL, 'not-landed'
FROM (SELECT DISTINCT 'https://example.com/p' || CAST(page_id % 7 AS VARCHAR) AS url FROM pages)"""
)

# --- streams: the result of the batch operator ---------------------------------------------------

CHECKS["stream_route"] = CHECKS["route_requests"]
CHECKS["stream_warmup_queue"] = _on_requests(f"SELECT key, substr(key, 6) AS url FROM ({_MISSES})", "resources")
CHECKS["stream_traffic_mix"] = _on_requests(
    f"""SELECT strftime(date_trunc('hour', ts), '{_ISO}') AS hour, type, count(*) AS requests
FROM labelled GROUP BY 1, 2"""
)
