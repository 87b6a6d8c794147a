"""Input views derived from the given tables.

The SQL of a view runs unchanged in Spark and DuckDB; ``$name`` stands for a table or
another view.
"""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame, SparkSession

TABLES = ("pages", "events")

VIEWS = {
    "requests": """
SELECT e.event_id AS request_id, e.ts AS ts, e.user_id AS user_id,
  CASE e.event_id % 20 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'POST' ELSE 'GET' END AS method,
  CASE
    WHEN e.event_id % 17 = 0 THEN 'https://static.example.com/Logo.PNG?v=1'
    WHEN e.event_id % 11 = 3 THEN split_part(p.url, '/', 1) || '//' || split_part(p.url, '/', 3) || '/new/' || CAST(e.event_id % 40 AS STRING) || '?n=1'
    WHEN e.event_id % 19 = 7 THEN replace(p.url, '.example.', '.EXAMPLE.')
    ELSE p.url END AS url,
  CASE e.user_id % 16
    WHEN 0 THEN 'Mozilla/5.0 (compatible; GPTBot/1.3; +https://robots.example/gpt)'
    WHEN 1 THEN 'ClaudeBot/2.4 (+mailto:robots@fetch.example)'
    WHEN 2 THEN 'Mozilla/5.0 (X11; Linux x86_64; Claude/3.1) like Gecko'
    WHEN 3 THEN 'Anchor-Browser/4.2 (beta)'
    WHEN 4 THEN 'Applebot-Extended/0.1'
    WHEN 5 THEN 'Mozilla/5.0 (compatible; Googlebot/2.7; rendering)'
    WHEN 6 THEN 'bingBOT/3.6 (+https://robots.example/b)'
    WHEN 7 THEN 'Mozilla/5.0 (compatible; archive.org_bot; snapshots)'
    WHEN 8 THEN 'PriceWatchBot/3.4 (+https://watch.example)'
    WHEN 9 THEN 'Mozilla/5.0 (compatible; SomeBot/1.0)'
    WHEN 10 THEN 'my crawler 2'
    WHEN 11 THEN 'curl/8.0'
    WHEN 12 THEN ''
    WHEN 13 THEN 'DeskAgent/7.1 intranet'
    WHEN 14 THEN 'PerplexityBot/5.1 like Googlebot/2.7'
    ELSE 'Mozilla/5.0 AppleWebKit/537.36 Chrome/125.0 Safari/537.36' END AS user_agent,
  CASE WHEN e.event_id % 3 = 0 THEN 'Text/HTML,*/*' ELSE '*/*' END AS accept
FROM (SELECT event_id, ts, user_id, event_id % (SELECT count(*) FROM $pages) AS page_no FROM $events) e
JOIN $pages p ON p.page_id = e.page_no
""",
    "responses": """
SELECT page_id AS seq, url,
  CASE page_id % 10 WHEN 3 THEN 404 WHEN 7 THEN 500 ELSE 200 END AS http_status,
  CASE page_id % 8 WHEN 5 THEN 'application/pdf' WHEN 6 THEN 'Text/HTML; charset=utf-8' ELSE 'text/html' END AS content_type,
  CASE WHEN page_id % 25 = 12 THEN '' ELSE html END AS html,
  CAST(CASE WHEN page_id % 40 = 9 THEN 'fetch failed' ELSE NULL END AS STRING) AS fetch_error
FROM $pages
""",
    "resources": """
SELECT 'page:' || split_part(split_part(url, '#', 1), '?', 1) AS key,
  min(url) AS url,
  CASE min(page_id) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'stale' WHEN 2 THEN 'pending' ELSE 'ready' END AS status,
  CASE WHEN min(page_id) % 2 = 0 THEN TIMESTAMP '2023-12-20 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS generated_at,
  CASE min(page_id) % 5 WHEN 0 THEN NULL WHEN 2 THEN '   ' ELSE '# Page' END AS markdown,
  CASE min(page_id) % 5 WHEN 0 THEN 'http-404' END AS reason
FROM $pages GROUP BY 1
""",
    "resource_history": """
SELECT key, url, status, generated_at, markdown, reason FROM $resources
UNION ALL
SELECT key, url, CASE status WHEN 'ready' THEN 'failed' ELSE 'ready' END AS status,
  TIMESTAMP '2024-01-10 00:00:00' AS generated_at, '# Page v2' AS markdown, reason FROM $resources
""",
    "sitemaps": """
SELECT page_id AS sitemap_id,
  '<?xml version="1.0"?><urlset><url><loc> ' || replace(url, '&', '&amp;') || ' </loc></url><url><LOC>https://example.com/p' || CAST(page_id % 7 AS STRING) || '</LOC></url><url><loc></loc></url><url><loc>https://example.com/p' || CAST(page_id % 7 AS STRING) || '</loc></url></urlset>' AS xml
FROM $pages
""",
    "pages_enriched": """
SELECT page_id, url,
  replace(replace(html, '</head>',
    CASE page_id % 4
      WHEN 0 THEN '<link href="https://canon.example.com/p' || CAST(page_id AS STRING) || '?x=1#t" rel="alternate canonical"><meta name="description" content="About &amp; more">'
      WHEN 1 THEN '<meta content="Second form" name="Description">'
      WHEN 2 THEN '<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"Org ' || CAST(page_id AS STRING) || '","url":"/org","sameAs":["https://s.example.com/a"]},{"@type":["Thing","SoftwareApplication"],"name":"App","applicationCategory":0.12345678901234568,"operatingSystem":"Web","featureList":["f1","f2"],"offers":{"url":"/buy"}}]}</script>'
      ELSE '<script type="application/ld+json">{bad json</script><script type="application/ld+json">[{"@type":"BreadcrumbList","itemListElement":[{"name":"Home","item":"/"},{"name":"Here"}]},{"@type":"WebPage","name":"W"}]</script>' END || '</head>'),
    '</article>',
    '<table><tr><th>Ward</th><th>Beds</th><th>Floor</th></tr><tr></tr><tr><td>North</td><td>' || CAST(page_id AS STRING) || '</td></tr></table><a href="/rota"><section><h4>Night rota</h4></section><em>View the rota</em></a></article>') AS html
FROM $pages
""",
}


def _reads(name: str) -> list[str]:
    """Tables and views that the view ``name`` reads."""
    return [read for read in dict.fromkeys(Template(VIEWS[name]).get_identifiers())]


def needed_views(*names: str) -> list[str]:
    """``names`` and the views they read, each after what it reads."""
    ordered: list[str] = []
    for name in names:
        for view_name in needed_views(*[read for read in _reads(name) if read in VIEWS]) + [name]:
            if view_name not in ordered:
                ordered.append(view_name)
    return ordered


def with_views(select: str, *names: str) -> str:
    """DuckDB text of ``select`` with the views it needs in front."""
    plain = {name: name for name in (*TABLES, *VIEWS)}
    parts = [f"{name} AS ({Template(VIEWS[name]).substitute(plain)})" for name in needed_views(*names)]
    return f"WITH {', '.join(parts)} {select}" if parts else select


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **tables: DataFrame) -> DataFrame:
    """A view over ``sf_dir``; ``tables`` replaces given tables, for streams."""
    if name in TABLES:
        return tables[name] if name in tables else table(spark, sf_dir, name)
    frames = {read: view(spark, sf_dir, read, **tables) for read in _reads(name)}
    braced = VIEWS[name].replace("{", "{{").replace("}", "}}")
    text = Template(braced).substitute({read: f"{{{read}}}" for read in frames})
    return spark.sql(text, **frames)
