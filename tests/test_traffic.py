"""Classification and request rows."""

from pagetables import rules
from pagetables.operators.traffic import classify_traffic, classify_with_rules, normalize_requests, page_requests
from pagetables.schemas import BOT_RULES, HTTP_LOG

# Known agents in match order, each with words that lead to it.
AI_AGENT_WORDS = {
    "Applebot": ["Applebot/0.1", "Applebot-Extended/0.1"],
    "GPTBot": ["GPTBot/1.3"],
    "ChatGPT-User": ["ChatGPT-User/2.0"],
    "OAI-SearchBot": ["OAI-SearchBot/1.3"],
    "Google-CloudVertexBot": ["Google-CloudVertexBot"],
    "Claude": ["Claude/3.1"],
    "ClaudeBot": ["ClaudeBot/1.2"],
    "Claude-User": ["Claude-User/1.2"],
    "Claude-SearchBot": ["Claude-SearchBot/1.2"],
    "Anthropic-AI": ["anthropic-ai"],
    "PerplexityBot": ["PerplexityBot/1.1"],
    "Perplexity-User": ["Perplexity-User/1.1"],
    "YouBot": ["YouBot"],
    "Cohere-AI": ["cohere-ai"],
    "Amazonbot": ["Amazonbot/0.7"],
    "Anchor Browser": ["Anchor Browser/2.3", "AnchorBrowser"],
    "Bytespider": ["Bytespider"],
    "Cloudflare Crawler": ["Cloudflare-Crawler/4"],
    "CCBot": ["CCBot/2.0"],
    "DuckAssistBot": ["DuckAssistBot/1.2"],
    "FacebookBot": ["FacebookBot/1.4"],
    "Manus Bot": ["Manus Bot/1.8"],
    "Meta-ExternalAgent": ["Meta-ExternalAgent/1.1"],
    "Meta-ExternalFetcher": ["Meta-ExternalFetcher/1.1"],
    "MistralAI-User": ["MistralAI-User/1.1"],
    "Novellum AI Crawl": ["Novellum AI Crawl/5"],
    "PetalBot": ["PetalBot"],
    "ProRataInc": ["ProRataInc/0.3"],
    "TikTok Spider": ["TikTok Spider"],
    "Timpibot": ["Timpibot/0.9"],
}
SEARCH_WORDS = {
    "Googlebot": ["Googlebot/2.1"],
    "Bingbot": ["bingbot/2.0"],
    "DuckDuckBot": ["DuckDuckBot/1.1"],
    "YandexBot": ["YandexBot/3.0"],
    "Baiduspider": ["Baiduspider/2.0"],
    "archive.org_bot": ["archive.org_bot"],
    "Arquivo Web Crawler": ["Arquivo Web Crawler/6.2"],
    "Terracotta Bot": ["Terracotta Bot/0.2"],
    "Slurp": ["Yahoo! Slurp"],
}


def _agents(words):
    """Full user agents: as a comment of a browser's, with an address, and in front."""
    for name, tokens in words.items():
        for token in tokens:
            yield f"Mozilla/5.0 (compatible; {token}; +https://robots.example/about)", name
            yield f"Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko; {token}) Safari/537.36", name
            yield f"{token} (+mailto:robots@fetch.example)", name


AI_AGENTS = list(_agents(AI_AGENT_WORDS)) + [("PerplexityBot/1.1 like Googlebot/2.1", "PerplexityBot")]
SEARCH_CRAWLERS = list(_agents(SEARCH_WORDS))
OTHERS = [
    ("Mozilla/5.0 AppleWebKit/537.36 Chrome/125.0 Safari/537.36", None, "browser", "Browser"),
    ("", None, "browser", "Browser"),
    ("   ", None, "browser", "Browser"),
    (None, None, "browser", "Browser"),
    ("curl/8.0", "Text/HTML,*/*", "browser", "Browser"),
    ("mozilla/5.0", "*/*", "unknown-bot", "mozilla"),
    ("curl/8.0", "*/*", "unknown-bot", "curl"),
    # No word boundary inside a name, so the bot word does not count.
    ("PriceWatchBot/3.4", "*/*", "unknown-bot", "PriceWatchBot"),
    ("Mozilla/5.0 (compatible; SomeBot/1.0)", "*/*", "browser", "Browser"),
    ("Mozilla/5.0 (my bot)", "text/html", "unknown-bot", "Mozilla"),
    ("my crawler 2", "text/html", "unknown-bot", "my"),
    ("ébot x-crawler", None, "unknown-bot", "x-crawler"),
    ("/; agent", None, "unknown-bot", "UnknownBot"),
    ("claude/ 1", "*/*", "unknown-bot", "claude"),
]


def test_default_rules(spark):
    cases = (
        [(agent, None, "ai-agent", name) for agent, name in AI_AGENTS]
        + [(agent, None, "search-crawler", name) for agent, name in SEARCH_CRAWLERS]
        + OTHERS
    )
    requests = spark.createDataFrame(cases, "user_agent string, accept string, want_type string, want_name string")
    rows = classify_traffic(requests).collect()
    assert [(r.user_agent, r.type, r.name) for r in rows] == [(r.user_agent, r.want_type, r.want_name) for r in rows]


def test_user_rules_come_first_by_priority(spark):
    table = spark.createDataFrame(
        [
            (2, rules.AI_AGENT, "Second", "substring", "internal"),
            (1, rules.AI_AGENT, "DeskAgent", "regex", "(?i)deskagent"),
            (3, rules.SEARCH_CRAWLER, "Own", "substring", "GPTBOT-search"),
        ],
        BOT_RULES,
    )
    agents = ["DeskAgent/7.1", "INTERNAL tool", "gptbot-search", "own gptbot-searcher", "GPTBot/1.0"]
    requests = spark.createDataFrame([(agent, None) for agent in agents], "user_agent string, accept string")
    got = [(row.type, row.name) for row in classify_with_rules(requests, table).collect()]
    assert got == [
        ("ai-agent", "DeskAgent"),
        ("ai-agent", "Second"),
        ("ai-agent", "GPTBot"),
        ("ai-agent", "GPTBot"),
        ("ai-agent", "GPTBot"),
    ]


def test_page_requests(spark):
    cases = [
        ("GET", "https://example.com/a", True),
        ("HEAD", "https://example.com/a.html", True),
        ("get", "https://example.com/a", False),
        ("POST", "https://example.com/a", False),
        ("GET", "https://example.com/Logo.PNG?v=1", False),
        ("GET", "https://example.com/a?f=logo.png", True),
        ("GET", "https://example.com/robots.txt", False),
        ("GET", "https://example.com/sitemap.xml", True),
        ("GET", "https://example.com/font.woff2", False),
    ]
    requests = spark.createDataFrame(cases, "method string, url string, keep boolean")
    kept = page_requests(requests).collect()
    assert [row.url for row in kept] == [url for _, url, keep in cases if keep]


def test_request_rows_from_server_logs(spark):
    log = spark.createDataFrame(
        [
            (1, None, None, "/pricing", None, {"User-Agent": ["GPTBot/1.0"], "Accept": ["a", "b"]}),
            (2, None, "HEAD", "/inner", "/outer/../x?q#f", {"USER-AGENT": ["x", "y"]}),
            (3, None, "GET", None, None, {}),
            (4, None, "GET", None, None, None),
        ],
        HTTP_LOG,
    )
    rows = [tuple(row)[2:] for row in normalize_requests(log, "https://Example.com").orderBy("request_id").collect()]
    assert rows == [
        ("GET", "https://example.com/pricing", "GPTBot/1.0", "a, b"),
        ("HEAD", "https://example.com/x?q", "x, y", None),
        ("GET", "https://example.com/", None, None),
        ("GET", "https://example.com/", None, None),
    ]
