"""Default traffic rules as data."""

from __future__ import annotations

from dataclasses import dataclass

AI_AGENT = "ai-agent"
SEARCH_CRAWLER = "search-crawler"
BROWSER = "browser"
UNKNOWN_BOT = "unknown-bot"


@dataclass(frozen=True)
class BotRule:
    """One rule; ``kind`` is ``regex`` (Java syntax) or ``substring`` (any case)."""

    traffic: str
    name: str
    kind: str
    pattern: str
    priority: int = 0


# Known agents in match order, as (name, words).  Words match whole
# and in any case.
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
GENERIC_WORDS = r"bot|crawler|spider|scraper|agent"
BOT_TOKEN_ENDINGS = "Bot|bot|Crawler|crawler|Spider|spider|Agent|agent"


def _whole_word(words: str) -> str:
    return rf"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


def _rules(traffic: str, words: tuple[tuple[str, str], ...]) -> list[BotRule]:
    return [
        BotRule(traffic, name, "regex", _whole_word(word), priority)
        for priority, (name, word) in enumerate(words)
    ]


DEFAULT_AI_RULES = _rules(AI_AGENT, AI_AGENT_WORDS)
DEFAULT_SEARCH_RULES = _rules(SEARCH_CRAWLER, SEARCH_CRAWLER_WORDS)
GENERIC_PATTERN = _whole_word(GENERIC_WORDS)
# One pattern for all default rules: most traffic matches none of them.
ANY_KNOWN_PATTERN = _whole_word("|".join(word for _, word in AI_AGENT_WORDS + SEARCH_CRAWLER_WORDS))
